"""Choice statistics of saturated models: cell means, equally weighted margins, clustered errors."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .ranks import beside, least_of_later, stored


def cell_means(long: DataFrame, cells: list[str]) -> DataFrame:
    return long.groupBy(*cells).agg(F.avg("chosen").alias("cell_mean"), F.count("chosen").alias("cell_n"))


def marginal_means(means: DataFrame, margin: list[str], grid: int | None = None) -> DataFrame:
    """The equally weighted mean of the cell means of a margin; null where cells of the grid are missing."""
    value = F.avg("cell_mean")
    if grid is not None:
        value = F.when(F.count(F.lit(1)) == grid, value)
    return means.groupBy(*margin).agg(value.alias("emm"), F.count(F.lit(1)).alias("cells"))


def _equals(columns: list[str], values: Row) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(c).eqNullSafe(F.lit(values[c]))
    return out


def _fit(long: DataFrame, cells: list[str], margin: list[str], cluster: str, levels: list[Row], forms: list[tuple[dict[str, Any], Callable[[list[Column]], Column]]], table: DataFrame) -> DataFrame:
    """A row a form: its literals and ``s``, the variance of the form of the levels' margins. Each cluster's score
    of a level is the sum of weight * residual / cell size: a column a level, so that one pass over the rows
    and one shuffle by cluster give all of them and the number of clusters."""
    sizes = table.groupBy(*margin).agg(F.count(F.lit(1)).alias("_cells"))
    weights = beside(table.select(*cells, "cell_mean", "cell_n"), sizes, margin).withColumnsRenamed({c: f"_c_{c}" for c in cells})
    same = F.lit(True)
    for c in cells:
        same &= F.col(c) == F.col(f"_c_{c}")
    u = (F.col("chosen") - F.col("cell_mean")) / F.col("cell_n") / F.col("_cells")
    each = long.select(cluster, *[c for c in cells if c != cluster], "chosen").join(weights, same, "left").groupBy(cluster)
    scores = each.agg(*[F.sum(F.when(_equals(margin, x), u)).alias(f"_u{i}") for i, x in enumerate(levels)])
    at = [F.coalesce(F.col(f"_u{i}"), F.lit(0.0)) for i in range(len(levels))]
    sums = scores.agg(F.count(cluster).alias("G"), *[F.sum(make(at) * make(at)).alias(f"_s{i}") for i, (_, make) in enumerate(forms)])
    whole = table.agg(F.sum("rows").alias("N"), F.count(F.lit(1)).alias("K"))
    factor = (F.col("N") - 1) / (F.col("N") - F.col("K")) * F.col("G") / (F.col("G") - 1)
    kinds = {f.name: f.dataType for f in table.schema}
    lits = lambda row: [F.lit(v).cast(kinds[c]).alias(c) if c in kinds else F.lit(v).alias(c) for c, v in row.items()]
    rows = [F.struct(*lits(row), (F.col(f"_s{i}") * factor).alias("s")) for i, (row, _) in enumerate(forms)]
    return sums.crossJoin(whole).select(F.inline(F.array(*rows)))


def _cell_table(long: DataFrame, cells: list[str]) -> DataFrame:
    """Means and counts of the cells: few (the product of the factors' levels), made once and stored."""
    return stored(long.groupBy(*cells).agg(F.avg("chosen").alias("cell_mean"), F.count("chosen").alias("cell_n"), F.count(F.lit(1)).alias("rows")), "cells")


def clustered_se(long: DataFrame, cells: list[str], margin: list[str], cluster: str = "pair_id") -> DataFrame:
    """``margin, emm, se``: cluster-robust errors of the marginal means, from two passes over the rows."""
    table = _cell_table(long, cells)
    emm = marginal_means(table, margin)
    levels = table.select(*margin).distinct().collect()
    if not levels:
        return emm.select(*margin, "emm", F.lit(None).cast("double").alias("se"))
    forms = [({c: x[c] for c in margin}, lambda u, i=i: u[i]) for i, x in enumerate(levels)]
    return beside(emm, _fit(long, cells, margin, cluster, levels, forms, table), margin).select(*margin, "emm", F.sqrt("s").alias("se"))


def contrasts(long: DataFrame, cells: list[str], focal: str, by: list[str], levels: list[str], cluster: str = "pair_id", pairwise: bool = False) -> DataFrame:
    """All differences of the focal levels within ``by``, later minus earlier or, ``pairwise``, earlier minus
    later: estimate and clustered SE. A cluster's scores are one row, a column a level, so no self-join."""
    table = _cell_table(long, cells)
    means = marginal_means(table, [focal, *by]).groupBy(*by).pivot(focal, levels).agg(F.first("emm"))
    pairs = [(b, a) if pairwise else (a, b) for i, a in enumerate(levels) for b in levels[i + 1 :]]
    groups = table.select(*by).distinct().collect()
    if not groups:
        return means.select(*by, F.lit(None).cast("string").alias("contrast"), F.lit(None).cast("double").alias("estimate"), F.lit(None).cast("double").alias("se"))
    margin = [focal, *by]
    every = [Row(**{focal: x}, **{c: g[c] for c in by}) for g in groups for x in levels]
    forms = []
    for k, g in enumerate(groups):
        for a, b in pairs:
            i, j = k * len(levels) + levels.index(a), k * len(levels) + levels.index(b)
            forms.append(({**{c: g[c] for c in by}, "contrast": f"{b} - {a}"}, lambda u, i=i, j=j: u[j] - u[i]))
    tested = beside(_fit(long, cells, margin, cluster, every, forms, table), means, by)
    value = F.lit(None).cast("double")
    for a, b in pairs:
        value = F.when(F.col("contrast") == f"{b} - {a}", F.col(f"`{b}`") - F.col(f"`{a}`")).otherwise(value)
    return tested.select(*by, "contrast", value.alias("estimate"), F.sqrt("s").alias("se"))


def bh_adjust(tests: DataFrame, by: list[str], p: str = "p", *keys: str, parts: int | None = None) -> DataFrame:
    """``tests`` with ``p_adjusted`` (Benjamini-Hochberg): the least p * n / rank over larger ranks of the
    family, at most 1; null p stay out of n, null families are one. Equal p get one value, whatever the
    order that ``keys`` give them.

    A family may be all rows: equal p are one row with their count, which holds the rank of the last of
    them; a scan over stretches of the order then finds the minima, so no task holds a family.
    """
    alike = tests.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"))
    value = F.col(p) * F.col("_all") / F.col("_through")
    least = least_of_later(alike, by, [p], "_n", value, parts).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(p).alias("_p"), "least")
    same = F.col(p) == F.col("_p")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = tests.join(least, same, "left")
    return joined.select(*tests.columns, F.when(F.col(p).isNotNull(), F.least("least", F.lit(1.0))).alias("p_adjusted"))


def head2head_long(results: DataFrame) -> DataFrame:
    rows = results.where("choice in ('first', 'second')")
    side = lambda n, c: F.struct(F.col(f"strategy{n}").alias("strategy"), (F.col("choice") == c).cast("int").alias("chosen"))
    return rows.select("pair_id", "model", "task", F.inline(F.array(side(1, "first"), side(2, "second"))))


def mitigation_outcomes(long: DataFrame, keys: list[str]) -> DataFrame:
    """Three outcomes a pair: both sides (0 where inconsistent) and ``inconsistent`` (1 or 0)."""
    sides = long.select(*keys, "type", F.coalesce("chosen", F.lit(0)).alias("chosen"))
    third = long.groupBy(*keys).agg(F.max(F.col("chosen").isNull().cast("int")).alias("chosen")).select(*keys, F.lit("inconsistent").alias("type"), "chosen")
    return sides.unionByName(third)


def human_choices_long(responses: DataFrame, by: str = "status", levels: list[str] | None = None) -> DataFrame:
    """Two rows a response, one an image: its status (``type``) or strategy, and whether it is the chosen
    one's. A level that isn't among ``levels`` is null, and so is what depends on it."""
    known = lambda c: c if levels is None else F.when(c.isin(levels), c)
    at = {n: known(F.col(f"image{n}_{by}")) for n in (1, 2)}
    chosen = F.when(F.col("choice") == 1, at[1]).when(F.col("choice").isNotNull(), at[2])
    name = "type" if by == "status" else by
    side = lambda n: F.struct(at[n].alias(name), (at[n] == chosen).cast("int").alias("chosen"))
    kept = ["participant_id", *(["strategy"] if by == "status" else []), "task"]
    return responses.select(*kept, F.inline(F.array(side(1), side(2))))
