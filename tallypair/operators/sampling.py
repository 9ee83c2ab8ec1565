"""Balanced and seeded samples: the draw is the order of a hash, so it is the same on every run."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallypair.functions.parse import seeded
from tallypair.operators.ranks import beside, stored


def seeded_rank(rows: DataFrame, by: list[str], seed: int, *keys: str) -> DataFrame:
    """``rows`` with ``rank`` (from 1) in the seeded order of their group (nulls a group of their own).

    A group may hold most rows, so no window takes one whole: rows are ranked within a slot of the hash,
    to which the group's earlier slots, counted before, are added.
    """
    hashed = rows.withColumn("_at", seeded(seed, *keys)).withColumn("_slot", F.substring("_at", 1, 3))
    counts = hashed.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_slot").alias("_own")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*[f"_by{i}" for i in range(len(by))]).orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    same = F.col("_slot") == F.col("_own")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    order = Window.partitionBy(*by, "_slot").orderBy("_at", *keys)
    ranked = hashed.join(before, same).withColumn("rank", F.col("_before") + F.row_number().over(order))
    return ranked.select(*rows.columns, "rank")


def _cut(pool: DataFrame, slots: DataFrame, sizes: DataFrame, by: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Of each group of a pool with ``_at`` and ``_slot`` the first ``quota`` rows. From the slots' counts it is known
    which slots are taken whole and which is cut: only rows of that one are ranked."""
    through = F.sum("_n").over(Window.partitionBy(*by).orderBy("_slot"))
    cut = beside(slots, sizes, by).withColumn("_over", through - F.coalesce("quota", through))
    kept = cut.where("_over < _n").select(*by, "_slot", F.when(F.col("_over") > 0, F.col("_n") - F.col("_over")).alias("_take"))
    taken = beside(pool, kept, [*by, "_slot"])
    whole, border = taken.where("_take is null"), taken.where("_take is not null")
    first = F.row_number().over(Window.partitionBy(*by, "_slot").orderBy("_at", *keys))
    return whole.unionByName(border.withColumn("_first", first).where("_first <= _take").drop("_first"))


def first_in_groups(rows: DataFrame, by: list[str], seed: int, keys: tuple[str, ...], quota: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of each group the first rows in seeded order, as many as ``quota`` adds as ``quota`` to the groups' sizes
    (``by, there``; null: all). The rows are computed once and stored with their slot of the hash."""
    at = seeded(seed, *keys)
    pool = stored(rows.withColumns({"_at": at, "_slot": F.substring(at, 1, 4)}), "pool")
    slots = pool.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    sizes = quota(slots.groupBy(*by).agg(F.sum("_n").alias("there"))).select(*by, "quota")
    return _cut(pool, slots, sizes, by, keys).select(*rows.columns)


#: Digits of the hash that a bound has, and slots under a bound.
DIGITS, SLOTS = 12, 4096


def first_of_known_groups(rows: DataFrame, by: list[str], seed: int, keys: tuple[str, ...], sizes: DataFrame) -> DataFrame:
    """``first_in_groups`` where the groups' sizes are known without the rows (``by, there, quota``; few groups): only rows
    under a bound of the hash are stored, under which a group has its quota and some more.

    Hashes are even, so too few are under a bound only by rare chance or if keys repeat; such a group is drawn again
    under a bound sixteen times as high, at last under none, so the result is exact.
    """
    every = F.lit(16**DIGITS)
    wanted = F.least(F.coalesce("quota", "there"), "there")
    sizes = sizes.select(*by, "quota", "there", wanted.alias("_wanted"), (wanted + 10 * F.sqrt(wanted) + 20).alias("_room"))
    left = sizes = stored(sizes.where("_wanted > 0").coalesce(1), "sizes")
    hashed, pools = rows.withColumn("_at", seeded(seed, *keys)), []
    while not left.isEmpty():
        limit = F.when(F.col("_room") < F.col("there"), F.ceil(F.col("_room") / F.col("there") * every)).otherwise(every)
        bounds = left.select(*by, limit.alias("_limit"), F.when(limit < every, F.lower(F.lpad(F.hex(limit), DIGITS, "0"))).alias("_bound"))
        near = beside(hashed, F.broadcast(bounds), by).where("_bound is null or _at < _bound")
        slot = F.floor(F.conv(F.substring("_at", 1, DIGITS), 16, 10).cast("long") / F.col("_limit") * SLOTS)
        pool = stored(near.withColumn("_slot", slot).drop("_limit", "_bound"), "pool")
        one = pool.select(*by, F.lit(1).alias("_found")).unionByName(left.select(*by, F.lit(0).alias("_found")))
        found = stored(beside(left, one.groupBy(*by).agg(F.sum("_found").alias("_found")), by).coalesce(1), "sizes")
        done = F.expr("_found >= _wanted or _room >= there")
        pools.append(beside(pool, found.where(done).select(*by), by))
        left = found.where(~done).drop("_found").withColumn("_room", F.col("_room") * 16)
    if not pools:
        return rows.limit(0)
    pool = reduce(DataFrame.unionByName, pools)
    slots = pool.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    return _cut(pool, slots, sizes.select(*by, "quota"), by, keys).select(*rows.columns)


def balanced_sample(pairs: DataFrame, most: int, seed: int = 42, by: str = "status", keys: tuple[str, ...] = ("base1", "base2"), counts: DataFrame | None = None) -> DataFrame:
    """If there are more than ``most`` pairs (and it is positive): of each pair of statuses (or
    strategies) the first ``most // groups`` in seeded order; no redistribution, and maybe none.

    ``counts``: how many pairs there are (``type1, type2, n``), where that is known without making them. Then pairs
    far from the sample are dropped as they are made, else all are stored.
    """
    if most <= 0:
        return pairs

    def quota(groups: DataFrame) -> DataFrame:
        whole = groups.agg(F.sum("there").alias("total"), F.count(F.lit(1)).alias("groups"))
        return groups.crossJoin(F.broadcast(whole)).withColumn("quota", F.when(F.col("total") > most, F.floor(F.lit(most) / F.col("groups"))))

    typed = pairs.withColumns({"type1": F.least(f"{by}1", f"{by}2"), "type2": F.greatest(f"{by}1", f"{by}2")})
    if counts is not None:
        known = quota(counts.withColumnRenamed("n", "there"))
        return first_of_known_groups(typed, ["type1", "type2"], seed, keys, known).select(*pairs.columns)
    return first_in_groups(typed, ["type1", "type2"], seed, keys, quota).select(*pairs.columns)


def sample_n_per_group(rows: DataFrame, n: int, by: list[str], key: str, seed: int = 42, total: bool = False, strict: bool = False) -> DataFrame:
    """The first ``n`` rows of each group in seeded order; ``total``: ``n`` is shared out evenly, rounded
    down. ``strict``: a group that has fewer fails the job, as a draw of a fixed size does."""

    def quota(groups: DataFrame) -> DataFrame:
        if not total:
            out = groups.withColumn("quota", F.lit(n).cast("long"))
        else:
            share = groups.agg(F.floor(F.lit(n) / F.count(F.lit(1))).cast("long").alias("quota"))
            out = groups.crossJoin(F.broadcast(share))
        if strict:
            out = out.withColumn("quota", F.when(F.col("there") >= F.col("quota"), F.col("quota")).otherwise(F.raise_error(F.lit("a group has too few rows")).cast("long")))
        return out

    return first_in_groups(rows, by, seed, (key,), quota)


def band_filter(rows: DataFrame, columns: tuple[str, ...], width: float = 0.5, most: int | None = None, key: str | None = None, seed: int = 42) -> DataFrame:
    """Rows within ``width`` sample deviations of the mean of every column, statistics over all rows; of
    more than ``most``, the first in the seeded order of ``key``."""
    stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    inside: Column = F.lit(True)
    for c in columns:
        inside &= F.abs(F.col(c) - F.col(f"mean_{c}")) <= F.col(f"sd_{c}") * F.lit(width)
    kept = rows.crossJoin(F.broadcast(stats)).where(inside).select(*rows.columns)
    return kept if most is None else kept.orderBy(seeded(seed, key), key).limit(most)


def partition_into_sets(rows: DataFrame, size: int, by: list[str], key: str, seed: int = 42) -> DataFrame:
    """Shuffle each task's rows and cut them into sets of ``size``."""
    return seeded_rank(rows, by, seed, key).withColumn("set_number", F.floor((F.col("rank") - 1) / size).cast("long")).drop("rank")


def repeat_tasks(rows: DataFrame, times: int) -> DataFrame:
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(times))))


def best_level(means: DataFrame, by: list[str], level: str, value: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(value), level)
    return means.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
