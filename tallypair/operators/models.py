"""Two-way clustered errors, t statistics, tables of differences and other shapes of the results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .stats import cell_means, marginal_means


def twoway_clustered_se(long: DataFrame, cells: list[str], margin: list[str], one: str, two: str) -> DataFrame:
    """``margin, emm, se, clipped`` with clusters ``one`` and ``two``: V(one) + V(two) - V(both), the factor
    of the smaller number of clusters; a negative variance is set to 0 and marked."""
    means = cell_means(long, cells)
    sizes = means.groupBy(*margin).agg(F.count(F.lit(1)).alias("cells"))
    u = (F.col("chosen") - F.col("cell_mean")) / F.col("cell_n") / F.col("cells")
    both = long.join(means.join(sizes, margin), cells).groupBy(one, two, *margin).agg(F.sum(u).alias("u"))
    square = lambda df, name: df.groupBy(*margin).agg(F.sum(F.col("u") * F.col("u")).alias(name))
    by = lambda c: both.groupBy(c, *margin).agg(F.sum("u").alias("u"))
    v = square(by(one), "v1").join(square(by(two), "v2"), margin).join(square(both, "v12"), margin)
    n = long.agg(F.count(F.lit(1)).alias("N"), F.countDistinct(one).alias("g1"), F.countDistinct(two).alias("g2")).crossJoin(means.agg(F.count(F.lit(1)).alias("K")))
    g = F.least("g1", "g2")
    raw = (F.col("v1") + F.col("v2") - F.col("v12")) * (F.col("N") - 1) / (F.col("N") - F.col("K")) * g / (g - 1)
    out = marginal_means(means, margin).join(v, margin).crossJoin(n).withColumn("raw", raw)
    return out.select(*margin, "emm", F.sqrt(F.greatest("raw", F.lit(0.0))).alias("se"), (F.col("raw") < 0).alias("clipped"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift beyond 10."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(10):
        low = x < 10
        shift[low] -= np.log(x[low])
        x[low] += 1
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= t): the substitution x = sqrt(df) tan(angle) makes the density a power of a cosine, which
    Gauss-Legendre nodes integrate over the shorter range."""
    t, df = np.abs(np.asarray(t, float)), np.asarray(df, float)
    nodes, weights = np.polynomial.legendre.leggauss(64)
    log_c = _log_gamma((df + 1) / 2) - _log_gamma(df / 2) - 0.5 * np.log(np.pi)
    # in units of the normal width the tail beyond 40 widths is nothing; it starts at the angle of t
    start = np.arctan(t / np.sqrt(df))
    end = np.minimum(np.pi / 2, start + 40 / np.sqrt(np.maximum(df, 1)))
    pieces = np.linspace(0, 1, 9)
    total = np.zeros_like(start)
    for a, b in zip(pieces[:-1], pieces[1:], strict=True):
        lo, hi = start + (end - start) * a, start + (end - start) * b
        angle = (lo + hi)[:, None] / 2 + (hi - lo)[:, None] / 2 * nodes
        with np.errstate(divide="ignore"):
            body = np.exp(log_c[:, None] + (df[:, None] - 1) * np.log(np.maximum(np.cos(angle), 1e-300)))
        total += (hi - lo) / 2 * (body * weights).sum(1)
    return np.where(np.isnan(t), np.nan, np.minimum(2 * total, 1.0))


def t_quantile(df: np.ndarray, level: float = 0.95) -> np.ndarray:
    """The t with two-sided probability 1 - level, by bisection."""
    low, high = np.zeros(len(df)), np.full(len(df), 1e4)
    for _ in range(60):
        middle = (low + high) / 2
        above = two_sided_p(middle, df) > 1 - level
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def p_of_t(t: pd.Series, df: pd.Series) -> pd.Series:
    known = (t.notna() & df.notna() & (df > 0)).to_numpy()
    out = np.full(len(t), np.nan)
    out[known] = two_sided_p(t.to_numpy(float)[known], df.to_numpy(float)[known])
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


@F.pandas_udf(DoubleType())
def t_of_df(df: pd.Series) -> pd.Series:
    known = (df.notna() & (df > 0)).to_numpy()
    kinds, which = np.unique(df.to_numpy(float)[known], return_inverse=True)
    out = np.full(len(df), np.nan)
    out[known] = t_quantile(kinds)[which] if len(kinds) else []
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def t_interval_p(tests: DataFrame, estimate: str = "estimate", se: str = "se", df: str = "df") -> DataFrame:
    """``t, p, low, high`` (95 %) of each estimate; null where the error or the degrees are not positive."""
    t = F.when(F.col(se) > 0, F.col(estimate) / F.col(se))
    width = t_of_df(F.col(df).cast("double")) * F.col(se)
    return tests.withColumn("t", t).withColumn("p", p_of_t("t", F.col(df).cast("double"))).withColumn("low", F.col(estimate) - width).withColumn("high", F.col(estimate) + width)


def t_ci_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, deviation, count and limits by the t quantile."""
    out = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")).withColumn("se", F.col("sd") / F.sqrt("n"))
    half = t_of_df((F.col("n") - 1).cast("double")) * F.col("se")
    return out.withColumn("half", half).withColumns({"low": F.col("mean") - F.col("half"), "high": F.col("mean") + F.col("half")}).drop("half")


def delta_table(means: DataFrame, tests: DataFrame, by: list[str], level: str) -> DataFrame:
    """Every level's difference to the best of its group (the first on ties), with the contrast's error
    looked up in either direction; without a contrast the difference of the means."""
    order = Window.partitionBy(*by).orderBy(F.desc("emm"), level)
    rows = means.withColumns({"best": F.first(level).over(order), "top": F.first("emm").over(order)})
    part = F.split("contrast", " - ")
    there = tests.select(*by, part[0].alias(level), part[1].alias("best"), F.col("estimate"), "se")
    back = tests.select(*by, part[1].alias(level), part[0].alias("best"), (-F.col("estimate")).alias("estimate"), "se")
    out = rows.join(there.unionByName(back), [*by, level, "best"], "left")
    return out.select(*by, level, "emm", F.coalesce("estimate", F.col("emm") - F.col("top")).alias("delta"), "se", (F.col(level) == F.col("best")).alias("is_best"))


def pivot_levels(means: DataFrame, by: list[str], level: str, levels: list[str], value: str = "emm") -> DataFrame:
    return means.groupBy(*by).pivot(level, levels).agg(F.first(value))


def final_by_task(means: DataFrame, tasks: list[str], strategies: list[str]) -> DataFrame:
    """Margins of finals in percent to one decimal, a star at the largest of each model and task (at all
    of them on ties), a column for each task and strategy."""
    rows = means.where("type = 'final'").withColumn("percent", F.round(F.col("emm") * 100, 1))
    top = F.max("percent").over(Window.partitionBy("model", "task"))
    said = F.concat(F.format_string("%.1f", "percent"), F.when(F.col("percent") == top, "*").otherwise(""))
    cell: list[Column] = [F.max(F.when((F.col("task") == t) & (F.col("strategy") == s), F.col("said"))).alias(f"{t}_{s}") for t in tasks for s in strategies]
    return rows.withColumn("said", said).groupBy("model").agg(*cell)


def human_mitigation_union(new: DataFrame, earlier: DataFrame) -> DataFrame:
    """New responses (k = 3) and those of the earlier study without a zero-shot side (k = 0)."""
    old = earlier.where("image1_status <> 'zero-shot' and image2_status <> 'zero-shot'")
    columns = ["participant_id", "task", "image1_status", "image2_status", "choice"]
    both = new.select(*columns, F.lit(3).alias("k")).unionByName(old.select(*columns, F.lit(0).alias("k")))
    side = lambda n: F.struct(F.col(f"image{n}_status").alias("type"), (F.col("choice") == n).cast("int").alias("chosen"))
    return both.select("participant_id", "task", "k", F.inline(F.array(side(1), side(2))))
