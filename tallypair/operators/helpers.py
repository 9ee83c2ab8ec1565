"""Where numpy is needed: a fixed-effects fit from sufficient statistics, structural similarity, and
agglomerative levels of bounded groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ranks import beside, stored

#: The fit's parameters (combinations of factor levels, and levels of the effect): the driver solves a
#: dense system of so many rows at most.
MOST_PARAMETERS = 3000


def fixed_effect_fit(long: DataFrame, factors: list[str], effect: str, cluster: str = "pair_id") -> DataFrame:
    """``factors, emm, se`` of ``chosen ~ product of factors | effect`` with clustered errors.

    Spark makes the cells' counts and sums, each cluster's score vector by parameter, and the sum of these
    vectors' outer products; the driver solves a system of a row a parameter, so there may be as many
    cells as that has pairs. Clusters never meet one another.
    """
    spark = long.sparkSession
    long = long.where(F.col("chosen").isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in long.select(*factors).schema) + ", emm double, se double"
    cells = stored(long.groupBy(*factors, effect).agg(F.count(F.lit(1)).alias("n"), F.sum("chosen").cast("double").alias("y")), "cells")
    combos, levels = (cells.select(*c).distinct().orderBy(*c).limit(MOST_PARAMETERS + 1).toPandas() for c in (factors, [effect]))
    if len(combos) + len(levels) > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} parameters")
    if not len(combos):
        return spark.createDataFrame([], schema)
    first = spark.createDataFrame(combos.assign(combo=range(len(combos))), long.select(*factors).schema.add("combo", "long"))
    second = spark.createDataFrame(levels.assign(level=range(len(levels))), long.select(effect).schema.add("level", "long"))
    numbered = beside(beside(cells, first, factors), second, [effect])
    table = numbered.select("combo", "level", "n", "y").toPandas()
    size = len(combos) + len(levels) - 1

    def normal(weight: np.ndarray) -> np.ndarray:
        """The sum over cells of weight times the outer product of their columns; the first level has none."""
        out = np.zeros((size, size))
        c, e = table["combo"].to_numpy(), table["level"].to_numpy()
        np.add.at(out, (c, c), weight)
        c, e, w = c[e > 0], len(combos) + e[e > 0] - 1, weight[e > 0]
        for i, j in ((e, e), (c, e), (e, c)):
            np.add.at(out, (i, j), w)
        return out

    c, e = table["combo"].to_numpy(), table["level"].to_numpy()
    right = np.zeros(size)
    np.add.at(right, c, table["y"].to_numpy())
    np.add.at(right, len(combos) + e[e > 0] - 1, table["y"].to_numpy()[e > 0])
    bread = np.linalg.pinv(normal(table["n"].to_numpy(float)), hermitian=True)
    beta = bread @ right
    shift = np.r_[0.0, beta[len(combos) :]]
    guess = spark.createDataFrame(table[["combo", "level"]].assign(fitted=beta[c] + shift[e]))
    fitted = numbered.join(guess, ["combo", "level"]).select(*factors, effect, "combo", "level", "fitted")
    residual = beside(long.groupBy(cluster, *factors, effect).agg(F.sum("chosen").alias("_y"), F.count(F.lit(1)).alias("_n")), fitted, [*factors, effect])
    of = F.array(F.col("combo"), F.when(F.col("level") > 0, F.col("level") + len(combos) - 1))
    scores = residual.select(cluster, F.explode(of).alias("at"), (F.col("_y") - F.col("_n") * F.col("fitted")).alias("u")).where("at is not null").groupBy(cluster, "at").agg(F.sum("u").alias("u"))
    vectors = stored(scores.groupBy(cluster).agg(F.collect_list(F.struct("at", "u")).alias("s")).select("s"), "scores")
    outer = vectors.select("s", F.inline("s").alias("i", "a")).select("i", "a", F.inline("s").alias("j", "b"))
    products = outer.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s")).toPandas()
    meat = np.zeros((size, size))
    meat[products["i"], products["j"]] = products["s"]
    total, g, k = table["n"].sum(), vectors.count(), np.linalg.matrix_rank(normal(np.ones(len(table))), hermitian=True)
    v = bread @ meat @ bread * (total - 1) / (total - k) * g / (g - 1)
    margin = np.hstack([np.eye(len(combos)), np.full((len(combos), len(levels) - 1), 1 / len(levels))])
    se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", margin, v, margin), 0))
    return spark.createDataFrame(combos.assign(emm=margin @ beta, se=se), schema)


def ssim_of(a: np.ndarray, b: np.ndarray, window: int = 7, data_range: float = 255.0) -> np.ndarray:
    """Mean structural similarity of planes ``(n, height, width)``, uniform windows, sample covariance. A
    window's mean is four places of a summed-area table."""

    def mean(x: np.ndarray) -> np.ndarray:
        area = np.pad(x.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
        return (area[:, window:, window:] - area[:, :-window, window:] - area[:, window:, :-window] + area[:, :-window, :-window]) / window**2

    fix = window**2 / (window**2 - 1)
    ma, mb = mean(a), mean(b)
    va, vb, cov = fix * (mean(a * a) - ma * ma), fix * (mean(b * b) - mb * mb), fix * (mean(a * b) - ma * mb)
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    return ((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean(axis=(1, 2))


@F.pandas_udf(DoubleType())
def ssim(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two square planes given as flat arrays of one length; null if the sizes differ or aren't square."""
    out = np.full(len(a), np.nan)
    lengths = [np.array([0 if v is None else len(v) for v in s], int) for s in (a, b)]
    for n in np.unique(lengths[0][(lengths[0] == lengths[1]) & (lengths[0] > 0)]):
        side, at = int(round(n**0.5)), np.flatnonzero((lengths[0] == n) & (lengths[1] == n))
        if side * side == n and side >= 7:
            x, y = (np.stack(s.iloc[at].tolist()).astype(float).reshape(len(at), side, side) for s in (a, b))
            out[at] = ssim_of(x, y)
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def merges(points: np.ndarray, linkage: str = "ward") -> list[tuple[float, int, int]]:
    """Agglomerative merges ``(height, item, item)`` by nearest-neighbour chains, lowest first."""
    square = (points * points).sum(1)
    d = np.maximum(square[:, None] + square - 2 * (points @ points.T), 0)
    d = d if linkage == "ward" else np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, out = np.ones(len(d)), np.ones(len(d), bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        b = int(np.argmin(np.where(alive, d[a], np.inf)))
        if len(chain) < 2 or d[a, chain[-2]] > d[a, b]:
            chain.append(b)
            continue
        b = chain[-2]
        chain = chain[:-2]
        out.append((float(d[a, b]), a, b))
        na, nb = size[a], size[b]
        if linkage == "ward":
            new = ((na + size) * d[a] + (nb + size) * d[b] - size * d[a, b]) / (na + nb + size)
        elif linkage == "average":
            new = (na * d[a] + nb * d[b]) / (na + nb)
        else:
            new = (np.maximum if linkage == "complete" else np.minimum)(d[a], d[b])
        keep, gone = min(a, b), max(a, b)
        d[keep], d[:, keep], d[keep, keep] = new, new, np.inf
        size[keep], alive[gone] = na + nb, False
    return sorted(out, key=lambda m: m[0])


def cut(n: int, tree: list[tuple[float, int, int]], clusters: int) -> np.ndarray:
    """Labels of ``clusters`` clusters, numbered by their first member."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, a, b in tree[: n - clusters]:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]
