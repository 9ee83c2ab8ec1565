"""Agglomerative levels of groups of any size, for the linkages that need no matrix of distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .helpers import cut, merges
from .ranks import beside, ranked, stored

#: Items of a block: pairs of blocks are compared in a task, and only each component's shortest edge leaves it.
BLOCK = 2048


def ward_merges(points: np.ndarray) -> list[tuple[float, int, int]]:
    """Ward's merges ``(height, item, item)``, lowest first, by nearest-neighbour chains over centroids and
    sizes: a cluster's distance to all others is made when its turn comes, so memory is that of the points."""
    n = len(points)
    at, size, alive = points.astype(float).copy(), np.ones(n), np.ones(n, bool)
    square = (at * at).sum(1)
    chain: list[int] = []
    out = []
    start = 0
    while len(out) < n - 1:
        if not chain:
            while not alive[start]:
                start += 1
            chain = [start]
        a = chain[-1]
        d = np.maximum(square + square[a] - 2 * (at @ at[a]), 0) * (2 * size * size[a] / (size + size[a]))
        d[~alive] = np.inf
        d[a] = np.inf
        b = int(np.argmin(d))
        if len(chain) < 2 or d[chain[-2]] > d[b]:
            chain.append(b)
            continue
        b = chain[-2]
        chain = chain[:-2]
        out.append((float(d[b]), a, b))
        keep, gone = min(a, b), max(a, b)
        at[keep] = (size[a] * at[a] + size[b] * at[b]) / (size[a] + size[b])
        square[keep] = at[keep] @ at[keep]
        size[keep], alive[gone] = size[a] + size[b], False
    return sorted(out, key=lambda m: m[0])


def _shortest(columns: list[str]):
    """Of two blocks of points ``k, component, v``: each component's shortest edge to another component, as
    ``component, d, a, b``; of equal distances the smaller ends."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            one, two = left.to_pandas().sort_values("k"), right.to_pandas().sort_values("k")
            x, y = (np.stack(t["v"].tolist()).astype(float) for t in (one, two))
            ka, kb, ca, cb = (t[c].to_numpy() for c in ("k", "component") for t in (one, two))
            square = (y * y).sum(1)
            best = np.full(len(x), np.inf)
            to = np.zeros(len(x), np.int64)
            for i in range(0, len(x), 256):
                d = np.maximum((x[i : i + 256] ** 2).sum(1)[:, None] + square - 2 * (x[i : i + 256] @ y.T), 0)
                d[ca[i : i + 256, None] == cb] = np.inf
                to[i : i + 256] = d.argmin(1)
                best[i : i + 256] = d.min(1)
            there = np.isfinite(best)
            low, high = np.minimum(ka, kb[to])[there], np.maximum(ka, kb[to])[there]
            frame = pd.DataFrame({"component": ca[there], "d": best[there], "a": low, "b": high}).sort_values(["component", "d", "a", "b"]).drop_duplicates("component")
            rows = list(frame.itertuples(index=False, name=None))
        key = [(left if left.num_rows else right)["_g"][0].as_py()]
        out = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.Table.from_arrays([pa.array(key * len(rows), pa.int64()), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)]], names=columns)

    return run


def spanning_edges(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """``_g, d, a, b``: a shortest spanning tree of each group of ``_g, k, v`` (``k`` from 0), squared distances,
    by Boruvka's rounds: each component takes its shortest edge to another one, so at least half of them
    go in a round. Blocks of a group meet pairwise; a task gives an edge a component, never all pairs."""
    columns = ["_g", "component", "d", "a", "b"]
    kinds = "_g long, component long, d double, a long, b long"
    where = stored(points.select("_g", "k", F.col("k").alias("component")), "components")
    blocked = points.withColumn("block", F.floor(F.col("k") / block).cast("int"))
    most = F.max("block").over(Window.partitionBy("_g"))
    counts = blocked.groupBy("_g", "block").agg(F.count(F.lit(1)).alias("_n")).select("_g", "block", most.alias("_last"))
    blocked = stored(beside(blocked, counts, ["_g", "block"]), "points")
    edges = None
    while True:
        here = beside(blocked, where.select("_g", "k", "component"), ["_g", "k"])
        every = F.explode(F.sequence(F.lit(0), F.col("_last")))
        left = here.withColumn("other", every).select("_g", F.col("block").alias("one"), F.col("other").alias("two"), "k", "component", "v")
        right = here.withColumn("other", every).select("_g", F.col("other").alias("one"), F.col("block").alias("two"), "k", "component", "v")
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)
        found = left.groupBy("_g", "one", "two").cogroup(right.groupBy("_g", "one", "two")).applyInArrow(_shortest(columns), kinds)
        best = stored(found.groupBy("_g", "component").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("_g", "component", "e.*"), "shortest")
        if not best.limit(1).count():
            break
        new = best.select("_g", "d", "a", "b").distinct()
        edges = new if edges is None else edges.unionByName(new)
        # each component points along its edge; of two that chose the same edge the smaller is the root
        ends = beside(beside(best, where.select("_g", F.col("k").alias("a"), F.col("component").alias("ca")), ["_g", "a"]), where.select("_g", F.col("k").alias("b"), F.col("component").alias("cb")), ["_g", "b"])
        to = F.when(F.col("ca") == F.col("component"), F.col("cb")).otherwise(F.col("ca"))
        points_to = ends.select("_g", "component", to.alias("to"))
        back = points_to.select("_g", F.col("component").alias("to"), F.col("to").alias("_back"))
        root = (F.col("_back") == F.col("component")) & (F.col("component") < F.col("to"))
        points_to = stored(beside(points_to, back, ["_g", "to"]).select("_g", "component", F.when(root, F.col("component")).otherwise(F.col("to")).alias("to")), "pointers")
        while True:  # pointers to their pointers, until all are at a root
            further = points_to.select("_g", F.col("component").alias("to"), F.col("to").alias("_next"))
            jumped = stored(beside(points_to, further, ["_g", "to"]).select("_g", "component", F.col("_next").alias("to"), (F.col("_next") != F.col("to")).alias("moved")), "pointers")
            points_to = jumped.drop("moved")
            if not jumped.where("moved").limit(1).count():
                break
        joined = where.alias("w").join(points_to.alias("p"), ["_g", "component"], "left")
        where = stored(joined.select("_g", "k", F.coalesce("to", "component").alias("component")), "components")
    return edges if edges is not None else points.sparkSession.createDataFrame([], "_g long, d double, a long, b long")


def _levels(table: pd.DataFrame, names: list[str], tree: list[tuple[float, int, int]]) -> Iterator[pd.DataFrame]:
    n = len(table)
    for level, k in enumerate(dict.fromkeys(-(-n // 2**i) for i in range(1, 63)), 1):
        yield table[names].assign(level=level, cluster_id=cut(n, tree, k))


def hierarchical_levels(rows: DataFrame, group: list[str], item: str, linkage: str = "ward", most: int = 8000, block: int = BLOCK) -> DataFrame:
    """``group, item, level, cluster_id``: one agglomerative tree of each group cut at n/2, n/4, ..., 1
    clusters, items in their order; one item is level 1, cluster 0. Rows without a vector go.

    A group of up to ``most`` items is a task with all its distances. A larger one has no limit for Ward's
    linkage (a task with its points, centroids instead of distances) and for single linkage (a spanning
    tree of which blocks of points find the edges; a task has the tree's n - 1 edges). Average and complete
    linkage need all distances, so there a larger group fails the job: another tree would be another result.
    """
    rows = rows.where(F.col("embedding").isNotNull()).select(*group, item, "embedding")
    names = [*group, item]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", level int, cluster_id long"

    def small(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > most and linkage not in ("ward", "single"):
            raise ValueError(f"a group has {len(part)} items; a tree takes {most} at most")
        part = part.sort_values(item, ignore_index=True)
        points = np.stack(part["embedding"].tolist()).astype(float)
        return pd.concat(_levels(part, names, ward_merges(points) if len(part) > most else merges(points, linkage)))

    if linkage != "single":
        return rows.groupBy(*group).applyInPandas(small, kinds)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    sized_rows = beside(rows, sizes, group)
    out = sized_rows.where(F.col("_size") <= most).drop("_size").groupBy(*group).applyInPandas(small, kinds)
    large = sized_rows.where(F.col("_size") > most).drop("_size")
    if not sizes.where(F.col("_size") > most).limit(1).count():
        return out
    numbers = stored(sizes.where(F.col("_size") > most).select(*group, F.monotonically_increasing_id().alias("_g")), "groups")
    placed = stored(beside(ranked(large, group, [item]), numbers, group).select(*names, "_g", (F.col("rank") - 1).cast("long").alias("k"), F.col("embedding").cast("array<double>").alias("v")), "placed")
    edges = spanning_edges(placed.select("_g", "k", "v"), block)

    def of_edges(part: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        part, edge = part.sort_values("k", ignore_index=True), edge.sort_values(["d", "a", "b"])
        return pd.concat(_levels(part, names, list(zip(edge["d"], edge["a"], edge["b"], strict=True))))

    return out.unionByName(placed.select(*names, "_g", "k").groupBy("_g").cogroup(edges.groupBy("_g")).applyInPandas(of_edges, kinds))
