"""Mixing sources to target weights: pivotal dependent rounding through a reduction tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, written

WORDS = r"[^\x20\x09-\x0D]+"
NEAR = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``source, source_size, target``: all sizes shared out by weight, no target above ``cap`` times its
    source's size. Sources by code point, null last, take the weights in turn.

    The shares are a water level: with sources by ``cap * size / weight``, those below the level are
    full, the others get level times weight. The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ring = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.element_at(ring, ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("full_at", F.col("source_size") * F.lit(cap) / F.col("weight"))
    upto = Window.orderBy("full_at", "nth").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("full_at", "nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * F.lit(cap))
        .withColumn("rest_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("rest_weight"))
    )
    level = F.first(F.when(F.col("full_at") >= F.col("level"), F.col("level")), ignorenulls=True).over(whole)
    return per.select(
        "source", "source_size",
        F.least(F.col("source_size") * F.lit(cap), F.coalesce(level * F.col("weight"), F.col("source_size") * F.lit(cap))).cast("double").alias("target"),
    )


def _pivot(size: np.ndarray, p: np.ndarray, chance: np.ndarray) -> int:
    """Round ``p`` in place to 0 and 1, keeping the sum of size times p; the place of the one that is
    left between, or -1. Of two fractions one gives words to the other until one is integral."""
    held = -1
    for i in range(len(p)):
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - p[a]) * size[a], p[b] * size[b])
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        if chance[i] * (up + down) < down:
            p[a] += up / size[a]
            p[b] -= up / size[b]
        else:
            p[a] -= down / size[a]
            p[b] += down / size[b]
        held = -1
        for j in (a, b):
            if NEAR < p[j] < 1 - NEAR:
                held = j
            else:
                p[j] = round(p[j])
    return held


def _level(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "k", "doc_id", "size"], na_position="last", kind="stable").reset_index(drop=True)
        p, done = rows["p"].to_numpy(float).copy(), np.ones(len(rows), bool)
        for at in rows.groupby("source", dropna=False, sort=False).indices.values():
            at = np.sort(at)
            part = p[at]
            size = rows["size"].to_numpy(float)[at]
            chance = rows["chance"].to_numpy(float)[at]
            held = _pivot(size, part, chance)
            if held >= 0:
                if last:
                    part[held] = float(chance[held] < part[held])
                else:
                    done[at[held]] = False
            p[at] = part
        return rows.assign(p=p, done=done)

    return run


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 9, leaf_rows: int = 1000, fan_in: int = 16
) -> DataFrame:
    """How often the mix takes each document: ``doc_id, size, source_size, target, taken, copies``.

    Size is the number of words of the whole text (null: 0). Every document of a source has the same
    fractional number of copies, target / source_size, at most ``cap``. Its fraction is rounded by pivotal
    rounding weighted by size, so a source's taken words miss its target by at most one document.
    Documents go to leaves of about ``leaf_rows`` by a hash of id and text, whatever their source, so a
    source with most rows fills no task; each leaf leaves one fraction a source, and those are rounded
    in groups of ``fan_in`` leaves, level by level. Order and chances come from hashes: reruns agree.
    One output row per input row, repeated rows and null ids included; a document without words has
    size 0 and taken 0; an empty table gives no rows. Other columns are ignored.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = written(
        docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).select(
            "doc_id", "source", key.alias("k"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size")
        ),
        "sizes",
    )
    leaves = max(1, -(-rows.count() // leaf_rows))
    goal = sized(written(source_targets(rows, weights, cap).withColumnRenamed("source", "_source"), "targets"))
    whole = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        rows.join(goal, rows["source"].eqNullSafe(F.col("_source")))
        .withColumn("ratio", F.when(F.abs(whole - F.round(whole)) < NEAR, F.round(whole)).otherwise(whole))
        .select(
            "doc_id", "source", "k", "size", "source_size", "target",
            F.floor("ratio").cast("long").alias("base"), (F.col("ratio") - F.floor("ratio")).alias("p"),
            F.pmod(F.xxhash64("k", F.lit(1)), F.lit(leaves)).alias("leaf"), F.lit(0).alias("part"),
            ((F.shiftrightunsigned(F.xxhash64("k", F.lit(2)), 11)).cast("double") / float(1 << 53)).alias("chance"),
        )
    )
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    kind = rows.withColumn("done", F.lit(False)).schema
    rounded = [rows.where(~open_).withColumn("p", F.lit(0.0)).withColumn("done", F.lit(True))]
    rows = rows.where(open_)
    while True:
        level = written(rows.groupBy("leaf", "part").applyInPandas(_level(leaves == 1), kind), "rounded")
        rounded.append(level.where("done"))
        if leaves == 1:
            break
        leaves = -(-leaves // fan_in)
        # above the leaves a task gets some of the sources only: there may be many of them
        rows = level.where("not done").drop("done").withColumn("leaf", F.expr(f"leaf div {fan_in}")).withColumn("part", F.pmod(F.xxhash64("source"), F.lit(64)).cast("int"))
    out = rounded[0]
    for more in rounded[1:]:
        out = out.unionByName(more)
    copies = F.col("base") + F.round("p").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))
