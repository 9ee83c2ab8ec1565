"""Pair generation and joins."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallypair.functions.parse import seeded


#: Rows of a block: each pair of blocks is a key of the join, of at most so many rows a side. Names that come again after so
#: few rows, in the same order, are also written in few bytes.
SPAN = 1024


def _pairs(items: DataFrame, by: list[str], order: list[str], apart: list[str], span: int) -> DataFrame:
    """Self join ``a``, ``b`` of the rows of a group (all distinct in ``order``) in which the first of ``order`` is less in
    ``a`` and all of ``apart`` differ; rows with a null there meet none.

    A group's rows are numbered in ``order`` and cut into blocks of ``span``. A key of the join is a pair of blocks,
    the later one in ``b``, so its work and its memory don't grow with the group. Only names are joined, never image bytes.
    """
    group = Window.partitionBy(*by)
    within = group.orderBy(*order)
    rows = items.dropna(subset=[*by, order[0], *apart])
    rows = rows.withColumns({"place": F.row_number().over(within) - 1, "rank": F.dense_rank().over(group.orderBy(order[0]))})
    rows = rows.withColumns({"block": F.floor(F.col("place") / span), "last": F.floor(F.max("place").over(group) / span)})
    a = rows.withColumns({"low": F.col("block"), "high": F.explode(F.sequence("block", "last"))})
    b = rows.withColumns({"low": F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))), "high": F.col("block")})
    keys = [*by, "low", "high"]
    # a number of partitions, since pairs are many where names are few; sorted names are written in fewer bytes
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (side.drop("block", "last").repartition(parts, *keys).sortWithinPartitions(*keys, "place").alias(n) for n, side in (("a", a), ("b", b)))
    same = F.col("a.rank") < F.col("b.rank")
    for c in keys:
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    for c in apart:
        same &= F.col(f"a.{c}") != F.col(f"b.{c}")
    return a.hint("merge").join(b, same)


def _pair_counts(rows: DataFrame, by: list[str], kind: str, apart: list[str]) -> DataFrame:
    """``type1, type2, n``: the pairs of distinct ``rows`` of a group that differ in all of ``apart``, by their two kinds.

    No pair is made: by inclusion and exclusion over the columns of ``apart`` in which two rows agree, from the sizes
    of groups.
    """
    rows = rows.dropna(subset=[*by, *apart])
    parts = []
    for k in range(len(apart) + 1):
        for held in combinations(apart, k):
            keys = [*by, *held]
            sizes = rows.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))
            a, b = sizes.alias("a"), sizes.alias("b")
            same = F.col(f"a.{kind}").isNull() | (F.col(f"a.{kind}") <= F.col(f"b.{kind}"))
            for c in keys:
                same &= F.col(f"a.{c}") == F.col(f"b.{c}")
            ways = F.col("a.n") * F.col("b.n") * F.lit((-1) ** k)
            parts.append(a.join(b, same).select(F.col(f"a.{kind}").alias("one"), F.col(f"b.{kind}").alias("other"), ways.alias("n")))
    ways = reduce(DataFrame.unionByName, parts).groupBy("one", "other").agg(F.sum("n").alias("n"))
    n = F.when(F.col("one").eqNullSafe(F.col("other")), F.expr("n div 2")).otherwise(F.col("n"))
    out = ways.select(F.least("one", "other").alias("type1"), F.greatest("one", "other").alias("type2"), n.alias("n"))
    return out.groupBy("type1", "type2").agg(F.sum("n").alias("n")).where("n > 0")


def pair_counts_within_class(items: DataFrame, cross_status: bool = False) -> DataFrame:
    """How many pairs ``pairs_within_class`` has of each two statuses, without making them."""
    items = items.select("image_class", "image_id", "status", "base").dropDuplicates()
    return _pair_counts(items, ["image_class"], "status", ["image_id", "base", "status"] if cross_status else ["image_id", "base"])


def paired_items(items: DataFrame, cross_status: bool = False) -> DataFrame:
    """The items that are in any pair of ``pairs_within_class``, without making the pairs: an item's partners are
    counted by inclusion and exclusion over the columns in which they must differ."""
    apart = ["image_id", "base", "status"] if cross_status else ["image_id", "base"]
    rows = items.select("image_class", "image_id", "status", "base").dropDuplicates().dropna(subset=["image_class", *apart])
    with_sizes, partners = rows, F.lit(0)
    for k in range(len(apart) + 1):
        for i, held in enumerate(combinations(apart, k)):
            keys = ["image_class", *held]
            with_sizes = with_sizes.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{k}{i}")), keys)
            partners = partners + F.col(f"_n{k}{i}") * (-1) ** k
    return with_sizes.where(partners > 0).select(*rows.columns)


def pair_counts_cross_strategy(items: DataFrame) -> DataFrame:
    """How many pairs ``pairs_cross_strategy`` has of each two strategies, without making them."""
    items = items.where("status = 'final'").select("task", "image_class", "strategy", "image_id").dropDuplicates()
    return _pair_counts(items, ["task", "image_class"], "strategy", ["image_id", "strategy"])


def pairs_within_class(items: DataFrame, cross_status: bool = False, span: int = SPAN) -> DataFrame:
    """All unordered pairs of a class with different ids, by text order of ``base``; the same status may
    meet itself unless ``cross_status``. Repeated items count once."""
    items = items.select("image_class", "image_id", "status", "base").dropDuplicates()
    both = _pairs(items, ["image_class"], ["base", "image_id", "status"], ["image_id", "status"] if cross_status else ["image_id"], span)
    return both.select(F.col("a.image_class").alias("image_class"), F.col("a.base").alias("base1"), F.col("b.base").alias("base2"), F.col("a.status").alias("status1"), F.col("b.status").alias("status2"))


def pairs_cross_strategy(items: DataFrame, span: int = SPAN) -> DataFrame:
    """Finals of one task and class by different strategies, in the order of (strategy, id)."""
    items = items.where("status = 'final'").select("task", "image_class", "strategy", "image_id").dropDuplicates()
    both = _pairs(items, ["task", "image_class"], ["strategy", "image_id"], ["image_id"], span)
    return both.select(*[F.col(f"a.{c}").alias(c) for c in ("task", "image_class")], F.col("a.strategy").alias("strategy1"), F.col("a.image_id").alias("image_id1"), F.col("b.strategy").alias("strategy2"), F.col("b.image_id").alias("image_id2"))


def participant_pairs(versions: DataFrame, seed: int = 42, by: str = "status", span: int = SPAN) -> DataFrame:
    """One seeded status (or strategy) for each id of a category, then all pairs in which it differs."""
    pick = Window.partitionBy("category", "base_id").orderBy(seeded(seed, "category", "base_id", by), by)
    one = versions.withColumn("n", F.row_number().over(pick)).where("n = 1").select("category", "base_id", by)
    both = _pairs(one, ["category"], ["base_id"], [by], span)
    return both.select(F.col("a.category").alias("category"), F.col("a.base_id").alias("id1"), F.col(f"a.{by}").alias(f"{by}1"), F.col("b.base_id").alias("id2"), F.col(f"b.{by}").alias(f"{by}2"))


def match_original_final(versions: DataFrame) -> DataFrame:
    """Per category and base id the original and the final, where there are both."""
    at = lambda s: F.max(F.when(F.col("status") == s, F.col("path")))
    both = versions.groupBy("category", "base_id").agg(at("original").alias("original_path"), at("final").alias("final_path"))
    return both.where("original_path is not null and final_path is not null")


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that aren't among the results."""
    return tasks.join(done.select(*keys), keys, "left_anti")
