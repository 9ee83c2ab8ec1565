"""Pairs of large groups: blocks against plain loops, and how they are dealt."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallypair.operators import pairing


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def picked(rows):
    at = lambda r: (hashlib.md5(f"42|{r[0]}|{r[1]}|{r[2]}".encode()).hexdigest(), r[2])
    return {k: min((r for r in rows if r[:2] == k), key=at)[2] for k in {r[:2] for r in rows}}


def test_participant_pairs_in_blocks_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else "b", str(rng.randrange(60)), rng.choice(["original", "zero-shot", "final"])) for _ in range(150)]
    one = picked(rows)
    want = sorted((c, i, s, j, t) for (c, i), s in one.items() for (d, j), t in one.items() if c == d and i < j and s != t)
    frame = spark.createDataFrame(rows, "category string, base_id string, status string").repartition(3)
    for span in (7, 60, 8192):
        assert sorted(map(tuple, pairing.participant_pairs(frame, span=span).collect())) == want


def test_a_hot_category_is_dealt_to_many_tasks(spark, many_partitions):
    frame = spark.createDataFrame([("hot", str(i), ("original", "zero-shot", "final")[i % 3]) for i in range(900)], "category string, base_id string, status string")
    sizes = [r["count"] for r in pairing.participant_pairs(frame, span=100).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 12 and max(sizes) < sum(sizes) / 5


def test_pairs_of_a_hot_class_are_dealt_and_written_small(spark, many_partitions, tmp_path):
    items = [("hot", str(i), ("original", "zero-shot", "final")[i * 7 % 3], f"{i}_{i * 7 % 3}") for i in range(2500)]
    frame = spark.createDataFrame(items, "image_class string, image_id string, status string, base string").repartition(5)
    pairing.pairs_within_class(frame, span=500).write.parquet(str(tmp_path / "a"))
    assert len(list((tmp_path / "a").glob("*.parquet"))) > 6
    pairing.pairs_within_class(frame).write.parquet(str(tmp_path / "b"))
    rows = spark.read.parquet(str(tmp_path / "b")).count()
    assert rows == 2500 * 2499 // 2 and sum(f.stat().st_size for f in (tmp_path / "b").glob("*.parquet")) < rows


def test_cross_status_pairs_of_a_hot_class_are_dealt(spark, many_partitions):
    items = [("hot", str(i), ("original", "zero-shot", "final")[i * 7 % 3], f"{i}_{i * 7 % 3}") for i in range(1200)]
    frame = spark.createDataFrame(items, "image_class string, image_id string, status string, base string").repartition(5)
    sizes = [r["count"] for r in pairing.pairs_within_class(frame, cross_status=True, span=100).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3 * 400**2 and len(sizes) > 12 and max(sizes) < sum(sizes) / 5


def test_strategy_pairs_of_a_hot_class_are_dealt(spark, many_partitions):
    items = [("t", "hot", ("x", "y", "z")[i % 3], str(i), "final") for i in range(1200)]
    frame = spark.createDataFrame(items, "task string, image_class string, strategy string, image_id string, status string").repartition(5)
    sizes = [r["count"] for r in pairing.pairs_cross_strategy(frame, span=100).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3 * 400**2 and len(sizes) > 12 and max(sizes) < sum(sizes) / 5
