"""Ranks and running values of groups of any size: no task holds a group, no window an unbounded one.

Rows are range-partitioned by group and order and written once, so that each partition is a stretch of
the total order. A window then ranks within a stretch; what lies before or after it comes from one
row a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallypair.sources.files import scratch


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once, and later plans start there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stretches(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``_part``, the number of their stretch of the order (by, order), stored. Rows that are
    equal in all of that are told apart by ``_tie``, so that many of them don't meet in one stretch."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    return stored(tied.repartitionByRange(parts, *by, *order, "_tie").withColumn("_part", F.spark_partition_id()), "stretches")


def beside(table: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the columns of ``small``, one row a key; null keys meet."""
    named = small.select([F.col(c).alias(f"_k{keys.index(c)}") if c in keys else F.col(c) for c in small.columns])
    same: Column = F.lit(True)
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return table.join(named, same).drop(*[f"_k{i}" for i in range(len(keys))])


def ranked(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 1, ties in any order) and ``total`` of their group; null keys are a group."""
    table = stretches(rows, by, order, parts)
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = table.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n")).select(*by, "_part", before.alias("_before"), F.sum("_n").over(group).alias("total"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order, "_tie"))
    return beside(table, counts, [*by, "_part"]).select(*rows.columns, (F.col("_before") + own).alias("rank"), "total")


def least_of_later(rows: DataFrame, by: list[str], order: list[str], weight: str, value: Column, parts: int | None = None) -> DataFrame:
    """``rows`` with ``least``: of their group, the smallest ``value`` of this and all later rows. ``value`` may
    use ``_through``, the sum of ``weight`` up to the row, and ``_all``, that of the group."""
    table = stretches(rows, by, order, parts)
    group, own = Window.partitionBy(*by), Window.partitionBy(*by, "_part")
    sums = table.groupBy(*by, "_part").agg(F.sum(weight).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_part", earlier.alias("_before"), F.sum("_n").over(group).alias("_all"))
    upward = own.orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    with_value = beside(table, sums, [*by, "_part"]).withColumn("_through", F.col("_before") + F.sum(weight).over(upward)).withColumn("_value", value)
    with_value = stored(with_value.select(*rows.columns, "_tie", "_part", "_value"), "values")
    later = group.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    lows = with_value.groupBy(*by, "_part").agg(F.min("_value").alias("_low")).select(*by, "_part", F.min("_low").over(later).alias("_later"))
    onward = own.orderBy(*order, "_tie").rowsBetween(0, Window.unboundedFollowing)
    out = beside(with_value, lows, [*by, "_part"]).withColumn("_least", F.min("_value").over(onward))
    return out.select(*rows.columns, F.least("_least", "_later").alias("least"))


def pages(rows: DataFrame, by: list[str], order: list[str], size: int, parts: int | None = None) -> DataFrame:
    """``rows`` with ``page`` (from 0), the place of each ``size`` rows of their group in its order, and ``total``."""
    table = ranked(rows, by, order, parts)
    return table.withColumn("page", F.floor((F.col("rank") - 1) / size).cast("int")).drop("rank")
