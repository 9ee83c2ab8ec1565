"""What the training-data operators share: the scratch folder, size-checked joins, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DatetimeType, DataType, MapType, NumericType, StringType, StructType

#: A table is broadcast only if neither its Parquet files nor its rows in memory are larger than these.
BROADCAST_BYTES, BROADCAST_MEMORY = 16 << 20, 64 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key() -> Column:
    """Tells the rows of a table apart unless they are equal in id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def nested(docs: DataFrame) -> DataFrame:
    """``_key, _row``: each row's ``row_key`` and, in one column, all of the row, so that no name of it
    meets a name of ours."""
    return docs.select(row_key().alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, but for those whose key is in ``keys`` (``key``, from ``written``)."""
    rows = nested(docs)
    return rows.join(sized(keys), rows["_key"] == keys["key"], "left_anti").select("_row.*")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a new one, in local mode only."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_tallypair_folder", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = sc._tallypair_folder = "file://" + tempfile.mkdtemp(prefix="spark-tallypair-")
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later plans start here, and a
    lost executor costs only the tasks that it was running."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallypair/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path
    return back


def written_apart(df: DataFrame, column: str, values: tuple, name: str) -> tuple[DataFrame, ...]:
    """Like ``written``, one table for each of the ``values`` of a column, which can be removed by itself."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallypair/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    kind = StructType([f for f in df.schema.fields if f.name != column])
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for value in values:
        part = f"{path}/{column}={value}"
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(part)):
            back = spark.read.schema(kind).parquet(part).withColumn(column, F.lit(value)).select(*df.columns)
        else:
            back = spark.createDataFrame([], df.schema)
        back._written_path = part
        out.append(back)
    return tuple(out)


def remove(table: DataFrame) -> None:
    """Delete the files of a scratch table that no later plan reads."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs in it give back their shuffle files when they end: for results that are written out."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def bytes_of(table: DataFrame) -> int:
    """Size of the files that ``written`` made."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(path).getLength()


def width_of(kind: DataType, column: Column) -> Column:
    """About the bytes that a value of ``column`` takes in memory, at least 8; a null takes that too."""
    if isinstance(kind, (StringType, BinaryType)):
        size = F.octet_length(column) + 16
    elif isinstance(kind, ArrayType):
        fixed = isinstance(kind.elementType, (NumericType, BooleanType, DatetimeType))
        size = F.size(column) * 8 + 24 if fixed else F.aggregate(column, F.lit(24).cast("long"), lambda n, x: n + width_of(kind.elementType, x))
    elif isinstance(kind, MapType):
        size = width_of(ArrayType(kind.keyType), F.map_keys(column)) + width_of(ArrayType(kind.valueType), F.map_values(column))
    elif isinstance(kind, StructType):
        size = F.lit(16)
        for f in kind.fields:
            size = size + width_of(f.dataType, column[f.name])
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def memory_of(table: DataFrame) -> int:
    """About the bytes of all rows in memory: compressed files can hold many times their size."""
    each = F.lit(16).cast("long")
    for f in table.schema.fields:
        each = each + width_of(f.dataType, F.col(f"`{f.name}`"))
    return table.agg(F.sum(each)).first()[0] or 0


def sized(table: DataFrame, limit: int = BROADCAST_BYTES, memory: int = BROADCAST_MEMORY, of: DataFrame | None = None) -> DataFrame:
    """``table`` (from ``written``, or columns of such a table ``of``) with a broadcast hint if its files,
    and then its rows, are small; else Spark joins by shuffle."""
    return F.broadcast(table) if bytes_of(table if of is None else of) <= limit and memory_of(table) <= memory else table


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges(a, b)`` as ``(node, component)``, the component
    being its smallest node: distributed union-find by alternating large-star and small-star steps.

    Each round replaces edges by edges to the smallest neighbour, so the graph becomes stars in about
    log(n) rounds. Each step pre-aggregates the minimum before its shuffle; a hub's edges are split by
    adaptive skew joins. No link or component reaches the driver. Null ends and self-loops are ignored.
    """
    pairs = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node goes to the smallest of its neighbourhood
        both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (
            both.join(least, "a").where("b > a")
            .select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        )
        large = written(large, "large-star")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = large.join(least, "b")
        small = (
            joined.where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
            .unionAll(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
            .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        )
        pairs = written(small, "small-star")
        # stars: no node has two smaller neighbours and no centre is itself a leaf
        loose = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if not loose and not pairs.select("a").join(pairs.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(
        pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
