"""The corpus pipeline: documents in, a mix of clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet
in the shared folder and read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallypair.llm.common import documents, written
from tallypair.llm.decontamination import decontaminate
from tallypair.llm.line_dedup import without_repeated_lines
from tallypair.llm.mixing import mix_sources
from tallypair.llm.quality import keep_good
from tallypair.llm.simhash_dedup import keep_one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near lines one stays; documents without a line of their own left go."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return keep_one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document; those that it doesn't take go."""
    return mix_sources(docs).where("copies > 0")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("benchmark_free", benchmark_free), ("mix", mix)]

#: The classifier's scores, near lines, XXH64 and the seeded rounding can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
