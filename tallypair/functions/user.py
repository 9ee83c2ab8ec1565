"""Where users' models come in: choosers, encoders and summarizers, by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypair.operators.ranks import pages, stored
from tallypair.operators.verdicts import collapse_orders

JUDGED = "completion_tokens int, prompt_tokens int, total_tokens int, reasoning_tokens int"


def mapped(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """``load()`` runs once in each task and gives the function for its batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        function = load()
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def judge_pairs(pairs: DataFrame, load: Callable, keys: list[str]) -> DataFrame:
    """Both orders of each pair to the user's chooser, which adds ``choice`` (first or second; null: the
    call failed and the pair is skipped), ``reason`` and the token counts; then one verdict a pair."""
    asked = pairs.select(*keys, "shown_a", "shown_b", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_a_first"))
    asked = asked.select(*keys, "is_a_first", F.when(F.col("is_a_first"), F.col("shown_a")).otherwise(F.col("shown_b")).alias("first"), F.when(F.col("is_a_first"), F.col("shown_b")).otherwise(F.col("shown_a")).alias("second"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    said = mapped(asked, load, f"{kept}, choice string, reason string, {JUDGED}")
    whole = said.where("choice is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(*keys)
    return collapse_orders(said.join(whole, keys, "left_semi"), keys)


def encode(df: DataFrame, load: Callable, keys: list[str], column: str) -> DataFrame:
    """``keys`` and the encoder's ``embedding``; unreadable rows (null) go."""
    rows = df.select(*keys, column)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return mapped(rows, load, f"{kept}, embedding array<double>").where("embedding is not null")


def summarize_clusters(rows: DataFrame, load: Callable, keys: list[str], source: str = "source", page: int = 10_000) -> DataFrame:
    """One ``summary`` for each cluster ``keys`` of texts ``rows`` (``keys, source``) by the user's summarizer of
    ``keys, texts``; texts in their order.

    A summarizer gets ``page`` texts at most. A larger cluster's pages are summarized side by side, and then
    their summaries, in the pages' order, in place of its texts, until one is left.
    """
    if page < 2:
        raise ValueError("a page needs two texts")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    texts, order, done = rows.select(*keys, F.col(source).alias("text")), ["text"], None
    while True:
        paged = pages(texts, keys, order, page)
        by_page = paged.groupBy(*keys, "page").agg(F.max("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("text").alias("said")))), lambda x: x["said"]).alias("texts"))
        said = stored(mapped(by_page, load, f"{kept}, page int, total long, summary string"), "summaries")
        whole = said.where(F.col("total") <= page).select(*keys, "summary")
        done = whole if done is None else done.unionByName(whole)
        more = said.where(F.col("total") > page)
        if not more.limit(1).count():
            return done
        texts, order = more.select(*keys, "page", F.col("summary").alias("text")).withColumnRenamed("page", "place"), ["place"]
