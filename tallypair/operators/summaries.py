"""Tournaments, prompt histories, run summaries and theme texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallypair.operators.ranks import beside, pages

#: Fixed value: the published price of an image, in dollars.
IMAGE_COST = 0.039


def candidate_tournament(panels: DataFrame) -> DataFrame:
    """From panels ``item, candidate, winner, score`` of each candidate (A) against the rival: the score is
    turned around if it lost. The best candidate (the first on ties) even if all lost."""
    own = F.when(F.col("winner") == "A", F.col("score")).otherwise(1 - F.col("score"))
    best = panels.withColumn("own", own).groupBy("item").agg(F.max(F.struct("own", -F.col("candidate"))).alias("best"))
    return best.select("item", (-F.col("best")["col2"]).alias("candidate"), F.col("best.own").alias("score"), (F.col("best.own") > 0.5).alias("beats_rival"))


def prompt_evolution(steps: DataFrame) -> DataFrame:
    """Prompt before and after each step, and the images made so far; failed steps change nothing."""
    order = Window.partitionBy("pair_key").orderBy("round_number")
    made = F.when(~F.col("failed"), F.col("proposed_prompt"))
    up_to, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    return steps.select("pair_key", "round_number", F.last(made, True).over(before).alias("prompt_before"), F.last(made, True).over(up_to).alias("prompt_after"), F.count(made).over(up_to).alias("images"))


def run_summary(trajectories: DataFrame, run: str) -> DataFrame:
    """Items, images (two to start with and one an edit), their cost, equilibria, mean rounds and edits."""
    edits = F.col("edits_a") + F.col("edits_b")
    out = trajectories.groupBy(run).agg(
        F.count(F.lit(1)).alias("items"), F.sum(edits + 2).alias("images"), F.count_if("equilibrium").alias("equilibria"),
        F.avg("rounds").alias("mean_rounds"), F.avg(edits).alias("mean_edits"),
    )
    return out.withColumn("cost", F.col("images") * F.lit(IMAGE_COST))


def set_task_counts(sets: DataFrame, tasks: list[str]) -> DataFrame:
    """Pairs of each set by task, zeros included, and their total."""
    wide = sets.groupBy("set_number").pivot("task", tasks).count().na.fill(0)
    total = F.lit(0)
    for t in tasks:
        total = total + F.col(f"`{t}`")
    return wide.withColumn("total", total)


def differences_by_category(rows: DataFrame, key: str = "base", page: int = 20_000) -> DataFrame:
    """``category, page, n, differences``: the bulleted text of a category for a summarizer, in the order of
    ``key``. Each ``page`` rows of a category are a text of their own, numbered from 0, so no task holds
    more than a page; the texts of a category, joined by line ends, are its text."""
    said = pages(rows.select("category", key, "differences"), ["category"], [key, "differences"], page)
    said = said.groupBy("category", "page").agg(F.array_sort(F.collect_list(F.struct(key, "differences"))).alias("said"))
    text = F.array_join(F.transform("said", lambda x: F.concat(F.lit("- "), x["differences"])), "\n")
    return said.select("category", "page", F.size("said").cast("long").alias("n"), text.alias("differences"))


def themes_by_category(rows: DataFrame, themes: DataFrame) -> DataFrame:
    """Each row with its category's theme text (null if it has none)."""
    return rows.join(themes.select("category", "themes"), "category", "left")


def level_sizes(n: Column) -> Column:
    """Cluster counts n/2, n/4, ... rounded up, strictly decreasing to 1."""
    halves = F.transform(F.sequence(F.lit(1), F.lit(62)), lambda k: F.ceil(n / F.pow(F.lit(2.0), k)).cast("long"))
    return F.array_distinct(halves)


def cluster_members(labels: DataFrame, group: list[str], item: str, page: int = 10_000) -> DataFrame:
    """Size and items, in order, of every cluster of every level: a row for each ``page`` items, numbered from
    0. The top level's cluster holds its whole group, so only its pages are ever in a task."""
    keys = [*group, "level", "cluster_id"]
    return pages(labels.select(*keys, item), keys, [item], page).groupBy(*keys, "page").agg(F.max("total").alias("cluster_size"), F.sort_array(F.collect_list(item)).alias("members"))


def cluster_sources(labels: DataFrame, summaries: DataFrame, group: list[str], item: str) -> DataFrame:
    """What each cluster of a level is told: at level 1 its items' texts, later the summaries of the level
    before, each once. ``alone`` marks a single source, which passes unsummarized."""
    keys = [*group, item]
    before = labels.select(*keys, (F.col("level") + 1).alias("level"), F.col("cluster_id").alias("prior"))
    told = labels.join(before, [*keys, "level"], "left")
    known = summaries.select(*group, (F.col("level") + 1).alias("level"), F.col("cluster_id").alias("prior"), "summary")
    told = told.join(known, [*group, "level", "prior"], "left").withColumn("source", F.when(F.col("level") == 1, F.col("text")).otherwise(F.col("summary")))
    rows = told.select(*group, "level", "cluster_id", F.when(F.col("level") == 1, F.col(item)).otherwise(F.col("prior")).alias("part"), "source").distinct()
    keys = [*group, "level", "cluster_id"]
    return beside(rows, rows.groupBy(*keys).agg((F.count(F.lit(1)) == 1).alias("alone")), keys)


def item_levels(labels: DataFrame, summaries: DataFrame, group: list[str], item: str, levels: list[int]) -> DataFrame:
    """One row an item, a column a level with the summary of its cluster there."""
    rows = labels.join(summaries, [*group, "level", "cluster_id"]).groupBy(*group, item).pivot("level", levels).agg(F.first("summary"))
    return rows.select(*group, item, *[F.col(f"`{x}`").alias(f"level_{x}") for x in levels])
