"""Verdicts from judgements in both presentation orders, and replays of optimization logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallypair.functions.parse import seeded


def collapse_orders(judgements: DataFrame, keys: list[str], strategies: bool = False) -> DataFrame:
    """Two judgements, one in each order, to a verdict: the item that both chose (A or B), else
    ``inconsistent``. The reason is that of the order in which the winner was shown first, or both
    judges' by name; with ``strategies`` that of the first order, or both joined by a bar. Tokens are
    summed, reasoning tokens only if both are known."""
    item = F.when((F.col("choice") == "first") == F.col("is_a_first"), "A").otherwise("B")
    a, b = F.max(F.when(F.col("is_a_first"), item)), F.max(F.when(~F.col("is_a_first"), item))
    r1, r2 = F.max(F.when(F.col("is_a_first"), F.col("reason"))), F.max(F.when(~F.col("is_a_first"), F.col("reason")))
    known = F.count("reasoning_tokens") == 2
    out = judgements.groupBy(*keys).agg(
        a.alias("a"), b.alias("b"), r1.alias("r1"), r2.alias("r2"),
        *[F.sum(c).alias(c) for c in ("completion_tokens", "prompt_tokens", "total_tokens")],
        F.when(known, F.sum("reasoning_tokens")).otherwise(0).cast("long").alias("reasoning_tokens"),
    )
    agree = F.col("a") == F.col("b")
    if strategies:
        reason = F.when(agree, F.col("r1")).otherwise(F.concat("r1", F.lit(" | "), "r2"))
    else:
        reason = F.when(agree & (F.col("a") == "A"), F.col("r1")).when(agree, F.col("r2")).otherwise(F.concat(F.lit("Judge 1: "), F.col("r1"), F.lit(" Judge 2: "), F.col("r2")))
    return out.select(*keys, F.when(agree, F.col("a")).otherwise("inconsistent").alias("choice"), reason.alias("reason"), "completion_tokens", "prompt_tokens", "total_tokens", "reasoning_tokens")


def judge_panel(judgements: DataFrame, tie: str = "A") -> DataFrame:
    """Winner by the consistent judges' votes, score = its votes / consistent judges; 0.5 and the tie rule
    if none or equal: A, B, or ``random``, which the hash of the contest's id decides. Feedback: the winner's
    A-first reasons by judge."""
    tied = F.when(F.conv(F.substring(seeded(42, "contest_id"), 1, 1), 16, 10).cast("int") % 2 == 0, "A").otherwise("B") if tie == "random" else F.lit(tie)
    each = collapse_orders(judgements, ["contest_id", "judge_id"]).join(
        judgements.where("is_a_first").select("contest_id", "judge_id", F.col("reason").alias("said")), ["contest_id", "judge_id"]
    )
    votes = each.groupBy("contest_id").agg(
        F.count_if(F.col("choice") == "A").alias("a"), F.count_if(F.col("choice") == "B").alias("b"),
        F.sort_array(F.collect_list(F.when(F.col("choice") != "inconsistent", F.struct("judge_id", "choice", "said")))).alias("said"),
    )
    n = F.col("a") + F.col("b")
    winner = F.when(F.col("a") > F.col("b"), "A").when(F.col("b") > F.col("a"), "B").otherwise(tied)
    out = votes.withColumn("winner", winner).withColumn("score", F.when(n == 0, F.lit(0.5)).otherwise(F.greatest("a", "b") / n))
    texts = F.transform(F.filter("said", lambda x: x["choice"] == F.col("winner")), lambda x: x["said"])
    feedback = F.when(n == 0, "No consistent preference detected.").otherwise(F.array_join(texts, "\n"))
    return out.select("contest_id", "winner", "score", n.alias("consistent"), feedback.alias("feedback"))


def retry_consensus(judgements: DataFrame, most: int = 3) -> DataFrame:
    """The first of up to ``most`` attempts whose two orders agree, else ``current_best``."""
    each = collapse_orders(judgements.where(F.col("judge_id") < most), ["contest_id", "judge_id"])
    first = F.min_by(F.when(F.col("choice") != "inconsistent", F.col("choice")), F.when(F.col("choice") != "inconsistent", F.col("judge_id")))
    return each.groupBy("contest_id").agg(F.coalesce(first, F.lit("current_best")).alias("winner"))


def _contest_rounds(rounds: DataFrame, threshold: float, least: int, most: int) -> DataFrame:
    """The rounds up to the one that stops, with ``stop``, ``equilibrium`` and the side ``edited`` after it:
    the loser, but nobody after an equilibrium."""
    rounds = rounds.withColumn("round_number", F.col("round_number").cast("long"))
    own = Window.partitionBy("pair_key")
    hit = F.min(F.when((F.col("round_number") >= least) & (F.col("winner_score") < threshold), F.col("round_number"))).over(own)
    kept = rounds.withColumn("stop", F.least(F.coalesce(hit, F.lit(most)), F.lit(most))).withColumn("equilibrium", hit.isNotNull() & (hit <= most)).where("round_number <= stop")
    edited = F.when((F.col("round_number") < F.col("stop")) | ~F.col("equilibrium"), F.when(F.col("winner") == "A", "B").otherwise("A"))
    return kept.withColumn("edited", edited)


def contest_trajectory(rounds: DataFrame, threshold: float = 0.51, least: int = 10, most: int = 30) -> DataFrame:
    """Replay round logs: stop at the first round from ``least`` on whose score is under the threshold, or
    at ``most``; winners of the first and last round kept, edits of each side (a round's loser is edited
    unless it is the last)."""
    return _contest_rounds(rounds, threshold, least, most).groupBy("pair_key").agg(
        F.min_by("winner", "round_number").alias("zero_shot_winner"), F.max_by("winner", "round_number").alias("final_winner"), F.count(F.lit(1)).alias("rounds"),
        F.max("equilibrium").alias("equilibrium"), F.count_if(F.col("edited") == "A").alias("edits_a"), F.count_if(F.col("edited") == "B").alias("edits_b"),
        F.max(F.when(F.col("winner") == "A", F.col("round_number"))).alias("champion_a"), F.max(F.when(F.col("winner") == "B", F.col("round_number"))).alias("champion_b"),
    )


def contest_edits(rounds: DataFrame, threshold: float = 0.51, least: int = 10, most: int = 30) -> DataFrame:
    """Every edit of a contest: the round it followed, the side, and whether that side won the next round;
    null if there is none, or if it lost the round of the equilibrium, which stops before it is noted."""
    rows = _contest_rounds(rounds, threshold, least, most)
    order = Window.partitionBy("pair_key").orderBy("round_number")
    nxt = F.lead("winner").over(order)
    won = F.when(nxt == F.col("edited"), True).when(F.col("equilibrium") & (F.lead("round_number").over(order) == F.col("stop")), None).when(nxt.isNotNull(), False)
    return rows.withColumn("won_next_round", won).where("edited is not null").select("pair_key", "round_number", F.col("edited").alias("side"), "won_next_round")


def descent_trajectory(steps: DataFrame, patience: int = 10, most: int = 30) -> DataFrame:
    """Replay accept/reject logs: failed steps don't count; stop when ``patience`` steps in a row don't
    improve, or at ``most``; best prompt, improvements and rejects since the last improvement, and those
    rejects' prompts, oldest first (``history``: what the next proposal would be told)."""
    order = Window.partitionBy("pair_key").orderBy("round_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.where((F.col("round_number") <= most)).withColumn("island", F.sum(F.col("improved").cast("int")).over(order))
    run = Window.partitionBy("pair_key", "island").orderBy("round_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("idle", F.sum((~F.col("failed") & ~F.col("improved")).cast("int")).over(run))
    stop = F.min(F.when(F.col("idle") >= patience, F.col("round_number"))).over(Window.partitionBy("pair_key"))
    rows = rows.withColumn("stop", stop).where("stop is null or round_number <= stop")
    tried = F.when(~F.col("failed") & ~F.col("improved"), F.struct("island", "round_number", "proposed_prompt"))
    out = rows.groupBy("pair_key").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if("improved").alias("improvements"),
        F.max_by(F.when(F.col("improved"), F.col("proposed_prompt")), F.when(F.col("improved"), F.col("round_number"))).alias("best_prompt"),
        F.max_by("idle", "round_number").alias("rejects_since"), F.max(F.col("stop").isNotNull()).alias("out_of_patience"),
        F.sort_array(F.collect_list(tried)).alias("tried"), F.max("island").alias("island"),
    )
    history = F.transform(F.filter("tried", lambda t: t["island"] == F.col("island")), lambda t: t["proposed_prompt"])
    return out.withColumn("history", F.array_join(history, "\n")).drop("tried", "island")


def comparison_type_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.least("status1", "status2").alias("type1"), F.greatest("status1", "status2").alias("type2")).agg(F.count(F.lit(1)).alias("n"))


def survey_summary(responses: DataFrame) -> DataFrame:
    """Participants, responses and responses a participant, over all and by strategy and task."""
    return responses.groupingSets([["strategy", "task"], []], "strategy", "task").agg(
        F.countDistinct("participant_id").alias("participants"), F.count(F.lit(1)).alias("responses"),
        F.round(F.count(F.lit(1)) / F.countDistinct("participant_id"), 6).alias("mean_responses"),
    )
