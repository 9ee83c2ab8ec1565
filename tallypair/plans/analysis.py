"""Summaries, statistics, similarity tables, themes and user functions as registered queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypair.fixtures import fixture, sql
from tallypair.functions import labels, user
from tallypair.operators import helpers, models, pictures, sampling, similarity, stats, summaries, trees, verdicts
from tallypair.plans.queries import BETWEEN, CELL_SQL, CELLS, COS, LEVELS, META, ORACLES, QUERIES, add, images, kept, rounded
from tallypair.sources.files import scratch

Get = Callable[[str], DataFrame]
TASKS = ["hotels", "houses", "people", "products"]
NAMES = ["competition", "textgrad", "feedback_descent"]


def panels(get: Get) -> DataFrame:
    return verdicts.judge_panel(get("judgements")).selectExpr("CAST(FLOOR(contest_id / 3) AS BIGINT) AS item", "CAST(contest_id % 3 AS INT) AS candidate", "winner", "score")


add("a3_candidate_tournament", lambda g: rounded(summaries.candidate_tournament(panels(g)), "score"), f"""
WITH p AS (SELECT contest_id // 3 AS item, CAST(contest_id % 3 AS INTEGER) AS candidate, CASE WHEN winner = 'A' THEN score ELSE 1 - score END AS own FROM ({ORACLES['a2_judge_panel']}))
SELECT item, candidate, round(own, 6) AS score, own > 0.5 AS beats_rival FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY own DESC, candidate) AS n FROM p) WHERE n = 1""")
add("a7_prompt_evolution", lambda g: summaries.prompt_evolution(g("rounds")), f"""
WITH r AS (SELECT *, CASE WHEN NOT failed THEN proposed_prompt END AS made FROM {sql('rounds')})
SELECT pair_key, round_number, last_value(made IGNORE NULLS) OVER (PARTITION BY pair_key ORDER BY round_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt_before,
  last_value(made IGNORE NULLS) OVER (PARTITION BY pair_key ORDER BY round_number ROWS UNBOUNDED PRECEDING) AS prompt_after, count(made) OVER (PARTITION BY pair_key ORDER BY round_number ROWS UNBOUNDED PRECEDING) AS images FROM r""")
add("a8_run_summary", lambda g: rounded(summaries.run_summary(verdicts.contest_trajectory(g("rounds")).withColumn("run", F.expr("pair_key % 5")), "run"), "mean_rounds", "mean_edits", "cost"), f"""
SELECT pair_key % 5 AS run, count(*) AS items, CAST(sum(edits_a + edits_b + 2) AS BIGINT) AS images, count(*) FILTER (equilibrium) AS equilibria, round(avg(rounds), 6) AS mean_rounds,
  round(avg(edits_a + edits_b), 6) AS mean_edits, round(CAST(sum(edits_a + edits_b + 2) AS DOUBLE) * CAST(0.039 AS DOUBLE), 6) AS cost FROM ({ORACLES['a5_contest_trajectory']}) GROUP BY 1""")
add("a11_set_task_counts", lambda g: summaries.set_task_counts(sampling.partition_into_sets(g("head2head").select("task", "pair_id"), 160, ["task"], "pair_id"), TASKS), f"""
SELECT set_number, {", ".join(f"count(*) FILTER (task = '{t}') AS {t}" for t in TASKS)}, count(*) AS total FROM ({ORACLES['k7_partition_into_sets']}) GROUP BY set_number""")


def differences(get: Get) -> DataFrame:
    return get("items").selectExpr("task AS category", "base", "concat(image_class, ' differs in ', status) AS differences")


BULLETS = f"""(SELECT category, page, count(*) AS n, string_agg('- ' || differences, chr(10) ORDER BY base) AS differences FROM (
  SELECT task AS category, base, concat(image_class, ' differs in ', status) AS differences, CAST((row_number() OVER (PARTITION BY task ORDER BY base) - 1) // 250 AS INTEGER) AS page FROM {sql('items')}) GROUP BY ALL)"""


def bullets(get: Get) -> DataFrame:
    return summaries.differences_by_category(differences(get), page=250)


def themes(get: Get) -> DataFrame:
    """A stand-in for a model's themes: a digest a page of a category's text."""
    digests = F.transform(F.array_sort(F.collect_list(F.struct("page", F.md5("differences").alias("digest")))), lambda x: x["digest"])
    return bullets(get).groupBy("category").agg(F.array_join(digests, ",").alias("themes"))


add("a13_differences_by_category", bullets, f"SELECT * FROM {BULLETS}")
add("a13_themes_by_category", lambda g: summaries.themes_by_category(differences(g), themes(g)), f"""
SELECT task AS category, base, concat(image_class, ' differs in ', status) AS differences, themes FROM {sql('items')} JOIN (SELECT category, string_agg(md5(differences), ',' ORDER BY page) AS themes FROM {BULLETS} GROUP BY category) t ON t.category = task""")

# --- statistics ----------------------------------------------------------------------------------
HUMAN = """(SELECT participant_id, pair_id % 701 AS pair, strategy, image1_status AS type, CAST(choice = 1 AS INTEGER) AS chosen FROM {0} UNION ALL SELECT participant_id, pair_id % 701, strategy, image2_status, CAST(choice = 2 AS INTEGER) FROM {0})""".format(sql("responses"))


def human(get: Get) -> DataFrame:
    return get("responses").selectExpr("participant_id", "pair_id % 701 AS pair", "strategy", "inline(array(struct(image1_status AS type, CAST(choice = 1 AS INT) AS chosen), struct(image2_status AS type, CAST(choice = 2 AS INT) AS chosen)))")


add("m4_twoway_clustered_se", lambda g: rounded(models.twoway_clustered_se(human(g), ["strategy", "type"], ["type"], "participant_id", "pair"), "emm", "se"), f"""
WITH h AS (SELECT * FROM {HUMAN}), c AS (SELECT strategy, type, avg(chosen) AS cell_mean, count(chosen) AS cell_n FROM h GROUP BY ALL), m AS (SELECT type, avg(cell_mean) AS emm, count(*) AS cells FROM c GROUP BY type),
e AS (SELECT participant_id, pair, type, (chosen - cell_mean) / cell_n / cells AS u FROM h JOIN c USING (strategy, type) JOIN m USING (type)),
v1 AS (SELECT type, sum(u * u) AS v1 FROM (SELECT type, participant_id, sum(u) AS u FROM e GROUP BY ALL) GROUP BY type), v2 AS (SELECT type, sum(u * u) AS v2 FROM (SELECT type, pair, sum(u) AS u FROM e GROUP BY ALL) GROUP BY type),
v3 AS (SELECT type, sum(u * u) AS v12 FROM (SELECT type, participant_id, pair, sum(u) AS u FROM e GROUP BY ALL) GROUP BY type),
f AS (SELECT (N - 1) / CAST(N - K AS DOUBLE) * g / CAST(g - 1 AS DOUBLE) AS factor FROM (SELECT count(*) AS N, least(count(DISTINCT participant_id), count(DISTINCT pair)) AS g FROM h), (SELECT count(*) AS K FROM c))
SELECT type, round(emm, 6) AS emm, round(sqrt(greatest((v1 + v2 - v12) * factor, 0)), 6) AS se, (v1 + v2 - v12) * factor < 0 AS clipped FROM m JOIN v1 USING (type) JOIN v2 USING (type) JOIN v3 USING (type), f""")


def tested(get: Get) -> DataFrame:
    df = get("verdicts").where("choice <> 'inconsistent'").agg((F.countDistinct("pair_id") - 1).alias("df"))
    return stats.contrasts(kept(get), CELLS, "type", ["strategy"], LEVELS).crossJoin(F.broadcast(df))


# SQL lacks the t distribution: p by Simpson's rule over the angle (x = sqrt(df) tan(angle)), the quantile by
# its expansion in 1 / df around the normal one, which is exact to 1e-11 from 50 degrees of freedom on
Z = "1.959963984540054e0"
QUANTILE = (
    "(z + (z ** 3 + z) / (4 * {0}) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * {0} ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * {0} ** 3)"
    " + (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / (92160 * {0} ** 4))"
).replace("z", Z)
P_OF_T = """least(1, 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * (SELECT sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp((df - 1) * ln(cos(a0 + (a1 - a0) * i / 4000)))) * (a1 - a0) / 4000 / 3 FROM range(4001) r(i)))"""
add_rows_only = lambda name, make: (add(name, make, ""), ORACLES.pop(name))
add("m8_t_interval_p", lambda g: rounded(models.t_interval_p(tested(g)), "estimate", "se", "t", "p", "low", "high"), f"""
WITH d AS (SELECT CAST(count(DISTINCT pair_id) - 1 AS DOUBLE) AS df FROM {sql('verdicts')} WHERE choice <> 'inconsistent'), c AS (SELECT * FROM ({ORACLES['m6_contrasts'].replace('round(mb.emm - ma.emm, 6)', 'mb.emm - ma.emm').replace('round(sqrt(s * factor), 6)', 'sqrt(s * factor)')})),
t AS (SELECT c.*, df, estimate / se AS t, atan(abs(estimate / se) / sqrt(df)) AS a0, least(pi() / 2 - 1e-12, atan(abs(estimate / se) / sqrt(df)) + 20 / sqrt(df)) AS a1 FROM c, d)
SELECT strategy, contrast, round(estimate, 6) AS estimate, round(se, 6) AS se, CAST(df AS BIGINT) AS df, round(t, 6) AS t, round({P_OF_T}, 6) AS p, round(estimate - se * {QUANTILE.format('df')}, 6) AS low, round(estimate + se * {QUANTILE.format('df')}, 6) AS high FROM t""")
add("m9_delta_table", lambda g: rounded(models.delta_table(stats.marginal_means(stats.cell_means(kept(g), CELLS), ["strategy", "type"]), stats.contrasts(kept(g), CELLS, "type", ["strategy"], LEVELS), ["strategy"], "type"), "emm", "delta", "se"), f"""
WITH t AS ({ORACLES['m6_contrasts']}), s AS (SELECT strategy, split_part(contrast, ' - ', 1) AS type, split_part(contrast, ' - ', 2) AS best, estimate, se FROM t
  UNION ALL SELECT strategy, split_part(contrast, ' - ', 2), split_part(contrast, ' - ', 1), -estimate, se FROM t),
m AS (SELECT strategy, type, avg(cell_mean) AS emm FROM {CELL_SQL} GROUP BY ALL), b AS (SELECT *, first_value(type) OVER (PARTITION BY strategy ORDER BY emm DESC, type) AS best FROM m)
SELECT b.strategy, b.type, round(emm, 6) AS emm, round(coalesce(estimate, 0), 6) AS delta, se, b.type = b.best AS is_best FROM b LEFT JOIN s ON s.strategy = b.strategy AND s.type = b.type AND s.best = b.best""")
add("m10_pivot_levels", lambda g: rounded(models.pivot_levels(stats.marginal_means(stats.cell_means(kept(g), CELLS), ["model", "type"]), ["model"], "type", LEVELS), *LEVELS), f"""
SELECT model, {", ".join(f'round(avg(cell_mean) FILTER (type = {chr(39)}{x}{chr(39)}), 6) AS "{x}"' for x in LEVELS)} FROM {CELL_SQL} GROUP BY model""")
add("m11_final_by_task", lambda g: models.final_by_task(stats.marginal_means(stats.cell_means(kept(g), CELLS), ["model", "task", "strategy", "type"]), TASKS, NAMES), f"""
WITH p AS (SELECT *, round(cell_mean * 100, 1) AS percent FROM {CELL_SQL} WHERE type = 'final'), s AS (SELECT *, printf('%.1f', percent) || CASE WHEN percent = max(percent) OVER (PARTITION BY model, task) THEN '*' ELSE '' END AS said FROM p)
SELECT model, {", ".join(f"max(said) FILTER (task = '{t}' AND strategy = '{s}') AS {t}_{s}" for t in TASKS for s in NAMES)} FROM s GROUP BY model""")
NEW = f"SELECT participant_id, task, image1_status, image2_status, choice, 3 AS k FROM {sql('responses')} WHERE pair_id % 2 = 0 UNION ALL SELECT participant_id, task, image1_status, image2_status, choice, 0 FROM {sql('responses')} WHERE pair_id % 2 = 1 AND image1_status <> 'zero-shot' AND image2_status <> 'zero-shot'"
add("m15_human_mitigation_union", lambda g: models.human_mitigation_union(g("responses").where("pair_id % 2 = 0"), g("responses").where("pair_id % 2 = 1")), f"""
WITH n AS ({NEW}) SELECT participant_id, task, k, image1_status AS type, CAST(choice = 1 AS INTEGER) AS chosen FROM n UNION ALL SELECT participant_id, task, k, image2_status, CAST(choice = 2 AS INTEGER) FROM n""")
add("m16_stack_tasks", lambda g: rounded(stats.marginal_means(stats.cell_means(kept(g), CELLS), ["task", "type"]).withColumn("task", labels.title_case("task")), "emm"), f"""
SELECT upper(substr(task, 1, 1)) || substr(task, 2) AS task, type, round(avg(cell_mean), 6) AS emm, count(*) AS cells FROM {CELL_SQL} GROUP BY ALL""")

# --- similarity ----------------------------------------------------------------------------------
ORIGINAL = f"""(WITH v AS (SELECT dataset, current_base_id, debiased_iter, current_id LIKE '%\\_final' ESCAPE '\\' AS is_final, min(image_path) AS p FROM {META} WHERE debiased_iter IS NOT NULL GROUP BY ALL)
SELECT v.current_base_id, v.debiased_iter, is_final, o.image_path AS path_a, i.image_path AS path_b, {COS.format('o.embedding', 'i.embedding')} AS similarity
FROM v JOIN {META} o ON o.debiased_iter IS NULL AND o.dataset = v.dataset AND o.current_base_id = v.current_base_id JOIN {META} i ON i.image_path = v.p)"""
STACKED = f"""(SELECT pair_key, NULL AS current_base_id, debiased_iter, NULL AS is_final, path_a, path_b, similarity, 'between_pairs' AS comparison, 'cosine' AS metric FROM {BETWEEN}
  UNION ALL SELECT NULL, current_base_id, debiased_iter, is_final, path_a, path_b, similarity, 'from_original', 'cosine' FROM {ORIGINAL})"""


def both(get: Get) -> DataFrame:
    return similarity.similarity_long(similarity.between_pairs(similarity.valid_pairs(images(get))), similarity.from_original(images(get)), "cosine")


add("v7_similarity_long", lambda g: rounded(both(g), "similarity"), f"SELECT * REPLACE (round(similarity, 6) AS similarity) FROM {STACKED}")
add("v8_harmonize_metrics", lambda g: rounded(similarity.harmonize_metrics([both(g), both(g).withColumn("distance", 1 - F.col("similarity")).withColumn("metric", F.lit("distance")).drop("similarity")]).select("metric", "label", "path_a", "path_b", "score"), "score"), f"""
WITH s AS (SELECT metric, similarity AS score, * EXCLUDE (metric, similarity) FROM {STACKED} UNION ALL SELECT 'distance', 1 - similarity, * EXCLUDE (metric, similarity) FROM {STACKED})
SELECT metric, CASE WHEN comparison = 'between_pairs' THEN 'Between pairs' WHEN is_final THEN 'Final to original' ELSE 'Original to original' END AS label, path_a, path_b, round(score, 6) AS score FROM s""")
add("v6_t_ci_stats", lambda g: rounded(models.t_ci_stats(both(g), ["metric", "comparison", "debiased_iter"], "similarity"), "mean", "sd", "se", "low", "high"), f"""
WITH g AS (SELECT metric, comparison, debiased_iter, avg(similarity) AS m, stddev_samp(similarity) AS sd, count(similarity) AS n, CAST(count(similarity) - 1 AS DOUBLE) AS df FROM {STACKED} GROUP BY ALL)
SELECT metric, comparison, debiased_iter, round(m, 6) AS mean, round(sd, 6) AS sd, n, round(sd / sqrt(n), 6) AS se, round(m - sd / sqrt(n) * {QUANTILE.format('df')}, 6) AS low, round(m + sd / sqrt(n) * {QUANTILE.format('df')}, 6) AS high FROM g""")


def halves(get: Get) -> tuple[DataFrame, DataFrame]:
    rows = get("images").alias("a").join(get("images").alias("b"), F.expr("a.vec_id + 1 = b.vec_id")).selectExpr("a.vec_id AS vec_id", "a.embedding AS x", "b.embedding AS y")
    return rows, rows.where("vec_id % 3 = 0").selectExpr("vec_id", "CAST(vec_id AS DOUBLE) / 1000 AS similarity")


add("v9_incremental_scores", lambda g: rounded(similarity.incremental_scores(*halves(g), similarity.cosine("x", "y"), ["vec_id"]), "similarity"), f"""
SELECT a.vec_id, round(CASE WHEN a.vec_id % 3 = 0 THEN CAST(a.vec_id AS DOUBLE) / 1000 ELSE {COS.format('a.embedding', 'b.embedding')} END, 6) AS similarity FROM {sql('images')} a JOIN {sql('images')} b ON a.vec_id + 1 = b.vec_id""")
add("v10_representation_gaps", lambda g: similarity.representation_gaps(images(g).withColumn("embedding", F.expr("CASE WHEN vec_id % 7 <> 0 THEN embedding END"))), f"""
WITH i AS (SELECT *, vec_id % 7 = 0 AS bare FROM {META}), o AS (SELECT DISTINCT dataset, current_base_id FROM i WHERE debiased_iter IS NULL AND NOT bare)
SELECT count(*) AS rows, count(*) FILTER (bare) AS no_vector, count(*) FILTER (o.dataset IS NULL) AS no_original FROM i LEFT JOIN o ON o.dataset = i.dataset AND o.current_base_id = i.current_base_id WHERE debiased_iter IS NOT NULL""")

# --- themes from given labels --------------------------------------------------------------------
CLUSTERS = "concat(task, '-', strategy) AS grp", "pair_id AS item", "level", "CAST(CASE level WHEN 1 THEN pair_id % 97 WHEN 2 THEN pair_id % 97 % 11 ELSE 0 END AS INT) AS cluster_id", "concat('t', CAST(pair_id AS STRING)) AS text"
LABELS = f"(SELECT {', '.join(CLUSTERS)} FROM {sql('verdicts')}, (VALUES (1), (2), (3)) l(level))"


def clustered(get: Get) -> DataFrame:
    return get("verdicts").withColumn("level", F.explode(F.array(*[F.lit(x) for x in (1, 2, 3)]))).selectExpr(*CLUSTERS)


def told(get: Get) -> DataFrame:
    return clustered(get).select("grp", "level", "cluster_id").distinct().withColumn("summary", F.concat_ws(":", "grp", "level", "cluster_id"))


TOLD = f"(SELECT DISTINCT grp, level, cluster_id, concat_ws(':', grp, level, cluster_id) AS summary FROM {LABELS})"
add("t1_level_sizes", lambda g: g("verdicts").groupBy("task").agg(F.count(F.lit(1)).alias("n")).select("task", F.posexplode(summaries.level_sizes(F.col("n"))).alias("place", "size")), f"""
WITH c AS (SELECT task, count(*) AS n FROM {sql('verdicts')} GROUP BY task), s AS (SELECT DISTINCT task, CAST(ceil(n / pow(2, k)) AS BIGINT) AS size FROM c, range(1, 63) r(k))
SELECT task, CAST(row_number() OVER (PARTITION BY task ORDER BY size DESC) - 1 AS INTEGER) AS place, size FROM s""")
add("t3_cluster_members", lambda g: summaries.cluster_members(clustered(g), ["grp"], "item", 500).withColumn("members", F.concat_ws(",", F.transform("members", lambda x: x.cast("string")))), f"""
SELECT grp, level, cluster_id, page, any_value(size) AS cluster_size, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS members
FROM (SELECT *, CAST((row_number() OVER c - 1) // 500 AS INTEGER) AS page, count(*) OVER (PARTITION BY grp, level, cluster_id) AS size FROM {LABELS} WINDOW c AS (PARTITION BY grp, level, cluster_id ORDER BY item)) GROUP BY grp, level, cluster_id, page""")
add("t4_cluster_sources", lambda g: summaries.cluster_sources(clustered(g), told(g), ["grp"], "item"), f"""
WITH l AS (SELECT * FROM {LABELS}), r AS (SELECT grp, level, cluster_id, item AS part, text AS source FROM l WHERE level = 1
  UNION SELECT l.grp, l.level, l.cluster_id, p.cluster_id, s.summary FROM l JOIN l p ON p.grp = l.grp AND p.item = l.item AND p.level = l.level - 1 JOIN {TOLD} s ON s.grp = p.grp AND s.level = p.level AND s.cluster_id = p.cluster_id)
SELECT *, count(*) OVER (PARTITION BY grp, level, cluster_id) = 1 AS alone FROM r""")
add("t5_item_levels", lambda g: summaries.item_levels(clustered(g), told(g), ["grp"], "item", [1, 2, 3]), f"""
SELECT grp, item, {", ".join(f"max(concat_ws(':', grp, level, cluster_id)) FILTER (level = {x}) AS level_{x}" for x in (1, 2, 3))} FROM {LABELS} GROUP BY grp, item""")


# --- user functions, with deterministic models ---------------------------------------------------
def load_judge() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Prefers the item of larger text, and the first shown where the two ends are alike."""

    def judge(batch: pd.DataFrame) -> pd.DataFrame:
        alike = batch["first"].str[-1] == batch["second"].str[-1]
        first = alike | (batch["first"] > batch["second"])
        out = batch.assign(choice=first.map({True: "first", False: "second"}), reason="saw " + batch["first"], completion_tokens=1, prompt_tokens=2, total_tokens=3, reasoning_tokens=0)
        return out

    return judge


def load_encoder() -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda batch: pd.DataFrame({"pair_id": batch["pair_id"], "embedding": [[float(len(t)), float(t.count("_"))] for t in batch["base1"]]})


def load_summarizer() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The number of texts, and the first of them."""
    return lambda batch: batch.drop(columns="texts").assign(summary=[f"{len(t)} from {min(t)}" for t in batch["texts"]])


add("u1_judge_pairs", lambda g: user.judge_pairs(g("verdicts").selectExpr("pair_id", "base1 AS shown_a", "base2 AS shown_b"), load_judge, ["pair_id"]), f"""
SELECT pair_id, CASE WHEN right(base1, 1) = right(base2, 1) THEN 'inconsistent' WHEN base1 > base2 THEN 'A' ELSE 'B' END AS choice,
  CASE WHEN right(base1, 1) = right(base2, 1) THEN 'Judge 1: saw ' || base1 || ' Judge 2: saw ' || base2 WHEN base1 > base2 THEN 'saw ' || base1 ELSE 'saw ' || base2 END AS reason,
  CAST(2 AS BIGINT) AS completion_tokens, CAST(4 AS BIGINT) AS prompt_tokens, CAST(6 AS BIGINT) AS total_tokens, CAST(0 AS BIGINT) AS reasoning_tokens FROM {sql('verdicts')}""")
add("u2_encode", lambda g: user.encode(g("verdicts"), load_encoder, ["pair_id"], "base1").selectExpr("pair_id", "embedding[0] AS x", "embedding[1] AS y"), f"""
SELECT pair_id, CAST(length(base1) AS DOUBLE) AS x, CAST(length(base1) - length(replace(base1, '_', '')) AS DOUBLE) AS y FROM {sql('verdicts')}""")
add("u3_summarize_clusters", lambda g: user.summarize_clusters(summaries.cluster_sources(clustered(g), told(g), ["grp"], "item"), load_summarizer, ["grp", "level", "cluster_id"]), f"""
SELECT grp, level, cluster_id, count(*) || ' from ' || min(source) AS summary FROM ({ORACLES["t4_cluster_sources"]}) GROUP BY grp, level, cluster_id""")


# --- numpy helpers: compared with plain computations in the tests ---------------------------------
def head2head(get: Get) -> DataFrame:
    return stats.head2head_long(get("head2head"))


def themed(get: Get) -> DataFrame:
    return get("vectors").selectExpr("concat('g', CAST(label AS STRING)) AS grp", "vec_id", "embedding")


add_rows_only("m5_fixed_effect_fit", lambda g: rounded(helpers.fixed_effect_fit(head2head(g), ["strategy", "model"], "task"), "emm", "se"))
add_rows_only("v4_ssim", lambda g: rounded(halves(g)[0].select("vec_id", helpers.ssim(F.transform("x", lambda v: (v + 1) * 127.5), F.transform("y", lambda v: (v + 1) * 127.5)).alias("similarity")), "similarity"))


# --- pictures of 64 rows of 64 pixels, from the vectors -------------------------------------------
GRAY = "CAST(FLOOR((CAST(x AS DOUBLE) + 1) * 127.5) AS INT)"


def picture_folder(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A bitmap for each 64 vectors: their components as red, 255 less it as green, half of it as blue."""
    folder = scratch(spark, "pictures")
    rows = fixture(spark, sf_dir, "vectors").selectExpr("CAST(FLOOR(vec_id / 64) AS BIGINT) AS name", "vec_id", f"transform(embedding, x -> least(greatest({GRAY}, 0), 255)) AS red")
    rows = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("vec_id", "red"))).alias("rows"))
    pixels = F.flatten(F.transform(F.flatten(F.transform("rows", lambda r: r["red"])), lambda v: F.array(v, 255 - v, F.floor(v / 2).cast("int"))))
    hexed = F.unhex(F.array_join(F.transform(pixels, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    written = pictures.write_bitmaps(rows.select(F.col("name").cast("string").alias("name"), F.size("rows").alias("height"), F.lit(64).alias("width"), hexed.alias("pixels")), folder)
    return folder, written


def picture_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = picture_folder(spark, sf_dir)
    read = pictures.pixel_statistics(pictures.picture_planes(spark, folder, None))
    return read.withColumn("name", F.regexp_extract("path", "([0-9]+)[.]bmp$", 1)).drop("path")


def picture_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture against the next: only the pixels' resizing and similarity, which SQL lacks."""
    folder, written = picture_folder(spark, sf_dir)
    named = written.withColumn("name", F.regexp_extract("path", "([0-9]+)[.]bmp$", 1).cast("long"))
    origin = lambda n: F.concat(F.lit(folder + "/"), n.cast("string"), F.lit(".bmp"))
    pairs = named.select("name", origin(F.col("name")).alias("path_a"), origin(F.col("name") + 1).alias("path_b"))
    return rounded(pictures.image_pair_scores(pairs, folder).select("name", "similarity"), "similarity")


QUERIES["v4_picture_statistics"] = picture_statistics
ORACLES["v4_picture_statistics"] = f"""
WITH p AS (SELECT CAST(vec_id // 64 AS VARCHAR) AS name, vec_id, unnest(list_transform(embedding, lambda x: least(greatest(CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INTEGER), 0), 255))) AS v FROM {sql('vectors')})
SELECT name, CAST(count(DISTINCT vec_id) AS INTEGER) AS height, 64 AS width, CAST(sum(v) AS BIGINT) AS red, CAST(sum(255 - v) AS BIGINT) AS green, CAST(sum(v // 2) AS BIGINT) AS blue FROM p GROUP BY name"""
QUERIES["v4_picture_similarity"] = picture_similarity
add_rows_only("t2_hierarchical_levels", lambda g: trees.hierarchical_levels(themed(g), ["grp"], "vec_id"))
