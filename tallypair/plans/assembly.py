"""Names, joins, manifests and samples as registered queries, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypair.fixtures import fixture, sql
from tallypair.functions import labels, parse
from tallypair.operators import assembly, pairing, stats
from tallypair.plans.queries import CELL_SQL, CELLS, J1, QUERIES, add, kept, rounded
from tallypair.sources.files import scratch

Get = Callable[[str], DataFrame]

ITEM_NAMES = f"(SELECT concat(replace(task, ' ', ''), '_', image_id, '_', status, '.jpg') AS file_name FROM {sql('items')})"
DEBIASED = f"(SELECT regexp_extract(image_path, '[^/]+$') AS file_name FROM {sql('images')})"
DEBIAS_FORM = r"^([A-Za-z_]+)_([a-z0-9]+)_(original|zero-shot|final)_vs_([a-z0-9]+)_(original|zero-shot|final)_iter([0-9]+)_debiased_([12])\.jpg$"
SIDES = "(SELECT * FROM (SELECT file_name, " + ", ".join(
    f"{'CAST(' * (i > 5)}regexp_extract(file_name, '{DEBIAS_FORM}', {i}){' AS INTEGER)' * (i > 5)} AS {c}" for i, c in enumerate(("category", "id1", "status1", "id2", "status2", "iteration", "side"), 1)
) + f" FROM {DEBIASED} WHERE regexp_matches(file_name, '{DEBIAS_FORM}')))"


def item_names(get: Get) -> DataFrame:
    return get("items").selectExpr("concat(replace(task, ' ', ''), '_', image_id, '_', status, '.jpg') AS file_name")


def debiased(get: Get) -> DataFrame:
    return labels.parse_debias_name(get("images").selectExpr("regexp_extract(image_path, '[^/]+$', 0) AS file_name"))


def products(get: Get) -> DataFrame:
    return get("items").selectExpr("image_id AS item_id", "concat('[{\"language\":\"en\",\"value\":\"', task, '\"}]') AS product_type", "CAST(image_id AS BIGINT) AS main_image_id")


add("p2_parse_final_name", lambda g: labels.parse_final_name(item_names(g)), f"""
SELECT * FROM (SELECT file_name, regexp_extract(file_name, '^([A-Za-z]+)_([a-z0-9]+)_final\\.jpg$', 1) AS category, regexp_extract(file_name, '^([A-Za-z]+)_([a-z0-9]+)_final\\.jpg$', 2) AS image_id FROM {ITEM_NAMES}) WHERE category <> ''""")
STATUS_FORM = "^([A-Za-z_]+)_([a-z0-9]+)_(original|zero-shot|final)\\.jpg$"
add("p3_parse_status_name", lambda g: labels.parse_status_name(item_names(g)), f"""
SELECT * FROM (SELECT file_name, {", ".join(f"regexp_extract(file_name, '{STATUS_FORM}', {i}) AS {c}" for i, c in enumerate(('category', 'image_id', 'status'), 1))} FROM {ITEM_NAMES}) WHERE category <> ''""")
add("p4_parse_debias_name", debiased, f"SELECT * FROM {SIDES}")
add("p7_recode_labels", lambda g: g("verdicts").select("pair_id", labels.recode("strategy", labels.STRATEGIES).alias("strategy"), labels.recode("model", labels.MODELS).alias("model"), labels.title_case("task").alias("task")), f"""
SELECT pair_id, CASE strategy WHEN 'competition' THEN 'CVPO' WHEN 'textgrad' THEN 'VTG' WHEN 'feedback_descent' THEN 'VFD' ELSE strategy END AS strategy, model,
  upper(substr(task, 1, 1)) || lower(substr(task, 2)) AS task FROM {sql('verdicts')}""")
add("p11_survey_question", lambda g: g("verdicts").select("pair_id", labels.survey_question("task", "image_class").alias("question")), f"""
SELECT pair_id, CASE task WHEN 'products' THEN 'Which ' || lower(image_class) || ' would you buy?' WHEN 'hotels' THEN 'Which hotel would you book?'
  WHEN 'houses' THEN 'Which house would you buy?' WHEN 'people' THEN 'Who would you hire for a job?' ELSE 'Which one do you prefer?' END AS question FROM {sql('verdicts')}""")
GIVEN = "pair_id", "CASE WHEN pair_id % 3 = 0 THEN strategy END AS given", "CASE WHEN pair_id % 3 < 2 THEN concat('c-', strategy) END AS config", "concat(task, '/', model, '/x.csv') AS path"
add("p15_derive_strategy", lambda g: g("verdicts").selectExpr(*GIVEN).select("pair_id", labels.derive_strategy("given", "config", "path").alias("strategy")), f"""
SELECT pair_id, coalesce(given, config, split_part(path, '/', 1)) AS strategy FROM (SELECT {", ".join(GIVEN)} FROM {sql('verdicts')})""")
P = "pair_id", "CAST(pair_id * 7919 % 100003 AS DOUBLE) / 1000003 AS p"
add("p16_significance_label", lambda g: g("verdicts").selectExpr(*P).select("pair_id", parse.significance_label("p").alias("label")), f"""
SELECT pair_id, CASE WHEN p < 0.0001 THEN '****' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS label FROM (SELECT {", ".join(P)} FROM {sql('verdicts')})""")
add("p17_parse_embedding", lambda g: g("verdicts").selectExpr("pair_id", "CASE WHEN pair_id % 7 = 0 THEN 'none' ELSE concat('[', CAST(pair_id AS STRING), ',0.5]') END AS v").withColumn("v", labels.parse_embedding("v")).selectExpr("pair_id", "v[0] AS x", "v[1] AS y"), f"""
SELECT pair_id, CASE WHEN pair_id % 7 <> 0 THEN CAST(pair_id AS DOUBLE) END AS x, CASE WHEN pair_id % 7 <> 0 THEN CAST(0.5 AS DOUBLE) END AS y FROM {sql('verdicts')}""")
add("p18_category_filter", lambda g: labels.category_filter(products(g), ["Economy", "small"]).select("item_id", "category"), f"""
SELECT image_id AS item_id, lower(task) AS category FROM {sql('items')} WHERE lower(task) IN ('economy', 'small')""")

# --- joins ---------------------------------------------------------------------------------------
J6 = f"(SELECT category, id1, status1, id2, status2, iteration, max(CASE WHEN side = 1 THEN file_name END) AS image1, max(CASE WHEN side = 2 THEN file_name END) AS image2 FROM {SIDES} GROUP BY ALL)"
add("j6_assemble_debiased_pairs", lambda g: assembly.assemble_debiased_pairs(debiased(g), 3), f"SELECT * EXCLUDE (iteration) FROM {J6} WHERE iteration = 3 AND image1 IS NOT NULL AND image2 IS NOT NULL")
add("j7_catalogue_join", lambda g: assembly.catalogue_join(products(g), g("images").selectExpr("vec_id AS image_id", "image_path")).select("item_id", "main_image_id", "image_path"), f"""
SELECT i.image_id AS item_id, v.vec_id AS main_image_id, v.image_path FROM {sql('items')} i JOIN {sql('images')} v ON CAST(i.image_id AS BIGINT) = v.vec_id""")


def wide_export(get: Get) -> DataFrame:
    answer = F.when(F.col("pair_id") % 3 == 0, "Top").when(F.col("pair_id") % 3 == 1, "Bottom").otherwise("")
    return get("responses").groupBy("participant_id").agg(*[F.max(F.when(F.col("number") == i, answer)).alias(f"{i}_Q7") for i in range(1, 6)])


def comparisons(get: Get) -> DataFrame:
    rows = get("head2head").groupBy(F.expr("CAST(pair_id % 5 + 1 AS INT)").alias("number"))
    return rows.agg(F.min_by(F.struct("strategy1", "strategy2"), F.struct("pair_id", "strategy1", "strategy2")).alias("s")).select("number", "s.*")


add("j12_resume_iteration", lambda g: assembly.resume_iteration(debiased(g), 4), f"""
SELECT category, id1, status1, id2, status2, coalesce(max(CASE WHEN iteration <= 4 AND image1 IS NOT NULL AND image2 IS NOT NULL THEN iteration END), 0) AS last,
  4 - coalesce(max(CASE WHEN iteration <= 4 AND image1 IS NOT NULL AND image2 IS NOT NULL THEN iteration END), 0) AS steps_left FROM {J6} GROUP BY ALL""")
RUNS = "concat(task, '/', model, '/', strategy, '/run', CAST(pair_id % 7 AS STRING), '/', CAST(pair_id AS STRING), '.csv')"
CONFIGS = "SELECT DISTINCT concat(task, '/', model) AS dir, concat('m:', model) AS config FROM {0} WHERE task <> 'people' UNION SELECT DISTINCT concat(task, '/', model, '/', strategy) AS dir, concat('s:', strategy) AS config FROM {0} WHERE strategy = 'textgrad'"


def configs(get: Get) -> DataFrame:
    v = get("verdicts")
    upper = v.where("task <> 'people'").selectExpr("concat(task, '/', model) AS dir", "concat('m:', model) AS config")
    return upper.unionByName(v.where("strategy = 'textgrad'").selectExpr("concat(task, '/', model, '/', strategy) AS dir", "concat('s:', strategy) AS config")).distinct()


add("s6_nearest_config_join", lambda g: assembly.nearest_config(g("verdicts").selectExpr(f"{RUNS} AS path"), configs(g)), f"""
WITH f AS (SELECT {RUNS} AS path FROM {sql('verdicts')}), c AS ({CONFIGS.format(sql('verdicts'))}) SELECT path, dir, config FROM (SELECT f.path, c.dir, c.config, row_number() OVER (PARTITION BY path ORDER BY length(dir) DESC) AS n
FROM f JOIN c ON starts_with(f.path, c.dir || '/')) WHERE n = 1""")
add("s11_image_manifest", lambda g: assembly.manifest_of_images(pairing.paired_items(g("items"), cross_status=True), "set"), f"""
WITH p AS ({J1} AND a.status <> b.status) SELECT DISTINCT 'set_' || image_class || '_' || base || '.jpg' AS dst, image_class || '/' || base || '.jpg' AS src
FROM (SELECT image_class, base1 AS base FROM p UNION SELECT image_class, base2 FROM p)""")

# --- samples -------------------------------------------------------------------------------------
add("k2_sample_per_category", lambda g: assembly.sample_per_category(g("verdicts").select("pair_id", "task", "strategy", "image_class"), 160, "pair_id", "image_class", ["strategy", "task"]), f"""
WITH c AS (SELECT strategy, task, count(*) AS total, count(DISTINCT image_class) AS k FROM {sql('verdicts')} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY strategy, task, image_class ORDER BY md5('42|' || CAST(pair_id AS VARCHAR)), pair_id) AS n FROM {sql('verdicts')})
SELECT pair_id, task, strategy, image_class FROM r JOIN c USING (strategy, task) WHERE total <= 160 OR n <= 160 // k""")
add("k4_sample_folders", lambda g: assembly.sample_folders(g("items").select("image_class", "image_id"), 7, 4, "image_class", "image_id"), f"""
WITH f AS (SELECT image_class FROM (SELECT DISTINCT image_class FROM {sql('items')}) ORDER BY md5('42|' || image_class), image_class LIMIT 7)
SELECT image_class, image_id FROM (SELECT image_class, image_id, row_number() OVER (PARTITION BY image_class ORDER BY md5('42|' || image_id), image_id) AS n FROM {sql('items')} WHERE image_class IN (SELECT image_class FROM f)) WHERE n <= 4""")
add("k6_density_allotment", lambda g: assembly.density_allotment(g("verdicts").selectExpr("pair_id", "task", "pair_id * 7 % 11 AS label"), 25, "pair_id", "task", "label"), f"""
WITH v AS (SELECT pair_id, task, pair_id * 7 % 11 AS label FROM {sql('verdicts')}), s AS (SELECT task, label, count(*) AS size FROM v GROUP BY ALL),
a AS (SELECT *, least(CAST(round_even(25.0::DOUBLE * size / sum(size) OVER (PARTITION BY task), 0) AS BIGINT), size) AS allot FROM s),
b AS (SELECT task, label, least(allot, greatest(25 - coalesce(sum(allot) OVER (PARTITION BY task ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS allot FROM a)
SELECT pair_id, task, label FROM (SELECT *, row_number() OVER (PARTITION BY task, label ORDER BY md5('42|' || CAST(pair_id AS VARCHAR)), pair_id) AS n FROM v) JOIN b USING (task, label) WHERE n <= allot""")
QUERIES["k6_density_subsample"] = lambda spark, sf_dir: assembly.density_subsample(fixture(spark, sf_dir, "vectors"), 12, "vec_id", "label", "embedding", scratch(spark, "kmeans"), steps=10)
K8 = """WITH p AS (SELECT pair_id, {0} AS category FROM {1}), s AS (SELECT category, count(*) AS size FROM p GROUP BY ALL), w AS (SELECT sum(size) AS total, min(size) AS least, count(*) AS k FROM s),
c AS (SELECT category, row_number() OVER (ORDER BY md5('42|' || category), category) AS place FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || CAST(pair_id AS VARCHAR)), pair_id) AS n FROM p)
SELECT pair_id, category, participant FROM (SELECT pair_id, category, total, CAST(CASE WHEN least < {2} AND least * k > {2} THEN CASE WHEN n <= least THEN (place - 1) // greatest({2} // least, 1) + 1 END ELSE (n - 1) // greatest({2} // k, 1) + 1 END AS BIGINT) AS participant
FROM r JOIN c USING (category), w) WHERE participant <= total // {2}"""
add("k8_assign_participants", lambda g: assembly.assign_participants(g("verdicts").selectExpr("pair_id", "task AS category"), 40, "pair_id", "category"), K8.format("task", sql("verdicts"), 40))
WIDE = "concat(task, '-', CAST(pair_id % 997 AS STRING))"
add("k8_assign_participants_whole", lambda g: assembly.assign_participants(g("verdicts").selectExpr("pair_id", f"{WIDE} AS category"), 40, "pair_id", "category"), K8.format(WIDE, sql("verdicts"), 40))
add("k12_model_order", lambda g: rounded(assembly.model_order(stats.marginal_means(stats.cell_means(kept(g), CELLS), ["model", "strategy"]), "competition"), "emm"), f"""
SELECT model, round(emm, 6) AS emm, row_number() OVER (ORDER BY emm DESC, model) AS place FROM (SELECT model, avg(cell_mean) AS emm FROM {CELL_SQL} WHERE strategy = 'competition' GROUP BY model)""")
add("j8_survey_answers", lambda g: assembly.survey_answers(wide_export(g), comparisons(g)), f"""
WITH w AS (SELECT participant_id, number, max(CASE WHEN pair_id % 3 = 0 THEN 'Top' WHEN pair_id % 3 = 1 THEN 'Bottom' ELSE '' END) AS answer
  FROM {sql('responses')} GROUP BY ALL), c AS (SELECT CAST(pair_id % 5 + 1 AS INTEGER) AS number, strategy1, strategy2 FROM {sql('head2head')} QUALIFY row_number() OVER (PARTITION BY pair_id % 5 ORDER BY pair_id, strategy1, strategy2) = 1)
SELECT participant_id, number, CASE answer WHEN 'Top' THEN 1 ELSE 2 END AS choice, strategy1, strategy2, 'across' AS mode FROM w JOIN c USING (number) WHERE answer IN ('Top', 'Bottom')""")
