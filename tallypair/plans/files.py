"""Sources and sinks as registered queries: files derived from the given tables, written and read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypair.fixtures import fixture, sql
from tallypair.plans.queries import ORACLES, QUERIES
from tallypair.sources import files

TOKENS = "CAST(20 AS BIGINT) AS completion_tokens", "CAST(pair_id AS BIGINT) AS prompt_tokens", "CAST(20 + pair_id AS BIGINT) AS total_tokens", "CAST(NULL AS BIGINT) AS reasoning_tokens"
ROWS = "image_class", "base1", "base2", "choice", "concat('said \"', choice, '\", then\nnothing') AS reason"


def add(name: str, make: Callable[[SparkSession, str], DataFrame], twin: str) -> None:
    QUERIES[name], ORACLES[name] = make, twin


def result_files(spark: SparkSession, sf_dir: str, name: str, *above: str) -> str:
    folder = files.scratch(spark, name)
    rows = fixture(spark, sf_dir, "verdicts").selectExpr(*ROWS, *TOKENS, "model", *above)
    rows.write.option("header", True).option("escape", '"').partitionBy("model", *[a.split(" AS ")[-1] for a in above]).csv(folder)
    return folder


def config_files(spark: SparkSession, sf_dir: str, folder: str, *above: str) -> DataFrame:
    """A config beside the result files of each run of all but one judge."""
    text = "concat('{\"task\": {\"name\": \"t-', model, '\"}, \"evaluate\": {\"strategy_name\": \"s\", \"iterations\": 3, \"seeds\": [1, 2]}}') AS value"
    rows = fixture(spark, sf_dir, "verdicts").selectExpr("model", *above).distinct().where("model <> '5-LOW'").selectExpr("*", text)
    rows.write.mode("append").partitionBy("model", *[a.split(" AS ")[-1] for a in above]).text(folder)
    return files.flatten_configs(spark, folder, "*.txt")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = result_files(spark, sf_dir, "pairs")
    return files.combine_pairs(spark, folder, config_files(spark, sf_dir, folder), "*.csv").drop("source_file")


def mitigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    above = "'a' AS run", "'b' AS step"
    folder = result_files(spark, sf_dir, "mitigations", *above)
    return files.combine_mitigations(spark, folder, config_files(spark, sf_dir, folder, *above), "*.csv").drop("source_file")


READ = f"SELECT {', '.join(ROWS)}, {', '.join(TOKENS)}, 'model=' || model AS model, CASE WHEN model <> '5-LOW' THEN 't-' || model END AS task_name, CASE WHEN model <> '5-LOW' THEN 's' END AS evaluate_strategy_name"
add("s2_combine_pairs", pairs, f"{READ} FROM {sql('verdicts')}")
add("s3_combine_mitigations", mitigations, f"{READ}, CASE WHEN model <> '5-LOW' THEN '3' END AS evaluate_iterations FROM {sql('verdicts')}")


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.scratch(spark, "strategies")
    rows = fixture(spark, sf_dir, "head2head").selectExpr("task", "'C' AS category", "strategy1", "'1' AS image_id1", "strategy2", "'2' AS image_id2", "choice", "'r' AS reason", *TOKENS, "model")
    rows.write.option("header", True).partitionBy("model").csv(folder)
    return files.combine_strategies(spark, folder, "*.csv").drop("source_file")


add("s4_combine_strategies", strategies, f"SELECT task, 'C' AS category, strategy1, '1' AS image_id1, strategy2, '2' AS image_id2, choice, 'r' AS reason, {', '.join(TOKENS)}, 'model=' || model AS model FROM {sql('head2head')}")


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = config_files(spark, sf_dir, files.scratch(spark, "configs"))
    return flat.select(F.explode("props").alias("key", "value"))


add("s5_flatten_configs", configs, f"""
SELECT k.key, CASE k.key WHEN 'task.name' THEN 't-' || model ELSE k.value END AS value FROM (SELECT DISTINCT model FROM {sql('verdicts')} WHERE model <> '5-LOW'),
  (VALUES ('task.name', NULL), ('evaluate.strategy_name', 's'), ('evaluate.iterations', '3'), ('evaluate.seeds', '[1, 2]')) k(key, value)""")


YAML = """concat('run:\n  started: 2024-03-', lpad(CAST(1 + length(model) % 28 AS STRING), 2, '0'), '\n  seeds: [1, 2]\n  on: true\n  ratio: 0.5\n  none: ~\n1: ', model, '\nname: "a: b"\n')"""


def yaml_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs in YAML, a run each, with dates, flags and numbers as keys; every fifth is broken."""
    folder = files.scratch(spark, "yaml")
    runs = fixture(spark, sf_dir, "verdicts").selectExpr("model", "pair_id % 20 AS run").distinct()
    runs.selectExpr("model", "run", f"CASE WHEN run % 5 = 4 THEN concat('a: [', model) ELSE {YAML} END AS value").write.partitionBy("model", "run").text(folder)
    flat = files.flatten_configs(spark, folder, "*.txt")
    named = flat.select(files.path_part(3, F.col("path")).alias("model"), files.path_part(2, F.col("path")).alias("run"), "props", F.col("error").isNotNull().alias("bad"))
    return named.select("model", "run", "bad", F.explode_outer("props").alias("key", "value"))


add("s5_flatten_configs_yaml", yaml_configs, f"""
WITH r AS (SELECT DISTINCT model, pair_id % 20 AS run FROM {sql('verdicts')}), k(key, value) AS (VALUES ('run.started', NULL), ('run.seeds', '[1, 2]'), ('run.true', 'true'), ('run.ratio', '0.5'), ('run.none', NULL), ('1', NULL), ('name', 'a: b'))
SELECT 'model=' || model AS model, 'run=' || run AS run, false AS bad, key, CASE key WHEN 'run.started' THEN '2024-03-' || lpad(CAST(1 + length(model) % 28 AS VARCHAR), 2, '0') WHEN '1' THEN model ELSE value END AS value
FROM r, k WHERE run % 5 <> 4 UNION ALL SELECT 'model=' || model, 'run=' || run, true, NULL, NULL FROM r WHERE run % 5 = 4""")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.scratch(spark, "images")
    fixture(spark, sf_dir, "images").selectExpr("image_path", "vec_id % 10 AS part").repartition("part").write.partitionBy("part").text(folder)
    return files.image_index(spark, folder, ("txt",)).select(files.path_part(2, F.col("path")).alias("folder")).distinct()


add("s1_image_index", index, f"SELECT DISTINCT 'part=' || (vec_id % 10) AS folder FROM {sql('images')}")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's log is as long as its item took rounds, which its run limits."""
    rounds = fixture(spark, sf_dir, "rounds")
    one = F.struct("round_number", F.struct("winner", F.when(F.col("winner") == "A", "B").otherwise("A").alias("loser"), "winner_score", F.array("proposed_prompt").alias("feedback")).alias("contest"), F.struct(F.col("proposed_prompt").alias("improved_prompt")).alias("improvement"))
    texts = rounds.groupBy("pair_key").agg(F.to_json(F.collect_list(one)).alias("value"))
    read = files.round_logs(texts)
    return read.selectExpr("pair_key", "round_number", "contest.winner", "contest.loser", "round(contest.winner_score, 6) AS winner_score", "contest.feedback[0] AS feedback", "improvement.improved_prompt")


add("s7_read_round_logs", logs, f"SELECT pair_key, round_number, winner, CASE winner WHEN 'A' THEN 'B' ELSE 'A' END AS loser, round(winner_score, 6) AS winner_score, proposed_prompt AS feedback, proposed_prompt AS improved_prompt FROM {sql('rounds')}")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, images = files.scratch(spark, "products"), files.scratch(spark, "catalogue")
    fixture(spark, sf_dir, "items").selectExpr("image_id AS item_id", "image_id AS main_image_id", "array(named_struct('language', 'en', 'value', task)) AS product_type").write.option("compression", "gzip").json(products)
    fixture(spark, sf_dir, "images").selectExpr("CAST(vec_id AS STRING) AS image_id", "image_path AS path").write.option("header", True).option("compression", "gzip").csv(images)
    left, right = files.read_catalogue(spark, products, images)
    return left.join(right, F.col("main_image_id") == F.col("image_id")).selectExpr("item_id", "product_type[0].value AS product_type", "path")


add("s8_read_catalogue", catalogue, f"SELECT i.image_id AS item_id, i.task AS product_type, v.image_path AS path FROM {sql('items')} i JOIN {sql('images')} v ON i.image_id = CAST(v.vec_id AS VARCHAR)")


def housing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.scratch(spark, "housing")
    rows = fixture(spark, sf_dir, "housing").repartitionByRange("id").sortWithinPartitions("id").selectExpr("3 AS bedrooms", "2 AS bathrooms", "area", "'0' AS zipcode", "price")
    rows.write.option("sep", " ").csv(folder)  # part files in the order of the ids
    return files.read_housing(spark, folder).selectExpr("id", "area", "round(price, 2) AS price")


add("s9_read_housing", housing, f"SELECT id, CAST(area AS DOUBLE) AS area, round(price, 2) AS price FROM {sql('housing')}")


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, rows = files.scratch(spark, "appended"), fixture(spark, sf_dir, "verdicts").select("pair_id", "task", "model", "choice")
    files.append_results(rows.where("pair_id % 2 = 0"), folder)
    files.append_results(rows.where("pair_id % 2 = 1"), folder)
    return spark.read.schema(rows.schema).parquet(folder)


add("s10_append_results", appended, f"SELECT pair_id, task, model, choice FROM {sql('verdicts')}")
