"""Readers and writers of result files, run configs, logs, catalogues and images."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIR_RESULTS = "image_class string, base1 string, base2 string, choice string, reason string, completion_tokens long, prompt_tokens long, total_tokens long, reasoning_tokens long"
STRATEGY_RESULTS = "task string, category string, strategy1 string, image_id1 string, strategy2 string, image_id2 string, choice string, reason string, completion_tokens long, prompt_tokens long, total_tokens long, reasoning_tokens long"
ROUND_LOG = "array<struct<round_number:long,contest:struct<winner:string,loser:string,winner_score:double,feedback:array<string>>,improvement:struct<improved_image:string,improved_prompt:string>>>"
STEP_LOG = "array<struct<iteration:long,winner:string,feedback:string,improved:boolean,proposed_prompt:string,best_prompt_before:string,best_prompt_after:string,error:string>>"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-files-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def path_part(back: int, path: Column | None = None) -> Column:
    """A part of the file's path, counted from its end (1: the file's name)."""
    return F.element_at(F.split(F.url_decode(F.col("_metadata.file_path") if path is None else path), "/"), -back)


def image_index(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png"), recursive: bool = True) -> DataFrame:
    """``path`` of the images; contents are never read."""
    ends = "{" + ",".join(extensions) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ends}").option("recursiveFileLookup", recursive).load(folder).select("path")


def flatten_configs(spark: SparkSession, folder: str, glob: str = "*.yaml") -> DataFrame:
    """``path, props, error``: nested run configs as dotted keys. Lists and sets are JSON text, dates ISO text,
    nulls null; keys of any kind are text. A file that can't be read, or isn't a mapping, has no properties
    and says why. JSON configs are read as they are; others need a YAML library on the executors."""
    texts = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(folder, wholetext=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [_config(t) for t in batch["value"]]
            yield pd.DataFrame({"path": batch["path"], "props": [p for p, _ in read], "error": [e for _, e in read]})

    return texts.select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, "path string, props map<string,string>, error string")


def _config(text: str) -> tuple[dict[str, str | None] | None, str | None]:
    try:
        try:
            value = json.loads(text)
        except ValueError:
            import yaml

            value = yaml.safe_load(text)
        if value is not None and not isinstance(value, dict):
            raise TypeError("not a mapping")
        return _dotted(value or {}), None
    except Exception as e:  # noqa: BLE001  a bad file is a row, not the end of the job
        return None, f"{type(e).__name__}: {e}"[:500]


def _text(value: object) -> str:
    """A value as text: booleans and numbers as in JSON, dates as ISO text."""
    return value if isinstance(value, str) else value.isoformat() if isinstance(value, date) else json.dumps(value, default=_plain)


def _plain(value: object) -> object:
    """What JSON lacks: sets in order, mappings' and all other values' text."""
    return sorted((_text(v) for v in value)) if isinstance(value, (set, frozenset)) else _text(value) if isinstance(value, date) else str(value)


def _stringed(value: object) -> object:
    """Nested mappings with text as keys."""
    if isinstance(value, dict):
        return {_text(k): _stringed(v) for k, v in value.items()}
    return [_stringed(v) for v in value] if isinstance(value, (list, tuple)) else value


def _dotted(value: dict, prefix: str = "") -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    for key, x in value.items():
        name = prefix + _text(key)
        if isinstance(x, dict) and x:
            out |= _dotted(x, f"{name}.")
        else:
            out[name] = x if x is None else _text(_stringed(x))
    return out


def combine_results(spark: SparkSession, folder: str, schema: str, model_back: int, configs: DataFrame | None = None, props: tuple[str, ...] = (), glob: str = "*.csv") -> DataFrame:
    """All result files under ``folder`` with their ``source_file`` and ``model`` (a part of the path), and
    properties of the config in the same directory (null if it has none). Configs are small: one a run."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("pathGlobFilter", glob).option("recursiveFileLookup", True).csv(folder)
    rows = rows.select("*", F.col("_metadata.file_path").alias("source_file"), path_part(model_back).alias("model"))
    if configs is None:
        return rows
    own = F.regexp_extract("source_file", "^(.*)/[^/]*$", 1)
    known = configs.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("_dir"), *[F.col("props")[p].alias(p.replace(".", "_")) for p in props])
    return rows.withColumn("_dir", own).join(known, "_dir", "left").drop("_dir")


def combine_pairs(spark: SparkSession, folder: str, configs: DataFrame, glob: str = "results_pairs.csv") -> DataFrame:
    return combine_results(spark, folder, PAIR_RESULTS, 2, configs, ("task.name", "evaluate.strategy_name"), glob)


def combine_mitigations(spark: SparkSession, folder: str, configs: DataFrame, glob: str = "results_mitigations.csv") -> DataFrame:
    return combine_results(spark, folder, PAIR_RESULTS, 4, configs, ("task.name", "evaluate.strategy_name", "evaluate.iterations"), glob)


def combine_strategies(spark: SparkSession, folder: str, glob: str = "results_strategies.csv") -> DataFrame:
    return combine_results(spark, folder, STRATEGY_RESULTS, 2, glob=glob)


def round_logs(texts: DataFrame, column: str = "value", schema: str = ROUND_LOG) -> DataFrame:
    """A row for each round of JSON arrays; text that isn't one gives none."""
    keep = [c for c in texts.columns if c != column]
    return texts.select(*keep, F.inline(F.from_json(column, schema)))


def read_round_logs(spark: SparkSession, folder: str, schema: str = ROUND_LOG) -> DataFrame:
    """Per-item files, each a JSON array."""
    files = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(folder, wholetext=True)
    return round_logs(files.select(F.col("_metadata.file_path").alias("source_file"), "value"), schema=schema)


def read_catalogue(spark: SparkSession, products: str, images: str) -> tuple[DataFrame, DataFrame]:
    """Products (JSON lines, maybe gzipped) and images (CSV)."""
    schema = "item_id string, main_image_id string, product_type array<struct<language:string,value:string>>"
    return spark.read.schema(schema).json(products), spark.read.schema("image_id string, path string").option("header", True).csv(images)


HOUSING = "bedrooms double, bathrooms double, area double, zipcode string, price double"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``id, value``: the lines that aren't blank with their number, from 1, over the files in the order of
    their paths. Spark reads a file in several splits: each split's lines are counted, the sums of the
    splits before it added to the line's place in its own."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).where(F.trim("value") != "")
    counts = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("n"))
    files = counts.groupBy("_file").agg(F.sum("n").alias("n"))
    up_to = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = files.select(F.col("_file").alias("_f"), up_to(Window.orderBy("_file")).alias("_files"))  # a row a file
    splits = counts.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), up_to(Window.partitionBy("_file").orderBy("_start")).alias("_splits")).join(first, "_f")
    own = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_at"))
    placed = lines.withColumn("_at", F.monotonically_increasing_id()).withColumn("_own", own)
    return placed.join(splits, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s"))).select((F.col("_files") + F.col("_splits") + F.col("_own")).alias("id"), "value")


def read_housing(spark: SparkSession, path: str) -> DataFrame:
    """The space-separated table without header; the id is the line's number."""
    lines = numbered_lines(spark, path)
    return lines.select(F.from_csv("value", HOUSING, {"sep": " "}).alias("row"), "id").select("row.*", "id")


def append_results(results: DataFrame, path: str, by: tuple[str, ...] = ("task", "model")) -> None:
    """Add verdicts; what is there stays."""
    results.write.mode("append").partitionBy(*by).parquet(path)
