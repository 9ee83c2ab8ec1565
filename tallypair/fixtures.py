"""Inputs of the paired-choice operators as expressions over the given tables, the same text for Spark
and for the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def div(x: str, k: int) -> str:
    return f"CAST(FLOOR(({x}) / {k}) AS BIGINT)"


def _pick(x: str, *values: str) -> str:
    n = len(values)
    return "CASE " + " ".join(f"WHEN ({x}) % {n} = {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


def status(x: str) -> str:
    return _pick(x, "original", "zero-shot", "final")


def strategy(x: str) -> str:
    return _pick(x, "competition", "textgrad", "feedback_descent")


def task(x: str) -> str:
    return _pick(x, "hotels", "houses", "people", "products")


_BASE1 = f"concat({text('o_custkey')}, '_', {status('o_orderkey')})"
_BASE2 = f"concat({text('o_custkey + 1')}, '_', {status('o_orderkey + 1 + o_custkey % 2')})"
_B = div("vec_id", 5)

#: Fixture: its table and columns.
COLUMNS: dict[str, tuple[str, dict[str, str]]] = {
    "items": ("part", {
        "task": "p_type", "image_class": "concat(p_brand, '-', p_type)", "image_id": text("p_partkey"), "status": status("p_partkey"),
        "strategy": strategy(div("p_partkey", 3)), "base": f"concat({text('p_partkey')}, '_', {status('p_partkey')})",
        "file_name": f"concat(replace(concat(p_brand, '-', p_type), '#', ''), '_', {text('p_partkey')}, '_', {status('p_partkey')}, '.jpg')",
    }),
    "versions": ("part", {"category": "p_brand", "base_id": text(div("p_partkey", 3)), "status": status("p_partkey"), "path": f"concat('img/', {text('p_partkey')})"}),
    "verdicts": ("orders", {
        "pair_id": "o_orderkey", "model": "o_orderpriority", "task": task("o_custkey"), "strategy": strategy("o_orderkey + o_custkey"),
        "iterations": "CASE WHEN o_custkey % 3 = 0 THEN 0 WHEN o_custkey % 3 = 1 THEN 1 ELSE 3 END", "image_class": f"concat('C', {text('o_custkey % 5')})",
        "base1": _BASE1, "base2": _BASE2,
        "choice": f"CASE WHEN o_orderkey % 7 = 0 THEN 'inconsistent' WHEN (o_orderkey * 31 + o_custkey) % 5 < 2 + o_orderkey % 2 THEN {_BASE1} ELSE {_BASE2} END",
    }),
    "head2head": ("orders", {
        "pair_id": "o_orderkey", "model": "o_orderpriority", "task": task("o_custkey"), "strategy1": strategy("o_orderkey"), "strategy2": strategy("o_orderkey + 1 + o_custkey % 2"),
        "choice": "CASE WHEN o_orderkey % 9 = 0 THEN 'inconsistent' WHEN (o_orderkey * 31 + o_custkey) % 5 < 2 THEN 'first' ELSE 'second' END",
    }),
    "responses": ("orders", {
        "pair_id": "o_orderkey", "number": "CAST(substr(o_orderpriority, 1, 1) AS INT)", "participant_id": "o_custkey", "choice": "CASE WHEN (o_orderkey * 31 + o_custkey) % 5 < 2 THEN 1 ELSE 2 END", "strategy": strategy("o_orderkey + o_custkey"),
        "task": task("o_orderkey + o_custkey"), "image1_id": text("o_custkey"), "image1_status": status("o_orderkey"), "image2_id": text("o_custkey + 1"), "image2_status": status("o_orderkey + 1 + o_custkey % 2"),
    }),
    "images": ("embeddings", {
        "vec_id": "vec_id",
        "image_path": f"CASE WHEN vec_id % 5 = 0 THEN concat('vp/data/hotels_enhanced/rooms_', {text(_B)}, '.jpg') ELSE concat('vp/cache/hotels/rooms_', {text(_B)}, '_original_vs_', {text(_B + ' + 1')}, '_final_iter', CASE WHEN vec_id % 5 < 3 THEN '1' ELSE '3' END, '_debiased_', CASE WHEN vec_id % 5 IN (1, 3) THEN '1' ELSE '2' END, '.jpg') END",
        "embedding": "embedding",
    }),
    "vectors": ("embeddings", {"vec_id": "vec_id", "embedding": "embedding", "label": "label"}),
    "housing": ("part", {"id": "CAST(p_partkey + 1 AS BIGINT)", "area": "CAST(p_size AS INT)", "price": "CAST(p_retailprice AS DOUBLE)"}),
    "rounds": ("events", {
        "pair_key": "user_id", "round_number": "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)", "winner": "CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END",
        "winner_score": "CASE WHEN event_id % 4 = 0 THEN CAST(0.5 AS DOUBLE) WHEN event_id % 4 = 1 THEN CAST(2 AS DOUBLE) / 3 ELSE CAST(1 AS DOUBLE) END",
        "failed": "event_id % 11 = 0", "improved": "event_id % 11 <> 0 AND event_id % 5 = 0", "proposed_prompt": f"concat('p', {text('event_id')})",
    }),
}
_JUDGED = {
    "contest_id": "o_orderkey", "judge_id": "judge_id", "is_a_first": "is_a_first",
    "choice": "CASE WHEN (o_orderkey * 3 + judge_id * (o_orderkey % 4)) % 5 = 0 THEN 'first' WHEN ((o_orderkey + judge_id) % 2 = 0) = is_a_first THEN 'first' ELSE 'second' END",
    "reason": f"concat('r', {text('judge_id')}, CASE WHEN is_a_first THEN 'a' ELSE 'b' END)",
    "completion_tokens": "20 + judge_id", "prompt_tokens": "500 + o_orderkey % 50", "total_tokens": "520 + judge_id + o_orderkey % 50",
    "reasoning_tokens": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE judge_id * 10 END",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "judgements":
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
        rows = rows.selectExpr("*", "explode(array(0, 1, 2)) AS judge_id").selectExpr("*", "explode(array(true, false)) AS is_a_first")
        return rows.selectExpr(*[f"{e} AS {c}" for c, e in _JUDGED.items()])
    table, columns = COLUMNS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def sql(name: str) -> str:
    """The fixture as a SQL subquery."""
    if name == "judgements":
        return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _JUDGED.items()) + " FROM orders, (VALUES (0), (1), (2)) j(judge_id), (VALUES (true), (false)) f(is_a_first))"
    table, columns = COLUMNS[name]
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table})"
