"""Labels, questions and the parsing of the other kinds of names: projections without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of strategies and judges, questions of the tasks, display names of categories.
STRATEGIES = {"competition": "CVPO", "textgrad": "VTG", "feedback_descent": "VFD", "feedback-descent": "VFD"}
MODELS = {
    "gemini-2.5-flash": "Gemini 2.5 Flash", "gemini-2.5-pro": "Gemini 2.5 Pro", "gemini-3-flash-preview": "Gemini 3 Flash", "gemini-3-pro-preview": "Gemini 3 Pro",
    "gpt-4o-2024-08-06": "GPT-4o", "gpt-4.1-nano": "GPT-4.1 Nano", "gpt-5-mini-2025-08-07": "GPT-5 Mini", "gpt-5-2025-08-07": "GPT-5", "gpt-5.2-2025-12-11": "GPT-5.2",
    "claude-haiku-4-5-20251001": "Claude Haiku 4.5", "claude-sonnet-4-5-20250929": "Claude Sonnet 4.5", "qwen.qwen3-vl-235b-a22b": "Qwen-VL 235B",
    "us.meta.llama4-maverick-17b-instruct-v1:0": "Llama 4 Maverick",
}
QUESTIONS = {"hotels": "Which hotel would you book?", "houses": "Which house would you buy?", "people": "Who would you hire for a job?"}
ANY_QUESTION = "Which one do you prefer?"
DISPLAY = {"CELLULARPHONECASE": "phone case", "FINERING": "ring", "SAUTEFRYPAN": "pan", "WALLART": "wall art"}  # others: in lower case


def recode(column: str, labels: dict[str, str]) -> Column:
    """The label of a raw name; unknown names stay, null stays null."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(table[F.col(column)], F.col(column))


def title_case(column: str) -> Column:
    return F.initcap(F.col(column))


def survey_question(task: str = "task", category: str = "category") -> Column:
    """What a participant is asked; null tasks get the general question."""
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv])[F.col(category)], F.lower(category))
    fixed = F.create_map(*[F.lit(x) for kv in QUESTIONS.items() for x in kv])[F.col(task)]
    return F.when(F.col(task) == "products", F.concat(F.lit("Which "), name, F.lit(" would you buy?"))).otherwise(F.coalesce(fixed, F.lit(ANY_QUESTION)))


def _fields(names: DataFrame, form: str, *fields: str) -> DataFrame:
    parts = [F.regexp_extract("file_name", form, i).alias(c) for i, c in enumerate(fields, 1)]
    return names.select("*", *parts).where(F.col(fields[0]) != "")


def parse_final_name(names: DataFrame, underscores: bool = False) -> DataFrame:
    """Names of finals, CATEGORY_ID_final.jpg; the category may hold underscores if asked. Others go."""
    return _fields(names, rf"^([A-Za-z{'_' * underscores}]+)_([a-z0-9]+)_final\.jpg$", "category", "image_id")


def parse_status_name(names: DataFrame, statuses: tuple[str, ...] = ("original", "zero-shot", "final")) -> DataFrame:
    """CATEGORY_ID_STATUS.jpg, the category with underscores. Others go."""
    return _fields(names, rf"^([A-Za-z_]+)_([a-z0-9]+)_({'|'.join(statuses)})\.jpg$", "category", "image_id", "status")


def parse_debias_name(names: DataFrame) -> DataFrame:
    """CATEGORY_ID1_STATUS1_vs_ID2_STATUS2_iterN_debiased_M.jpg as seven fields. Others go."""
    form = r"^([A-Za-z_]+)_([a-z0-9]+)_(original|zero-shot|final)_vs_([a-z0-9]+)_(original|zero-shot|final)_iter([0-9]+)_debiased_([12])\.jpg$"
    out = _fields(names, form, "category", "id1", "status1", "id2", "status2", "iteration", "side")
    return out.withColumns({c: F.col(c).cast("int") for c in ("iteration", "side")})


def derive_strategy(given: str, config: str, path: str) -> Column:
    """The given strategy, else the run config's, else the first part of the path under the root."""
    return F.coalesce(F.col(given), F.col(config), F.nullif(F.split(path, "/")[0], F.lit("")))


def parse_embedding(column: str) -> Column:
    """JSON text to doubles; null if it isn't an array of numbers."""
    return F.from_json(column, "array<double>")


def category_filter(products: DataFrame, categories: list[str]) -> DataFrame:
    """Products whose first type, whatever its case, is listed."""
    first = F.from_json("product_type", "array<struct<language:string,value:string>>")[0]["value"]
    return products.withColumn("category", F.lower(first)).where(F.col("category").isin([c.lower() for c in categories]))
