"""Names and choices: projections without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The statuses in order and their labels.
STATUSES = {"original": "Original", "zero-shot": "Zero-shot", "final": "Final", "distillation": "Distilled"}
BASE = "^(.*)_(original|zero-shot|final|distillation)$"


def seeded(seed: int, *keys: str) -> Column:
    """The seeded order's key: md5 of the seed and the key columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def parse_item_name(names: DataFrame, statuses: tuple[str, ...] = ("original", "zero-shot", "final")) -> DataFrame:
    """``file_name, category, image_id, status`` of names CATEGORY_ID_STATUS.jpg; others are left out."""
    form = rf"(?:^|_)([^_]+)_([^_]+)_({'|'.join(statuses)})\.jpg$"
    part = [F.regexp_extract("file_name", form, i).alias(c) for i, c in enumerate(("category", "image_id", "status"), 1)]
    return names.select("file_name", *part).where("status <> ''")


def split_base(base: str) -> tuple[Column, Column]:
    """Id and status of ``<id>_<status>``; null if it isn't one."""
    return tuple(F.nullif(F.regexp_extract(base, BASE, i), F.lit("")) for i in (1, 2))


def clean_choices(verdicts: DataFrame) -> DataFrame:
    """``inconsistent`` to null, the chosen base, both bases split."""
    chosen = F.when(F.col("choice") == F.col("base1"), F.col("base1")).when(F.col("choice") == F.col("base2"), F.col("base2"))
    (i1, t1), (i2, t2) = split_base("base1"), split_base("base2")
    return verdicts.withColumns({"chosen_base": chosen, "item1": i1, "type1": t1, "item2": i2, "type2": t2}).drop("choice")


def choices_long(clean: DataFrame) -> DataFrame:
    """A row for each pair and side: ``item_id, type, chosen`` (null if the pair was inconsistent)."""
    side = lambda n: F.struct(F.col(f"item{n}").alias("item_id"), F.col(f"type{n}").alias("type"), (F.col("chosen_base") == F.col(f"base{n}")).cast("int").alias("chosen"))
    keep = [c for c in clean.columns if c not in ("base1", "base2", "chosen_base", "item1", "item2", "type1", "type2")]
    return clean.select(*keep, F.inline(F.array(side(1), side(2))))


def prep_choices(long: DataFrame) -> DataFrame:
    """Decided rows with the label and order of their type; unknown types are null."""
    label = F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])
    place = F.create_map(*[F.lit(x) for i, k in enumerate(STATUSES) for x in (k, i)])
    return long.where("chosen is not null").withColumns({"type_label": label[F.col("type")], "type_order": place[F.col("type")]})


def significance_label(p: str = "p") -> Column:
    return F.when(F.col(p) < 1e-4, "****").when(F.col(p) < 1e-3, "***").when(F.col(p) < 1e-2, "**").when(F.col(p) < 5e-2, "*").otherwise("")


def orient_pairs(pairs: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Left and right of each pair, swapped for half of the keys."""
    swap = F.conv(F.substring(seeded(seed, *keys), 1, 8), 16, 10).cast("long") % 2 == 0
    return pairs.withColumns({"left": F.when(swap, F.col("base2")).otherwise(F.col("base1")), "right": F.when(swap, F.col("base1")).otherwise(F.col("base2"))})
