"""Similarity of image versions: pair keys, cosines and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The data sets of directories of originals; any other directory is one of its own.
DATASETS = {"abod_enhanced": "products", "hotels_enhanced": "hotels", "houses_enhanced": "houses", "shhq_enhanced": "people"}


def parse_image_path(images: DataFrame, data_prefix: str = "vp/data/") -> DataFrame:
    """``dataset, image_class, current_base_id, other_base_id, current_id, other_id, debiased_iter`` of the
    two kinds of paths: originals, under ``data_prefix``, whose id is the name's last part, and versions
    named CLASS_ID_STATUS_vs_ID_STATUS_iterN_debiased_SIDE, of whose two ids the side tells the current.
    The other's and the iteration are null for originals; a name that isn't such a one has only nulls."""
    parts = F.split("image_path", "/")
    name = F.element_at(parts, -1)
    word = F.split(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "_")
    directory = F.get(parts, F.lit(2))
    original = F.startswith("image_path", F.lit(data_prefix))
    number = F.regexp_extract(F.get(word, F.lit(6)), "^iter([0-9]+)$", 1)
    side = F.element_at(word, -1)
    version = ~original & (F.size(word) >= 8) & side.isin("1", "2") & (number != "")
    mapped = F.create_map(*[F.lit(x) for kv in DATASETS.items() for x in kv])
    ids = [F.concat_ws("_", F.get(word, F.lit(i)), F.get(word, F.lit(i + 1))) for i in (1, 4)]
    swapped = lambda x, y: F.when(version, F.when(side == "1", x).otherwise(y))
    own, other = swapped(*ids), swapped(*ids[::-1])
    return images.withColumns({
        "dataset": F.when(original, F.coalesce(mapped[directory], directory)).when(version, directory),
        "image_class": F.when(original | version, F.get(F.split(name, "_"), F.lit(0))),
        "current_base_id": F.when(original, side).otherwise(F.split(own, "_")[0]), "other_base_id": F.split(other, "_")[0],
        "current_id": F.when(original, side).otherwise(own), "other_id": other,
        "debiased_iter": F.when(version, number.cast("int")),
    })


def first_of_each_name(table: DataFrame) -> DataFrame:
    """The table with the first of the columns that share a name, as joins of metadata leave them."""
    names = [f"_{i}" for i in range(len(table.columns))]
    first = [i for i, c in enumerate(table.columns) if c not in table.columns[:i]]
    return table.toDF(*names).select(*[F.col(names[i]).alias(table.columns[i]) for i in first])


def pair_key() -> Column:
    """The sorted ids and the iteration; null for originals."""
    return F.when(F.col("debiased_iter").isNotNull(), F.concat_ws("_", F.col("dataset"), F.array_join(F.array_sort(F.array("current_id", "other_id")), "_"), F.col("debiased_iter").cast("string")))


def valid_pairs(images: DataFrame, least: int = 2) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("pair_key"))
    return images.where("pair_key is not null").withColumn("n", n).where(F.col("n") >= least).drop("n")


def cosine(a: str, b: str) -> Column:
    """Cosine in double; 0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def between_pairs(images: DataFrame) -> DataFrame:
    """Per pair the first two images by path, and their similarity."""
    keys = ["pair_key", "debiased_iter"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("image_path", "embedding"))
    two = images.select(*keys, "image_path", "embedding").withColumn("n", place).where("n <= 2").groupBy(*keys)
    at = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    rows = two.agg(at("image_path", 1).alias("path_a"), at("image_path", 2).alias("path_b"), at("embedding", 1).alias("x"), at("embedding", 2).alias("y"), F.max("n").alias("n"))
    return rows.where("n = 2").withColumn("similarity", cosine("x", "y")).drop("x", "y", "n")


def from_original(images: DataFrame) -> DataFrame:
    """Per base, iteration and kind the image of smallest path against the base's original."""
    versions = images.where("debiased_iter is not null").withColumn("is_final", F.col("current_id").endswith("_final"))
    one = versions.groupBy("dataset", "current_base_id", "debiased_iter", "is_final").agg(F.min_by(F.struct("image_path", "embedding"), "image_path").alias("v"))
    originals = images.where("debiased_iter is null").groupBy("dataset", "current_base_id").agg(F.min_by(F.struct("image_path", "embedding"), "image_path").alias("o"))
    rows = one.join(originals, ["dataset", "current_base_id"]).select("current_base_id", "debiased_iter", "is_final", F.col("o.image_path").alias("path_a"), F.col("v.image_path").alias("path_b"), F.col("o.embedding").alias("x"), F.col("v.embedding").alias("y"))
    return rows.withColumn("similarity", cosine("x", "y")).drop("x", "y")


def ci95_stats(rows: DataFrame, by: list[str], value: str = "similarity") -> DataFrame:
    out = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    half = F.lit(196.0) / 100 * F.col("sd") / F.sqrt("n")
    return out.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def similarity_long(between: DataFrame, originals: DataFrame, metric: str) -> DataFrame:
    """Both comparisons as one table with the metric's name; rows without a value go."""
    rows = between.withColumn("comparison", F.lit("between_pairs")).unionByName(originals.withColumn("comparison", F.lit("from_original")), allowMissingColumns=True)
    return rows.withColumn("metric", F.lit(metric)).where("similarity is not null and not isnan(similarity)")


def harmonize_metrics(tables: list[DataFrame]) -> DataFrame:
    """Metrics stacked: the score is the distance where there is one; a label of the comparison."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    for c in {"distance", "similarity"} - set(out.columns):
        out = out.withColumn(c, F.lit(None).cast("double"))
    label = F.when(F.col("comparison") == "between_pairs", "Between pairs").when(F.col("is_final"), "Final to original").otherwise("Original to original")
    return out.withColumns({"score": F.coalesce("distance", "similarity"), "label": label})


def incremental_scores(pairs: DataFrame, cache: DataFrame, score: Column, keys: list[str]) -> DataFrame:
    """The cache's rows and those of pairs that it lacks, scored now."""
    new = pairs.join(cache.select(*keys), keys, "left_anti").withColumn("similarity", score)
    return cache.select(*keys, "similarity").unionByName(new.select(*keys, "similarity"))


def representation_gaps(images: DataFrame) -> DataFrame:
    """Rows of pairs, those without a vector, and those whose original lacks one or isn't there."""
    versions = images.where("debiased_iter is not null").select("dataset", "current_base_id", F.col("embedding").isNull().alias("bare"))
    originals = images.where("debiased_iter is null and embedding is not null").select("dataset", "current_base_id").distinct().withColumn("known", F.lit(True))
    return versions.join(originals, ["dataset", "current_base_id"], "left").agg(F.count(F.lit(1)).alias("rows"), F.count_if("bare").alias("no_vector"), F.count_if(F.col("known").isNull()).alias("no_original"))
