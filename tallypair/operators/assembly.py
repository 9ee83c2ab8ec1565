"""Joins that put inputs together, manifests, and samples with quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallypair.functions.parse import seeded
from tallypair.operators.ranks import beside
from tallypair.operators.sampling import first_in_groups, seeded_rank

PAIR = ["category", "id1", "status1", "id2", "status2"]


def debiased_sides(names: DataFrame, *keys: str) -> DataFrame:
    """Groups that have both images 1 and 2, with their names."""
    at = lambda m: F.max(F.when(F.col("side") == m, F.col("file_name")))
    return names.groupBy(*PAIR, *keys).agg(at(1).alias("image1"), at(2).alias("image2")).where("image1 is not null and image2 is not null")


def assemble_debiased_pairs(names: DataFrame, iteration: int) -> DataFrame:
    return debiased_sides(names.where(F.col("iteration") == iteration))


def resume_iteration(names: DataFrame, target: int) -> DataFrame:
    """For every pair the last iteration up to ``target`` with both images (0 if none) and the steps left."""
    done = debiased_sides(names.where(F.col("iteration") <= target), "iteration").groupBy(*PAIR).agg(F.max("iteration").alias("last"))
    out = names.select(*PAIR).distinct().join(done, PAIR, "left").withColumn("last", F.coalesce("last", F.lit(0)))
    return out.withColumn("steps_left", F.lit(target) - F.col("last"))


def catalogue_join(products: DataFrame, images: DataFrame) -> DataFrame:
    """Products with the path of their main image; those without one go."""
    return products.join(images, F.col("main_image_id") == F.col("image_id"))


def survey_answers(wide: DataFrame, comparisons: DataFrame, id_column: str = "participant_id") -> DataFrame:
    """Answers of a wide export, columns ``<number>_Q7``, joined with the comparison of that number.
    Top is choice 1, Bottom 2; all else is dropped, the export's two rows of question texts and import ids
    among it, as are numbers without a comparison. ``mode``: ``within`` if comparisons are of one strategy."""
    mode = F.lit("within" if "strategy" in comparisons.columns else "across").alias("mode")
    asked = [c for c in wide.columns if "_Q7" in c and c.split("_")[0].isdigit()]
    each = [F.struct(F.lit(int(c.split("_")[0])).alias("number"), F.col(f"`{c}`").alias("answer")) for c in asked]
    rows = wide.select(id_column, F.inline(F.array(*each))).withColumn("choice", F.when(F.col("answer") == "Top", 1).when(F.col("answer") == "Bottom", 2))
    return rows.where("choice is not null").drop("answer").join(comparisons, "number").select("*", mode)


def nearest_config(files: DataFrame, configs: DataFrame, most: int = 5) -> DataFrame:
    """For each file the config of its nearest directory: its own first, then up, ``most`` in all. Files
    without one go."""
    parts = F.split("path", "/")
    up = F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size(parts) - 1))).alias("depth")
    rows = files.select("path", up).withColumn("dir", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - F.col("depth")), "/"))
    return rows.join(configs, "dir").groupBy("path").agg(F.min_by("dir", "depth").alias("dir"), F.min_by("config", "depth").alias("config"))


def image_manifest(pairs: DataFrame, prefix: str) -> DataFrame:
    """Each image of the pairs to publish once: its new name and its source."""
    side = lambda n: F.struct("image_class", F.col(f"base{n}").alias("base"))
    return manifest_of_images(pairs.select(F.inline(F.array(side(1), side(2)))), prefix)


def manifest_of_images(images: DataFrame, prefix: str) -> DataFrame:
    """``image_manifest`` of images (``image_class, base``) that are known to be in pairs."""
    name = F.concat(F.lit(f"{prefix}_"), F.col("image_class"), F.lit("_"), F.col("base"), F.lit(".jpg"))
    source = F.concat(F.col("image_class"), F.lit("/"), F.col("base"), F.lit(".jpg"))
    return images.groupBy(name.alias("dst")).agg(F.min(source).alias("src"))


def sample_per_category(rows: DataFrame, most: int, key: str, category: str, by: list[str], seed: int = 42) -> DataFrame:
    """Within each group of ``by`` that has more than ``most`` rows: the first ``most // categories`` of
    each category in seeded order; other groups stay whole."""

    def quota(groups: DataFrame) -> DataFrame:
        outer = groups.groupBy(*by).agg(F.sum("there").alias("total"), F.count(F.lit(1)).alias("categories"))
        return beside(groups, outer, by).withColumn("quota", F.when(F.col("total") > most, F.floor(F.lit(most) / F.col("categories"))))

    return first_in_groups(rows, [*by, category], seed, (key,), quota)


def sample_folders(rows: DataFrame, folders: int, images: int, folder: str, key: str, seed: int = 42) -> DataFrame:
    """The first folders in seeded order, and the first images of each; -1 takes all."""
    names = rows.select(folder).distinct()
    if folders >= 0:
        names = names.orderBy(seeded(seed, folder), folder).limit(folders)
    kept = rows.join(names, folder, "left_semi").select(*rows.columns)
    if images < 0:
        return kept
    return first_in_groups(kept, [folder], seed, (key,), lambda groups: groups.withColumn("quota", F.lit(images).cast("long")))


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


class _Means:
    """Rounds of k-means: rows meet their category's centers in a join, and a label's sums are one row, a
    column a component, combined before the shuffle. Each round's centers go to ``folder``, so that a
    round's plan starts there."""

    def __init__(self, rows: DataFrame, k: int, key: str, by: str, vector: str, folder: str, seed: int):
        self.folder, self.by, self.key = folder, by, key
        points = rows.where(F.col(vector).isNotNull()).select(F.col(key), F.col(by), F.col(vector).cast("array<double>").alias("_v"))
        self.points = self.stored(points, "points")
        some = self.points.select(F.size("_v").alias("n")).first()
        self.size = some["n"] if some else 0
        first = seeded_rank(self.points, [by], seed, key).where(F.col("rank") <= k)
        start = first.select(F.col(by).alias("_by"), (F.col("rank") - 1).cast("int").alias("label"), F.col("_v").alias("at"), F.lit(0).cast("long").alias("seen"))
        self.centers = self.packed(start, "centers-0")

    def stored(self, table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{self.folder}/{name}")
        return table.sparkSession.read.schema(table.schema).parquet(f"{self.folder}/{name}")

    def packed(self, table: DataFrame, name: str) -> DataFrame:
        return self.stored(table.groupBy("_by").agg(F.sort_array(F.collect_list(F.struct("label", "at", "seen"))).alias("centers")), name)

    def labelled(self, points: DataFrame) -> DataFrame:
        """The nearest center of the category, ties to the smaller label."""
        near = F.array_min(F.transform("centers", lambda c: F.struct(_squared(F.col("_v"), c["at"]).alias("d"), c["label"].alias("label"))))["label"]
        return points.join(self.centers, points[self.by] == self.centers["_by"]).select(self.key, points[self.by].alias("_by"), "_v", near.alias("label"))

    def sums(self, points: DataFrame) -> DataFrame:
        """``_by, label, n, sums`` of the points' labels."""
        each = self.labelled(points).groupBy("_by", "label").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_v")[i]).alias(f"_s{i}") for i in range(self.size)])
        return each.select("_by", "label", "n", F.array(*[f"_s{i}" for i in range(self.size)]).alias("sums"))

    def labels_of(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.join(self.labelled(self.points).select(self.key, F.col("_by").alias(self.by), F.col("label").alias(name)), [self.key, self.by])


def kmeans_labels(rows: DataFrame, k: int, key: str, by: str, vector: str, folder: str, rounds: int = 10, seed: int = 42, name: str = "label") -> DataFrame:
    """``rows`` with ``name`` (0 to ``k - 1``), the nearest of their category's centers after ``rounds``
    rounds of k-means over all rows; ties to the smaller label. The first ``k`` rows of a category in seeded
    order are the first centers, and a center without rows goes. Rows without a vector have no label."""
    own = _Means(rows, k, key, by, vector, folder, seed)
    for n in range(1, rounds + 1):
        means = own.sums(own.points).select("_by", "label", F.transform("sums", lambda x: x / F.col("n")).alias("at"), F.col("n").alias("seen"))
        own.centers = own.packed(means, f"centers-{n}")
    return own.labels_of(rows, name)


def minibatch_labels(rows: DataFrame, k: int, key: str, by: str, vector: str, folder: str, batch: int = 1000, steps: int = 30, seed: int = 42, name: str = "label") -> DataFrame:
    """As ``kmeans_labels``, but each step takes a batch of about ``batch`` rows of each category: a slot of their
    seeded order, the slots in turn, and again from the first where a category has fewer than ``steps``. A
    center moves to the mean of all rows that it ever got: by the batch's share in them. Only rows of slots
    that a step takes are read again and again; all rows get a label at the end."""
    own = _Means(rows, k, key, by, vector, folder, seed)
    slots = own.points.groupBy(F.col(by).alias("_b")).agg(F.ceil(F.count(F.lit(1)) / batch).cast("int").alias("_slots"))
    place = F.floor(F.conv(F.substring(seeded(seed, key), 1, 12), 16, 10).cast("double") / F.lit(16.0**12) * F.col("_slots")).cast("int")
    used = own.points.join(slots, F.col(by) == F.col("_b")).drop("_b").withColumn("_slot", place).where(F.col("_slot") < steps)
    used = own.stored(used, "batches")
    for n in range(1, steps + 1):
        new = own.sums(used.where(F.col("_slot") == F.lit(n - 1) % F.col("_slots"))).select(F.col("_by").alias("_b"), F.col("label").alias("_l"), "n", "sums")
        old = own.centers.select("_by", F.inline("centers"))
        moved = old.join(new, (F.col("_by") == F.col("_b")) & (F.col("label") == F.col("_l")), "left")
        seen = F.col("seen") + F.col("n")
        at = F.when(F.col("n").isNull(), F.col("at")).otherwise(F.zip_with("at", "sums", lambda c, s: c + (s - F.col("n") * c) / seen))
        own.centers = own.packed(moved.select("_by", "label", at.alias("at"), F.coalesce(seen, "seen").alias("seen")), f"centers-{n}")
    return own.labels_of(rows, name)


def density_subsample(rows: DataFrame, n: int, key: str, by: str, vector: str, folder: str, seed: int = 42, batch: int = 1000, steps: int = 30) -> DataFrame:
    """About ``n`` rows of each category, by the density of their vectors: mini-batch k-means into ``n``
    clusters, each of which gets its rounded share of ``n``. ``folder``: a new one that all executors share."""
    labelled = minibatch_labels(rows, n, key, by, vector, folder, batch, steps, seed, "_cluster")
    return density_allotment(labelled, n, key, by, "_cluster", seed).select(*rows.columns)


def density_allotment(rows: DataFrame, n: int, key: str, by: str, label: str, seed: int = 42) -> DataFrame:
    """From given cluster labels: each cluster gets its share of ``n`` rounded half to even, drawn in
    seeded order; in label order no more than ``n`` rows of a category are taken in all."""
    sizes = rows.groupBy(by, label).agg(F.count(F.lit(1)).alias("size"))
    own = Window.partitionBy(by)
    shares = sizes.withColumn("allot", F.least(F.bround(F.lit(float(n)) * F.col("size") / F.sum("size").over(own)).cast("long"), F.col("size")))
    before = own.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("allot", F.least("allot", F.greatest(F.lit(n) - F.coalesce(F.sum("allot").over(before), F.lit(0)), F.lit(0)))).drop("size")
    return seeded_rank(rows.join(shares, [by, label]), [by, label], seed, key).where("rank <= allot").select(*rows.columns)


def assign_participants(pairs: DataFrame, n: int, key: str, category: str, seed: int = 42) -> DataFrame:
    """``participant`` (from 1) of each pair. Each gets ``n`` pairs: whole categories where the smallest
    is under ``n`` but all together are not, else as many of every category. The surplus is dropped."""
    sizes = pairs.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.count(F.lit(1)).alias("categories"))
    place = sizes.withColumn("place", F.row_number().over(Window.orderBy(seeded(seed, category), category))).drop("n")
    rows = seeded_rank(pairs.join(place, category).crossJoin(F.broadcast(whole)), [category], seed, key)
    each = F.greatest(F.floor(F.lit(n) / F.col("least")), F.lit(1))
    by_category = F.when(F.col("rank") <= F.col("least"), F.floor((F.col("place") - 1) / each) + 1)
    spread = F.floor((F.col("rank") - 1) / F.greatest(F.floor(F.lit(n) / F.col("categories")), F.lit(1))) + 1
    blocks = (F.col("least") < n) & (F.col("least") * F.col("categories") > n)
    out = rows.withColumn("participant", F.when(blocks, by_category).otherwise(spread).cast("long"))
    return out.where(F.col("participant") <= F.floor(F.col("total") / n)).select(*pairs.columns, "participant")


def model_order(means: DataFrame, strategy: str, value: str = "emm") -> DataFrame:
    """Judges by their mean for one strategy, largest first. A row a judge: one task may rank them."""
    order = Window.orderBy(F.desc(value), "model")
    return means.where(F.col("strategy") == strategy).select("model", value).withColumn("place", F.row_number().over(order))
