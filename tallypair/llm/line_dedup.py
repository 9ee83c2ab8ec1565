"""Line dedup: MinHash of character shingles, banding, exact Jaccard, union-find. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, sized, written
from .places import keyed

#: Characters of a shingle, one from every character of a line; a shorter line is one shingle.
SHINGLE = 12
#: Bands, each of two minima: two lines of similarity 0.8 share one with probability 0.994.
BANDS = 5
#: Bits by which the hashes are turned from band to band; those of all bands fit into 64.
TURN = 12
#: Shingles that one row carries to the aggregates of minima and of sketches.
ABREAST, SKETCHED = 8, 4
#: Lines of more first shingles don't carry them to the pairs; such pairs may be met more than once.
CARRIED = 64
#: Lines of at most so many shingles meet exactly, besides the bands.
FEW = 9
#: Words of 64 bits in a sketch of a line's shingles, for pivots and for the last candidates.
WIDE, SKETCH = 16, 8
#: Further pivots of the buckets that the first leaves with several components; one of so many lines or one more is decided by them.
MORE = 16
#: Of an undecided bucket of at most so many lines all sketches are compared; in larger ones lines meet by their rarest shingles.
CROWD = 2048


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, n, line, id``: every line that isn't blank; ``id`` is the hash of its text."""
    lines = docs.where("doc_id is not null").select("doc_id", "tag", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    # what a regular expression's \S leaves out, without decoding the line for one
    return lines.where(F.octet_length(F.ltrim("line", F.lit(" \t\n\x0b\f\r"))) > 0).withColumn("id", F.xxhash64("line"))


def _coded(line: Column) -> Column:
    """Four bytes a character, so that a shingle is cut out without reading the line from its start."""
    return F.encode(line, "UTF-32")


def _last(coded: Column) -> Column:
    """Where the last shingle starts."""
    return F.greatest(F.octet_length(coded) - F.lit(4 * SHINGLE - 1), F.lit(1))


def _shingle(coded: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(coded, start, F.lit(4 * SHINGLE)))


def with_shingles(df: DataFrame, line: str, name: str) -> DataFrame:
    """``df`` with the set of hashes of ``line``'s shingles instead of the line."""
    # as a lambda's variable the coded line is fetched from the row once, not once a shingle
    of = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), _last(c), F.lit(4)), lambda i: _shingle(c, i)))
    return df.select("*", F.explode(F.transform(F.array(_coded(F.col(line))), of)).alias(name)).drop(line)


def _abreast(lines: DataFrame, *columns: str, abreast: int) -> DataFrame:
    """``columns, n, one, h0, h1, ...``: ``abreast`` successive shingles a row, for partial aggregates that
    leave a row a line before the shuffle. ``n``: shingles of the line, with repeats; ``one``: 1 in the
    line's first row, else 0. What a row has too many repeats the last shingle."""
    coded = lines.select(*columns, F.explode(F.array(_coded(F.col("line")))).alias("coded")).select("*", _last(F.col("coded")).alias("last"))
    rows = coded.select("*", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * abreast))).alias("at"))
    shingles = [_shingle(F.col("coded"), F.least(F.col("at") + F.lit(4 * j), "last")).alias(f"h{j}") for j in range(abreast)]
    n = F.shiftright(F.col("last") + 3, 2).alias("n")
    return rows.select(*columns, n, F.when(F.col("at") == 1, 1).otherwise(0).alias("one"), *shingles)


def _sketches(lines: DataFrame) -> DataFrame:
    """``id, n, s0, s1, ...``: each shingle sets one bit of a line's sketch, so two lines differ in at least
    as many shingles as their sketches in bits."""
    # dealt by line, so that words are gathered, a row each, and then put side by side without a further shuffle
    rows = _abreast(lines.repartition("id"), "id", abreast=SKETCHED)
    words = [F.shiftright(f"h{j}", 6).bitwiseAND(F.lit(WIDE - 1)).alias(f"w{j}") for j in range(SKETCHED)]
    bits = [F.expr(f"shiftleft(1L, cast(h{j} & 63 as int))").alias(f"b{j}") for j in range(SKETCHED)]
    # a row a shingle: the code of several abreast would be too long to be compiled
    rows = rows.select("id", "n", F.inline(F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in zip(words, bits, strict=True)])))
    rows = rows.groupBy("id", "n", "w").agg(F.bit_or("b").alias("b"))
    parts = [F.coalesce(F.max(F.when(F.col("w") == i, F.col("b"))), F.lit(0).cast("long")).alias(f"s{i}") for i in range(WIDE)]
    return rows.groupBy("id", "n").agg(*parts).select("id", "n", *[f"s{i}" for i in range(WIDE)])


def _signed(lines: DataFrame) -> DataFrame:
    """``id, doc, copies, bands`` of each distinct line: its smallest document, its number of places and its
    bands. A band's two minima are of two 64-bit hashes of the shingles, turned by ``TURN`` bits from band to
    band: other bits lead in each, so two lines agree in one with the chance of their Jaccard similarity,
    whatever the others do."""
    rows = _abreast(lines, "id", "doc_id", abreast=ABREAST)
    rows = rows.select("*", *[F.xxhash64(f"h{j}").alias(f"g{j}") for j in range(ABREAST)])
    turned = lambda h, k: F.shiftleft(h, TURN * k).bitwiseOR(F.shiftrightunsigned(h, 64 - TURN * k)) if k else F.col(h)
    least = [F.least(*[turned(f"{h}{j}", k) for j in range(ABREAST)]).alias(f"m{k}_{i}") for k in range(BANDS) for i, h in enumerate("hg")]
    rows = rows.select("id", "doc_id", "one", *least)
    minima = [F.min(f"m{k}_{i}").alias(f"m{k}_{i}") for k in range(BANDS) for i in range(2)]
    bands = F.array(*[F.xxhash64(F.lit(k), f"m{k}_0", f"m{k}_1") for k in range(BANDS)])
    return rows.groupBy("id").agg(F.min("doc_id").alias("doc"), F.sum("one").alias("copies"), *minima).select("id", "doc", "copies", bands.alias("bands"))


def _few(lines: DataFrame) -> DataFrame:
    """``id, bucket`` of the lines of ``FEW`` shingles or fewer: two whose sets differ in one shingle, or by
    one on either side, meet in a bucket. At a similarity of 0.8 no others of such sizes are near but
    those of equal sets, whose bands are equal."""
    # a longer line has so few only if one of its first shingles comes again, and with it what they all
    # share; likewise among its last
    again = lambda part: F.contains(F.substring(part, FEW + 1, SHINGLE), F.substring(part, FEW, SHINGLE + 1 - FEW))
    periodic = again(F.substring("line", 1, SHINGLE + FEW)) & again(F.right("line", F.lit(SHINGLE + FEW)))
    # characters have up to four bytes, so only lines of few bytes need theirs counted
    few = (F.octet_length("line") < 4 * (SHINGLE + FEW)) & (F.char_length("line") < SHINGLE + FEW)
    short = lines.select("id", "line").where(few | periodic)
    rows = with_shingles(short, "line", "h").where(F.size("h").between(4, FEW)).select("id", F.sort_array("h").alias("o"))
    rest = F.transform("o", lambda x: F.xxhash64(F.lit(BANDS), F.array_remove("o", x)))
    buckets = F.concat(F.array(F.xxhash64(F.lit(BANDS), "o")), F.when(F.size("o") > 4, rest).otherwise(F.array().cast("array<bigint>")))
    return rows.select("id", F.explode(buckets).alias("bucket")).distinct()


def _similar(x: Column, y: Column, similar: float) -> Column:
    """Whether two sets have a Jaccard similarity of ``similar`` or more; sizes that rule it out are seen first."""
    common = F.size(F.array_intersect(x, y))
    sizes = F.least(F.size(x), F.size(y)) >= F.greatest(F.size(x), F.size(y)) * F.lit(similar)
    return F.when(sizes, common >= (F.size(x) + F.size(y)) * F.lit(similar / (1 + similar)) - F.lit(1e-9)).otherwise(F.lit(False))


def _unlike(similar: float) -> Column:
    """Whether the sketches ``as0, ..., bs0, ...`` of lines of ``an`` and ``bn`` shingles differ in more bits
    than sets of a Jaccard similarity of ``similar`` can in shingles."""
    bits = reduce(add, [F.bit_count(F.col(f"as{i}").bitwiseXOR(F.col(f"bs{i}"))) for i in range(WIDE)])
    return bits > (F.col("an") + F.col("bn")) * F.lit((1 - similar) / (1 + similar)) + F.lit(1e-6)


def _end(sketches: DataFrame, end: str) -> DataFrame:
    """``sketches`` with their columns named for the end ``a`` or ``b`` of a pair."""
    return sketches.select(*[F.col(c).alias(end if c == "id" else end + c) for c in sketches.columns])


def _alike(pairs: DataFrame, sketches: DataFrame, similar: float) -> DataFrame:
    """The pairs ``a, b`` whose sketches don't rule out a Jaccard similarity of ``similar``."""
    met = pairs
    for end in "ab":
        met = met.join(sized(_end(sketches, end), of=sketches), end)
    return written(met.where(~_unlike(similar)).select(*pairs.columns), "like-pairs")


def _verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets have a Jaccard similarity of ``similar`` or more."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("s")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("t")), "b")
    both = with_shingles(with_shingles(both, "s", "x"), "t", "y")
    return both.where(_similar(F.col("x"), F.col("y"), similar)).select(*pairs.columns)


def _renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with the ``component`` that ``names`` (``node, component``) has for theirs, where it has one;
    ``near``, if there, becomes true of these."""
    new = names.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    named = rows.join(new, rows["component"] == F.col("_node"), "left")
    if "near" in rows.columns:
        named = named.withColumn("near", F.col("near") | F.col("_component").isNotNull())
    return named.withColumn("component", F.coalesce("_component", "component")).drop("_node", "_component")


def _open(rows: DataFrame) -> DataFrame:
    """The rows (``bucket, id, component``) of buckets with lines of several components."""
    ends = rows.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    return rows.join(sized(written(ends.where("c0 <> c1").select("bucket"), "undecided-buckets")), "bucket", "left_semi")


def _with_pivots(rows: DataFrame) -> DataFrame:
    """``rows`` (``bucket, id, component``) with ``pivots``, ``MORE`` lines of the bucket or all, chosen by hashes."""
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("id", F.lit(0)), "id")
    picked = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= MORE)
    picked = picked.groupBy("bucket").agg(F.collect_list(F.struct("id", "component")).alias("pivots"))
    return written(rows.join(sized(written(picked, "further-pivots")), "bucket"), "undecided-members")


def _bucket_pairs(rows: DataFrame, sketches: DataFrame, similar: float) -> DataFrame:
    """``a, b, ca, cb``: all pairs of a bucket's lines (``rows``: ``bucket, id, component``) in different
    components whose sketches don't rule out a Jaccard similarity of ``similar``, and each once."""
    known = written(rows.join(sketches, "id"), "sketched-members")
    x, y = (known.select(*[F.col(c).alias({"id": end, "component": f"c{end}", "bucket": f"bucket{end}"}.get(c, end + c)) for c in known.columns]) for end in "ab")
    met = x.join(y, (F.col("bucketa") == F.col("bucketb")) & (F.col("ca") < F.col("cb")) & ~_unlike(similar))
    return met.select("a", "b", "ca", "cb").distinct()


def _candidates(lines: DataFrame, similar: float) -> DataFrame:
    """``a, b, ca, cb``: all pairs of ``lines`` (``id, component, line``) in different components that can
    have a Jaccard similarity of ``similar``, and each once.

    With shingles in one order for all lines, rarest first, similar lines share one of their first
    ``size - similar * size + 1``; and at the first that they share, enough must be left in both. Each
    shingle turns a bit of a line's sketch, so at least as many shingles as bits differ.
    """
    sets = written(with_shingles(lines, "line", "h"), "undecided-lines").withColumn("k", F.size("h"))
    one = sets.select("id", "k", F.explode("h").alias("t"))
    often = one.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    # shingles that no other line has would come first: places are counted from the end
    commonest = Window.partitionBy("id").orderBy(F.desc("f"), F.desc("t"))
    ranked = one.join(often, "t").withColumn("pos", F.col("k") - F.row_number().over(commonest))
    heads = ranked.where(F.col("pos") <= F.col("k") - F.ceil(F.col("k") * F.lit(similar) - F.lit(1e-9))).select("id", "k", "t", "pos")
    # the first shingles go along, so that of those that two lines share only one makes the pair
    heads = heads.withColumn("head", F.sort_array(F.collect_list(F.struct("pos", "t")).over(Window.partitionBy("id")))["t"])
    word = F.shiftright("t", 6).bitwiseAND(F.lit(SKETCH - 1))
    bit = F.expr("shiftleft(1L, cast(t & 63 as int))")
    sketch = [f"s{i}" for i in range(SKETCH)]
    marked = sets.select("id", "component", F.explode("h").alias("t"))
    sketches = marked.groupBy("id", "component").agg(*[F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(c) for i, c in enumerate(sketch)])
    heads = heads.withColumn("head", F.when(F.size("head") <= CARRIED, F.col("head"))).join(sketches, "id")
    heads = written(heads, "line-heads")
    x, y = (heads.select(*[F.col(c).alias(f"{c}{side}") for c in heads.columns]) for side in "xy")
    small, large = F.least("kx", "ky"), F.greatest("kx", "ky")
    left = F.least(F.col("kx") - F.col("posx"), F.col("ky") - F.col("posy"))
    # the small slack keeps pairs that are similar by rounding only; they are verified exactly
    fits = (small >= large * F.lit(similar) - F.lit(1e-6)) & (left >= (F.col("kx") + F.col("ky")) * F.lit(similar / (1 + similar)) - F.lit(1e-6))
    first = F.coalesce(F.get(F.array_intersect("headx", "heady"), 0) == F.col("tx"), F.lit(True))
    unlike = reduce(add, [F.bit_count(F.col(f"{c}x").bitwiseXOR(F.col(f"{c}y"))) for c in sketch])
    fits = fits & (F.col("kx") + F.col("ky") - unlike >= (F.col("kx") + F.col("ky")) * F.lit(2 * similar / (1 + similar)) - F.lit(1e-6))
    met = x.join(y, (F.col("tx") == F.col("ty")) & (F.col("componentx") < F.col("componenty")) & fits & first)
    return met.select(F.col("idx").alias("a"), F.col("idy").alias("b"), F.col("componentx").alias("ca"), F.col("componenty").alias("cb")).distinct()


def repeated_lines(docs: DataFrame, similar: float = 0.8) -> DataFrame:
    """``_doc, _tag, gone``: for each document that loses lines, a flag a line (by number): it isn't the
    one that its component keeps. ``docs``: ``doc_id, tag, text``.

    Exact copies of a line are one; its first place is the smallest (id, number). Every line of a band's
    bucket is compared with its pivot, the line of the most copies, which joins the large groups of near
    lines; where the others are still of several components, with up to ``MORE`` further ones. The lines of
    buckets that then hold several components are compared across components, all that can be similar,
    so no pair that meets in a band is left out.
    """
    lines = lines_of(docs)
    signed = written(_signed(lines), "distinct-lines")
    # near lines are mostly variants of a line with many copies; of equals, one that all bands choose
    weight = F.shiftleft("copies", 32) + F.shiftrightunsigned("id", 32)
    few = signed.join(sized(written(_few(lines), "few")), "id").select("id", weight.alias("weight"), "bucket")
    banded = signed.select("id", weight.alias("weight"), F.explode("bands").alias("bucket")).unionByName(few)
    buckets = banded.groupBy("bucket").agg(F.max_by("id", "weight").alias("pivot"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    members = written(banded.drop("weight").join(sized(written(buckets.select("bucket", "pivot"), "buckets")), "bucket"), "bucket-members")
    wanted = members.select("id").distinct().join(signed.select("id", "doc"), "id")
    wanted = written(wanted.select(F.col("id").alias("_id"), "doc"), "wanted-lines")
    found = lines.join(sized(wanted), (F.col("id") == F.col("_id")) & (F.col("doc_id") == F.col("doc")))
    texts = written(found.select("id", "line").dropDuplicates(["id"]), "wanted-texts")
    sketches = written(_sketches(texts), "wanted-sketches")

    stars = members.where("id <> pivot").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
    joined = written(components(_verified(_alike(stars, sketches, similar), texts, similar)), "joined-lines")

    # a pivot has been compared with all of its bucket, so only the others count there from then on
    rest = _with_pivots(_open(_renamed(members.where("id <> pivot").select("bucket", "id", F.col("id").alias("component")), joined)))
    own = F.array_contains(F.transform("pivots", lambda p: p["id"]), F.col("id"))
    stars = rest.select("id", "component", own.alias("own"), F.explode("pivots").alias("p")).where("p.component <> component and (not own or p.id < id)")
    stars = stars.select(F.col("p.id").alias("a"), F.col("id").alias("b"), F.col("p.component").alias("ca"), F.col("component").alias("cb")).distinct()
    ends = [F.col("ca").alias("a"), F.col("cb").alias("b")]
    merged = written(components(_verified(_alike(stars, sketches, similar), texts, similar).select(*ends)), "merged-components")
    left = written(_open(_renamed(rest.where(~own).select("bucket", "id", "component"), merged)), "undecided-rest")
    crowds = written(left.groupBy("bucket").count().where(F.col("count") > CROWD).select("bucket"), "crowded-buckets")
    pairs = _bucket_pairs(left.join(sized(crowds), "bucket", "left_anti"), sketches, similar)
    if crowds.limit(1).count():
        crowded = left.join(sized(crowds), "bucket", "left_semi").groupBy("id").agg(F.min("component").alias("component")).join(texts, "id")
        pairs = pairs.unionByName(_candidates(crowded, similar)).distinct()
    last = written(components(_verified(pairs, texts, similar).select(*ends)), "last-components")

    # the lines that have several places or near ones, by the class that keeps one place
    placed = signed.select("id", (F.col("copies") > 1).alias("near"), F.col("id").alias("component"))
    for names in (joined, merged, last):
        placed = _renamed(placed, names)
    contested = written(placed.where("near").select(F.col("id").alias("_id"), F.col("component").alias("group")), "contested-lines")
    marked = lines.drop("line").join(sized(contested), F.col("id") == F.col("_id"))
    marked = written(marked.select("doc_id", "tag", "n", "group"), "contested-places")
    place = F.struct("doc_id", "tag", "n")
    kept = marked.groupBy("group").agg(F.min(place).alias("keep"))
    gone = marked.join(sized(written(kept, "kept-places")), "group").where(place != F.col("keep"))
    numbers = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag")).agg(F.sort_array(F.collect_list("n")).alias("numbers"))
    # flags up to the last line that goes: the differences of successive numbers say how many stay between
    steps = F.zip_with("numbers", F.concat(F.array(F.lit(-1)), F.slice("numbers", 1, F.size("numbers") - 1)), lambda a, b: F.concat(F.array_repeat(F.lit(False), a - b - 1), F.array(F.lit(True))))
    return written(numbers.select("_doc", "_tag", F.flatten(steps).alias("gone")), "repeated-lines")


def remove_repeated_lines(docs: DataFrame, similar: float = 0.8) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_text`` of every input row: of each component of near lines, the
    one at the smallest (doc_id, line number) stays.

    Lines are near if the Jaccard similarity of their shingle sets is ``similar`` or more; a pair of
    similarity 0.8 meets in a band with probability 0.994, of 0.9 with 0.9998, and all that meet are decided. Blank lines always stay.
    Null text: one empty line. Null id: such a row neither loses lines nor takes any. Rows that share an
    id and differ in text keep separate lines; equal rows lose the same ones. An empty table gives no
    rows; other columns are ignored. Lines are told apart by 64-bit hashes of their texts.
    """
    rows = keyed(docs)
    return _without_lines(rows, similar).select("doc_id", "n_lines", "n_removed", "kept_text")


def _without_lines(rows: DataFrame, similar: float) -> DataFrame:
    flags = sized(repeated_lines(rows, similar))
    joined = rows.join(flags, (rows["doc_id"] == F.col("_doc")) & (rows["tag"] == F.col("_tag")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    joined = joined.withColumns({"n_lines": F.size(lines).cast("long")})
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get("gone", i), F.lit(False))), "\n")
    lost = F.coalesce(F.size(F.filter("gone", lambda g: g)), F.lit(0)).cast("long")
    lost = F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(lost)
    whole = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)
    return joined.withColumns({"n_removed": lost, "kept_text": whole})


def without_repeated_lines(docs: DataFrame, similar: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all their columns, with the text that stays; ``n_chars``, where there is one,
    follows. A row that loses lines and has none but blank ones left goes; null, empty and blank texts
    stay as they are. Lines are near as in ``remove_repeated_lines``, which says what rows without an id,
    repeated rows and shared ids do. An empty table gives no rows; other columns pass unchanged."""
    rows = keyed(docs, whole=True)
    left = _without_lines(rows, similar).where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    cut = F.col("n_removed") > 0
    put = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(cut, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return left.select(*[put[c].alias(c) if c in put else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
