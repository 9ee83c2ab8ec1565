import hashlib
import random

import pytest

from tallypair.llm.decontamination import contamination, decontaminate
from tallypair.llm.line_dedup import remove_repeated_lines, without_repeated_lines
from tallypair.llm.mixing import mix_sources
from tallypair.llm.pii import base_spans, personal_data
from tallypair.llm.quality import keep_good, quality_scores
from tallypair.llm.simhash_dedup import fingerprint, keep_one_of_each, near_duplicates
from tallypair.llm.substring_dedup import remove_repeated_windows
from tallypair.llm.suffix_dedup import remove_repeated_strings
from tallypair.llm.token_counts import token_counts
from tallypair.llm.vector_search import top_inner_products

KIND = "doc_id long, text string, lang string, source string, n_chars long, tag string, row string, box int"
LABELS = "doc_id long, quality int, toxic int"


def words(rng, n):
    return " ".join(rng.choice(["oak", "elm", "ash", "fir", "yew", "bay", "box", "fig"]) + str(rng.randint(0, 60)) for _ in range(n))


def table():
    rng = random.Random(5)
    common = words(rng, 40)
    texts = [words(rng, 60), common, words(rng, 30) + " " + common + "\n" + words(rng, 5), None, "", "one", "  \n\n", common, words(rng, 3000) + " " + common]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, common), (2, "other text of id two"), (None, common), (None, None)]
    return [(i, t, "en", ["a", None, "b"][k % 3], 1, "t", "r", k) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def covered(rows, units, width, join):
    """Brute force: what is left of each row's units."""
    starts = {}
    for i, t, *_ in rows:
        u = units(t)
        for k in range(len(u) - width + 1):
            w = tuple(u[k : k + width])
            if i is not None:
                starts[w] = min(starts.get(w, i), i)
    out = []
    for i, t, *_ in rows:
        u, gone = units(t), set()
        for k in range(len(u) - width + 1):
            if i is not None and starts[tuple(u[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i if i is not None else -1, len(u), len(gone), join([x for k, x in enumerate(u) if k not in gone])))
    return sorted(out)


def test_windows_against_brute_force(docs, empty):
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_windows(docs).collect()]
    assert sorted(got) == covered(table(), lambda t: (t or "").split(), 13, " ".join)
    assert remove_repeated_windows(empty).count() == 0


def test_strings_against_brute_force(docs, empty):
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in remove_repeated_strings(docs).collect()]
    assert sorted(got) == covered(table(), lambda t: list((t or "").encode()), 50, bytes)
    assert remove_repeated_strings(empty).count() == 0


def test_contamination(spark, docs, empty):
    text = table()[1][1].upper().replace(" ", ", ")
    tests = spark.createDataFrame([("x", text), ("y", "one"), ("z", None), (None, "one"), ("w", "!")], "item_id string, text string")
    got = {(r.doc_id, r.n_hit, r.n_items) for r in contamination(docs, tests).collect()}
    assert (1, 40, 1) in got and (5, 1, 1) in got and (0, 0, 0) in got and (8, 40, 1) in got
    assert contamination(empty, tests).count() == 0
    left = decontaminate(docs, tests)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {0, 2, 3, 4, 6, None} and left.count() == 6


def test_tokens(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    own = tokenizers.Tokenizer.from_file(path)
    assert sorted(r.n_tokens for r in token_counts(docs, path).collect()) == sorted(len(own.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in table())
    assert token_counts(empty, path).count() == 0


def test_near_copies(docs, empty):
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(table())
    of = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = f"{0:016x}"
    assert fingerprint(None) == fingerprint(" \n") == 0 and of[3, zero] == of[4, zero] == of[6, zero] == 3
    assert of[7, f"{fingerprint(table()[1][1]):016x}"] == 1
    assert near_duplicates(empty).count() == 0
    left = keep_one_of_each(docs)
    assert left.columns == docs.columns and left.where("doc_id = 7").count() == 0 and left.where("doc_id = 1").count() == 1


def test_lines(spark, docs, empty):
    a = "The quick brown fox jumps over the lazy dog while seven wise owls watch from old trees tonight and count every star above the quiet village until morning comes"
    rows = [(0, a + "\nLes.\n\nnew"), (1, a.replace("seven", "eleven") + "\nLes."), (2, "Les.\nLes"), (None, a)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (4, 0, a + "\nLes.\n\nnew"), 1: (2, 2, ""), 2: (2, 1, "Les"), None: (1, 0, a)}
    assert remove_repeated_lines(empty).count() == 0
    assert remove_repeated_lines(docs).count() == len(table()) and without_repeated_lines(docs).columns == docs.columns


def test_personal_data(docs, empty):
    text = "mail a.b@c.de or +1 (017) 555-7713, 10.0.0.256 10.0.0.1 and 4111111111111111"
    assert [(k, text[a:b]) for a, k, b in base_spans(text)] == [(0, "a.b@c.de"), (3, "+1 (017) 555-7713"), (1, "10.0.0.1"), (2, "4111111111111111")]
    rows = personal_data(docs).collect()
    assert len(rows) == len(table()) and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert personal_data(empty).count() == 0


def test_mix(docs, empty):
    rows = mix_sources(docs, leaf_rows=3, fan_in=2).collect()
    assert len(rows) == len(table()) and all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs, leaf_rows=3, fan_in=2).collect()))
    assert abs(sum({r.source_size: r.target for r in rows}.values()) - sum(r.size for r in rows)) < 1e-6
    assert mix_sources(empty).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, 1, 0), (3, None, 0)], LABELS)
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == len(table()) and all(0 <= r.score <= 1 for r in rows)
    assert quality_scores(empty, labels).count() == 0 and {r.score for r in quality_scores(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert keep_good(docs, labels).columns == docs.columns


def test_search(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(200)] + [(300, None), (301, [float("nan")] * 16), (7, [0.5] * 16), (7, [0.5] * 16), (None, [1.0] * 16)]
    got = {}
    for r in top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [(i, [int(x * 256 // 1) for x in v]) for i, v in rows if i is not None and v and v[0] == v[0]]
    for i, q in whole:
        if i % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i))[:5]
            assert sorted(got[i]) == [(k, j, -s) for k, (s, j) in enumerate(best, 1)]


def test_crowded_buckets(spark):
    """One bucket of many lines, near and less near: what goes equals brute force over all pairs."""
    rng = random.Random(3)
    base = words(rng, 60).split()
    lines = []
    for _ in range(150):
        w = list(base)
        for k in rng.sample(range(60), rng.randint(0, 6)):
            w[k] = f"w{rng.randint(0, 10**6)}"
        lines.append(" ".join(w))
    left = kept_by_brute_force(lines)
    assert 1 < len(left) < len(lines) and kept_lines(spark, lines) == left


def kept_by_brute_force(lines):
    """Numbers of the lines that stay by all pairs of their full sets of 12-character shingles."""
    of = [{x[i : i + 12] for i in range(max(len(x) - 11, 1))} for x in lines]
    label = list(range(len(lines)))
    for i, x in enumerate(of):
        for j in range(i):
            if len(x & of[j]) >= 0.8 * len(x | of[j]):
                old, new = sorted((label[i], label[j]), reverse=True)
                label = [new if k == old else k for k in label]
    return set(label)


def kept_lines(spark, lines):
    got = remove_repeated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    return {r.doc_id for r in got.where("n_removed = 0").collect()}


def test_shingles_at_every_character(spark):
    """Lines near by all 12-character shingles, which shingles at word starts hold apart, and a crowded bucket."""
    said = "Subscribe to our newsletter today"
    lines = [said, said + "!", "Über " + said.lower() + " 😀 und mehr", "Über " + said.lower() + " 😀 und mehr.", "x" * 40, "x" * 50, "ab", "abc"]
    assert kept_by_brute_force(lines) == {0, 2, 4, 6, 7}
    rng = random.Random(3)
    base = words(rng, 60).split()
    for _ in range(150):
        w = list(base)
        for k in rng.sample(range(60), rng.randint(0, 6)):
            w[k] = f"w{rng.randint(0, 10**6)}"
        lines.append(" ".join(w))
    lines += [" ".join(lines[8:14]), " ".join(lines[8:14]) + " and a little more at the end"]
    assert kept_lines(spark, lines) == kept_by_brute_force(lines)


def test_lines_of_few_shingles(spark):
    """Lines of 4 to 9 shingles at a similarity of 0.8 or a little more always meet."""
    rng = random.Random(11)
    lines = []
    for i in range(1500):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(15 + i % 5))
        lines += [line, line + "!"]
    lines += ["?abcdefghijklmnopqrs", "abcdefghijklmnopqrs?"]
    left = set(range(0, 3000, 2)) | {3000}
    assert kept_lines(spark, lines) == left


def test_items_without_an_id_hit(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "alpha beta gamma"), (4, "beta")], "doc_id long, text string")
    tests = spark.createDataFrame([(None, "alpha beta"), ("x", "gamma")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(rows, tests).collect()}
    none, x = (hashlib.sha256(s).hexdigest() for s in (b"", b"x"))
    assert got == {1: (2, 0, none, True), 2: (1, 1, x, True), 3: (3, 1, x, True), 4: (0, 0, none, False)}
    assert [r.doc_id for r in decontaminate(rows, tests).collect()] == [4]
