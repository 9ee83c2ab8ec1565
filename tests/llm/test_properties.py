"""Operators without SQL against plain versions, and the stages on awkward tables."""

import random

import pytest

from tallypair.llm.decontamination import decontaminate
from tallypair.llm.line_dedup import without_repeated_lines
from tallypair.llm.mixing import mix_sources
from tallypair.llm.quality import held_out, keep_good, quality_scores
from tallypair.llm.simhash_dedup import fingerprint, keep_one_of_each, near_duplicates, near_links

CLASHING = "doc_id long, text string, _row string, _key string, _near string, _hit string, _poor string, _again string, row string, key string, `a.b` string"
SAY = "the river runs past old mills and quiet fields until it meets the sea near a small harbour town".split()


def texts(rng, n):
    return [" ".join(rng.choice(SAY) for _ in range(60)) for _ in range(n)]


def test_links_against_all_pairs(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for x in prints[:100]:
        for bits in (1, 3, 4, 5, 6):
            prints.append(x ^ sum(1 << b for b in rng.sample(range(64), bits)))
    prints += [prints[0] ^ (1 << b) for b in range(40)] + [0, 1, (1 << 64) - 1]
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    root = {p: p for p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = sorted((top(a), top(b)))
        root[b] = a

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                join(a, b)
    want = {p: top(p) for p in prints}
    root.update({p: p for p in prints})
    for r in near_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect():
        assert want[r.a] == want[r.b]
        join(r.a, r.b)
    assert {p: top(p) for p in prints} == want


def test_components_of_texts_against_all_pairs(spark):
    rng = random.Random(8)
    rows = list(enumerate(texts(rng, 60)))
    rows += [(100 + i, t + " again" * k) for i, (_, t) in enumerate(rows[:40]) for k in [i % 3]]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of = {i: fingerprint(t) for i, t in rows}
    label = {i: i for i, _ in rows}
    for i in label:
        for j in label:
            if (of[i] ^ of[j]).bit_count() <= 4 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    assert got == label


def level(sizes, weights, cap):
    """Targets by filling up: the excess of full sources is shared out again until none is above."""
    left, out = dict.fromkeys(sizes), {}
    total = sum(sizes.values())
    while left:
        rest = total - sum(out.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        full = [s for s in left if share[s] > cap * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = cap * sizes[s]
            del left[s]
    return out


def test_targets_and_taken_words(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 90)), ["a", "b", "c", "d", None][min(rng.randint(0, 14), 4) if i % 3 else 0]) for i in range(900)]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(s for s in sizes if s is not None) + [None]
    want = level(sizes, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source, taken, target = {i: s for i, _, s in rows}, {}, {}
    for r in mix_sources(docs, leaf_rows=50, fan_in=4).collect():
        s = source[r.doc_id]
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
        assert r.taken <= 3 * r.size and r.source_size == sizes[s]
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 90


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(6)
    good = [(i, ". ".join(" ".join(rng.sample(SAY, 9)).capitalize() for _ in range(rng.randint(3, 9))) + ".", 1) for i in range(0, 600, 2)]
    poor = [(i, " ".join(rng.choice(["$$$", "BUY", "click", "!!!", "win", "0000"]) for _ in range(rng.randint(5, 80))), 0) for i in range(1, 600, 2)]
    rows = good + poor
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    held = [(got[i].score, q) for i, _, q in rows if got[i].held_out]
    pairs = [(a, b) for a, q in held if q for b, z in held if not z]
    assert len(held) > 100 and sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) > 0.98
    # labels of held-out rows turned round change nothing
    other = spark.createDataFrame([(i, 1 - q if got[i].held_out else q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in quality_scores(docs, other).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)
    assert docs.where(held_out()).count() == len(held)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(2)
    plain = texts(rng, 12)
    long = " ".join(rng.choice(SAY) + str(k % 977) for k in range(120_000))
    cases = [(1, plain[0]), (2, plain[0]), (1, plain[1]), (3, plain[2]), (3, plain[2]), (4, None), (5, ""), (6, " \n"), (None, plain[3]), (None, None), (7, long), (8, long), *[(20 + i, t) for i, t in enumerate(plain[4:])]]
    return spark.createDataFrame([(i, t, *[f"{c}{k}" for c in "rknhpagxd"]) for k, (i, t) in enumerate(cases)], CLASHING).repartition(3)


def test_stages_on_awkward_tables(spark, awkward):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    tests = spark.createDataFrame([("x", " ".join(SAY)), (None, None)], "item_id string, text string")
    stages = [lambda d: keep_good(d, labels), without_repeated_lines, keep_one_of_each, lambda d: decontaminate(d, tests)]
    own = {r.row: r for r in awkward.collect()}
    for stage in stages:
        left = stage(awkward)
        assert left.columns == awkward.columns
        for r in left.collect():
            was = own[r.row]
            assert (r.doc_id, r._row, r._near, r.key, r["a.b"]) == (was.doc_id, was._row, was._near, was.key, was["a.b"])
        nothing = stage(awkward.limit(0))
        assert nothing.columns == awkward.columns and nothing.count() == 0
    ids = sorted((r.doc_id or -1, r.text or "") for r in keep_one_of_each(awkward).collect())
    texts_of_1 = [t for i, t in ids if i == 1]
    assert len(texts_of_1) == 2 and not any(i in (2, 8) for i, _ in ids) and sum(i == 3 for i, _ in ids) == 1 and sum(i == -1 for i, _ in ids) == 2


def test_pipeline_on_a_small_folder(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts(rng, 40))] + [(50, None, None, None, None), (None, "no id here", "en", "a", 10)]
    rows += [(60, rows[3][1], "en", "a", 1), (61, "fresh words " + " ".join(SAY) + " and more", "en", "b", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("x", " ".join(SAY))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # without labels every score is 0.5, under the cut: all go
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        after = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(after.collect(), after.schema)
    left = {r.doc_id for r in docs.collect()}
    assert 60 not in left and 61 not in left and len(left) > 5
