"""Samples and counts of pairs that aren't stored or made, against plain loops over all pairs."""

import hashlib
import random
from collections import Counter
from itertools import combinations

from tallypair.operators import assembly, pairing, sampling, verdicts
from tallypair.plans import queries

ITEM = "task string, image_class string, strategy string, image_id string, status string, base string"


def odd_items(n=200, seed=4):
    """Items with nulls, repeats, one base of several ids and one id of several bases."""
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    rows = [("t", pick("hot", "hot", "hot", "b", None), pick("x", "y", "z", None), pick(None, *map(str, range(30))), pick("original", "final", "final", None), pick(None, *(f"b{i}" for i in range(25)))) for _ in range(n)]
    return rows + rows[:9]


def plain_pairs(rows, cross_status=False):
    out = []
    for a, b in combinations({(c, i, s, base) for _, c, _, i, s, base in rows}, 2):
        if None not in (a[0], a[1], a[3], b[1], b[3]) and a[0] == b[0] and a[1] != b[1] and a[3] != b[3] and (not cross_status or (a[2] and b[2] and a[2] != b[2])):
            a, b = sorted((a, b), key=lambda x: x[3])
            out.append((a[0], a[3], b[3], a[2], b[2]))
    return out


def kinds(a, b):
    there = [x for x in (a, b) if x is not None]
    return (min(there), max(there)) if there else (None, None)


def test_pairs_and_their_counts_on_odd_items(spark):
    rows = odd_items()
    frame = spark.createDataFrame(rows, ITEM).repartition(3)
    for cross in (False, True):
        want = plain_pairs(rows, cross)
        got = pairing.pairs_within_class(frame, cross, span=9)
        assert len(want) > 300 and Counter(map(tuple, got.collect())) == Counter(want)
        counts = {(r.type1, r.type2): r.n for r in pairing.pair_counts_within_class(frame, cross).collect()}
        assert counts == Counter(kinds(s, t) for *_, s, t in want)
        assert counts == {(r.type1, r.type2): r.n for r in verdicts.comparison_type_counts(got).collect()}
    finals = {(t, c, s, i) for t, c, s, i, status, _ in rows if status == "final"}
    want = [(a[0], a[1], a[2], a[3], b[2], b[3]) for a in finals for b in finals if None not in (*a, *b) and a[:2] == b[:2] and a[2] < b[2] and a[3] != b[3]]
    assert len(want) > 50 and Counter(map(tuple, pairing.pairs_cross_strategy(frame, span=5).collect())) == Counter(want)
    assert {(r.type1, r.type2): r.n for r in pairing.pair_counts_cross_strategy(frame).collect()} == Counter((s, t) for _, _, s, _, t, _ in want)


def test_counts_of_a_large_class_without_its_pairs(spark, tmp_path):
    """The registered query on 120 000 parts of one class, 7.2 * 10^9 pairs."""
    spark.range(120_000).selectExpr("id AS p_partkey", "'n' AS p_name", "'Brand#1' AS p_brand", "'SMALL' AS p_type", "1 AS p_size", "1.0D AS p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.type1, r.type2): r.n for r in queries.QUERIES["a12_comparison_type_counts"](spark, str(tmp_path)).collect()}
    names = ("final", "original", "zero-shot")
    assert got == {(a, b): 40_000 * 39_999 // 2 if a == b else 40_000**2 for a in names for b in names if a <= b}


def test_images_of_pairs_on_odd_items(spark):
    rows = odd_items(60)
    frame = spark.createDataFrame(rows, ITEM).repartition(3)
    for cross in (False, True):
        want = {(c, base) for c, a, b, *_ in plain_pairs(rows, cross) for base in (a, b)}
        items = pairing.paired_items(frame, cross)
        got = items.collect()
        assert {(r.image_class, r.base) for r in got} == want and len({(c, base) for _, c, _, _, _, base in rows}) > len(want) > 10
        of_pairs = assembly.image_manifest(pairing.pairs_within_class(frame, cross), "set").collect()
        assert sorted(map(tuple, assembly.manifest_of_images(items, "set").collect())) == sorted(map(tuple, of_pairs))
    assert pairing.paired_items(frame.limit(1)).count() == 0


def test_images_of_a_large_class_without_its_pairs(spark):
    """A class of 200 000 images has 2 * 10^10 pairs."""
    items = spark.range(200_000).selectExpr("'t' AS task", "concat('c', CAST(id DIV 200000 AS STRING)) AS image_class", "'x' AS strategy", "CAST(id AS STRING) AS image_id", "IF(id = 7, 'final', 'original') AS status", "CAST(id AS STRING) AS base")
    assert pairing.paired_items(items, True).count() == 200_000
    assert pairing.paired_items(items.where("id <> 7"), True).count() == 0


def test_sample_of_known_counts_with_repeated_keys(spark):
    """One key of many rows has them all under a bound or none, so groups are drawn again."""
    rows = [("a", "b", i % 2, "s", "t") for i in range(400)] + [(f"k{i}", f"l{i}", i, "s", "u") for i in range(300)] + [("p", "q", 0, None, "t")]
    pairs = spark.createDataFrame(rows, "base1 string, base2 string, item long, status1 string, status2 string").repartition(3)
    counts = spark.createDataFrame([("s", "t", 400), ("s", "u", 300), ("t", "t", 1)], "type1 string, type2 string, n long")
    at = lambda r: (hashlib.md5(f"42|{r[0]}|{r[1]}".encode()).hexdigest(), r[0], r[1])
    for most in (3, 90, 100000):
        quota = most // 3 if len(rows) > most else len(rows)
        want = Counter()
        for own in (rows[:400], rows[400:700], rows[700:]):
            want += Counter(r[:2] for r in sorted(own, key=at)[:quota])
        assert Counter((r.base1, r.base2) for r in sampling.balanced_sample(pairs, most, counts=counts).collect()) == want
    assert sampling.balanced_sample(pairs, 2, counts=counts).count() == 0


def stored_rows(spark, monkeypatch, name):
    """The query's rows, and the most rows that it stores in a table."""
    rows, real = [], sampling.stored

    def seen(df, name):
        out = real(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(sampling, "stored", seen)
    return queries.QUERIES[name](spark, "/root/testdata/sf0.01").count(), max(rows)


def test_sampled_pairs_are_not_all_stored(spark, monkeypatch):
    drawn, most = stored_rows(spark, monkeypatch, "k1_balanced_sample")
    assert drawn == 600 and most < 2000  # of 13491
    drawn, most = stored_rows(spark, monkeypatch, "k1_balanced_sample_large")
    assert drawn == 7200 and most < 10000  # six groups, their quota of 1200 and some more


def test_sampled_strategy_pairs_are_not_all_stored(spark, monkeypatch):
    drawn, most = stored_rows(spark, monkeypatch, "k1_balanced_sample_strategies")
    assert drawn == 60 and most < 400  # of 974
