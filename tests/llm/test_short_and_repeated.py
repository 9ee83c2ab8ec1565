"""Short texts in window deduplication; repeated, empty and clashing rows in vector search."""

import duckdb
import numpy as np
import pytest

from tallypair.llm.common import bytes_of, memory_of, sized, written
from tallypair.llm.queries import OP8_SQL
from tallypair.llm.substring_dedup import remove_repeated_windows
from tallypair.llm.vector_search import _nearest, top_inner_products


@pytest.mark.parametrize("short", [0, 1, 2, 5, 11, 12, 13, 14])
def test_short_texts_alone_and_first(spark, short):
    own = " ".join(f"w{i}" for i in range(short))
    long = " ".join(f"x{i}" for i in range(40))
    alone = spark.createDataFrame([(1, own)], "doc_id long, text string")
    assert [tuple(r) for r in remove_repeated_windows(alone).collect()] == [(1, short, 0, own)]
    three = spark.createDataFrame([(1, own), (2, long), (3, long + " end"), (4, own)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeated_windows(three).collect()}
    assert got == {1: (short, 0), 2: (40, 0), 3: (41, 40), 4: (short, short if short >= 13 else 0)}


def test_search_of_repeated_rows_equals_its_sql(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(2).tolist(), "x") for i in range(1, 130)]
    rows += [(50, rows[49][1], "y"), (50, rng.normal(size=8).tolist(), "z"), (100, rows[99][1], "y"), (100, rows[99][1], "w"), (150, rows[0][1], ""), (200, None, ""), (None, rows[3][1], ""), (250, [1.0, None] * 4, ""), (300, [float("inf")] * 8, "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_inner_products(frame).collect())
    db = duckdb.connect()
    db.register("given", frame.toPandas())
    db.execute("CREATE TABLE embeddings AS SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM given")
    assert got == sorted(db.execute(OP8_SQL).fetchall())
    assert {r[1] for r in got} == {1, 2, 3, 4, 5} and len(got) == 20


def test_search_of_tiny_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert top_inner_products(spark.createDataFrame([], kind)).count() == 0
    assert top_inner_products(spark.createDataFrame([(50, [1.0])], kind)).count() == 0
    twice = top_inner_products(spark.createDataFrame([(50, [1.0]), (50, [1.0]), (7, [2.0])], kind)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in twice) == [(50, 1, 7, 131072), (50, 2, 50, 65536)]
    with pytest.raises(Exception, match="doesn't fit 64 bits"):
        top_inner_products(spark.createDataFrame([(50, [1.5e9] * 4), (7, [1.5e9] * 4)], kind)).collect()


def test_small_files_of_large_rows_are_not_broadcast(spark):
    flags = written(spark.range(2000).selectExpr("id", "array_repeat(true, 5000) AS flags"), "flags")
    assert bytes_of(flags) < 1 << 20 and memory_of(flags) > 60 << 20
    joined = lambda t: spark.range(10).join(t, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in joined(sized(flags)) and "strategy=broadcast" in joined(sized(flags, memory=1 << 30))
    rows = [(1, "ab", b"x", ["a", None], {"k": 1}, (1, "z")), (None, None, None, None, None, None)]
    odd = spark.createDataFrame(rows, "i int, s string, b binary, a array<string>, m map<string,int>, t struct<x:int,y:string>")
    assert 100 < memory_of(written(odd, "odd")) < 1000 and memory_of(written(odd.limit(0), "none")) == 0


def test_floors_leave_few_rows_of_other_clusters_and_lose_none():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 1)) * 300 + np.repeat(rng.normal(size=(12, 8)) * 300, 8, axis=1)
    rows = np.rint(centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 64)) * 8).astype(np.int64)
    queries, scores = rows[:30], rows[:30] @ rows.T
    floors = np.sort(scores[:, :500], axis=1)[:, -6].astype(float)
    left = _nearest(queries, rows[500:], 6, floors)
    for i, own in enumerate(left):
        best = np.sort(scores[i])[-6]
        assert set(np.flatnonzero(scores[i, 500:] >= best)) <= set(own.tolist())
    assert sum(map(len, left)) < 0.1 * 30 * 2500


def test_search_of_several_blocks_equals_one(spark, monkeypatch):
    rng = np.random.default_rng(9)
    kind, size = "vec_id long, embedding array<double>", {True: 8, False: 5}
    rows = [(i, (rng.normal(size=size[i % 7 > 0]) + 2 * (i % 5)).round(1).tolist()) for i in range(400)] + [(100, [9.5] * 8), (100, [9.5] * 8)]
    frame = spark.createDataFrame(rows, kind).repartition(3)
    found = lambda: sorted(map(tuple, top_inner_products(frame).collect()))
    one = found()
    monkeypatch.setattr("tallypair.llm.vector_search.CANDIDATES", 60)
    monkeypatch.setattr("tallypair.llm.vector_search.QUERIES", 4)
    assert len(one) == 9 * 5
    assert found() == one
