"""The index of window fingerprints: sorted runs, merges by position, levels, even batches."""

import os
import random

import numpy as np
import pytest

from tallypair.llm.places import keyed
from tallypair.llm.substring_dedup import WindowIndex, even_cuts, in_run, merged_runs, remove_repeated_windows


def a_run(rng, n, most):
    pairs = sorted({(int(k), int(c)) for k, c in zip(rng.integers(0, most, n), rng.integers(0, 3, n), strict=True)})
    return np.array([k for k, _ in pairs], np.uint64), np.array([c for _, c in pairs], np.uint8)


@pytest.mark.parametrize("most", [5, 60, 1 << 40])
def test_matches_are_verified_among_keys_alike(most):
    rng = np.random.default_rng(most)
    for n in (0, 1, 40):
        run, (key, check) = a_run(rng, n, most), a_run(rng, 40, most)
        there = set(zip(*(x.tolist() for x in run), strict=True))
        assert in_run(run, key, check).tolist() == [p in there for p in zip(key.tolist(), check.tolist(), strict=True)]


def test_runs_are_merged_by_position():
    rng = np.random.default_rng(3)
    for most in (6, 100, 1 << 50):
        key, check = a_run(rng, 50, most)
        own = rng.random(len(key)) < 0.4
        got = merged_runs((key[own], check[own]), (key[~own], check[~own]))
        assert got[0].tolist() == key.tolist()
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(zip(key.tolist(), check.tolist(), strict=True))


def texts(n):
    rng = random.Random(n)
    passages = [" ".join(f"p{k}w{rng.randint(0, 9)}" for _ in range(20)) for k in range(6)]
    return [(i, " ".join([f"own{i}a", rng.choice(passages), *(f"d{i}x{j}" for j in range(rng.randint(0, 40))), rng.choice(passages)])) for i in range(n)]


def test_levels_of_runs_and_removed_files(spark):
    frame = keyed(spark.createDataFrame(texts(14), "doc_id long, text string")).cache()
    index, files, found = WindowIndex(4), [], []
    for k in range(7):
        found.append(index.ingest(frame.where(f"doc_id between {2 * k} and {2 * k + 1}")))
        files.append(index.runs[-1][1]._written_path.removeprefix("file://"))
    index.compact()
    assert [level for level, _ in index.runs] == [2, 1, 0]
    assert [os.path.exists(f) for f in files] == [False] * 6 + [True]
    assert all(f.count() >= 0 for f in found)  # places found stay when runs go


def test_any_number_of_batches_gives_the_same_rows(spark):
    frame = spark.createDataFrame(texts(60) + [(7, "own7a and others"), (None, texts(60)[0][1])], "doc_id long, text string").repartition(3)
    rows = [sorted(map(tuple, remove_repeated_windows(frame, batches=n).collect()), key=str) for n in (1, 4, 9)]
    assert rows[0] == rows[1] == rows[2] and sum(r[2] for r in rows[0]) > 1000


def test_batches_have_even_bytes(spark):
    rng = random.Random(4)
    sizes = [(i, "x" * (rng.randint(1, 400) if i < 1500 else 20)) for i in range(3000)]
    frame = keyed(spark.createDataFrame(sizes, "doc_id long, text string").repartition(4))
    cuts, total = even_cuts(frame, 4)
    ends = [-1, *cuts, 3000]
    parts = [sum(len(t) for i, t in sizes if a < i <= b) for a, b in zip(ends, ends[1:], strict=False)]
    assert total == sum(parts) == sum(len(t) for _, t in sizes) and len(parts) == 4 and max(parts) < total / 3
    assert even_cuts(frame.where("doc_id < 0"), 4) == ([], 0)
