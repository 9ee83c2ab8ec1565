"""Suffix arrays of words against plain sorting, and matches in several blocks of items against all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tallypair.llm import decontamination as d
from tallypair.llm.words import texts_of


def said(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def samples(rng):
    word = lambda: rng.choice(["Oak", "elm", "äsh", "fir", "2", "x1"])
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(f"t{i}", text(rng.randint(1, 30))) for i in range(25)] + [("t0", text(12)), (None, text(15)), ("null", None), ("none", "!?"), ("one", "x1")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, text(5) + " " + rng.choice(items[:27])[1] + " " + text(rng.randint(0, 20))) for i in range(60)]
    return docs + [(100, docs[40][1]), (None, items[3][1]), (300, None), (301, "")], items


def hits(text, items, width):
    words, hit, found = said(text), set(), set()
    for i, t in items:
        other = said(t)
        n = min(width, len(other))
        windows = {tuple(other[k : k + n]) for k in range(len(other) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(i)
    names = sorted(found - {None})
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def test_one_and_several_blocks_against_all_windows(spark, monkeypatch):
    docs, items = samples(random.Random(3))
    want = sorted((-1 if i is None else i, *hits(t, items, 4)) for i, t in docs)
    rows, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for size in (d.BLOCK_BYTES, 500):
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        got = d.contamination(rows, tests, 4).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
        left = sorted(str(r.doc_id) for r in d.decontaminate(rows, tests, 4).collect())
        assert left == sorted(str(i) for i, t in docs if not hits(t, items, 4)[-1])
    assert len(d.verbatim_matches(rows, tests, 4)) > 2


def test_suffixes_and_longest_matches_against_plain_sorting():
    docs, items = samples(random.Random(4))
    raw, offsets = texts_of(pa.array([t for _, t in docs]))
    array = d.SuffixArray(raw, offsets)
    ends = np.arange(len(array.words)) + array.left
    suffixes = [tuple(array.words[k : ends[k]].tolist()) for k in range(len(ends))]
    assert [suffixes[k] for k in array.order] == sorted(suffixes)
    tests = d.ItemSuffixes([x for x in items if x[1] is not None], 4)
    longest = array.longest(tests).tolist()
    for start, left, best in zip(tests.starts.tolist(), tests.left.tolist(), longest, strict=True):
        own = tuple(tests.words[start : start + left].tolist())
        alike = lambda s: next((k for k, (x, y) in enumerate(zip(s, own, strict=False)) if x != y), min(len(s), len(own)))  # noqa: E731, B023
        assert best == max(map(alike, suffixes))


def test_words_alike_in_hash_only_part_a_match(monkeypatch):
    docs, items = ["a b c d e f g h"], [("i", "a b c d x f g h")]
    tests = d.ItemSuffixes(items, 3)
    raw, offsets = texts_of(pa.array(docs))
    array = d.SuffixArray(raw, offsets)
    monkeypatch.setattr(d, "_longest", lambda *_: tuple(np.array([x]) for x in (0, 0, 0, 0, 0, 8, 3)))
    assert d._verbatim(raw, offsets, array, tests) == [(0, 0, 0, 0, 4), (0, 0, 5, 5, 3)]
