"""The classifier's scores against a plain computation of every statistic, covariance and density."""

import math
import random
import zlib

import numpy as np

from tallypair.llm.quality import quality_scores, statistics

PIECES = ["Harbour", "lamp", "reads", "straße", "naïve", "42", "3.14", "$$$", "win!", "BUY", "a|b", "of", "the", "the", "grain.", "\n", "{x}", "日本", "end?"]


def plain_statistics(text):
    text = text or ""
    raw, words = text.encode(), [w.encode() for w in text.replace("\n", " ").split(" ") if w]
    if not words:
        return [0.0] * 16
    n, of = len(words), lambda chars: sum(b in chars for b in raw)
    upper, lower = of(range(65, 91)), of(range(97, 123))
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    share = lambda x, whole: math.asin(math.sqrt(min(1.0, x / whole)))
    alike = sum(words[i] == words[i + 1] for i in range(n - 1))
    last = [w[-1] for w in words]
    ends = sum(not (b >= 128 or chr(b).isalnum()) for b in last)
    return [
        math.log(n), math.log(mean), math.log1p(math.sqrt(sum((x - mean) ** 2 for x in lengths) / n)), share(upper, max(upper + lower, 1)),
        share(of(b"!#$%&*+/<=>@[\\]^_`{|}~"), len(raw)), share(of(b".,;:?'\"()-"), len(raw)), share(of(range(48, 58)), len(raw)), share(of(b"\n"), n),
        share(len(set(words)), n), share(max(words.count(w) for w in set(words)), n), share(alike, n), math.log(min(len(zlib.compress(raw, 1)) / len(raw), 2.0)),
        math.log1p(n / (1 + of(b".!?"))), share(of(b"|"), n), share(of(range(128, 256)), len(raw)), share(ends, n),
    ]


def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(400):
        weights = [rng.random() + (i % 2) * (k % 3) for k in range(len(PIECES))]
        rows.append((i, " ".join(rng.choices(PIECES, weights, k=rng.randint(1, 90))), i % 2 if rng.random() < 0.8 else 1 - i % 2))
    return [*rows, (400, None, 0), (401, "", 1), (402, " \n ", 0)]


def test_statistics_of_every_text():
    for _, text, _ in corpus():
        assert np.allclose(statistics(text), plain_statistics(text), rtol=1e-12, atol=1e-12)


def test_scores_against_a_plain_discriminant(spark):
    rows = corpus()
    learnt = [(text, q) for i, text, q in rows if i % 5 and zlib.crc32(str(i).encode()) % 4 != 2]
    x = {c: np.array([plain_statistics(t) for t, q in learnt if q == c]) for c in (0, 1)}
    size = {c: len(x[c]) for c in x}
    every = sum(size.values())
    pooled = sum(np.diag(np.cov(x[c].T)) * size[c] for c in x) / every
    shrunk = {c: 0.85 * np.cov(x[c].T) + 0.15 * np.diag(pooled) + 1e-3 * np.eye(16) for c in x}

    def density(v, c):
        away = v - x[c].mean(0)
        return math.log(size[c] / every) - 0.5 * (np.linalg.slogdet(shrunk[c])[1] + away @ np.linalg.solve(shrunk[c], away))

    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 5] * 2 + [(7000, 1, 0), (5, None, 1), (10, 3, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        v = np.array(plain_statistics(text))
        score = 1 / (1 + math.exp(-(density(v, 1) - density(v, 0)) / 4))
        assert abs(got[i].score - score) < 1e-8 and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].predicted == int(got[i].score >= 0.7)
