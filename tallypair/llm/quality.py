"""Quality classifier: a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, sized, without, written

#: Byte classes whose shares are statistics.
SYMBOLS, STOPS, SENTENCE = b"!#$%&*+/<=>@[\\]^_`{|}~", b".,;:?'\"()-", b".!?"
NAMES = (
    "words", "word_length", "word_spread", "upper", "symbols", "stops", "digits", "lines", "distinct",
    "commonest", "repeated", "packed", "sentence", "bars", "beyond_ascii", "ends",
)


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOLS, _STOPS, _SENTENCE = map(_table, (SYMBOLS, STOPS, SENTENCE))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text: logs of lengths, arc sines of shares."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(int(counts[65:91].sum() + counts[97:123].sum()), 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    often = Counter(words)
    packed = len(zlib.compress(raw, 1)) / size
    ends = sum(not (w[-1] >= 128 or 48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or 97 <= w[-1] <= 122) for w in words)

    def share(x: float, of: float) -> float:
        return float(np.arcsin(np.sqrt(min(1.0, x / of))))

    return [
        float(np.log(n)),
        float(np.log(lengths.mean())),
        float(np.log1p(lengths.std())),
        share(counts[65:91].sum(), letters),
        share(counts[_SYMBOLS].sum(), size),
        share(counts[_STOPS].sum(), size),
        share(counts[48:58].sum(), size),
        share(counts[10], n),
        share(len(often), n),
        share(max(often.values()), n),
        share(sum(a == b for a, b in pairwise(words)), n),
        float(np.log(min(packed, 2.0))),
        float(np.log1p(n / (1 + counts[_SENTENCE].sum()))),
        share(counts[124], n),
        share(counts[128:].sum(), size),
        share(ends, n),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, row, x`` with the statistics of every whole text; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "row", "x"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("row"))
    return rows.mapInArrow(run, "doc_id long, row long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, inverse of the Cholesky factor of the shrunken covariance, the log
    determinant of the covariance."""

    parts: tuple[tuple[float, np.ndarray, np.ndarray, float], ...] | None
    flat: float
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None or not len(x):
            return np.full(len(x), self.flat)
        logs = []
        for prior, mean, unmix, log_det in self.parts:
            z = unmix @ (x - mean).T
            logs.append(prior - 0.5 * (log_det + (z * z).sum(0)))
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / self.temper, -36, 36)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: count, sums and sums of products of the rows of one task."""
    p, sums = len(NAMES), {}
    for batch in batches:
        x = np.asarray(batch.column(1).flatten()).reshape(-1, p)
        y = batch.column(0).to_numpy(zero_copy_only=False)
        for c in (0, 1):
            own = x[y == c]
            sums[c] = sums.get(c, 0) + np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    for c, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["quality", "v"])


def fit(stats: DataFrame, labels: DataFrame, shrink: float = 0.15, ridge: float = 1e-3, temper: float = 4.0) -> Discriminant:
    """Fit on all labelled rows: Spark sums counts, means and products; the driver gets one bounded row
    a class and statistic. A class covariance is drawn towards the diagonal of the pooled one by
    ``shrink``, with ``ridge`` added; ``temper`` flattens the log-density difference.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int")).distinct()
    marks = sized(written(marks, "marks"))
    sums = stats.join(marks, "doc_id").select("quality", "x").mapInArrow(_sums, "quality int, v array<double>")
    cells = sums.select("quality", F.posexplode("v").alias("at", "v")).groupBy("quality", "at").agg(F.sum("v").alias("v")).collect()
    p = len(NAMES)
    total = np.zeros((2, 1 + p + p * p))
    for c, at, v in cells:
        total[c, at] = v
    n = total[:, 0]
    if n.min() < 2:
        return Discriminant(None, float(n[1] / n.sum()) if n.sum() else 0.5, temper)
    means = total[:, 1 : 1 + p] / n[:, None]
    covs = [(total[c, 1 + p :].reshape(p, p) - n[c] * np.outer(means[c], means[c])) / (n[c] - 1) for c in (0, 1)]
    pooled = np.diag(np.diag((covs[0] * n[0] + covs[1] * n[1]) / n.sum()))
    parts = []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrink) * covs[c] + shrink * pooled + ridge * np.eye(p))
        parts.append((float(np.log(n[c] / n.sum())), means[c], np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())))
    return Discriminant(tuple(parts), float(n[1] / n.sum()), temper)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, the score from its whole text alone.

    Labels of held-out ids (crc32 of the id as text, modulo 4, is 2) are not read. Null, empty or
    wordless texts have all-zero statistics and get a score like any other. A null id is not held out.
    Labels that are null, other than 0 and 1, or without a document are ignored; repeated labels count
    once. With fewer than two documents in a class the score is the share of class 1 (0.5 without
    labels). Repeated rows each get a row; an empty table gives none; other columns are ignored.
    """
    return _scored(docs, labels, cut).drop("row")


def _scored(docs: DataFrame, labels: DataFrame, cut: float) -> DataFrame:
    stats = written(document_statistics(docs), "statistics")
    model = fit(stats, labels.select(F.col("doc_id").cast("long"), "quality").where(~held_out()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(np.asarray(batch.column(2).flatten()).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "row", "score"])

    scored = stats.mapInArrow(run, "doc_id long, row long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "row")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all their columns, that the classifier doesn't reject, scored as by
    ``quality_scores``: null, empty and very long texts by their statistics like any other, repeated rows
    alike, rows that share an id each by its own text. A row with a null id is judged too. An empty
    table gives no rows; columns of any other name pass unchanged."""
    poor = written(_scored(docs, labels, cut).where("predicted = 0").select(F.col("row").alias("key")).distinct(), "rejected")
    return without(docs, poor)
