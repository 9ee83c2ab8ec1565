"""Vector code compression: a code of one entry a part, found by memoised grid cells."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, written
from .vectors import finite, floors, matrix
from .words import FIRST, mixed, powers

#: Integer components stay below this, so that squared distances of up to 128 components fit 64 bits.
MOST = 2.0**27
#: Cells that a task remembers for one part's codebook; it starts anew when there are more.
REMEMBERED = 200_000
SUMS = "part int, entry int, at int, s long, n long"


class Cells:
    """Nearest entries of one part's codebook. The part's space is a grid of boxes; a box remembers the
    entries that some point of it may have nearest: those whose least distance to the box isn't over
    the smallest of all entries' largest distances. Only these are compared exactly."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        spread = float(entries.std(axis=0).max()) if len(entries) else 0.0
        self.shift = max(0, int(np.ceil(np.log2(max(spread, 1.0)))))
        self.all = (1 << len(entries)) - 1
        self.known: dict[int, tuple[bytes, int]] = {}
        self.compared = self.rows = 0

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        """For each box a bit mask of its entries."""
        low = (cells << self.shift)[:, None, :]
        high = low + (1 << self.shift) - 1
        outside = np.maximum(np.maximum(low - self.entries, self.entries - high), 0)
        across = np.maximum(np.abs(self.entries - low), np.abs(self.entries - high))
        least, largest = (outside * outside).sum(2), (across * across).sum(2)
        keep = least <= largest.min(axis=1, keepdims=True)
        return (keep.astype(np.int64) << np.arange(len(self.entries))).sum(1)

    def _masks(self, cells: np.ndarray) -> np.ndarray:
        """For each row's box its mask, from memory where it was met before. Boxes are told apart by a
        hash; where two share one, rows of the second are compared with all entries."""
        key = mixed((cells.astype(np.uint64) * powers(FIRST[1], cells.shape[1] + 1)[1:]).sum(1, dtype=np.uint64))
        unlike, first, which = np.unique(key, return_index=True, return_inverse=True)
        boxes = cells[first]
        masks, new = np.empty(len(unlike), np.int64), []
        for i, (k, box) in enumerate(zip(unlike.tolist(), boxes, strict=True)):
            found = self.known.get(k)
            if found is None:
                new.append(i)
            else:
                masks[i] = found[1] if found[0] == box.tobytes() else self.all
        if new:
            masks[new] = self._undominated(boxes[new])
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
            self.known.update({k: (boxes[i].tobytes(), m) for i, k, m in zip(new, unlike[new].tolist(), masks[new].tolist(), strict=True)})
        out = masks[which]
        out[(cells != boxes[which]).any(axis=1)] = self.all
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest entry (ties to the lower index) and squared distance."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = (self._masks(x >> self.shift)[:, None] >> np.arange(len(self.entries))) & 1
        row, entry = np.nonzero(maybe)
        self.compared, self.rows = self.compared + len(row), self.rows + len(x)
        apart = x[row] - self.entries[entry]
        distance = (apart * apart).sum(1)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(distance, starts)
        at = np.flatnonzero(distance == least[row])
        at = at[np.concatenate([[True], row[at][1:] != row[at][:-1]])]
        return entry[at], least


def _parts(batch: pa.RecordBatch, scale: float, parts: int) -> list[np.ndarray]:
    x = floors(matrix(batch.column("embedding")), scale, MOST)
    if x.shape[1] % parts:
        raise ValueError(f"vectors of {x.shape[1]} components can't be cut into {parts} equal parts")
    if x.shape[1] > 128:
        peak = int(np.abs(x).max(initial=0))
        if x.shape[1] * (2 * peak + 1) ** 2 >= 1 << 62:
            raise ValueError("a squared distance might not fit 64 bits")
    return np.split(x, parts, axis=1)


def _sums(books: list[np.ndarray], scale: float):
    """A task's counts and sums of the parts that have each entry nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        count, total = [np.zeros(len(b), np.int64) for b in books], [np.zeros_like(b) for b in books]
        for batch in batches:
            for c, n, s, x in zip(cells, count, total, _parts(batch, scale, len(books)), strict=True):
                entry, _ = c.nearest(x)
                n += np.bincount(entry, minlength=len(n))
                np.add.at(s, entry, x)
        rows = [(p, e, i, int(s[e, i]), int(n[e])) for p, (n, s) in enumerate(zip(count, total, strict=True)) for e in np.flatnonzero(n).tolist() for i in range(s.shape[1])]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["part", "entry", "at", "s", "n"])

    return run


def _codes(books: list[np.ndarray], scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            error, code = np.zeros(len(batch), np.int64), np.zeros((len(batch), len(books)), np.uint8)
            for p, (c, x) in enumerate(zip(cells, _parts(batch, scale, len(books)), strict=True)):
                code[:, p], d = c.nearest(x)
                error += d
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def codebooks(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> list[np.ndarray]:
    """Of rows from ``finite``: a codebook a part. A round is one pass over the rows; only each task's sums
    leave it, and the driver gets ``entries`` sums a component, however many rows there are."""
    first = vectors.where("vec_id is not null").orderBy("vec_id", "embedding").select("embedding").limit(entries).collect()
    if not first:
        return []
    if len({len(r[0]) for r in first}) > 1:
        raise ValueError("the vectors have several lengths")
    seeds = floors(np.array([r[0] for r in first], float), scale, MOST)
    if seeds.shape[1] % parts:
        raise ValueError(f"vectors of {seeds.shape[1]} components can't be cut into {parts} equal parts")
    books = np.split(seeds, parts, axis=1)
    for _ in range(rounds):
        sums = vectors.select("embedding").mapInArrow(_sums(books, scale), SUMS).groupBy("part", "entry", "at")
        books = [b.copy() for b in books]
        for r in sums.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
            books[r["part"]][r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return books


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256``: each vector as ``parts`` entries of
    codebooks that ``rounds`` rounds over all rows make, all in integers.

    One row per row whose vector is there and finite, repeated rows too. The first entries are the rows of
    the smallest ids, of equal ids those of smaller vectors; fewer rows make smaller codebooks. Rows
    without an id get a code but don't start an entry. Null labels are one label. Vectors of several
    lengths, of a length that ``parts`` doesn't divide, or with components too large for exact 64-bit
    distances fail the job with a message. No such rows: no rows. Other columns are ignored.
    """
    rows = finite(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    books = codebooks(rows, parts, entries, rounds, scale)
    kind = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    if not books:
        return rows.sparkSession.createDataFrame([], f"{kind}, label_error long, codebooks_sha256 string")
    said = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    coded = written(rows.mapInArrow(_codes(books, scale), kind), "vector-codes")
    labels = written(coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    joined = coded.join(sized(labels), coded["label"].eqNullSafe(labels["_label"]))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
