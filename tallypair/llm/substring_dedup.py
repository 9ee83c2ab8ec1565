"""Substring dedup: a log-structured index of window fingerprints, in sorted immutable runs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shuffles_removed, sized, written, written_apart
from .places import PLACES, as_batch, as_table, by_box, from_planes, in_ranges, keyed, pack, planes, ranges, unpack
from .words import FIRST, SECOND, SPACED, slices, texts_of, windows_of, words_of

ASK, RUN, FOUND = 0, 1, 2
#: Text bytes for each box of fingerprints, and the least number of boxes.
BOX_BYTES, LEAST_BOXES = 16 << 20, 64
#: Bits of the first hash that aren't kept, and of the second but for the verifying byte.
SPARE, REST = np.uint64(8), np.uint64(56)

#: A task takes so many bytes of text at a time.
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: int = 2) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = texts_of(batch.column(column))
        for a, b in slices(offsets, PIECE_BYTES):
            yield batch.slice(a, b - a)


def _fingerprints(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """Of every window of the batch (its texts sorted by id): text, place and two independent hashes."""
    raw, offsets = texts_of(batch.column(2))
    parts = []
    for a, b in slices(offsets):
        cut = offsets[a : b + 1]
        text, nth, (one, two) = words_of(raw[cut[0] : cut[-1]], cut - cut[0], SPACED, families=(FIRST, SECOND))
        whole = np.zeros(len(text), bool)
        whole[: len(text) - width + 1 or None] = text[width - 1 :] == text[: len(text) - width + 1] if len(text) >= width else False
        parts.append((text[whole].astype(np.int32) + a, nth[whole].astype(np.int32), windows_of(one, width, FIRST[1])[whole], windows_of(two, width, SECOND[1])[whole]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, t) for t in (np.int32, np.int32, np.uint64, np.uint64))


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key; where each key's group starts in it; the groups' sizes."""
    order = np.argsort(key)
    there = key[order]
    starts = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order, starts, np.diff(starts, append=len(key))


def _ask(width: int, boxes: int):
    """A batch's windows: those that a smaller document of the batch has are found at once; the others
    are asked about, a binary row a box, keys in the order of documents and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            text, at, key, check = _fingerprints(batch, width)
            if not len(key):
                continue
            doc = ids[text]
            order, starts, size = _groups(key)
            owner = np.empty(len(key), np.int64)
            owner[order] = np.repeat(np.minimum.reduceat(order, starts), size)
            known = (check[owner] == check) & (doc[owner] < doc)
            rows = by_box(doc[known], tags[text[known]], at[known], boxes, FOUND, boxes) if known.any() else []
            ask = np.flatnonzero(~known)
            box = (check[ask] % np.uint64(boxes)).astype(np.uint16 if boxes <= 1 << 16 else np.int64)
            ask = ask[np.argsort(box, kind="stable")]
            box = np.sort(box, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], box[1:] != box[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(ask)], strict=True):
                own = ask[a:b]
                rows.append((int(box[a]), ASK, pack(doc[own], tags[text[own]], at[own]), _as_bytes(key[own] >> SPARE, check[own] >> REST)))
            yield as_batch(rows)

    return run


def _as_bytes(key: np.ndarray, check: np.ndarray) -> bytes:
    """Keys of 56 bits, then the bytes that verify them."""
    return planes(key)[: 7 * len(key)] + check.astype(np.uint8).tobytes()


def _from_bytes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 8
    return from_planes(blob[: 7 * n] + bytes(n), np.uint64, n), np.frombuffer(blob, np.uint8, n, 7 * n)


def _run_row(box: int, key: np.ndarray, check: np.ndarray) -> tuple:
    """A sorted run of one box: the steps from key to key are small, so they compress."""
    return box, RUN, zstandard.compress(planes(np.diff(key, prepend=np.uint64(0))), 1), check.tobytes()


def _run_of(steps: bytes, checks: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(from_planes(zstandard.decompress(steps), np.uint64, len(checks)), dtype=np.uint64), np.frombuffer(checks, np.uint8)


def in_run(run: tuple[np.ndarray, np.ndarray], key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Which of the sorted keys the sorted run holds: each goes to its position in the run, and a match
    is verified; a run's keys that are alike but for the verifying byte are gone through."""
    keys, checks = run
    there, at = np.zeros(len(key), bool), np.searchsorted(keys, key)
    left = np.flatnonzero(at < len(keys))
    while len(left):
        left = left[keys[at[left]] == key[left]]
        same = checks[at[left]] == check[left]
        there[left[same]] = True
        left = left[~same]
        at[left] += 1
        left = left[at[left] < len(keys)]
    return there


def merged_runs(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs without a common fingerprint as one, merged by position, not sorted again."""
    n = len(one[0]) + len(two[0])
    at = np.searchsorted(one[0], two[0], "right") + np.arange(len(two[0]))
    rest = np.ones(n, bool)
    rest[at] = False
    key, check = np.empty(n, np.uint64), np.empty(n, np.uint8)
    key[at], check[at], key[rest], check[rest] = two[0], two[1], one[0], one[1]
    return key, check


def _merge(width: int, boxes: int):
    """One box: the batch's fingerprints, sorted, are merged with each historical run. Gives the windows
    that a smaller document has, of a run or of the batch, and the batch's own run: what no run holds."""

    def run(table: pa.Table) -> pa.Table:
        out, runs, asked = [], [], []
        for box, kind, places, keys in zip(*(c.to_pylist() for c in table.columns), strict=True):
            if kind == FOUND:
                out.append((box - boxes, FOUND, places, None))
            elif kind == RUN:
                runs.append(_run_of(places, keys))
            else:
                asked.append((*_from_bytes(keys), *unpack(places)))
        if not asked:
            return as_table(out)
        own = table["box"][0].as_py()
        key, check, doc, tag, at = (np.concatenate(x) for x in zip(*asked, strict=True))
        order, starts, size = _groups(key)
        there = check[order]
        unlike = np.flatnonzero(np.minimum.reduceat(there, starts) != np.maximum.reduceat(there, starts))
        for g in unlike:  # keys alike, windows not: split the group
            a, n = starts[g], size[g]
            order[a : a + n] = order[a : a + n][np.argsort(check[order[a : a + n]], kind="stable")]
        if len(unlike):
            there, by = check[order], key[order]
            starts = np.flatnonzero(np.concatenate([[True], (by[1:] != by[:-1]) | (there[1:] != there[:-1])]))
            size = np.diff(starts, append=len(key))
        first = order[starts]
        old = np.zeros(len(first), bool)
        for r in runs:
            old |= in_run(r, key[first], check[first])
        least = np.minimum.reduceat(doc[order], starts)
        hit = order[np.repeat(old, size) | (np.repeat(least, size) < doc[order])]
        if len(hit):
            out += by_box(doc[hit], tag[hit], at[hit], boxes, FOUND)
        fresh = first[~old]
        if len(fresh):
            out.append(_run_row(own, key[fresh], check[fresh]))
        return as_table(out)

    return run


def _compact(table: pa.Table) -> pa.Table:
    """One box's runs as one run."""
    runs = [_run_of(steps, checks) for steps, checks in zip(table["places"].to_pylist(), table["keys"].to_pylist(), strict=True)]
    return as_table([_run_row(table["box"][0].as_py(), *reduce(merged_runs, runs))])


class WindowIndex:
    """Fingerprints of the windows of all documents so far, as sorted runs in the shared folder.

    Documents come in batches of ascending ids, so that whatever a run holds is of a smaller document.
    ``ingest`` merges a batch with every run box by box and adds the batch's run, which is never changed.
    A batch's run is of level 0. Before the next batch the last two runs of a level become one of the
    next, so that a fingerprint is rewritten once a level and the runs are about the logarithm of the
    batches; the files of the two are removed once their successor is written.
    """

    def __init__(self, boxes: int, width: int = 13):
        self.boxes, self.width = boxes, width
        #: Level and table of each run, the oldest first.
        self.runs: list[tuple[int, DataFrame]] = []

    def compact(self) -> None:
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            (level, one), (_, two) = self.runs[-2:]
            with shuffles_removed(one.sparkSession):
                both = written(one.unionByName(two).groupBy("box").applyInArrow(_compact, PLACES), "window-runs")
            self.runs[-2:] = [(level + 1, both)]
            remove(one)
            remove(two)

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Places of the batch's windows that start in a smaller document of this or an earlier batch."""
        self.compact()
        asked = batch.select("doc_id", "tag", "text").where("doc_id is not null").mapInArrow(_ask(self.width, self.boxes), PLACES)
        for _, r in self.runs:
            asked = asked.unionByName(r)
        with shuffles_removed(batch.sparkSession):
            found, run = written_apart(asked.groupBy("box").applyInArrow(_merge(self.width, self.boxes), PLACES), "kind", (FOUND, RUN), "window-run")
        self.runs.append((0, run))
        return found


def even_cuts(rows: DataFrame, batches: int, steps: int = 128) -> tuple[list[int], int]:
    """Ids after which a batch ends, so that the batches have about equal bytes of text, and the bytes of
    all: a sum for each of ``steps`` stretches of ids. Rows of one id are never parted."""
    marks = rows.agg(F.percentile_approx("doc_id", [k / steps for k in range(1, steps)], 100 * steps)).first()[0] or []
    marks = sorted({int(m) for m in marks})
    stretch = F.size(F.filter(F.array(*[F.lit(m) for m in marks]).cast("array<bigint>"), lambda m: m < F.col("doc_id")))
    sums = dict(rows.where("doc_id is not null").groupBy(stretch.alias("k")).agg(F.sum(F.octet_length("text"))).collect())
    total, cuts, done = sum(v or 0 for v in sums.values()), [], 0
    for k, mark in enumerate(marks):
        done += sums.get(k) or 0
        if len(cuts) < batches - 1 and done * batches >= total * (len(cuts) + 1):
            cuts.append(mark)
    return cuts, total


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, cut, kept = [], [], []
        for text, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (text or "").encode().split()
            n.append(len(words))
            if blob:
                gone = in_ranges(blob, len(words))
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            cut.append(n[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeated_windows(docs: DataFrame, width: int = 13, batches: int = 4) -> DataFrame:
    """Remove each word that a window of ``width`` words covers whose words also start in a document with
    a smaller id: ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space).

    The documents are ingested in id order, in ``batches`` of about equal bytes, all of them into the
    index. Fingerprints are 56 bits, matches verified by 8 more and those that choose the box, of another
    hash. A window that several documents of a task's batch have is asked about once, so a passage in a
    third of all documents adds a row's worth of bytes a task to its box.

    One row per input row. Null text: no words. Null id: such a row neither loses words nor takes any.
    Rows that share an id don't take words from each other. Texts of fewer words than a window are
    kept. An empty table gives no rows; other columns are ignored.
    """
    rows = keyed(docs)
    cuts, size = even_cuts(rows, batches)
    boxes = LEAST_BOXES
    while boxes * BOX_BYTES < size:
        boxes *= 2
    index = WindowIndex(boxes, width)
    found, low = None, None
    for high in [*cuts, None]:
        part = rows if low is None else rows.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        more = index.ingest(part)
        found, low = more if found is None else found.unionByName(more), high
    gone = sized(ranges(found, width, "repeated-windows"))
    joined = rows.join(gone, (rows["doc_id"] == F.col("_doc")) & (rows["tag"] == F.col("_tag")), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")
