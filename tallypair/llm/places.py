"""Places in documents as compact binary: for shuffles that carry arrays, not a row a window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, written
from .words import mixed

PLACES = "box int, kind int, places binary, keys binary"
SCHEMA = pa.schema([("box", pa.int32()), ("kind", pa.int32()), ("places", pa.binary()), ("keys", pa.binary())])


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array, those of equal weight together, so that they compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(raw: bytes, kind: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel()


def pack(doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> bytes:
    """Entries sorted by document, then place."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    first = np.flatnonzero(new)
    step = at.astype(np.int64)
    step[1:] -= at[:-1]
    step[first] = at[first]
    count = np.diff(first, append=len(doc)).astype(np.uint32)
    ids = np.diff(doc[first], prepend=0)
    body = planes(ids.astype(np.int64)) + planes(tag[first].astype(np.int64)) + planes(count) + planes(step.astype(np.uint32))
    return np.array([len(first), len(doc)], np.int64).tobytes() + zstandard.compress(body, 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, n = map(int, np.frombuffer(blob, np.int64, 2))
    body = zstandard.decompress(blob[16:])
    ids = np.cumsum(from_planes(body[: 8 * docs], np.int64, docs))
    tag = from_planes(body[8 * docs : 16 * docs], np.int64, docs)
    count = from_planes(body[16 * docs : 20 * docs], np.uint32, docs)
    step = from_planes(body[20 * docs :], np.uint32, n).astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(count) - count
    base = np.repeat(total[first] - step[first], count) if docs else total
    return np.repeat(ids, count), np.repeat(tag, count), total - base


def boxes_of(doc: np.ndarray, n: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int32)


def by_box(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, boxes: int, kind: int, shift: int = 0, size: np.ndarray | None = None) -> list[tuple]:
    """Rows of ``PLACES`` for entries in any order: one a box of documents. ``size``: of each entry's
    range, where it isn't one width for all."""
    box = boxes_of(doc, boxes)
    order = np.lexsort((at, tag, doc, box))
    box, doc, tag, at = box[order], doc[order], tag[order], at[order]
    cuts = np.flatnonzero(np.diff(box, prepend=-1))
    sizes = size[order].astype(np.uint32) if size is not None else None
    blob = lambda a, b: zstandard.compress(planes(sizes[a:b]), 1) if sizes is not None else None
    return [(int(box[a]) + shift, kind, pack(doc[a:b], tag[a:b], at[a:b]), blob(a, b)) for a, b in zip(cuts, [*cuts[1:], len(box)], strict=True)]


def as_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, SCHEMA.types, strict=True)], schema=SCHEMA)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return as_table(rows).combine_chunks().to_batches()[0] if rows else pa.RecordBatch.from_pylist([], SCHEMA)


def covered(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges that the ranges of ``size`` at ``at`` cover: document, tag, first, end. Sorted."""
    if not len(doc):
        return doc, tag, at, at
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    apart = np.cumsum(other) * (int((at + size).max()) + 2)  # documents one after the other on one line
    first, end = at + apart, np.maximum.accumulate(at + size + apart)
    new = np.ones(len(doc), bool)
    new[1:] = first[1:] > end[:-1]
    start = np.flatnonzero(new)
    last = np.append(start, len(doc))[1:] - 1
    return doc[start], tag[start], at[start], (end - apart)[last]


def ranges(found: DataFrame, width: int, name: str) -> DataFrame:
    """``_doc, _tag, ranges`` (binary: firsts, then ends, int32) of the places in rows of ``PLACES``, by box."""
    kind = pa.schema([("_doc", pa.int64()), ("_tag", pa.int64()), ("ranges", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table["places"].to_pylist()]
        size = [np.full(len(p[0]), width) if k is None else from_planes(zstandard.decompress(k), np.uint32, len(p[0])).astype(np.int64) for p, k in zip(parts, table["keys"].to_pylist(), strict=True)]
        doc, tag, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = np.concatenate(size)
        order = np.lexsort((at, tag, doc))
        doc, tag, first, end = covered(doc[order], tag[order], at[order], size[order])
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
        cuts = np.flatnonzero(new)
        blobs = [np.concatenate([first[a:b], end[a:b]]).astype(np.int32).tobytes() for a, b in zip(cuts, np.append(cuts, len(doc))[1:], strict=True)]
        return pa.Table.from_arrays([pa.array(doc[cuts]), pa.array(tag[cuts]), pa.array(blobs, pa.binary())], schema=kind)

    return written(found.groupBy("box").applyInArrow(run, "_doc long, _tag long, ranges binary"), name)


def pairs_of(blob: bytes | None) -> np.ndarray:
    """Firsts and ends, a row each."""
    return np.frombuffer(blob, np.int32).reshape(2, -1) if blob else np.zeros((2, 0), np.int32)


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``doc_id, tag, text``. The tag is 0; rows that share an id have a hash
    of their text instead, so that places in one are not taken for places in another. ``whole``: with all
    columns of the row in ``_row``."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if whole else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
    again = written(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "repeated")
    if again.limit(1).count():
        rows = rows.join(sized(again), rows["doc_id"] == F.col("_again"), "left")
        tag = F.when(F.col("_again").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    else:
        tag = F.lit(0).cast("long")
    return rows.select("doc_id", tag.alias("tag"), "text", *(["_row"] if whole else []))


def in_ranges(blob: bytes | None, n: int) -> np.ndarray:
    """A mask of ``n`` places: those in the ranges."""
    out = np.zeros(n + 1, np.int8)
    first, end = pairs_of(blob)
    np.add.at(out, first, 1)
    np.add.at(out, np.minimum(end, n), -1)
    return np.cumsum(out[:n]) > 0
