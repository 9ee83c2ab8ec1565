"""Suffix-array dedup: repeated byte strings by bucket-pointer refinement of suffixes.

Suffixes that can't repeat never get far. Every ``width``-byte string has an anchor: of the grams that
lie in it, the one of least hash, the leftmost of equals. Equal strings have equal anchors at equal
offsets, so (1) anchors are the initial q-gram buckets, and a bucket with one document ends there;
(2) the strings of the other buckets go, as segments of text that share an anchor, to the box of their
anchor's gram; (3) there the suffixes of each bucket are refined to ``width`` bytes, later buckets by the new pointers of earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized
from .places import PLACES, as_batch, as_table, by_box, from_planes, keyed, pack, pairs_of, planes, ranges, text_bytes, unpack
from .substring_dedup import pieces
from .suffixes import suffix_order
from .words import FIRST, mixed, texts_of

ASK, KNOWN, FOUND = 0, 1, 2
GRAM = 24
#: Text bytes for each box, and the least number of boxes.
BOX_BYTES, LEAST_BOXES = 4 << 20, 64


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each place (of no use at the last places): 8, 16, then 24."""
    h, base, n = raw.astype(np.uint64) + np.uint64(1), FIRST[0], 1
    eight = None
    while n < 16:
        out = h * base
        out[:-n] += h[n:]
        h, base, n = out, np.uint64(int(base) ** 2 % (1 << 64)), 2 * n
        if n == 8:
            eight, base_eight = h, base
    out = h * base_eight
    out[:-16] += eight[16:]
    return mixed(out)


def _segments(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of successive strings of one text that share an anchor: text, first and last place (in
    ``raw``), and the hash of the anchor's gram."""
    n = len(raw)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    grams = _grams(raw)
    mask = np.uint64((1 << max(1, int(n).bit_length())) - 1)
    low = (grams & ~mask) | np.arange(n, dtype=np.uint64)
    span, reach = width - GRAM + 1, 1
    while 2 * reach <= span:
        low[:-reach] = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = span - reach
    low[: n - rest] = np.minimum(low[: n - rest], low[rest:])
    sizes = np.diff(offsets)
    end = np.repeat(offsets[1:], sizes)
    place = np.flatnonzero(np.arange(n) + width <= end)
    if not len(place):
        return _segments(raw[:0], offsets[:1], width)
    anchor = (low[place] & mask).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    last = np.append(first, len(place))[1:] - 1
    text = np.searchsorted(offsets, place[first], "right") - 1
    return text, place[first], place[last], grams[anchor[first]]


def _ask(width: int, boxes: int):
    """Which anchors have other documents? Those that have one in the batch are found at once and are
    told about once; the others are asked about, six bytes and a place each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = texts_of(batch.column(2))
            text, first, _, gram = _segments(raw, offsets, width)
            if not len(text):
                continue
            at, doc, tag = first - offsets[text], ids[text], tags[text]
            order = np.argsort(gram)
            by, its = gram[order], doc[order]
            starts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
            size = np.diff(starts, append=len(by))
            shared = np.repeat(np.minimum.reduceat(its, starts) != np.maximum.reduceat(its, starts), size)
            there = order[shared]
            rows = by_box(doc[there], tag[there], at[there], boxes, FOUND, boxes) if len(there) else []
            once = np.zeros(len(by), bool)
            once[starts] = True
            for kind, own in ((ASK, np.sort(order[~shared])), (KNOWN, np.sort(order[shared & once]))):
                own = own[np.lexsort((at[own], tag[own], doc[own], gram[own] % np.uint64(boxes)))]
                box = (gram[own] % np.uint64(boxes)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(box, prepend=-1))
                for a, b in zip(cuts, np.append(cuts, len(own))[1:], strict=True):
                    x = own[a:b]
                    keys = (gram[x] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
                    rows.append((int(box[a]), kind, pack(doc[x], tag[x], at[x]), np.ascontiguousarray(keys).tobytes()))
            yield as_batch(rows)

    return run


def _answer(boxes: int):
    """One box of initial buckets: the anchors that have two documents or more."""

    def run(table: pa.Table) -> pa.Table:
        out, key, doc, tag, at, known = [], [], [], [], [], []
        for box, kind, places, keys in zip(*(c.to_pylist() for c in table.columns), strict=True):
            if kind == FOUND:
                out.append((box - boxes, FOUND, places, None))
                continue
            d, t, p = unpack(places)
            wide = np.zeros((len(d), 8), np.uint8)
            wide[:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
            for to, x in zip((key, doc, tag, at, known), (wide.view(np.uint64).ravel(), d, t, p, np.full(len(d), kind == KNOWN)), strict=True):
                to.append(x)
        if key:
            key, doc, tag, at, known = map(np.concatenate, (key, doc, tag, at, known))
            order = np.argsort(key)
            by, its = key[order], doc[order]
            starts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
            size = np.diff(starts, append=len(by))
            shared = (np.minimum.reduceat(its, starts) != np.maximum.reduceat(its, starts)) | (np.maximum.reduceat(known[order].astype(np.int8), starts) > 0)
            there = order[np.repeat(shared, size) & ~known[order]]
            if len(there):
                out += by_box(doc[there], tag[there], at[there], boxes, FOUND)
        return as_table(out)

    return run


def _cut(width: int, boxes: int):
    """The segments of the places that may repeat, to the boxes of their anchors. Where documents of a
    batch have the same segment, the smallest one's goes and the others' strings are found at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = texts_of(batch.column(2))
            parts, of, at = [], [], []
            for i, blob in enumerate(batch.column(3).to_pylist()):
                for a, b in pairs_of(blob).T.tolist():
                    parts.append(raw[offsets[i] + a : min(offsets[i] + b, offsets[i + 1])])
                    of.append(i)
                    at.append(a)
            if not parts:
                continue
            size = np.array([len(p) for p in parts])
            cuts = np.concatenate([[0], np.cumsum(size)])
            some = np.concatenate(parts)
            part, first, last, gram = _segments(some, cuts, width)
            of, at = np.array(of)[part], np.array(at)[part] + first - cuts[part]
            doc, tag = ids[of], tags[of]
            body = some.tobytes()
            least: dict[bytes, int] = {}
            texts = [body[a : b + width] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            for t, d in zip(texts, doc.tolist(), strict=True):
                if d < least.get(t, d + 1):
                    least[t] = d
            known = np.array([least[t] for t in texts], np.int64) < doc if texts else np.zeros(0, bool)
            n = last - first + width
            rows = by_box(doc[known], tag[known], at[known], boxes, FOUND, boxes, n[known]) if known.any() else []
            box = (gram % np.uint64(boxes)).astype(np.int64)
            own = np.flatnonzero(~known)
            own = own[np.lexsort((at[own], tag[own], doc[own], box[own]))]
            cuts = np.flatnonzero(np.diff(box[own], prepend=-1))
            for a, b in zip(cuts, np.append(cuts, len(own))[1:], strict=True):
                x = own[a:b]
                blob = zstandard.compress(planes(n[x].astype(np.uint32)) + b"".join([texts[i] for i in x.tolist()]), 3)
                rows.append((int(box[x[0]]), ASK, pack(doc[x], tag[x], at[x]), blob))
            yield as_batch(rows)

    return run


def refined(text: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """The bucket of the ``width``-byte suffix prefix at each place of ``text`` (-1: it would pass the end
    of its part, at ``ends``), by bucket-pointer refinement of buckets of 8-byte grams. Buckets that
    were refined further and agree in ``width`` bytes are neighbours, and are joined."""
    n = len(text)
    left = ends - np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key[: max(n - k, 0)] |= text[k:].astype(np.uint64) << np.uint64(8 * (7 - k))
    short = np.flatnonzero(left < 8)
    key[short] &= ~np.uint64(0) << (8 * (8 - left[short])).astype(np.uint64)
    # where there are zero bytes, they must not be taken for an end
    order, pointer = suffix_order((key,) if text.all() else (np.minimum(left, 8), key), left, 8, width)
    order = order[left[order] >= width]
    bucket = np.full(n, -1)
    unlike = np.flatnonzero(pointer[order[1:]] != pointer[order[:-1]])
    same = np.ones(len(unlike), bool)
    for k in (*range(0, width - 8, 8), width - 8):
        some = np.flatnonzero(same)
        same[some] = key[order[unlike[some]] + k] == key[order[unlike[some] + 1] + k]
    new = np.zeros(len(order), np.int64)
    new[unlike[~same] + 1] = 1
    bucket[order] = np.cumsum(new)
    return bucket


def _refine(width: int, boxes: int):
    """One box: equal segments are one, with its smallest document; the suffixes of different segments
    are refined; strings that a smaller document has are found, as ranges of places."""

    def run(table: pa.Table) -> pa.Table:
        out, docs, tags, ats, texts = [], [], [], [], []
        for box, kind, places, keys in zip(*(c.to_pylist() for c in table.columns), strict=True):
            if kind == FOUND:
                out.append((box - boxes, FOUND, places, keys))
                continue
            d, t, p = unpack(places)
            body = zstandard.decompress(keys)
            size = from_planes(body[: 4 * len(d)], np.uint32, len(d)).astype(np.int64)
            cuts = (4 * len(d) + np.concatenate([[0], np.cumsum(size)])).tolist()
            texts += [body[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            for to, x in zip((docs, tags, ats), (d, t, p), strict=True):
                to.append(x)
        if not texts:
            return as_table(out)
        doc, tag, at = map(np.concatenate, (docs, tags, ats))
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(t, len(number)) for t in texts])
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        size = np.array([len(t) for t in number], np.int64)
        text = np.frombuffer(b"".join(number), np.uint8)
        ends = np.cumsum(size)
        bucket = refined(text, np.repeat(ends, size), width)
        place = np.flatnonzero(bucket >= 0)
        part = np.searchsorted(ends, place, "right")
        owner = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(owner, bucket[place], least[part])
        # of a segment, the places whose string a document smaller than its own smallest has
        gone = np.zeros(len(text) + 1, np.int8)
        gone[place] = owner[bucket[place]] < least[part]
        edge = np.diff(gone, prepend=np.int8(0))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        part = np.searchsorted(ends, first, "right")
        inside, n = first - (ends - size)[part], last - first + width - 1
        whole = doc > least[which]
        found = [(doc[whole], tag[whole], at[whole], size[which[whole]])]
        own = np.flatnonzero(~whole)  # members that are their segment's smallest document
        count = np.bincount(part, minlength=len(size))
        begin = np.cumsum(count) - count
        times = count[which[own]]
        run_ = np.repeat(begin[which[own]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        own = np.repeat(own, times)
        found.append((doc[own], tag[own], at[own] + inside[run_], n[run_]))
        doc, tag, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(doc):
            out += by_box(doc, tag, at, boxes, FOUND, size=n)
        return as_table(out)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, cut = (text or "").encode(), pairs_of(blob).T.tolist()
            kept, at = [], 0
            for a, b in cut:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            out.append((len(raw), len(raw) - len(kept), len(cut), kept))
        columns = zip(*out, strict=True) if out else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeated_strings(docs: DataFrame, width: int = 50) -> DataFrame:
    """Remove each byte that a ``width``-byte string covers which also starts in a document with a smaller
    id: ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary: a cut may part a character).

    Strings are bytes, so a match is exact. A string that many documents of a batch have goes on once.
    One row per input row. Null text: no bytes. Null id: such a row neither loses bytes nor takes any.
    Rows that share an id don't take bytes from each other. Shorter texts are kept whole. An empty table
    gives no rows; other columns are ignored.
    """
    rows = keyed(docs)
    size = text_bytes(rows)
    boxes = LEAST_BOXES
    while boxes * BOX_BYTES < size:
        boxes *= 2
    known = rows.where("doc_id is not null")
    asked = known.mapInArrow(_ask(width, boxes), PLACES)
    answered = asked.groupBy("box").applyInArrow(_answer(boxes), PLACES)
    maybe = sized(ranges(answered, 2 * width - GRAM, "maybe-repeated"))
    own = (F.col("doc_id") == F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    cut = known.join(maybe, own).select("doc_id", "tag", "text", "ranges").mapInArrow(_cut(width, boxes), PLACES)
    gone = sized(ranges(cut.groupBy("box").applyInArrow(_refine(width, boxes), PLACES), width, "repeated"))
    joined = rows.join(gone, own, "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
