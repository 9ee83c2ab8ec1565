"""SimHash near-dedup: fingerprints linked by searches in BK-trees, then connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, nested, row_key, sized, written

#: Fingerprints that a shard should hold on average, and that one tree or one row of queries holds.
SHARD, TREE = 64, 1024
#: Query-node pairs that a search looks at together, at most.
AT_ONCE = 2_000_000


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the shingles' XXH64 values; 0 without words."""
    all_ = (text or "").encode().lower().split()
    if not all_:
        return 0
    n = max(1, len(all_) - words + 1)
    joined = b" ".join(all_)
    ends = np.cumsum([len(w) + 1 for w in all_]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[words - 1 :].tolist() if len(all_) >= words else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    set_ = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        set_ += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > n).tobytes())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, row, fp`` (the key of the row; the fingerprint's bits as a long) of every whole text; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], ["doc_id", "row", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("row")).mapInArrow(run, "doc_id long, row long, fp long")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the list that each is in."""
    sizes = np.asarray(column.value_lengths())
    return np.asarray(column.flatten()).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A BK-tree of each row's fingerprints; all trees of a batch grow together, level by level. A node
    keeps its fingerprint, its parent and the Hamming distance to it: the edge."""
    for batch in batches:
        value, tree = _lists(batch.column(2))
        n = len(value)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        first = np.ones(n, bool)
        first[1:] = tree[1:] != tree[:-1]
        at = np.flatnonzero(first)[tree] if n else tree
        rest = np.flatnonzero(~first)
        while len(rest):
            distance = np.bitwise_count(value[rest] ^ value[at[rest]]).astype(np.int64)
            _, new, which = np.unique(at[rest] * 65 + distance, return_index=True, return_inverse=True)
            child = rest[new]
            parent[child], edge[child] = at[child], distance[new]
            at[rest] = child[which]
            stays = np.ones(len(rest), bool)
            stays[new] = False
            rest = rest[stays]
        base = np.flatnonzero(first)[tree] if n else tree
        offsets = batch.column(2).offsets
        local = pa.ListArray.from_arrays(offsets, pa.array(np.where(parent < 0, -1, parent - base), pa.int32())) if n else pa.array([], pa.list_(pa.int32()))
        edges = pa.ListArray.from_arrays(offsets, pa.array(edge, pa.int32())) if n else pa.array([], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), local, edges], ["band", "value", "nodes", "parent", "edge"])


def _linked(queries: np.ndarray, of: np.ndarray, nodes: np.ndarray, root: np.ndarray, parent: np.ndarray, edge: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within ``radius``, by following from each node only the edges whose distance
    differs from the query's by no more than the radius. ``root``: of the tree that ``of`` numbers."""
    child = np.flatnonzero(parent >= 0)
    child = child[np.argsort(parent[child], kind="stable")]
    many = np.bincount(parent[child], minlength=len(nodes))
    begin = np.cumsum(many) - many
    query, node = np.arange(len(queries)), root[of]
    found = []
    while len(query):
        distance = np.bitwise_count(queries[query] ^ nodes[node]).astype(np.int64)
        near = distance <= radius
        found.append((query[near], node[near]))
        times = many[node]
        step = np.repeat(begin[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        next_ = child[step]
        follow = np.abs(edge[next_] - np.repeat(distance, times)) <= radius
        query, node = np.repeat(query, times)[follow], next_[follow]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (query, node)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as links of each fingerprint to the smallest of those it hangs together with: no
    more links than fingerprints."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(names))
    return names[own], names[label[own]]


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work = np.asarray(batch.column(0).value_lengths()).astype(np.int64) * np.asarray(batch.column(1).value_lengths())
            lines = np.cumsum(work) // AT_ONCE
            cuts = np.flatnonzero(np.diff(lines, prepend=-1)) if len(lines) else []
            for a, b in zip(cuts, np.append(cuts, batch.num_rows)[1:], strict=True):
                part = batch.slice(a, b - a)
                queries, of = _lists(part.column(0))
                nodes, tree = _lists(part.column(1))
                root = np.searchsorted(tree, np.arange(part.num_rows))
                parent, edge = np.asarray(part.column(2).flatten()).astype(np.int64), np.asarray(part.column(3).flatten()).astype(np.int64)
                parent = np.where(parent < 0, -1, parent + root[tree])
                query, node = _linked(queries, of, nodes, root, parent, edge, radius)
                x, y = queries[query].view(np.int64), nodes[node].view(np.int64)
                other = x != y
                x, y = _stars(x[other], y[other])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``a, b`` that join, directly or through others, all distinct fingerprints ``fp`` that differ
    in ``radius`` bits or fewer.

    The 64 bits are cut into blocks, of which near fingerprints share all but ``radius``; each choice of
    the shared blocks is a band, and the fingerprints of equal bits in a band are a shard with BK-trees
    of its own. More fingerprints take more blocks, so shards stay small; the links found are the same.
    The trees go to the tasks of their shard's queries: by broadcast while they are small, else by a
    shuffle on the shard. Larger shards have several trees and several rows of queries.
    """
    n = prints.count()
    blocks = radius + 1
    while n >> (64 * (blocks - radius) // blocks) > SHARD and blocks < radius + 5:
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    bands = []
    for band, shared in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in shared)
        bands.append(F.struct(F.lit(band).alias("band"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("value")))
    rows = prints.select("fp", F.inline(F.array(*bands))).select("band", "value", "fp")
    sizes = rows.groupBy("band", "value").count().where("count > 1")
    sizes = written(sizes.select("band", "value", F.ceil(F.col("count") / TREE).cast("int").alias("parts")), "shards")
    rows = rows.join(sized(sizes), ["band", "value"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    cells = written(rows.groupBy("band", "value", "part").agg(F.sort_array(F.collect_list("fp")).alias("nodes")), "cells")
    trees = cells.select("band", "value", "nodes").mapInArrow(_grow, "band int, value long, nodes array<long>, parent array<int>, edge array<int>")
    trees = written(trees, "trees")
    met = cells.select("band", "value", F.col("nodes").alias("queries")).join(sized(trees), ["band", "value"])
    return met.select("queries", "nodes", "parent", "edge").mapInArrow(_search(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every input row.

    The fingerprint is 16 hex digits. Fingerprints link at ``radius`` differing bits or fewer; a
    component's id is the smallest ``doc_id`` that links reach (rows of equal fingerprints, repeated rows
    too, are together). Null, empty and wordless texts have fingerprint zero, linked like any other. A
    null id is never a component's id unless there is no other. An empty table gives no rows; other
    columns are ignored. Documents come down to distinct fingerprints before any search, so exact
    copies cost nothing; within a shard's cluster of n fingerprints fewer than n links go on.
    """
    out = _in_components(docs, radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _in_components(docs: DataFrame, radius: int) -> DataFrame:
    rows = written(fingerprints(docs), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    joined = components(near_links(prints.select("fp"), radius))
    named = prints.join(joined, prints["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = written(named, "named-fingerprints")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(named.join(ids, "component").select(F.col("fp").alias("_fp"), "component", "component_id"), "fingerprint-components")
    return rows.join(sized(named), rows["fp"] == F.col("_fp")).drop("_fp")


def keep_one_of_each(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, all their columns, but for near copies: of each component the row of the
    smallest id stays (of those that share it, the one of the smallest hash). Rows with a null id, whose
    order isn't known, all stay. Rows that share an id but not a component each stay; of repeated rows
    one does. Null, empty and wordless texts are near each other. An empty table gives no rows; columns
    of any other name pass unchanged."""
    known = written(_in_components(docs, radius).where("doc_id is not null").select("component", F.struct("doc_id", "row").alias("place")), "places")
    first = known.groupBy("component").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = known.join(sized(written(first.select("component", "first"), "first-places")), "component")
    gone = written(met.where("place <> first").select("place.row").distinct(), "near-copies")
    again = written(met.where("place = first").groupBy("place.row").count().where("count > 1").select("row"), "repeated")
    rows = nested(docs)
    rows = rows.join(sized(gone), rows["_key"] == gone["row"], "left_anti")
    if again.limit(1).count():
        own = rows["_key"] == again["row"]
        rows = rows.join(sized(again), own, "left_anti").unionByName(rows.join(sized(again), own, "left_semi").dropDuplicates(["_key"]))
    return rows.select("_row.*")
