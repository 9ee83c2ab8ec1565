"""Exact top-k search: multi-resolution segment statistics bound the scores, coarse to fine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a block of candidates and in a block of queries.
CANDIDATES, QUERIES = 4096, 2048
LEVELS = (1, 2, 4, 8, 16)
PAIRS = "query_id long, query_key long, vec_id long, score long, own boolean"


def _segments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations of ``n`` segments, each times the root of the segment's length."""
    cuts = np.linspace(0, x.shape[1], n + 1).astype(int)
    mean, spread = np.empty((len(x), n)), np.empty((len(x), n))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part, root = x[:, a:b], np.sqrt(b - a)
        mean[:, k] = part.mean(1) * root
        spread[:, k] = part.std(1) * root
    return mean, spread


def _nearest(queries: np.ndarray, rows: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query, places of rows among which are the ``k`` largest inner products, ties included.

    The distance of two vectors is at least that of their segment means and deviations, so the inner
    product is at most (q.q + x.x - that bound) / 2: the sum over segments of length times (product of
    means + product of deviations). Each finer level tests the rows that the level before left. ``floors``:
    scores that ``k`` rows elsewhere reach for each query; rows that can't reach them go at every level.
    """
    q, x = queries.astype(float), rows.astype(float)
    levels = [n for n in LEVELS if n <= x.shape[1]]
    stats = [(_segments(q, n), _segments(x, n)) for n in levels]
    out = []
    coarse = stats[0][0][0] @ stats[0][1][0].T + stats[0][0][1] @ stats[0][1][1].T if levels else np.zeros((len(q), len(x)))
    for i in range(len(q)):
        left, bound = np.arange(len(x)), coarse[i]
        slack = 1e-9 * (np.abs(q[i]).sum() * np.abs(x).max(initial=0) + 1)
        given = -np.inf if floors is None else floors[i] - slack
        if given > -np.inf:
            keep = bound >= given
            left, bound = left[keep], bound[keep]
        if len(left) > k:
            for (qm, qs), (xm, xs) in stats[1:]:
                likely = left[np.argpartition(-bound, k - 1)[: 4 * k]] if len(left) > 4 * k else left
                floor = np.partition(x[likely] @ q[i], -k)[-k] - slack if len(left) >= k else -np.inf
                left = left[bound >= max(floor, given)]
                bound = xm[left] @ qm[i] + xs[left] @ qs[i]
        out.append(left)
    return out


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dim = table["dim"][0].as_py()
    flat = np.concatenate([np.asarray(c.flatten()) for c in table["v"].chunks]) if table.num_rows else np.zeros(0, np.int64)
    return np.asarray(table["vec_id"]), np.asarray(table["key"]), flat.reshape(table.num_rows, dim)


def _match(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            ids, keys, x = _arrays(rows)
            query_ids, query_keys, q = _arrays(queries)
            if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] >= 2.0**63:
                raise ValueError("a score doesn't fit 64 bits")
            floors = queries["floor"].to_numpy(zero_copy_only=False).astype(float) if "floor" in queries.column_names else None
            for i, left in enumerate(_nearest(q, x, k, floors)):
                score = x[left] @ q[i]
                best = left[np.lexsort((ids[left], -score))[:k]]
                score = x[best] @ q[i]
                own = (ids[best] == query_ids[i]) & (keys[best] == query_keys[i])
                out += zip([int(query_ids[i])] * len(best), [int(query_keys[i])] * len(best), ids[best].tolist(), score.tolist(), own.tolist(), strict=True)
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = [("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("own", pa.bool_())]
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return run


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest integer inner product for each query,
    the rows whose ``vec_id`` is divisible by ``every``; ties to the smaller id; own row left out.

    Components become floor(scale * x). Blocks of queries meet blocks of candidates, each pair in a task;
    a block's ``k + 1`` best go on. One block goes first: the score of its ``k + 1``th best is each query's
    floor in all others, where a row, or every row, that can't reach it is left out by its bounds. Vectors that are null, or hold a null or non-finite component, and null
    ids take no part. Rows that repeat a query's id and vector are one query, of which one is its own row
    and the others are candidates; rows of one id and several vectors are a query each. Vectors of other
    lengths than the query's aren't its candidates. Components so large that a score might not fit 64 bits
    fail the job with a message. No vectors: no rows; other columns are ignored.
    """
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(c * float(scale)).cast("long"))
    rows = vectors.where(good).select(F.col("vec_id").cast("long"), ints.alias("v"), F.size("embedding").alias("dim"))
    rows = written(rows.withColumn("key", F.xxhash64("v")).withColumn("nth", F.monotonically_increasing_id()), "vectors")
    queries = rows.drop("nth").where(F.col("vec_id") % every == 0).distinct()
    parts = max(1, -(-rows.count() // CANDIDATES))
    blocks = max(1, -(-queries.count() // QUERIES))
    dealt = rows.withColumn("part", F.pmod("nth", F.lit(parts)).cast("int")).drop("nth")
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "key"), F.lit(blocks)).cast("int"))

    def match(some: DataFrame, by: DataFrame, of: range) -> DataFrame:
        left = some.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = by.withColumn("part", F.explode(F.array(*[F.lit(p) for p in of]) if len(of) == 1 else F.sequence(F.lit(of[0]), F.lit(of[-1]))))
        keys = ["part", "block", "dim"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_match(k + 1), PAIRS)

    found = match(dealt.where("part = 0"), asked, range(1))
    if parts > 1:
        found = written(found, "first-block")
        floors = found.groupBy(F.col("query_id").alias("vec_id"), F.col("query_key").alias("key")).agg(F.when(F.count(F.lit(1)) == k + 1, F.min("score")).alias("floor"))
        held = asked.join(floors, ["vec_id", "key"], "left").select(*asked.columns, F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("floor"))
        held = written(held, "floors")
        found = found.unionByName(match(dealt.where("part > 0"), held, range(1, parts)))
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    first = F.coalesce(F.min(F.when(F.col("own"), F.col("n"))).over(Window.partitionBy("query_id", "query_key")), F.lit(k + 2))
    found = found.withColumn("own_at", first).where(F.col("n") != F.col("own_at"))
    rank = F.col("n") - (F.col("n") > F.col("own_at")).cast("int")
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
