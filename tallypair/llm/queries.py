"""The training-data operators as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .decontamination import contamination
from .line_dedup import remove_repeated_lines
from .mixing import mix_sources
from .packing import pack_documents
from .pii import personal_data
from .quality import quality_scores
from .simhash_dedup import near_duplicates
from .substring_dedup import remove_repeated_windows
from .suffix_dedup import remove_repeated_strings
from .token_counts import token_counts
from .vector_codes import compress_vectors
from .vector_search import top_inner_products
from .whitening import whiten


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_windows(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_strings(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_personal_data": op7_personal_data,
    "op8_vector_search": op8_vector_search,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op9_mixing": op9_mixing,
    "op11_vector_codes": op11_vector_codes,
    "op12_whitening": op12_whitening,
    "op13_packing": op13_packing,
}

OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), o AS (SELECT win, min(doc_id) AS first_doc FROM g GROUP BY win),
hit AS (SELECT DISTINCT g.doc_id, i + k AS i FROM g JOIN o USING (win), range(0, 13) AS r(k) WHERE first_doc < g.doc_id),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n FROM e ANTI JOIN hit ON e.doc_id = hit.doc_id AND e.i = hit.i GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + 9], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), n AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, n WHERE len(ws) >= n)
), m AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, range(0, 10) AS r(k) WHERE k < m.n GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT min(rid) AS rid, vec_id, e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id, e),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v c ON q.rid <> c.rid
), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""



def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Codebooks ``b0`` to the last one, each from the assignment ``a`` of all parts to the one before."""
    apart = "list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT rid, part, e[part * (len(e) // {parts}) + 1:(part + 1) * (len(e) // {parts})] AS x FROM v, range({parts}) r(part)),
s AS (SELECT rid, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS entry FROM v WHERE vec_id IS NOT NULL),
b0 AS MATERIALIZED (SELECT part, entry, x AS c FROM s JOIN p USING (rid) WHERE entry < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT rid, part, min(CAST({apart} AS BIGINT) * {entries} + entry) AS m FROM p JOIN b{k} b USING (part) GROUP BY rid, part)")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(n.c, o.c) AS c FROM b{k} o LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT part, m % {entries} AS entry, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT a.part, a.m, unnest(p.x) AS x, generate_subscripts(p.x, 1) AS i FROM a{k} a JOIN p USING (rid, part)) GROUP BY ALL) GROUP BY ALL) n USING (part, entry))""")
    return f"""WITH {", ".join(steps)},
r AS (SELECT rid, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
k AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN r USING (rid), k"""


OP11_SQL = _op11_sql()

ORACLES: dict[str, str] = {"op11_vector_codes": OP11_SQL, "op1_substring_dedup": OP1_SQL, "op3_decontamination": OP3_SQL, "op8_vector_search": OP8_SQL}
