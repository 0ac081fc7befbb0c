"""Queries of this package's operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_topk, language_id, lm_scoring, near_dedup, packing, quality, secrets, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(_table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(_table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_lm_scoring,
        op3_language_id,
        op4_quality_classifier,
        op5_packing,
        op6_secret_scans,
        op7_minhash_near_dedup,
        op8_exact_topk,
        op9_warc,
        op10_chat_formatting,
    )
}

_ASCII_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Matches of a kind with their places: sums of what lies between the matches and of the matches."""
    return f"""
  SELECT row, '{kind}' AS kind, {rank} AS rank, value, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i-1], lambda m: length(m))), 0) AS s,
         length(found[i]) AS n
  FROM (SELECT row, gaps, found, unnest(range(1, len(found) + 1)) AS i, unnest(vals) AS value
        FROM (SELECT row, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {group}) AS vals FROM d))
  WHERE length(value) >= {least}"""


_ASSIGN_SQL = secrets.ASSIGN.replace("'", "''")
_SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS owner FROM documents),
c AS ({" UNION ALL ".join((_spans_sql("assign", 0, _ASSIGN_SQL, 2, 12), _spans_sql("access", 1, "AKIA[A-Z0-9]+", 0, 18), _spans_sql("hex", 2, "[0-9a-f]+", 0, 16), _spans_sql("owned", 3, "[A-Za-z0-9_-]+", 0, 28)))}),
k AS (SELECT * FROM c WHERE rank < 3 OR regexp_matches(value, '^[A-Za-z_-]{{0,64}}[0-9]') AND regexp_matches(value, '^[0-9_-]{{0,64}}[A-Za-z]')),
o AS (SELECT value, count(DISTINCT owner) <= 1 AND count(DISTINCT (owner, doc_id)) <= 3 AS live FROM k JOIN d USING (row) GROUP BY value),
j AS (SELECT k.row, k.kind, k.rank, k.s, k.s + k.n AS e, o.live FROM k JOIN o USING (value)),
a AS (SELECT * FROM j WHERE rank < 3 OR live AND NOT EXISTS (SELECT 1 FROM j b WHERE b.row = j.row AND b.rank < 3 AND b.s < j.e AND b.e > j.s))
SELECT d.doc_id, count(*) FILTER (a.kind = 'assign') AS n_assign, count(*) FILTER (a.kind = 'access') AS n_access, count(*) FILTER (a.kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank IS NOT NULL), '') AS spans,
  count(*) FILTER (a.live) AS n_live, count(*) FILTER (NOT a.live) AS n_example
FROM d LEFT JOIN a ON d.row = a.row GROUP BY d.row, d.doc_id
"""

_CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k FROM b, range(1, greatest(len(w) - 8, 2)) r(i) WHERE len(w) > 0),
x AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM p) l, range(1, len(w) - n + 2) r(i)),
m AS (SELECT x.doc_id, x.i, x.n, p.item FROM x JOIN p USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), range(i, i + n) t(q) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_DEDUP_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM d, range(1, greatest(len(w) - 2, 2)) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.c AS component_id, l.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) l ON l.id = d.doc_id
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS bits,
        max(page_id) OVER (PARTITION BY h) AS largest FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, 5 * i + j, 1) AS INTEGER) * (1 << (5 - j)))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN largest IS NULL OR page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN largest IS NULL OR page_id = largest THEN NULL ELSE largest END AS refers_to
FROM b
"""

#: DuckDB SQL for the rows of those queries that SQL can express.
ORACLES = {
    "op1_benchmark_decontamination": _CONTAMINATION_SQL,
    "op6_secret_scans": _SECRETS_SQL,
    "op7_minhash_near_dedup": _DEDUP_SQL,
    "op9_warc": _WARC_SQL,
    "op8_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
  FROM scored
)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 5
""",
}
