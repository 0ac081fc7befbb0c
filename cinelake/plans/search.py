"""Searches: fuzzy re-rank, BM25 candidates, unified results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.functions import expr
from cinelake.operators import search
from cinelake.plans._base import Tables, query

QUERY = "Golden-wdget small"


def fuzzy_sql(table: str, key: str, field: str, text: str, limit: int) -> str:
    """The fuzzy score in DuckDB: half overlap of trigram sets, half word by word."""
    q = search.normalized(text)
    return f"""
WITH grams AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower({field}), '[^a-z0-9 \\t\\-_:]', '', 'g'), '[ \\t\\-_:]+', ' ', 'g')) AS nt, '{q}' AS nq
  FROM {table}
), sets AS (
  SELECT *, CASE WHEN length(nt) >= 3 THEN list_distinct(list_transform(range(1, length(nt) - 1), lambda i: substr(nt, i, 3))) ELSE [] END AS tg,
         list_distinct(list_transform(range(1, length(nq) - 1), lambda i: substr(nq, i, 3))) AS qg,
         CASE WHEN length({field}) >= 3 THEN list_transform(range(1, length({field}) - 1), lambda i: substr(lower({field}), i, 3)) ELSE [] END AS raw,
         list_filter(string_split(nt, ' '), lambda w: w <> '') AS tw, list_filter(string_split(nq, ' '), lambda w: w <> '') AS qw
  FROM grams
), pairs AS (
  SELECT {key}, q.w AS q, t.w AS t, list_distinct(list_transform(range(1, length(q.w) - 1), lambda i: substr(q.w, i, 3))) AS a,
         list_distinct(list_transform(range(1, length(t.w) - 1), lambda i: substr(t.w, i, 3))) AS b
  FROM sets, unnest(list_distinct(qw)) AS q(w), unnest(tw) AS t(w)
), best AS (
  SELECT {key}, q, max(CASE WHEN q = t THEN 1.0 WHEN length(q) >= 3 AND length(t) >= 3
    THEN CAST(2 * len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b)) ELSE 0.0 END) AS s
  FROM pairs GROUP BY {key}, q
), words AS (
  SELECT {key}, sum(length(q) * s) / sum(length(q)) AS s FROM best GROUP BY {key}
)
SELECT x.{key}, x.{field}, round(0.5 * CASE WHEN len(tg) = 0 OR len(qg) = 0 THEN 0 ELSE 2.0 * len(list_intersect(tg, qg)) / (len(tg) + len(qg)) END
  + 0.5 * coalesce(w.s, 0), 6) AS score
FROM sets x LEFT JOIN words w ON x.{key} = w.{key}
WHERE len(list_intersect(raw, qg)) > 0
ORDER BY 0.5 * CASE WHEN len(tg) = 0 OR len(qg) = 0 THEN 0 ELSE 2.0 * len(list_intersect(tg, qg)) / (len(tg) + len(qg)) END + 0.5 * coalesce(w.s, 0) DESC, x.{key}
LIMIT {limit}"""


def _scored(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("score", 6).alias("score"))


@query(fuzzy_sql("part", "p_partkey", "p_name", QUERY, 20))
def q1_fuzzy_part(t: Tables) -> DataFrame:
    return _scored(search.fuzzy(t.part, "p_partkey", "p_name", QUERY, 20), "p_partkey", "p_name")


@query(fuzzy_sql("part", "p_partkey", "p_brand", "brand 17", 15))
def q1_fuzzy_by_field(t: Tables) -> DataFrame:
    return _scored(search.fuzzy(t.part, "p_partkey", "p_brand", "brand 17", 15), "p_partkey", "p_brand")


@query(fuzzy_sql("part", "p_partkey", "p_name", "blue gizmo", 25))
def q1_search_movies(t: Tables) -> DataFrame:
    """The whole two-step search with weights 10, 2, 2; the cap is wider than the table, so BM25 only breaks ties by score."""
    hits = search.search(t.part, "p_partkey", {"p_name": 10, "p_brand": 2, "p_type": 2}, "p_name", "blue gizmo", 1 << 20, cap=1 << 20)
    some = hits.where(F.arrays_overlap(search._grams(F.col("p_name")), F.array(*(F.lit(g) for g in search.query_grams("blue gizmo")))))
    return _scored(some.orderBy(F.desc("score"), "p_partkey").limit(25), "p_partkey", "p_name")


def _capped_sql(text: str, cap: int, limit: int) -> str:
    """The two steps in DuckDB: the cap best by BM25 over three fields, then the best of these by fuzzy score."""
    q = search.normalized(text)
    weights = {"p_name": 10, "p_brand": 2, "p_type": 2}
    fields = " UNION ALL ".join(
        f"SELECT p_partkey, {w} AS w, unnest(list_transform(range(1, greatest(length({f}) - 1, 1)), lambda i: substr(lower({f}), i, 3))) AS g FROM part" for f, w in weights.items()
    )
    size = " + ".join(f"greatest(length(coalesce({f}, '')) - 2, 0)" for f in weights)
    return f"""
WITH asked AS (SELECT DISTINCT unnest(list_transform(range(1, length('{q}') - 1), lambda i: substr('{q}', i, 3))) AS g),
tf AS (SELECT p_partkey, g, sum(w) AS f FROM ({fields}) WHERE g IN (SELECT g FROM asked) GROUP BY ALL),
df AS (SELECT g, count(*) AS df FROM tf GROUP BY g),
sized AS (SELECT p_partkey, {size} AS size FROM part),
stats AS (SELECT count(*) AS n, avg(size) AS mean FROM sized),
best AS (
  SELECT p_partkey, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS bm25
  FROM tf JOIN df USING (g) JOIN sized USING (p_partkey) CROSS JOIN stats GROUP BY p_partkey
  ORDER BY 2 DESC, 1 LIMIT {cap}
), fuzzy AS ({fuzzy_sql("(SELECT * FROM part WHERE p_partkey IN (SELECT p_partkey FROM best))", "p_partkey", "p_name", text, 1 << 20)})
SELECT p_partkey, p_name, score, round(bm25, 5) AS bm25 FROM fuzzy JOIN best USING (p_partkey) ORDER BY score DESC, best.bm25 DESC, p_partkey LIMIT {limit}"""


@query(_capped_sql("small gadget bolt", 60, 25))
def q1_search_capped(t: Tables) -> DataFrame:
    """The whole two-step search where the cap binds: what BM25 leaves out is not ranked."""
    hits = search.search(t.part, "p_partkey", {"p_name": 10, "p_brand": 2, "p_type": 2}, "p_name", "small gadget bolt", 60, cap=60)
    some = hits.where(F.arrays_overlap(search._grams(F.col("p_name")), F.array(*(F.lit(g) for g in search.query_grams("small gadget bolt")))))
    return some.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), F.desc("bm25"), "p_partkey").limit(25).select("p_partkey", "p_name", "score", F.round("bm25", 5).alias("bm25"))


@query(
    """
WITH hits AS (
  SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%0000001%' ORDER BY c_custkey LIMIT 12
)
SELECT h.c_custkey, h.c_name, count(o.o_orderkey) AS n_credits
FROM hits h LEFT JOIN orders o ON h.c_custkey = o.o_custkey GROUP BY h.c_custkey, h.c_name"""
)
def q4_people_hits_with_counts(t: Tables) -> DataFrame:
    hits = t.customer.where(F.col("c_name").contains("0000001")).select("c_custkey", "c_name").orderBy("c_custkey").limit(12)
    return search.with_counts(hits, "c_custkey", t.orders, "o_custkey", "n_credits")


def _hits(df: DataFrame, key: str, name: str, query_: str, n: int) -> DataFrame:
    return search.fuzzy(df, key, name, query_, n).select(F.col(key).cast("long").alias("id"), F.col(name).alias("title"), "score")


def _unified_sql() -> str:
    parts = [("movie", "part", "p_partkey", "p_name", 8), ("person", "supplier", "s_suppkey", "s_name", 6), ("event", "region", "r_regionkey", "r_name", 6)]
    each = ",\n".join(f"{k} AS (SELECT '{k}' AS type, CAST({key} AS BIGINT) AS id, {name} AS title, score FROM ({fuzzy_sql(tab, key, name, 'america supplier bolt', n)}))" for k, tab, key, name, n in parts)
    union = " UNION ALL ".join(f"SELECT * FROM {k}" for k, *_ in parts)
    return f"WITH {each} SELECT * FROM ({union}) ORDER BY score DESC, CASE type WHEN 'movie' THEN 1 WHEN 'event' THEN 2 ELSE 3 END, id LIMIT 25"


@query(_unified_sql())
def q6_unified(t: Tables) -> DataFrame:
    q = "america supplier bolt"
    parts = {"movie": _hits(t.part, "p_partkey", "p_name", q, 8), "person": _hits(t.supplier, "s_suppkey", "s_name", q, 6), "event": _hits(t.region, "r_regionkey", "r_name", q, 6)}
    return search.unified({k: d.withColumn("score", F.round("score", 6)) for k, d in parts.items()}).select("type", "id", "title", "score")


_BM25_GRAMS = ("the", "ing", "ion")


@query(
    """
WITH grams AS (
  SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS g FROM documents WHERE length(text) >= 3
), tf AS (
  SELECT doc_id, g, count(*) AS f FROM grams WHERE g IN ('the', 'ing', 'ion') GROUP BY doc_id, g
), df AS (SELECT g, count(*) AS df FROM tf GROUP BY g),
stats AS (SELECT count(*) AS n, avg(greatest(length(coalesce(text, '')) - 2, 0)) AS mean FROM documents),
scored AS (
  SELECT tf.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 10 * 2.2 / (f * 10 + 1.2 * (0.25 + 0.75 * greatest(length(text) - 2, 0) / mean))) AS s
  FROM tf JOIN df USING (g) JOIN documents d ON d.doc_id = tf.doc_id CROSS JOIN stats GROUP BY tf.doc_id
)
SELECT doc_id, round(s, 5) AS bm25 FROM scored"""
)
def a18_bm25_candidates(t: Tables) -> DataFrame:
    docs = t.documents
    index = search.index(docs, "doc_id", ["text"])
    return search.bm25(index, search.statistics(docs, ["text"]), {"text": 10.0}, list(_BM25_GRAMS)).select(F.col("id").alias("doc_id"), F.round("bm25", 5).alias("bm25"))


@query(
    """
WITH g AS (SELECT doc_id AS id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS gram FROM documents WHERE length(text) >= 3)
SELECT gram, count(DISTINCT id) AS df, count(*) AS cf FROM g GROUP BY gram"""
)
def x13_trigram_index(t: Tables) -> DataFrame:
    index = search.index(t.documents, "doc_id", ["text"])
    return index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(
    """
WITH asked(p, id) AS (VALUES (0, 42), (1, 7), (2, 99999999), (3, 3), (5, 11))
SELECT p_partkey, p_name, p_brand FROM part JOIN asked ON p_partkey = id ORDER BY p"""
)
def q10_film_info(t: Tables) -> DataFrame:
    from cinelake.operators.relational import lookup

    return lookup(t.part, "p_partkey", [42, 7, 99999999, 3, 42, 11]).select("p_partkey", "p_name", "p_brand")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (1, 7, 32) ORDER BY 1, 2, 3")
def q11_episodes_of_series(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_orderkey").isin(1, 7, 32)).select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT min(s_suppkey) AS id, s_name FROM supplier GROUP BY s_name")
def o8_person_by_name(t: Tables) -> DataFrame:
    return t.supplier.groupBy("s_name").agg(F.min("s_suppkey").alias("id"))


@query(
    """
SELECT o.o_orderkey, count(l.l_linenumber) AS n_episodes,
  string_agg(l.l_linenumber || ':' || l.l_partkey, ',' ORDER BY l.l_linenumber, l.l_partkey) AS episodes
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey"""
)
def q13_series_view(t: Tables) -> DataFrame:
    """A series with its episodes as one ordered list."""
    lists = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("e"))
    joined = t.orders.select("o_orderkey").join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_episodes"), F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("episodes"))


@query(
    """
WITH d AS (SELECT p_partkey, hex(encode('part' || chr(31) || p_partkey || chr(31) || p_name || chr(31))) AS h FROM part),
b AS (SELECT p_partkey, list_transform(range(1, length(h), 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1 AS HUGEINT)) AS bytes FROM d),
f AS (SELECT p_partkey, list_reduce(list_prepend(CAST('14695981039346656037' AS HUGEINT), bytes), lambda h, x: (xor(h, x) * 1099511628211) % CAST('18446744073709551616' AS HUGEINT)) % 4611686018427387904 AS h FROM b)
SELECT p_partkey, CAST(CASE WHEN h = 0 THEN 1 ELSE h END AS BIGINT) AS id FROM f"""
)
def f15_stable_id(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", expr.stable_id(F.lit("part"), F.col("p_partkey"), F.col("p_name")).alias("id"))
