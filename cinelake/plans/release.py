"""Digests, reconciliation, and event-time extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinelake.operators import release
from cinelake.plans._base import Tables, query
from cinelake.streaming import reconcile


@query(
    """
SELECT p_partkey, sha256('i' || p_partkey || chr(31) || 't' || p_name || chr(31) || CASE WHEN p_partkey % 5 = 0 THEN 'n' ELSE 't' || p_brand END || chr(31) || 'i' || p_size || chr(31)) AS digest FROM part"""
)
def r1_row_digest(t: Tables) -> DataFrame:
    df = t.part.withColumn("p_brand", F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")))
    return df.select("p_partkey", release.row_digest(df, ["p_partkey", "p_name", "p_brand", "p_size"]).alias("digest"))


@query(
    """
WITH h AS (SELECT sha256('i' || p_partkey || chr(31) || 't' || p_name || chr(31) || 'i' || p_size || chr(31)) AS h FROM part),
c AS (SELECT h, count(*) AS n FROM h GROUP BY h),
b AS (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h || 'x' || n, chr(30) ORDER BY h || 'x' || n)) AS d, sum(n) AS rows FROM c GROUP BY 1)
SELECT sha256(string_agg(b || ':' || d, chr(30) ORDER BY b)) AS digest, CAST(sum(rows) AS BIGINT) AS rows FROM b"""
)
def r1_table_digest(t: Tables) -> DataFrame:
    return release.table_digest(t.part, ["p_partkey", "p_name", "p_size"])


@query(
    """
SELECT doc_id, text, 'old' AS origin FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0
UNION ALL SELECT doc_id, reverse(substr(text, 1, 60)), 'new' FROM documents WHERE doc_id % 4 = 0 AND doc_id % 8 <> 0"""
)
def t2_reconcile(t: Tables) -> DataFrame:
    """A day's claims replace what their pages claimed before; a touched page that claims nothing loses its rows."""
    docs = t.documents.select("doc_id", "text")
    held = docs.where("doc_id % 3 <> 0").withColumn("origin", F.lit("old"))
    claims = docs.where("doc_id % 4 = 0 AND doc_id % 8 <> 0").select("doc_id", F.reverse(F.substring("text", 1, 60)).alias("text"), F.lit("new").alias("origin"))
    return reconcile.replace(held, docs.where("doc_id % 4 = 0").select("doc_id"), claims, "doc_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling_window(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query(
    """
WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, session"""
)
def ext_session_window(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT l_returnflag, l_linestatus, sum(l_linenumber) AS lines, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.sum("l_linenumber").alias("lines"), F.count(F.lit(1)).alias("n"))


@query(
    """
SELECT e.event_id, e.user_id, max(s.ts) AS signed_up FROM events e LEFT JOIN events s ON s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts
WHERE e.event_type = 'purchase' GROUP BY 1, 2"""
)
def ext_as_of(t: Tables) -> DataFrame:
    """Each purchase with the latest signup before it: one window over both streams, no range join."""
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "signup", 0).otherwise(1), "event_id")
    marked = t.events.where(F.col("event_type").isin("signup", "purchase")).withColumn("signed_up", F.last(F.when(F.col("event_type") == "signup", F.col("ts")), ignorenulls=True).over(w))
    return marked.where("event_type = 'purchase'").select("event_id", "user_id", "signed_up")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def ext_pricing_summary(t: Tables) -> DataFrame:
    lines = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))
