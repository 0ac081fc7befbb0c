"""Joins, aggregations, windows and set operations over the driver's tables: parts are works, suppliers and customers
are people, orders are series, lines are episodes and credits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.operators import relational as r
from cinelake.plans._base import Tables, query

_ROLE = "CASE l_returnflag WHEN 'A' THEN 'movie' WHEN 'R' THEN 'tv' ELSE 'event' END"


def _kind():
    return F.when(F.col("l_returnflag") == "A", "movie").when(F.col("l_returnflag") == "R", "tv").otherwise("event")


@query(
    f"""
WITH f AS (SELECT l_orderkey, l_linenumber, {_ROLE} AS work_type, l_partkey AS work_id FROM lineitem)
SELECT f.l_orderkey, f.l_linenumber, f.work_type, f.work_id, CASE WHEN work_type = 'movie' THEN p_name WHEN work_type = 'tv' THEN s_name END AS title,
  CASE WHEN work_type = 'movie' THEN p_size WHEN work_type = 'tv' THEN s_nationkey END AS year
FROM f LEFT JOIN part ON work_type = 'movie' AND work_id = p_partkey LEFT JOIN supplier ON work_type = 'tv' AND work_id = s_suppkey"""
)
def j3_conditional_left(t: Tables) -> DataFrame:
    facts = t.lineitem.select("l_orderkey", "l_linenumber", _kind().alias("work_type"), F.col("l_partkey").alias("work_id"))
    dims = {"movie": t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("year")), "tv": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("year"))}
    return r.by_kind(facts, dims, "work_type", "work_id")


@query("SELECT DISTINCT o_custkey AS person_id, l_partkey AS work_id, l_returnflag AS role FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j4_distinct_credit(t: Tables) -> DataFrame:
    staged = t.lineitem.select(F.col("l_orderkey").alias("wiki"), F.col("l_partkey").alias("work_id"), F.col("l_returnflag").alias("role"))
    return r.resolved_credits(staged, t.orders.select(F.col("o_orderkey").alias("wiki"), F.col("o_custkey").alias("person_id"))).select("person_id", "work_id", "role")


@query("SELECT c_custkey, min(c_name) AS c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_custkey")
def j5_unresolved_min(t: Tables) -> DataFrame:
    known = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return r.unresolved(t.customer, known, "c_custkey", "c_name")


@query(
    """
SELECT o_orderkey, o_custkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'F'"""
)
def j6_double_dimension(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "o_custkey", "c_name", "n_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 UNION ALL SELECT s_suppkey FROM supplier)")
def j7_semi_union(t: Tables) -> DataFrame:
    works = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("k")).unionByName(t.supplier.select(F.col("s_suppkey").alias("k")))
    return t.part.join(works, F.col("p_partkey") == F.col("k"), "left_semi").select("p_partkey", "p_name")


@query(
    """
SELECT DISTINCT s_suppkey AS franchise_id, p_partkey AS id, p_type AS kind FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1"""
)
def j8_franchise_members(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation.where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("s_suppkey").alias("franchise_id"), F.col("p_partkey").alias("id"), F.col("p_type").alias("kind")).distinct()


@query(
    """
WITH n AS (SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_id FROM orders)
SELECT a.o_orderkey AS id, b.o_orderkey AS next_id, a.o_custkey AS owner FROM n a JOIN orders b ON a.next_id = b.o_orderkey"""
)
def j9_sequel_self(t: Tables) -> DataFrame:
    """Works whose sequel exists too: a self-join through the edge."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = t.orders.select("o_orderkey", "o_custkey", F.lead("o_orderkey").over(w).alias("next_id"))
    return edges.join(t.orders.select(F.col("o_orderkey").alias("next_id")), "next_id").select(F.col("o_orderkey").alias("id"), "next_id", F.col("o_custkey").alias("owner"))


@query(
    """
SELECT DISTINCT * FROM (
  SELECT p_partkey AS id, 'movie' AS kind, p_brand AS value FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_discount = 0.1
  UNION ALL SELECT s_suppkey, 'person', s_name FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_discount = 0.1
  UNION ALL SELECT o_orderkey, 'tv', o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount = 0.1)"""
)
def j10_external_ids(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_discount = 0.1")
    parts = (
        (t.part, "p_partkey", "l_partkey", "movie", "p_brand"),
        (t.supplier, "s_suppkey", "l_suppkey", "person", "s_name"),
        (t.orders, "o_orderkey", "l_orderkey", "tv", "o_orderpriority"),
    )
    out = None
    for df, key, foreign, kind, value in parts:
        one = df.join(lines, F.col(key) == F.col(foreign)).select(F.col(key).alias("id"), F.lit(kind).alias("kind"), F.col(value).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


@query(
    """
SELECT c_custkey, coalesce(o.id, c_nationkey) AS page_id, CASE WHEN o.id IS NULL THEN 'map' ELSE 'dump' END AS source
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o ON c_custkey = o_custkey"""
)
def j11_precedence_left(t: Tables) -> DataFrame:
    own = t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("id"))
    return t.customer.join(own, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("id", F.col("c_nationkey").cast("long")).alias("page_id"), F.when(F.col("id").isNull(), "map").otherwise("dump").alias("source"))


@query(
    """
SELECT DISTINCT l_suppkey AS wiki FROM lineitem
WHERE l_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10 AND p_partkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))"""
)
def j12_anti_with_exception(t: Tables) -> DataFrame:
    """Targets that are no work, unless they are a biography too."""
    people = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    works = t.part.where("p_size < 10").select(F.col("p_partkey").alias("k")).join(people, "k", "left_anti")
    return t.lineitem.select(F.col("l_suppkey").alias("wiki")).distinct().join(works, F.col("wiki") == F.col("k"), "left_anti")


@query("SELECT l_partkey, arg_min(l_orderkey, (l_quantity, l_orderkey)) AS owner FROM lineitem GROUP BY l_partkey")
def j13_best_claim(t: Tables) -> DataFrame:
    return r.best_claim(t.lineitem, "l_partkey", "l_orderkey", [F.col("l_quantity"), F.col("l_orderkey")]).select("l_partkey", F.col("l_orderkey").alias("owner"))


@query(
    """
SELECT o.o_orderkey, coalesce(a.owner, b.owner, c.owner) AS owner FROM orders o
LEFT JOIN (SELECT o_orderkey, o_custkey AS owner FROM orders WHERE o_orderstatus = 'F') a ON o.o_orderkey = a.o_orderkey
LEFT JOIN (SELECT l_orderkey AS o_orderkey, min(l_suppkey) AS owner FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON o.o_orderkey = b.o_orderkey
LEFT JOIN (SELECT l_orderkey AS o_orderkey, min(l_partkey) AS owner FROM lineitem GROUP BY 1) c ON o.o_orderkey = c.o_orderkey
WHERE coalesce(a.owner, b.owner, c.owner) IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""
)
def j14_owner_precedence(t: Tables) -> DataFrame:
    a = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("owner"))
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    b = lines.where("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.min("l_suppkey").alias("owner"))
    c = lines.groupBy("o_orderkey").agg(F.min("l_partkey").alias("owner"))
    known = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("owner"))
    return r.owner_by_precedence(t.orders.select("o_orderkey"), "o_orderkey", [a, b, c], known, "owner").select("o_orderkey", "owner")


@query("SELECT l_orderkey, l_linenumber, coalesce(s_suppkey, 0) AS show_id FROM lineitem LEFT JOIN supplier ON l_partkey = s_suppkey")
def j15_show_ids(t: Tables) -> DataFrame:
    return t.lineitem.join(t.supplier.select("s_suppkey"), F.col("l_partkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("s_suppkey", F.lit(0)).alias("show_id"))


@query(
    """
WITH s AS (SELECT l_orderkey AS day, l_returnflag AS part, l_suppkey AS network, l_orderkey * 10 + l_linenumber AS slot,
  strftime(l_shipdate, '%Y-%m-%d') AS "start", strftime(l_shipdate + INTERVAL 40 DAY, '%Y-%m-%d') AS "end" FROM lineitem)
SELECT a.day, a.part, a.slot AS "left", b.slot AS "right" FROM s a JOIN s b ON a.day = b.day AND a.part = b.part
AND a.network <> b.network AND a."start" < b."end" AND a."end" > b."start" AND a.slot < b.slot"""
)
def j16_interval_overlap(t: Tables) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    slots = t.lineitem.select(
        F.col("l_orderkey").alias("day"),
        F.col("l_returnflag").alias("part"),
        F.col("l_suppkey").alias("network"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("slot"),
        day("l_shipdate").alias("start"),
        day(F.col("l_shipdate") + F.expr("INTERVAL 40 DAYS")).alias("end"),
    )
    month = lambda c: F.floor(F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) / 40)
    return r.overlapping(slots, ["day", "part"], "network", "start", "end", "slot", lambda s, e: F.sequence(month(s), month(e)))


@query("SELECT p_partkey, p_partkey IN (SELECT s_suppkey FROM supplier) AS local FROM part")
def j17_membership_flag(t: Tables) -> DataFrame:
    return t.part.join(t.supplier.select(F.col("s_suppkey").alias("k"), F.lit(True).alias("hit")), F.col("p_partkey") == F.col("k"), "left").select("p_partkey", F.coalesce("hit", F.lit(False)).alias("local"))


@query("SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def j18_orphans(t: Tables) -> DataFrame:
    return r.orphans(t.customer, t.orders, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 = 0)")
def j18_orphans_found(t: Tables) -> DataFrame:
    """Of fewer orders: customers that none of them names."""
    return r.orphans(t.customer, t.orders.where("o_orderkey % 40 = 0"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 5000) AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def j19_removals(t: Tables) -> DataFrame:
    return r.lost_but_alive(t.orders, t.orders.where("o_totalprice > 5000"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j20_cross_database(t: Tables) -> DataFrame:
    """Tables attached under two names, joined by SQL."""
    from cinelake.sources.catalog import Database

    with Database(t.spark, {"core": {"nation": t.nation}, "text": {"region": t.region}}) as db:
        return db.sql("SELECT n_nationkey, n_name, r_name FROM {core}.nation JOIN {text}.region ON n_regionkey = r_regionkey")


_OLD = "SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_partkey % 7 <> 0"
_NEW = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS p_brand, p_size FROM part WHERE p_partkey % 9 <> 0"


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    part = t.part.select("p_partkey", "p_name", "p_brand", "p_size")
    k = F.col("p_partkey")
    new = part.where(k % 9 != 0).withColumns({"p_name": F.when(k % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")), "p_brand": F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("p_brand"))})
    return part.where(k % 7 != 0), new


@query(
    f"""
WITH a AS ({_OLD}), b AS ({_NEW})
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey,
  CASE WHEN b.p_partkey IS NULL THEN 2 WHEN a.p_partkey IS NULL THEN 3 ELSE 1 END AS op,
  CASE WHEN a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL THEN concat_ws(',', CASE WHEN a.p_name IS DISTINCT FROM b.p_name THEN 'p_name' END,
    CASE WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN 'p_brand' END, CASE WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'p_size' END) END AS changed,
  b.p_name AS new_name, b.p_brand AS new_brand
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey
WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_name IS DISTINCT FROM b.p_name OR a.p_brand IS DISTINCT FROM b.p_brand OR a.p_size IS DISTINCT FROM b.p_size"""
)
def j21_record_diff(t: Tables) -> DataFrame:
    d = r.diff(*_versions(t), ["p_partkey"])
    return d.select("p_partkey", "op", F.array_join("changed", ",").alias("changed"), F.col("new_p_name").alias("new_name"), F.col("new_p_brand").alias("new_brand"))


@query(_NEW)
def r3_apply_patch(t: Tables) -> DataFrame:
    old, new = _versions(t)
    return r.apply_diff(old, r.diff(old, new, ["p_partkey"]), ["p_partkey"])


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size = l_linenumber WHERE l_returnflag IN ('A', 'R')")
def j22_self_credits(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_returnflag").isin("A", "R")).join(t.part, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("p_size") == F.col("l_linenumber"))).select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def j23_season_before_series(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey, o_orderstatus, min(o_orderkey) AS page_id FROM orders GROUP BY ALL")
def j24_by_title(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("page_id"))


@query("SELECT o_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def j25_kinds(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("kinds")).join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi")


@query("SELECT p_type AS kind, count(*) AS n FROM part GROUP BY p_type")
def a2_count_by_kind(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_shipmode AS source, n FROM (SELECT l_linestatus AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, source")
def a3_count_by_source(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_linestatus").alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT count(DISTINCT l_orderkey) AS pages, count(*) AS claims FROM lineitem")
def a4_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.countDistinct("l_orderkey").alias("pages"), F.count(F.lit(1)).alias("claims"))


@query("SELECT o_custkey, max(o_orderpriority) AS wikitext FROM orders GROUP BY o_custkey")
def a5_max_group(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("wikitext"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 7")
def a8_referrers(t: Tables) -> DataFrame:
    return t.lineitem.where("l_partkey = 7").select("l_orderkey").distinct()


@query(
    """
WITH w AS (
  SELECT l_suppkey, l_returnflag AS role, l_linestatus AS kind, p_name AS title, min((l_partkey, p_size)) AS w
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4
)
SELECT l_suppkey, CASE role WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 0 END AS role_rank, role,
  string_agg(w[1] || '|' || title || '|' || w[2], ';' ORDER BY w[2] DESC, w[1], title) AS works
FROM w GROUP BY 1, 2, 3"""
)
def a9_filmography(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("kind"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.col("l_partkey").alias("work"))
    out = r.filmography(rows, "l_suppkey", "role", "title", "year", "kind", "work", {"A": 0, "R": 1})
    text = F.transform("works", lambda w: F.concat_ws("|", w["work"].cast("string"), w["title"], w["year"].cast("string")))
    return out.select("l_suppkey", "role_rank", "role", F.array_join(text, ";").alias("works"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS best, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS aliases FROM orders GROUP BY o_custkey")
def a10_best_and_aliases(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("aliases"))


@query(
    """
WITH s AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS network, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END AS episodes FROM orders)
SELECT o_custkey, coalesce(arg_min(network, (o_orderdate, o_orderkey)) FILTER (network <> ''), '') AS network,
  coalesce(arg_min(episodes, (o_orderdate, o_orderkey)) FILTER (episodes <> 0), 0) AS episodes FROM s GROUP BY o_custkey"""
)
def a11_fill_first(t: Tables) -> DataFrame:
    s = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("network"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_orderkey")).alias("episodes"))
    return r.fill_first(s, ["o_custkey"], ["network", "episodes"], ["o_orderdate", "o_orderkey"], {"network": "", "episodes": 0})


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS seasons, count(l_linenumber) AS episodes FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def a12_season_episode_counts(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    joined = t.orders.select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("seasons"), F.coalesce(F.sum("n"), F.lit(0)).alias("episodes"))


@query("SELECT label, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> ''))) AS label FROM documents) GROUP BY label")
def a13_facets(t: Tables) -> DataFrame:
    return r.facets(t.documents, "doc_id", F.filter(F.split(F.lower("text"), " ", -1), lambda w: w != ""))


@query("SELECT l_orderkey, coalesce(nullif(max(CASE WHEN l_linenumber = 2 THEN l_suppkey ELSE 0 END), 0), sum(l_partkey)) AS num_episodes FROM lineitem GROUP BY l_orderkey")
def a14_parts_where_no_total(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("total", F.when(F.col("l_linenumber") == 2, F.col("l_suppkey")).otherwise(F.lit(0).cast("long")))
    return r.totals_or_parts(lines, ["l_orderkey"], "total", "l_partkey", "num_episodes").withColumn("num_episodes", F.col("num_episodes").cast("long"))


@query("SELECT l_orderkey, min(strftime(l_shipdate, '%Y-%m-%d')) AS first_aired, max(strftime(l_shipdate, '%Y-%m-%d')) AS last_aired FROM lineitem GROUP BY l_orderkey")
def a15_first_last(t: Tables) -> DataFrame:
    d = F.date_format("l_shipdate", "yyyy-MM-dd")
    return t.lineitem.groupBy("l_orderkey").agg(F.min(d).alias("first_aired"), F.max(d).alias("last_aired"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def w1_last_revision(t: Tables) -> DataFrame:
    return r.first_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def w3_first_per_key(t: Tables) -> DataFrame:
    return r.first_per_key(t.lineitem, ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS season FROM events")
def w4_preceding(t: Tables) -> DataFrame:
    return r.preceding(t.events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "season").select("event_id", "user_id", "season")


@query("SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 8")
def w5_top_n_per_type(t: Tables) -> DataFrame:
    return r.capped(t.part, "p_type", [F.desc("p_retailprice"), "p_partkey"], 8).select("p_type", "p_partkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY o_custkey")
def w6_last_wins(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last"))


@query("SELECT event_type AS kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 25")
def w7_cap(t: Tables) -> DataFrame:
    return r.capped(t.events, "event_type", ["event_id"], 25).select(F.col("event_type").alias("kind"), "event_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 500")
def o1_candidates(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber").limit(500)


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem ORDER BY l_suppkey, l_linenumber, l_orderkey, l_partkey")
def o4_multi_key(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").orderBy("l_suppkey", "l_linenumber", "l_orderkey", "l_partkey")


@query("WITH a(p, id) AS (VALUES (0, 9), (1, 4), (2, 5)) SELECT CAST(p AS BIGINT) AS pos, s_suppkey, s_name FROM supplier JOIN a ON id = s_suppkey")
def o5_requested_order(t: Tables) -> DataFrame:
    return r.lookup(t.supplier, "s_suppkey", [9, 4, 9, 5, 888888888]).select("pos", "s_suppkey", "s_name")


@query("SELECT l_orderkey AS id FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def u3_set_difference(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("id")).subtract(t.orders.where("o_orderstatus = 'F'").select("o_orderkey"))


@query(
    """
SELECT coalesce(a.k, i.k, o.k) AS k, coalesce(a.v, i.v, o.v) AS v FROM (SELECT l_orderkey AS k, max(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) i
FULL JOIN (SELECT l_orderkey AS k, min(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.k = i.k
FULL JOIN (SELECT o_orderkey AS k, CAST(0 AS INTEGER) AS v FROM orders) o ON o.k = coalesce(a.k, i.k)"""
)
def u4_merged_numbers(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_orderkey", "k")
    inline = lines.where("l_returnflag = 'A'").groupBy("k").agg(F.max("l_linenumber").alias("v"))
    authority = lines.where("l_returnflag = 'R'").groupBy("k").agg(F.min("l_linenumber").alias("v"))
    return r.merged_numbers(inline, authority, t.orders.select(F.col("o_orderkey").alias("k"), F.lit(0).alias("v")), ["k"], "v")


@query("SELECT DISTINCT l_returnflag AS kind, l_linestatus AS title, l_suppkey AS detail FROM lineitem")
def u5_dedupe_findings(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("title"), F.col("l_suppkey").alias("detail")).dropDuplicates(["kind", "title", "detail"])


@query(
    """
SELECT 'cheap_order' AS kind, o_orderkey AS id, o_orderpriority AS detail FROM orders WHERE o_totalprice < 2000
UNION ALL SELECT 'ships_early', l_orderkey, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'no_lines', o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""
)
def b17_lint(t: Tables) -> DataFrame:
    found = lambda df, kind, id_, detail: df.select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col(detail).alias("detail"))
    early = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate")
    out = found(t.orders.where("o_totalprice < 2000"), "cheap_order", "o_orderkey", "o_orderpriority")
    return out.unionByName(found(early, "ships_early", "l_orderkey", "l_returnflag")).unionByName(found(t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), "no_lines", "o_orderkey", "o_orderstatus"))


@query("SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#7'), '') AS p_brand, length(p_name) AS n, substr(p_name, 1, 4) AS head FROM part WHERE length(p_name) >= 9 AND p_name LIKE '%ol%' AND p_size IS NOT NULL AND p_size <> 0")
def p1_projection_predicates(t: Tables) -> DataFrame:
    return t.part.where((F.length("p_name") >= 9) & F.col("p_name").contains("ol") & F.col("p_size").isNotNull() & (F.col("p_size") != 0)).select("p_partkey", F.coalesce(F.nullif("p_brand", F.lit("Brand#7")), F.lit("")).alias("p_brand"), F.length("p_name").alias("n"), F.substring("p_name", 1, 4).alias("head"))


@query("SELECT doc_id, contains(text, 'the ') AS has_mark FROM documents WHERE contains(lower(text), 'tion')")
def p10_needle_prefilter(t: Tables) -> DataFrame:
    return t.documents.where(F.contains(F.lower("text"), F.lit("tion"))).select("doc_id", F.contains("text", F.lit("the ")).alias("has_mark"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate, o_orderkey")
def p12_slots(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")
