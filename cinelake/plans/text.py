"""Scalar text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.functions import expr
from cinelake.plans._base import Tables, query

_NORMAL = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 \\t\\-_:]', '', 'g'), '[ \\t\\-_:]+', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, {_NORMAL.format('text')} AS norm FROM documents")
def f1_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", expr.normalize("text").alias("norm"))


@query("SELECT s_suppkey, len(list_distinct(list_transform(range(1, length(s_name) - 1), lambda i: substr(s_name, i, 3)))) AS n FROM supplier")
def f2_trigrams(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.size(expr.trigrams("s_name")).cast("long").alias("n"))


@query(
    """
WITH g AS (SELECT n_nationkey AS k, list_distinct(list_transform(range(1, length(n_name) - 1), lambda i: substr(n_name, i, 3))) AS s FROM nation)
SELECT a.k AS a, b.k AS b, round(2.0 * len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s)), 6) AS dice FROM g a JOIN g b ON a.k < b.k"""
)
def f3_dice(t: Tables) -> DataFrame:
    g = t.nation.select(F.col("n_nationkey").alias("k"), expr.trigrams("n_name").alias("s"))
    pairs = g.alias("a").join(g.alias("b"), F.col("a.k") < F.col("b.k"))  # 25 nations
    return pairs.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.round(expr.dice(F.col("a.s"), F.col("b.s")), 6).alias("dice"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS short FROM documents")
def f6_truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", expr.truncate("text", 40).alias("short"))


_TITLES = "p_name || CASE p_partkey % 7 WHEN 0 THEN ' (film)' WHEN 1 THEN ' (1985 film)' WHEN 2 THEN ' (1966–67 Indian film)' WHEN 3 THEN ' (Yellow)' WHEN 4 THEN ' (TV series)' WHEN 5 THEN ' (2001 TV series)' ELSE ' (1999)' END"


def _titles(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 7
    tail = F.when(k == 0, " (film)").when(k == 1, " (1985 film)").when(k == 2, " (1966–67 Indian film)").when(k == 3, " (Yellow)").when(k == 4, " (TV series)").when(k == 5, " (2001 TV series)").otherwise(" (1999)")
    return t.part.select("p_partkey", F.concat("p_name", tail).alias("title"))


_KIND = expr.FILM_WORDS


@query(
    rf"""SELECT p_partkey, regexp_replace({_TITLES}, '(?i)\s*\((?:\d{{4}}(?:[–-]\d{{2,4}})?s?(?:[ -][\p{{L}}.]+)*(?: (?:{_KIND}))?|(?:[\p{{L}}.-]+ )*(?:{_KIND}))\)\s*$', '') AS film,
  trim(regexp_replace({_TITLES}, '(?i)\s*\([^()]*\b(?:{expr.SERIES_WORDS})\b[^()]*\)\s*$', '')) AS series,
  trim(regexp_replace({_TITLES}, '\s*\([^()]*\)\s*$', '')) AS person FROM part"""
)
def f7_f8_f9_clean_titles(t: Tables) -> DataFrame:
    return _titles(t).select("p_partkey", expr.clean_title("title").alias("film"), expr.clean_series_title("title").alias("series"), expr.clean_person_name("title").alias("person"))


@query("SELECT p_partkey, replace(p_name, ' ', ' ') AS title FROM part")
def f10_url_round_trip(t: Tables) -> DataFrame:
    """A title's address, and the title again from the address."""
    return t.part.select("p_partkey", expr.title_from_url(expr.article_url("p_name")).alias("title"))


@query("SELECT s_suppkey, 'https://en.wikipedia.org/wiki/' || replace(replace(s_name, '#', '%23'), ' ', '_') AS url FROM supplier")
def f11_article_url(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", expr.article_url("s_name").alias("url"))


@query("SELECT p_partkey, 'https://en.wikipedia.org/wiki/Special:FilePath/' || replace(p_name, ' ', '_') || '.jpg?width=220' AS url FROM part")
def f12_file_path_url(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", expr.file_path_url(F.concat(F.lit("File: "), "p_name", F.lit(".jpg ")), 220).alias("url"))


@query(
    """
WITH n AS (SELECT p_partkey, upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', '_') || '.jpg' AS c, p_partkey IN (SELECT s_suppkey FROM supplier) AS loc FROM part)
SELECT p_partkey, 'https://upload.wikimedia.org/wikipedia/' || CASE WHEN loc THEN 'en' ELSE 'commons' END || '/' || substr(md5(c), 1, 1) || '/' || substr(md5(c), 1, 2) || '/' || c AS url FROM n"""
)
def f13_cdn_image_url(t: Tables) -> DataFrame:
    local = t.supplier.select(F.col("s_suppkey").alias("k"), F.lit(True).alias("hit"))
    joined = t.part.join(local, F.col("p_partkey") == F.col("k"), "left")
    return joined.select("p_partkey", expr.cdn_image_url(F.concat("p_name", F.lit(".jpg")), F.coalesce("hit", F.lit(False))).alias("url"))


@query("SELECT c_custkey, 'C' || substr(trim(split_part(c_name, '#', 1)), 2) AS title FROM customer")
def f14_canon_title(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", expr.canon_title(F.concat(F.lit(" "), F.regexp_replace("c_name", "^C", "c"))).alias("title"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<ref[^>]*/>', '', 'g'), '(?is)<ref[^>]*>.*?</ref>', '', 'g') AS body FROM pages")
def f18_strip_refs(t: Tables) -> DataFrame:
    return t.pages.select("page_id", expr.strip_refs("html").alias("body"))


@query(
    r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS s FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(s, '(?is)<ref[^>]*/>', '', 'g'), '(?is)<ref[^>]*>.*?</ref>', '', 'g') AS s FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s,
  '\[\[(?:[^\]]*\|)?([^\]|]*)\]\]', '\1', 'g'), '(?is)<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'g'), '''''''?', '', 'g'), '&amp;', '&', 'g'), '&quot;', '"', 'g'), '[ \t]+', ' ', 'g') AS s FROM b)
SELECT page_id, trim(regexp_replace(s, '^\s+|\s+$', '', 'g')) AS body FROM c"""
)
def f19_clean_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", expr.clean_html("html").alias("body"))


def _categories():
    k = F.col("p_partkey")
    one = lambda a: F.concat(F.lit("[[Category:"), a, F.lit("]]"))
    first = F.when(k % 3 == 0, "American science fiction films").when(k % 3 == 1, "Award-winning horror comedies").otherwise("1990s war drama films|x")
    second = F.when(k % 5 == 0, "Neo-noir crime film").otherwise("Martial arts films")
    return F.concat(one(first), F.lit(" text "), one(second))


@query(
    """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Science fiction · ' WHEN 2 THEN 'Drama · War · ' ELSE '' END
  || CASE WHEN p_partkey % 5 = 0 THEN 'Crime · Film noir' ELSE 'Martial arts' END AS genres FROM part"""
)
def f26_genres(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", expr.joined(expr.genres(_categories())).alias("genres"))


@query("SELECT o_orderkey, CAST(substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS BIGINT) AS year, (CAST(year(o_orderdate) AS BIGINT) // 10 * 10) || 's' AS decade FROM orders")
def f29_year_decade(t: Tables) -> DataFrame:
    year = expr.year_of(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", year.alias("year"), expr.decade(year).alias("decade"))


@query(r"SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 THEN l_quantity ELSE 0.0 END AS viewers FROM lineitem")
def f33_viewers(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", expr.viewers(F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit("&nbsp;million[2]"))).alias("viewers"))


@query("SELECT o_orderkey, o_orderpriority AS series, CAST(o_custkey AS BIGINT) AS season FROM orders")
def f36_season_of_title(t: Tables) -> DataFrame:
    s = expr.season_of_title(F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, " (season ").otherwise(" series "), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ")").otherwise("")))
    return t.orders.select("o_orderkey", s["series"].alias("series"), s["season"].alias("season"))


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ' · ' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS joined, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def f38_join_split(t: Tables) -> DataFrame:
    items = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))), lambda x: F.concat(x["l_returnflag"], x["l_linestatus"]))
    out = t.lineitem.groupBy("l_orderkey").agg(expr.joined(items).alias("joined"))
    return out.select("l_orderkey", "joined", F.size(expr.split_joined("joined")).cast("long").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE contains(props, '\"k\"')")
def f39_json_claims(t: Tables) -> DataFrame:
    return t.events.where(F.contains("props", F.lit('"k"'))).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT p_partkey, lower(lpad(hex(p_partkey % 256), 2, '0')) AS shard FROM part")
def f46_record_shard(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", expr.record_shard("p_partkey").alias("shard"))
