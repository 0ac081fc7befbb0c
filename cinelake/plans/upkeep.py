"""Queries over the stores: days applied one after the other, releases published and fetched, files written and read back."""

from __future__ import annotations

import bz2
import uuid
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.operators import store
from cinelake.plans._base import Tables, query
from cinelake.session import shared_folder
from cinelake.sources import dumps, files, records
from cinelake.streaming import reconcile


def _folder(t: Tables, tag: str) -> str:
    return f"{shared_folder(t.spark)}/cinelake/{tag}-{uuid.uuid4().hex}"


@query(
    """
SELECT p_partkey AS page_id, CASE WHEN p_partkey % 10 = 3 THEN 'second' WHEN p_partkey % 10 IN (1, 2) THEN 'first' ELSE 'full' END AS source, p_name AS title
FROM part WHERE p_partkey % 10 <> 4"""
)
def t1_days(t: Tables) -> DataFrame:
    """Two days over a store: pages change, and change again; pages that claim nothing any more are gone; a day applied twice changes nothing."""
    held = reconcile.Store(t.spark, _folder(t, "store"))
    claims = t.part.select(F.col("p_partkey").cast("long").alias("page_id"), F.lit("full").alias("source"), F.col("p_name").alias("title"))
    links = claims.select(F.col("page_id").alias("from_id"), F.lit("director").alias("field"), F.col("title").alias("target"))
    held.commit({"claims": claims, "links": links}, "full")

    def recognised(source: str):
        def of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
            some = pages.where("text <> ''").select(F.col("id").alias("page_id"), F.lit(source).alias("source"), "title")
            return some, some.select(F.col("page_id").alias("from_id"), F.lit("director").alias("field"), F.col("title").alias("target"))

        return of

    day = lambda condition, text: t.part.where(condition).selectExpr("CAST(p_partkey AS BIGINT) AS id", "0 AS ns", "p_name AS title", f"{text} AS text")
    reconcile.apply_day(held, "20260101", day("p_partkey % 10 IN (1, 2, 3)", "'text'"), recognised("first"))
    second = day("p_partkey % 10 IN (3, 4)", "CASE WHEN p_partkey % 10 = 3 THEN 'text' ELSE '' END")
    reconcile.apply_day(held, "20260102", second, recognised("second"))
    reconcile.apply_day(held, "20260102", second, recognised("never"))
    return held.read("claims")


_SPECS = {"movies": ["id", "title", "year"]}


def _movies(t: Tables, condition: str, year: str) -> DataFrame:
    return t.part.where(condition).selectExpr("CAST(p_partkey AS BIGINT) AS id", "p_name AS title", f"CAST({year} AS BIGINT) AS year")


def _published(t: Tables) -> store.Releases:
    """A full build and two days behind it; the second day's build offers a patch from the full one as well."""
    releases = store.Releases(t.spark, _folder(t, "releases"), _SPECS)
    releases.publish_full("full", "2026-01-01", {"movies": _movies(t, "p_partkey % 5 <> 0", "p_size")})
    releases.publish_daily("one", "2026-01-02", {"movies": _movies(t, "p_partkey % 5 <> 1", "p_size")})
    releases.publish_daily("two", "2026-01-03", {"movies": _movies(t, "p_partkey % 5 <> 1", "CASE WHEN p_partkey % 7 = 0 THEN 1900 ELSE p_size END")}, rollups=["full"])
    return releases


@query("SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 7 = 0 THEN 1900 ELSE p_size END AS year FROM part WHERE p_partkey % 5 <> 1")
def r11_update(t: Tables) -> DataFrame:
    """What a consumer holds that was at the first day's build when the second came."""
    releases, mine = _published(t), _folder(t, "consumer")
    releases.update(mine, "one")
    return t.spark.read.parquet(f"{mine}/{releases.update(mine)}/movies.parquet")


@query("SELECT p_partkey AS id, p_name AS title, p_size AS year FROM part WHERE p_partkey % 5 <> 1")
def r10_build_before_the_tip(t: Tables) -> DataFrame:
    return _published(t).tables_of("one")["movies"]


@query("SELECT DISTINCT 'Part ''' || p_brand || '''),(' || p_size || '.png' AS name FROM part")
def s9_image_names(t: Tables) -> DataFrame:
    """Names of an image table's dump, with quotes, brackets and commas in them."""
    path = _folder(t, "images")
    name = F.concat(F.lit("Part \\'"), "p_brand", F.lit("\\'),("), "p_size", F.lit(".png"))
    row = F.concat(F.lit("('"), name, F.lit("',"), "p_partkey", F.lit(",'(\\'x"), "p_size", F.lit("),')"))
    lines = t.part.groupBy(F.expr("p_partkey % 16").alias("line")).agg(F.array_join(F.collect_list(row), ",").alias("rows"))
    lines.select(F.concat(F.lit("INSERT INTO `image` VALUES "), "rows", F.lit(";")).alias("value")).write.text(path)
    return dumps.image_names(t.spark, path)


@query("SELECT c_custkey AS page_id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey <> 0")
def s17_records(t: Tables) -> DataFrame:
    """Records written in shards and read back; one without an id, or of id 0, is no entity."""
    folder = _folder(t, "records")
    rows = t.customer.selectExpr("CAST(c_custkey AS BIGINT) AS page_id", "c_name AS name", "CAST(c_acctbal AS DOUBLE) AS balance")
    records.write_records(rows.unionByName(t.region.selectExpr("0L AS page_id", "r_name AS name", "CAST(1 AS DOUBLE) AS balance")), folder)
    return records.read_records(t.spark, folder, "page_id long, name string, balance double")


@query("SELECT n_nationkey AS id, 0 AS ns, 'A & ' || n_name AS title, 'Text of <' || n_name || '>' || chr(10) || 'é' AS text FROM nation")
def s1_streams(t: Tables) -> DataFrame:
    """A dump of several streams, which are dealt out by its index; of several revisions the last one counts."""
    folder, data, lines = _folder(t, "dump"), bz2.compress(b"<mediawiki>\n"), []
    nations = t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows at every size
    for i in range(0, len(nations), 4):
        lines += [f"{len(data)}:{r.n_nationkey}:A & {r.n_name}" for r in nations[i : i + 4]]
        pages = (f"<page><title>{escape(f'A & {r.n_name}')}</title><ns>0</ns><id>{r.n_nationkey}</id><revision><id>1</id><text>old</text></revision><revision><text xml:space='preserve'>{escape(f'Text of <{r.n_name}>')}\né</text></revision></page>" for r in nations[i : i + 4])
        data += bz2.compress("\n".join(pages).encode())
    files.write_bytes(t.spark, f"{folder}/dump.xml.bz2", data + bz2.compress(b"</mediawiki>"))
    files.write_text(t.spark, f"{folder}/index.txt", "\n".join(lines))
    return dumps.pages(t.spark, f"{folder}/dump.xml.bz2", f"{folder}/index.txt")
