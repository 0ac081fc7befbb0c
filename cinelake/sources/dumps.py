"""Readers of bulk dumps: article XML, its index, the property and image tables, and the knowledge graph."""

from __future__ import annotations

import bz2
import re
import zlib
from html import unescape

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "title string, ns int, id long, revision array<struct<text:string>>"

# The properties read from the knowledge graph.
PART_OF, SEASON, FOLLOWS, FOLLOWED_BY = "P179", "P4908", "P155", "P156"
IDENTIFIERS = {"P345": "imdb", "P4947": "tmdb_movie", "P4983": "tmdb_tv", "P4835": "tvdb", "P1258": "rotten_tomatoes"}


STREAMS_PER_TASK = 64
READ_BYTES = 1 << 20


def pages(spark: SparkSession, path: str, index_path: str | None = None) -> DataFrame:
    """Articles of an XML dump or change file: id, ns, title and the newest text.

    With the index of a multi-stream dump its streams are dealt out over tasks (multistream); without it Spark's XML reader takes a
    file in one task."""
    if index_path is not None:
        return multistream(spark, path, offsets(spark, index_path))
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE).load(path)
    return newest(raw)


_PAGE = re.compile(r"<page>(.*?)</page>", re.S)
_FIELDS = {f: re.compile(rf"<{f}>(.*?)</{f}>", re.S) for f in ("title", "ns", "id")}
_TEXT = re.compile(r"<text(?:\s[^>]*)?(?:/>|>(.*?)</text>)", re.S)
_STREAM = pa.schema([("id", pa.int64()), ("ns", pa.int32()), ("title", pa.string()), ("text", pa.string())])


def stream_pages(xml: str) -> list[tuple[int, int, str, str]]:
    """(id, ns, title, text of the last revision) of the whole pages in a piece of a dump."""
    out = []
    for m in _PAGE.finditer(xml):
        title, ns, page_id = (f.search(m[1]) for f in _FIELDS.values())
        if title and page_id:
            texts = _TEXT.findall(m[1])
            out.append((int(page_id[1]), int(ns[1]) if ns else 0, unescape(title[1]), unescape(texts[-1]) if texts else ""))
    return out


def inflate(handle, offset: int) -> bytes:
    """One bzip2 or gzip stream of a file, from where it begins to its own end."""
    handle.seek(offset)
    data = handle.read(READ_BYTES)
    step = bz2.BZ2Decompressor() if data[:3] == b"BZh" else zlib.decompressobj(31)
    out = []
    while data and not step.eof:
        out.append(step.decompress(data))
        data = b"" if step.eof else handle.read(READ_BYTES)
    return b"".join(out)


def multistream(spark: SparkSession, path: str, offsets_: DataFrame, streams_per_task: int = STREAMS_PER_TASK) -> DataFrame:
    """Pages of a multi-stream dump: each stream is read from its offset to its own end, and streams are dealt out over tasks.

    A lost task reads only its own streams again; what is held at a time is one stream of some hundred pages."""

    def scan(batches):
        fs, place = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        with fs.open_input_file(place) as handle:
            for batch in batches:
                for offset in batch.column(0).to_pylist():
                    rows = stream_pages(inflate(handle, offset).decode("utf-8", "replace"))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _STREAM)], schema=_STREAM)

    found = offsets_.select(F.col("offset").cast("long").alias("offset")).distinct()
    tasks = max(1, -(-found.count() // streams_per_task))
    return found.repartitionByRange(tasks, "offset").mapInArrow(scan, "id long, ns int, title string, text string")


def newest(raw: DataFrame) -> DataFrame:
    """Of pages as the XML has them, the last revision's text; several rows of a page stay several."""
    return raw.select("id", "ns", "title", F.coalesce(F.try_element_at("revision", F.lit(-1))["text"], F.lit("")).alias("text"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(offset, page_id, title) of a multi-stream index; titles may hold colons."""
    parts = F.split("value", ":", 3)
    return spark.read.text(path).where(F.size(parts) == 3).select(parts[0].try_cast("long").alias("offset"), parts[1].try_cast("long").alias("page_id"), parts[2].alias("title")).where("offset IS NOT NULL AND page_id IS NOT NULL")


def offsets(spark: SparkSession, path: str) -> DataFrame:
    return index(spark, path).select("offset").distinct().orderBy("offset")


def page_qids(spark: SparkSession, page_props: str, index_path: str) -> DataFrame:
    """The identity map (title, qid, page_id): property rows joined with the index; of equal titles the first in the index."""
    tuples = spark.read.option("lineSep", "),(").text(page_props)
    found = tuples.select(F.regexp_extract("value", r"\(?(\d+),'wikibase_item','Q(\d+)'", 1).try_cast("long").alias("page_id"), F.regexp_extract("value", r"\(?(\d+),'wikibase_item','Q(\d+)'", 2).try_cast("long").alias("qid")).where("page_id IS NOT NULL")
    joined = index(spark, index_path).join(found, "page_id")
    return joined.groupBy("title").agg(F.min(F.struct("offset", "page_id", "qid")).alias("m")).select("title", "m.qid", "m.page_id")


#: A quoted SQL string, and a whole tuple that begins with one. Possessive, so that long values cost no stack.
_QUOTED = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_TUPLE = rf"\(({_QUOTED})(?:[^'()]++|{_QUOTED})*+\)"


def image_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of a wiki's own files: the first column of its image table, unescaped. Tuples are taken whole, so that what stands in quotes cuts none."""
    quoted = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(_TUPLE), F.lit(1))).alias("q"))
    return quoted.select(F.regexp_replace(F.expr("substring(q, 2, length(q) - 2)"), r"\\(.)", "$1").alias("name")).where("name <> ''").distinct()


def _targets(c: Column) -> Column:
    good = F.filter(c, lambda x: (F.coalesce(x["rank"], F.lit("")) != "deprecated") & (x["mainsnak"]["snaktype"] == "value"))
    return F.transform(good, lambda x: x["mainsnak"]["datavalue"]["value"])


def entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities with claims of interest: (qid, one array of values for each property).

    Lines without any of the properties' names are dropped before they are parsed."""
    item = "array<struct<rank:string,mainsnak:struct<snaktype:string,datavalue:struct<value:struct<`numeric-id`:bigint>>>>>"
    text = "array<struct<rank:string,mainsnak:struct<snaktype:string,datavalue:struct<value:string>>>>"
    edges, names = (PART_OF, SEASON, FOLLOWS, FOLLOWED_BY), tuple(IDENTIFIERS)
    schema = "id string, claims struct<" + ",".join([f"{p}:{item}" for p in edges] + [f"{p}:{text}" for p in names]) + ">"
    some = F.lit(False)
    for p in (*edges, *names):
        some = some | F.contains("value", F.lit(f'"{p}"'))
    rows = spark.read.text(path).where(some).select(F.from_json(F.rtrim("value", F.lit(",")), schema).alias("e"))
    qid = F.regexp_extract("e.id", r"^Q(\d+)$", 1).try_cast("long")
    out = [F.transform(_targets(F.col(f"e.claims.{p}")), lambda v: v["numeric-id"]).alias(p) for p in edges] + [F.transform(_targets(F.col(f"e.claims.{p}")), lambda v: F.trim(v)).alias(p) for p in names]
    return rows.select(qid.alias("qid"), *out).where("qid IS NOT NULL")


def edges(found: DataFrame) -> dict[str, DataFrame]:
    """part_of (item, series), season_of (episode, season), sequel_of (item, next; 'follows' turned round), identifiers (item, source, value)."""
    to = lambda p, name: found.select(F.col("qid").alias("item_qid"), F.explode(p).alias(name)).where(F.coalesce(F.col(name), F.lit(0)) != 0)
    before = found.select(F.explode(FOLLOWS).alias("item_qid"), F.col("qid").alias("next_qid")).where("item_qid <> 0")
    names = None
    for p, source in IDENTIFIERS.items():
        one = found.select(F.col("qid").alias("item_qid"), F.lit(source).alias("source"), F.explode(p).alias("value")).where("value <> ''")
        names = one if names is None else names.unionByName(one)
    return {"part_of": to(PART_OF, "series_qid").distinct(), "season_of": to(SEASON, "season_qid").distinct(), "sequel_of": to(FOLLOWED_BY, "next_qid").unionByName(before).distinct(), "identifiers": names.distinct()}
