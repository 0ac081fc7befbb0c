"""Trigram retrieval: an inverted index, BM25 candidates, and a fuzzy re-rank.

The index is a table (gram, id, field, tf) with the sizes of fields beside it; a query touches only the rows of its own
grams. The cap on candidates is part of the operator: the re-rank sees the best by BM25, as in any two-step search."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions import expr

K1, B = 1.2, 0.75


def normalized(query: str) -> str:
    """The query as expr.normalize gives it; queries are single strings, known on the driver."""
    return re.sub(r"[ \t\-_:]+", " ", re.sub(r"[^a-z0-9 \t\-_:]", "", query.lower())).strip(" ")


def query_grams(query: str) -> list[str]:
    q = normalized(query)
    return sorted({q[i : i + 3] for i in range(len(q) - 2)})


def _grams(s: Column) -> Column:
    return expr.runs_of_three(F.lower(s))


def _size(fields: Iterable[str]) -> Column:
    """Grams of all fields of a row."""
    return sum((F.greatest(F.length(F.coalesce(F.col(f), F.lit(""))) - 2, F.lit(0)) for f in fields), F.lit(0))


INDEX = "gram string, id long, field string, size int, tf long"
_INDEX = pa.schema([("gram", pa.string()), ("id", pa.int64()), ("field", pa.string()), ("size", pa.int32()), ("tf", pa.int64())])
CHUNK = 1 << 20  # characters that are counted at once


def _counted(texts: list[tuple[int | None, int, str, list[str]]]) -> pa.RecordBatch:
    """Rows of the index: how often each run of three characters stands in the texts of an (id, size, field)."""
    pieces = [x for *_, some in texts for x in some]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.int64)
    whose = np.repeat(np.repeat(np.arange(len(texts)), [len(some) for *_, some in texts]), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    at = np.flatnonzero(np.arange(len(codes)) + 3 <= end)  # no run goes from one text into the next
    grams, which = np.unique(codes[at] << 42 | codes[at + 1] << 21 | codes[at + 2], return_inverse=True)
    pairs, tf = np.unique(whose[at] * len(grams) + which, return_counts=True)
    owner, which = np.divmod(pairs, max(len(grams), 1))
    shown = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    named = pa.array([shown[i : i + 3] for i in range(0, len(shown), 3)], pa.string())
    ids, sizes, fields = (pa.array([x[n] for x in texts], _INDEX.field(name).type) for n, name in enumerate(("id", "size", "field")))
    return pa.RecordBatch.from_arrays([named.take(pa.array(which)), *(x.take(pa.array(owner)) for x in (ids, fields, sizes)), pa.array(tf)], schema=_INDEX)


def index(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(gram, id, field, tf, size) of the raw text of some columns; size: grams of all of them, so that scoring needs no other table.

    Texts are dealt out once, by id; there each id is counted on its own, so what is moved and held doesn't grow with the grams of a text."""

    def scan(batches):
        rows = ((i, size, texts) for b in batches for i, size, *texts in zip(*(c.to_pylist() for c in b.columns)))
        held, n = [], 0
        for (i, size), same in groupby(rows, key=lambda r: r[:2]):
            for f, some in zip(fields, zip(*(texts for *_, texts in same))):
                held.append((i, size, f, list(some)))
                n += sum(map(len, some))
            if n >= CHUNK:
                yield _counted(held)
                held, n = [], 0
        if held:
            yield _counted(held)

    texts = df.select(F.col(key).cast("long").alias("_id"), _size(fields).cast("int").alias("_size"), *(F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f"_text{n}") for n, f in enumerate(fields)))
    dealt = texts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_id").sortWithinPartitions("_id", "_size")
    return dealt.mapInArrow(scan, INDEX)


def statistics(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """One row: docs, and the mean of their sizes."""
    return df.agg(F.count(F.lit(1)).alias("docs"), F.avg(_size(fields)).alias("mean"))


def bm25(postings: DataFrame, stats: DataFrame, fields: Mapping[str, float], grams: list[str]) -> DataFrame:
    """(id, bm25) of the documents that have any of the grams in any field; weights multiply frequencies.

    Rare grams count more; a gram that most documents have counts next to nothing, never less. Scores are rounded to nine places, so
    that the order of their sums decides nothing."""
    weight = F.coalesce(*(F.when(F.col("field") == f, F.lit(float(w))) for f, w in fields.items()))
    hits = postings.where(F.col("gram").isin(grams) & F.col("field").isin(list(fields))).withColumn("weighted", F.col("tf") * weight)
    per_document = hits.groupBy("gram", "id", "size").agg(F.sum("weighted").alias("f"))
    # A query has few grams: one row each, and one row of statistics.
    df = per_document.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    joined = per_document.join(F.broadcast(df), "gram").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return joined.groupBy("id").agg(F.round(F.sum(score), 9).alias("bm25"))


def search(df: DataFrame, key: str, fields: Mapping[str, float], field: str, query: str, limit: int, cap: int = 500, postings: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """The best rows by fuzzy score of one field, among the cap best by BM25 over all fields; ties by BM25, then by id.

    postings and stats: a written index over just these fields; without them both are made on the spot."""
    grams = query_grams(query)
    if not grams:
        return df.limit(0).withColumns({"score": F.lit(0.0), "bm25": F.lit(0.0)})
    postings = index(df, key, list(fields)) if postings is None else postings
    stats = statistics(df, fields) if stats is None else stats
    best = bm25(postings, stats, fields, grams).orderBy(F.desc("bm25"), "id").limit(cap)
    joined = df.join(best, df[key].cast("long") == best["id"]).drop(best["id"])
    scored = joined.withColumn("score", expr.fuzzy_score(F.lit(normalized(query)), expr.normalize(F.coalesce(F.col(field), F.lit("")))))
    return scored.orderBy(F.desc("score"), F.desc("bm25"), key).limit(limit)


def fuzzy(df: DataFrame, key: str, field: str, query: str, limit: int) -> DataFrame:
    """The re-rank alone, over rows that share a gram with the query; what search gives where the cap doesn't bind."""
    grams = query_grams(query)
    text = F.coalesce(F.col(field), F.lit(""))
    some = F.arrays_overlap(_grams(text), F.array(*(F.lit(g) for g in grams))) if grams else F.lit(False)
    return df.where(some).withColumn("score", expr.fuzzy_score(F.lit(normalized(query)), expr.normalize(text))).orderBy(F.desc("score"), key).limit(limit)


def with_counts(hits: DataFrame, key: str, facts: DataFrame, foreign: str, name: str) -> DataFrame:
    """Hits with the number of their facts: one aggregation, not a query for each hit."""
    counts = facts.join(hits.select(F.col(key).alias(foreign)), foreign, "left_semi").groupBy(foreign).agg(F.count(F.lit(1)).alias(name))
    return hits.join(counts, hits[key] == counts[foreign], "left").drop(counts[foreign]).withColumn(name, F.coalesce(name, F.lit(0)))


# Rank of a type where scores tie, and how many of each type a unified search asks for.
TYPE_RANK = {"tv": 0, "movie": 1, "event": 2, "person": 3, "episode": 4}
TYPE_LIMITS = {"movie": 8, "tv": 8, "person": 6, "event": 6, "episode": 4}
TOLERANCE = 0.02


def unified(parts: Mapping[str, DataFrame], limit: int = 25) -> DataFrame:
    """Hits (type, id, title, score) of several searches in one list: at most so many of each type, by score, type, id."""
    every = None
    for kind, hits in parts.items():
        one = hits.select(F.lit(kind).alias("type"), F.col("id").cast("long").alias("id"), "title", "score")
        if kind == "episode":  # one row for each title, three at most
            first = Window.partitionBy(F.lower("title")).orderBy(F.desc("score"), "id")
            one = one.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").orderBy(F.desc("score"), "id").limit(3)
        every = one if every is None else every.unionByName(one)
    rank = F.coalesce(*(F.when(F.col("type") == t, F.lit(r)) for t, r in TYPE_RANK.items()), F.lit(9))
    within = Window.partitionBy("type").orderBy(F.desc("score"), "id")
    ask = F.coalesce(*(F.when(F.col("type") == t, F.lit(n)) for t, n in TYPE_LIMITS.items()), F.lit(limit))
    return every.withColumn("n", F.row_number().over(within)).where(F.col("n") <= ask).drop("n").orderBy(F.desc("score"), rank, "id").limit(limit)


def tolerant_order(rows: list[dict], tolerance: float = TOLERANCE) -> list[dict]:
    """Orders the few final hits: scores closer than the tolerance tie, then the type decides, then the order given.

    This is no total order, so it is an insertion into what stands already, on the driver."""
    out: list[dict] = []
    for row in rows:
        at = len(out)
        while at:
            before = out[at - 1]
            gap = row["score"] - before["score"]
            if gap > tolerance or (abs(gap) <= tolerance and TYPE_RANK.get(row["type"], 9) < TYPE_RANK.get(before["type"], 9)):
                at -= 1
            else:
                break
        out.insert(at, row)
    return out
