"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights. A block of queries is broadcast; a task gathers its candidates in chunks of
fixed size, builds postings by term, and for each query scatters weight * weight into a dense array of scores, term by
term. The best k of each chunk are selected by partition and merged in the task; a last top-k per query
merges the tasks' lists. Queries come in blocks of bounded size, each a pass over the candidates, so neither the driver nor a
broadcast holds more than block_rows queries.

Defined results: vectors that are null, or hold a null or a component that isn't finite, take no part; a vector
shorter than another has zeros where it ends; an empty vector scores 0 with all; rows that
repeat an id are candidates each and one query (of the smallest vector), never compared to rows of its own id; a null id takes no part; ties go to the smaller id; scores are exact, beyond 64 bits they are held at the
border; further columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import column, materialise

SCALE = 256
K = 5
QUERY_EVERY = 50
BLOCK_ROWS = 8192
CHUNK_ROWS = 16384
#: Below this weight sums of up to 2**15 products fit into 64 bits.
SMALL = 2**23
_LOW, _HIGH = -(2**63), 2**63 - 1

SCHEMA = "query_id long, vec_id long, score long"


def quantise(vector: list | None) -> list[int] | None:
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(x * SCALE) if abs(x) < 2**900 else int(x) * SCALE for x in map(float, vector)]


class Queries:
    """A block of queries as sparse rows."""

    def __init__(self, ids: list[int], rows: list[list[int]]):
        self.ids = np.array(ids, np.int64)
        self.rows = [[(t, w) for t, w in enumerate(r) if w] for r in rows]
        self.largest = max((abs(w) for r in self.rows for _, w in r), default=0)


def best_of_chunk(queries: Queries, ids: np.ndarray, rows: list[list[int]], k: int) -> list[tuple[int, int, int]]:
    """(query's place, candidate id, score) of the k best candidates of each query."""
    largest = max((abs(w) for r in rows for w in r), default=0)
    width = max((len(r) for r in rows), default=0)
    exact = max(largest, queries.largest) >= SMALL or width > 2**15
    kind = object if exact else np.int64
    matrix = np.zeros((width, len(rows)), kind)
    for i, r in enumerate(rows):
        matrix[: len(r), i] = r
    postings = []
    for t in range(width):
        docs = np.flatnonzero(matrix[t])
        postings.append((slice(None), matrix[t]) if 2 * len(docs) > len(rows) else (docs, matrix[t][docs]))
    out = []
    for q, terms in enumerate(queries.rows):
        scores = np.zeros(len(rows), kind)
        for t, weight in terms:
            if t < width:
                docs, weights = postings[t]
                scores[docs] += weight * weights
        if exact:
            scores = np.array([min(max(int(s), _LOW), _HIGH) for s in scores], np.int64)
        other = np.flatnonzero(ids != queries.ids[q])
        if len(other) > k:
            scores_other = scores[other]
            border = np.partition(scores_other, len(other) - k)[len(other) - k]
            other = other[scores_other >= border]
        order = np.lexsort((ids[other], -scores[other].astype(np.float64) if exact else -scores[other]))[: k if not exact else None]
        if exact:
            order = sorted(range(len(other)), key=lambda j: (-int(scores[other[j]]), int(ids[other[j]])))[:k]
        out += [(q, int(ids[other[j]]), int(scores[other[j]])) for j in order]
    return out


def _prepared(batch: pa.RecordBatch) -> tuple[list[int], list[list[int]]]:
    ids, rows = [], []
    vectors = batch.column(batch.schema.get_field_index("embedding"))
    flat = vectors.flatten()
    plain = vectors.null_count == 0 and flat.null_count == 0
    if plain and len(flat) and len(set(np.diff(vectors.offsets.to_numpy()).tolist())) == 1:
        grid = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        fine = np.isfinite(grid).all(axis=1)
        if (np.abs(grid[fine]) < 2**50).all():
            kept = np.flatnonzero(fine)
            return np.array(column(batch, "vec_id"), dtype=object)[kept].tolist(), np.floor(grid[kept] * SCALE).astype(np.int64).tolist()
    for i, v in zip(column(batch, "vec_id"), vectors.to_pylist()):
        w = quantise(v)
        if w is not None:
            ids.append(i)
            rows.append(w)
    return ids, rows


def _query_blocks(queries: DataFrame, block_rows: int):
    ids, rows = [], []
    for r in queries.toLocalIterator():
        w = quantise(r.embedding)
        if w is None:
            continue
        ids.append(r.vec_id)
        rows.append(w)
        if len(ids) == block_rows:
            yield Queries(ids, rows)
            ids, rows = [], []
    if ids:
        yield Queries(ids, rows)


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The k best of vectors(vec_id, embedding) for each row whose id is divisible by every."""
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    found = None
    queries = base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    blocks = _query_blocks(queries, block_rows)
    block, following = next(blocks, None), next(blocks, None)
    several = following is not None
    while block is not None:
        sent = spark.sparkContext.broadcast(block)

        def scan(batches, sent=sent):
            queries, best, ids, rows = sent.value, {}, [], []

            def merge():
                for q, i, s in best_of_chunk(queries, np.array(ids, np.int64), rows, k):
                    best.setdefault(q, []).append((-s, i))
                for q, found in best.items():
                    best[q] = sorted(found)[:k]

            for batch in batches:
                i, r = _prepared(batch)
                ids += i
                rows += r
                while len(ids) >= chunk_rows:
                    rest = ids[chunk_rows:], rows[chunk_rows:]
                    ids, rows = ids[:chunk_rows], rows[:chunk_rows]
                    merge()
                    ids, rows = rest
            if ids:
                merge()
            names = queries.ids.tolist()
            out = [(names[q], i, -s) for q, found in best.items() for s, i in found]
            for a in range(0, len(out), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[a : a + 100_000])], schema=schema)

        one = base.mapInArrow(scan, SCHEMA).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if several:  # one block after the other: each is written and makes room for the next
            one = materialise(one, "topk", share=8)
            sent.destroy()
        found = one if found is None else found.unionByName(one)
        block, following = following, next(blocks, None)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if found is None else found
