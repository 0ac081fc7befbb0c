"""Benchmark decontamination with an FM-index for each shard of training text.

Words of a shard become numbers of the phrases' vocabulary. A word that no phrase has ends every match, so
the shard keeps only the runs between such words that are long enough for some phrase; nothing that could match is
lost. Over these runs an FM-index is built: suffix array, Burrows-Wheeler transform in a wavelet matrix, sampled
suffix positions. All phrases are searched backwards at once, occurrences are located by walking to the next sampled
position, and overlapping removal spans are merged.

The plan is one narrow pass over the documents: no shuffle, and a shard needs memory for about shard_bytes of text.
The phrases are sent to the executors in blocks of at most block_words words. A larger benchmark takes several passes, one after the
other: each writes its spans and frees its block, and spans are merged by a row number that is written first, so that all passes
mean the same rows.

Defined results: null and wordless texts have no words and no hits; an item without words has no phrase; items with
equal texts are all reported; a null item_id is reported as "null"; repeated documents are judged one by one; a null
doc_id stays null; a very long text is a shard of its own; occurrences that overlap or touch count each word once, and items are told in the order of their ids;
further columns are ignored; an empty table, or a benchmark without words, gives no hits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import DOC_COLUMNS, column, materialise, slices, trimmed

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 2_000_000
SAMPLE = 8
#: Runs are cut to this many words, each piece overlapping the next by the longest phrase.
RUN_WORDS = 1 << 20

#: Bytes of words stay, A-Z are lower-cased, the rest are spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").translate(_TABLE).split()


class Phrases:
    """The distinct windows of a block of items, in numbers of a vocabulary that starts at 1."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(ids[i : i + window], set()).add(name)
        self.owners = []
        self.by_length: list[tuple[int, int, np.ndarray]] = []
        for n in sorted({len(p) for p in owners}):
            same = [p for p in owners if len(p) == n]
            self.by_length.append((n, len(self.owners), np.array(same, dtype=np.int64)))
            self.owners += [sorted(owners[p]) for p in same]
        self.shortest = self.by_length[0][0] if self.by_length else 0
        self.longest = self.by_length[-1][0] if self.by_length else 0


class FMIndex:
    """FM-index of runs of positive numbers."""

    def __init__(self, runs: list[np.ndarray], sample: int = SAMPLE):
        self.text = np.concatenate([x for r in runs for x in (r, np.zeros(1, np.int64))])
        n = self.n = len(self.text)
        ends = np.flatnonzero(self.text == 0)
        # Each end of a run has its own rank, so no comparison goes beyond a run.
        rank = self.text + len(ends)
        rank[ends] = np.arange(len(ends))
        k = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            fresh = np.empty(n, np.int64)
            fresh[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            rank = fresh
            if rank[order[-1]] == n - 1 or k >= n:
                break
            k *= 2
        self.bwt = self.text[order - 1]
        starts = np.zeros(n, bool)
        starts[np.concatenate(([0], ends[:-1] + 1))] = True
        marked = starts[order] | (order % sample == 0)
        self.samples = np.where(marked, order, -1)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(self.bwt, minlength=int(self.text.max()) + 1))))
        self.levels = []
        rest = self.bwt
        for bit in reversed(range(max(1, int(self.text.max()).bit_length()))):
            ones = (rest >> bit) & 1
            counts = np.concatenate(([0], np.cumsum(ones))).astype(np.int32 if n < 2**31 else np.int64)
            self.levels.append((bit, counts, n - int(counts[-1])))
            rest = np.concatenate((rest[ones == 0], rest[ones == 1]))

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place in the transform."""
        low, high = np.zeros_like(places), places
        for bit, counts, zeros in self.levels:
            one = ((symbols >> bit) & 1).astype(bool)
            low = np.where(one, zeros + counts[low], low - counts[low])
            high = np.where(one, zeros + counts[high], high - counts[high])
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The patterns that occur, and for each the first and last row (exclusive) of its suffixes."""
        top = len(self.before) - 2
        alive = np.flatnonzero((patterns <= top).all(axis=1))
        first, last = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for j in reversed(range(patterns.shape[1])):
            symbols = patterns[alive, j]
            first = self.before[symbols] + self.rank(symbols, first)
            last = self.before[symbols] + self.rank(symbols, last)
            some = first < last
            alive, first, last = alive[some], first[some], last[some]
        return alive, first, last

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, found = rows.copy(), np.full(len(rows), -1, np.int64)
        steps, left = 0, np.arange(len(rows))
        while len(left):
            at = self.samples[rows[left]]
            found[left] = np.where(at >= 0, at + steps, -1)
            left = left[at < 0]
            symbols = self.bwt[rows[left]]
            rows[left] = self.before[symbols] + self.rank(symbols, rows[left])
            steps += 1
        return found


def _runs(ids: np.ndarray, shortest: int, longest: int) -> list[tuple[int, np.ndarray]]:
    """(place, numbers) of the runs of known words in which a phrase can lie."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a < shortest:
            continue
        step = max(RUN_WORDS, longest)
        out += [(i, ids[i : min(b, i + step + longest - 1)]) for i in range(a, b, step) if i == a or b - i >= shortest]
    return out


def match_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """For each text: words, words hit, items that occur, merged spans of words."""
    split = [words(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    firsts = np.concatenate(([0], np.cumsum(counts + 1)))  # a gap after each text
    ids = np.zeros(int(firsts[-1]), np.int64)
    known = phrases.vocabulary.get
    for at, w in zip(firsts.tolist(), split):
        ids[at : at + len(w)] = np.fromiter((known(x, 0) for x in w), np.int64, len(w))
    delta, items = np.zeros(len(ids) + 1, np.int64), {}
    runs = _runs(ids, phrases.shortest, phrases.longest) if phrases.by_length else []
    if runs:
        index = FMIndex([r for _, r in runs])
        homes = np.concatenate([np.arange(at, at + len(r) + 1) for at, r in runs])
        for length, number, patterns in phrases.by_length:
            which, first, last = index.search(patterns)
            if not len(which):
                continue
            sizes = last - first
            rows = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
            places = homes[index.locate(rows)]
            np.add.at(delta, places, 1)
            np.add.at(delta, places + length, -1)
            docs = np.searchsorted(firsts, places, side="right") - 1
            pairs = np.unique(docs * len(phrases.owners) + np.repeat(which + number, sizes))
            for doc, phrase in zip((pairs // len(phrases.owners)).tolist(), (pairs % len(phrases.owners)).tolist()):
                items.setdefault(doc, set()).update(phrases.owners[phrase])
    hit = (np.cumsum(delta[:-1]) > 0).astype(np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
    spans: dict[int, list[tuple[int, int]]] = {}
    for doc, a, b in zip((np.searchsorted(firsts, edges[::2], side="right") - 1).tolist(), edges[::2].tolist(), edges[1::2].tolist()):
        spans.setdefault(doc, []).append((a - int(firsts[doc]), b - int(firsts[doc])))
    return [(int(counts[i]), sum(b - a for a, b in spans.get(i, ())), sorted(items.get(i, ())), spans.get(i, [])) for i in range(len(texts))]


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def _blocks(benchmark: DataFrame, block_words: int):
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        n = len(words(row.text))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += n
    yield block


def _merge(parts: list[dict]) -> tuple[int, list[dict]]:
    merged: list[list[int]] = []
    for s in sorted((p["start"], p["end"]) for p in parts):
        if merged and s[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s[1])
        else:
            merged.append(list(s))
    return sum(b - a for a, b in merged), [{"start": a, "end": b} for a, b in merged]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of docs(doc_id, text): words, words hit, items that occur, spans of words to remove."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan_for(sent):
        def scan(batches):
            for batch in batches:
                for part in slices(batch, "text", shard_bytes):
                    found = match_shard(column(part, "text"), sent.value)
                    data = [column(part, "doc_id"), *map(list, zip(*((n, h, i, [{"start": a, "end": b} for a, b in s]) for n, h, i, s in found)))]
                    out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(data, _ARROW)], schema=_ARROW)
                    yield out if "row" not in part.schema.names else pa.RecordBatch.from_arrays([*out.columns, part.column(part.schema.get_field_index("row"))], schema=_ARROW.append(pa.field("row", pa.int64())))

        return trimmed(scan)

    blocks = _blocks(benchmark, block_words)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return base.mapInArrow(scan_for(spark.sparkContext.broadcast(Phrases(block, window))), SCHEMA)
    base = materialise(base.withColumn("row", F.monotonically_increasing_id()), "rows", "zstd")
    all_parts = None
    while block is not None:
        sent = spark.sparkContext.broadcast(Phrases(block, window))
        one = materialise(base.mapInArrow(scan_for(sent), SCHEMA + ", row long"), "spans", "zstd")
        sent.destroy()
        all_parts = one if all_parts is None else all_parts.unionByName(one)
        block, following = following, next(blocks, None)

    def join(batches):
        for batch in batches:
            out = []
            for d, n, i, s in zip(*(column(batch, c) for c in ("doc_id", "n_words", "items", "spans"))):
                hit, spans = _merge(s)
                out.append((d, n, hit, i, spans))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(map(list, zip(*out)), _ARROW)], schema=_ARROW)

    grouped = all_parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")
    )
    return grouped.drop("row").mapInArrow(trimmed(join), SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without the spans found, again until no phrase is left; a document of which no word remains goes.

    Removal joins what stood before and after a span, which may form a phrase anew; so texts that lost words are
    searched again."""
    cols = [F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in DOC_COLUMNS]

    def scan_for(sent):
        def scan(batches):
            for batch in batches:
                for part in slices(batch, "text", shard_bytes):
                    texts = column(part, "text")
                    keep, changed, todo = [True] * len(texts), set(), list(range(len(texts)))
                    while todo:
                        again = []
                        for i, (n, hit, _, spans) in zip(todo, match_shard([texts[i] for i in todo], sent.value)):
                            if hit:
                                texts[i] = remove_spans(texts[i], spans)
                                keep[i] = hit < n
                                again.append(i)
                        changed |= set(again)
                        todo = [i for i in again if keep[i]]
                    data = {c: column(part, c) for c in DOC_COLUMNS} | {"text": texts, "cut": [i in changed for i in range(len(texts))]}
                    for i in changed:
                        data["n_chars"][i] = len(texts[i])
                    yield pa.RecordBatch.from_pydict({c: [x for x, k in zip(v, keep) if k] for c, v in data.items()}, schema=schema)

        return trimmed(scan)

    schema = pa.schema([*((c, pa.int64() if c in ("doc_id", "n_chars") else pa.string()) for c in DOC_COLUMNS), ("cut", pa.bool_())])
    context, docs = docs.sparkSession.sparkContext, docs.select(*cols)
    while True:
        blocks, cut = _blocks(benchmark, block_words), False
        block, following = next(blocks), next(blocks, None)
        if following is None:
            return docs.mapInArrow(scan_for(context.broadcast(Phrases(block, window))), CLEAN_SCHEMA).drop("cut")
        while block is not None:
            sent = context.broadcast(Phrases(block, window))
            found = materialise(docs.mapInArrow(scan_for(sent), CLEAN_SCHEMA), "clean", "zstd")
            sent.destroy()
            cut = cut or found.where("cut").limit(1).count() > 0
            docs = found.drop("cut")
            block, following = following, next(blocks, None)
        if not cut:  # what one block's removal joins, another block's phrases may match
            return docs


CLEAN_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cut boolean"
