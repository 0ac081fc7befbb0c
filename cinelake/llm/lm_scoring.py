"""Language-model scoring by a hierarchical Pitman-Yor model.

Restaurants: one for each pair of words before a token, one for each word before it, and a root. The pairs that end in a word share that
word's restaurant as parent, and all words share the root; so contexts grow with the corpus. Customers are tokens of training texts; the
tables of a pair are customers of its word, those of a word customers of the root. Seatings are sampled by Gibbs sweeps, and predictive
probabilities are averaged over samples:

    p(w | u v) = (c_uvw - d t_uvw + (a + d t_uv) p(w | v)) / (a + c_uv), p(w | v) likewise over p(w), and p(w) over 1 / (V + 1)

A step of a sweep draws the number of tables of one dish in one restaurant from its distribution given all other tables, weighted by
generalised Stirling numbers, up to SMALL customers; larger dishes are seated anew in batches that double. The steps of a sweep see the
other tables as the sweep before left them, and the root as the bucket's own tables tell it; the probabilities take the root of all buckets.

Distribution: a bucket has all tokens that follow its words, with the pairs above them, so it samples these restaurants alone; a first pass
over the buckets gives the root its customers, a second one repeats the same seatings (seeded by bucket) and scores every occurrence. There is a
bucket for every BUCKET_TOKENS training tokens, at least LEAST_BUCKETS, by the data alone. The tokens after a word that precedes more than a
bucket's share of them (a split word) are dealt to buckets in parts, each of some documents (by id and stretch of PART_TOKENS tokens), so no word,
pair, start or text holds a bucket of its own size; but the word's restaurants are one for the whole corpus. Each part says how often it has
which cells (pair and next word); groups of whole pairs add up the counts of all parts and seat their customers, ranges of words add up what all pairs
send to the dishes of a split word and seat these, and parts are told both. So a group holds cells, not tokens. While a group draws tables, it knows the
dishes of its word by its own pairs, and a range the numbers of tables of a split word by its own words; the probabilities take all. The most frequent words (heads, a table of fixed size) travel as two bytes, and what the
root says of them is sent to all; tokens of all other words go on, with what their contexts say, to hash ranges of words. Sums return to the texts by slice of
the input.

Defined results: null text is empty: it has the end token alone; null ids neither train nor are held out; repeated rows are answered
each and train each; a very long text is a slice of its own; heads that occur equally often are ordered by hash; further columns are ignored; an empty table gives an empty table; without training text every token has
probability one.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import column, crc_remainder, materialise, shards, trimmed

HEADS = 65_535  # the code of words that are no heads; one less stands for the start
SLICE = 8 << 20
LEAST_BUCKETS = 64
BUCKET_TOKENS = 1_000_000  # training tokens of the corpus for each bucket
PART_TOKENS = 1 << 16
GROUP_PARTS = 2  # parts of a split word for each group of its pairs
D, A = 0.75, 1.0  # discount and strength of contexts
E, B = 0.6, 1.0  # of the root
BURN, SAMPLES = 3, 4
SMALL = 32
END = xxhash.xxh3_64_intdigest(b"")
START = xxhash.xxh3_64_intdigest(b" ")  # no word holds a space
KEPT = 1 << 19  # words that a task counts before it hands them over
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CODEC = pa.Codec("zstd", 1)


def _pack(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(packed: bytes, dtype) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True), dtype)


def _range(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _part_keys(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    mixed = (key ^ (part + np.uint64(1))) * _MIX
    return mixed ^ (mixed >> np.uint64(29))


class Slice:
    """Tokens of some texts: hash and text."""

    def __init__(self, texts: list[str | None]):
        split = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
        self.sizes = np.array([len(s) + 1 for s in split], np.int64)  # with the end
        total = int(self.sizes.sum())
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        last = np.cumsum(self.sizes) - 1
        word = np.ones(total, bool)
        word[last] = False
        self.hash = np.full(total, END, np.uint64)
        self.hash[word] = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, total - len(texts))
        self.first = last - self.sizes + 1

    def before(self, words: np.ndarray, start) -> np.ndarray:
        """Of each token, what words holds of the one before it."""
        out = np.empty_like(words)
        out[1:] = words[:-1]
        out[self.first] = start
        return out

    def contexts(self, place: np.ndarray, parts: np.ndarray, start_parts: int, ids: list) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, the word before it or that word's part, and a number for the word before that one: its rank, or bits of its hash."""
        key = self.before(self.hash, START)
        n = self.before(np.append(parts, 1)[place], start_parts)
        split = np.flatnonzero(n > 1)
        if len(split):
            seed = np.array([xxhash.xxh3_64_intdigest(str(i).encode()) for i in ids], np.uint64)
            stretch = ((split - self.first[self.doc[split]]) // PART_TOKENS).astype(np.uint64)
            part = (seed[self.doc[split]] + stretch * _MIX) % n[split].astype(np.uint64)
            key[split] = _part_keys(key[split], part)
        return key, self.before(self.before(np.where(place < 0, self.hash & np.uint64(0xFFFFFFFF) | np.uint64(1 << 16), place.astype(np.uint64)), HEADS - 1), HEADS - 1).astype(np.uint32)


class Heads:
    """The most frequent words, most frequent first, and their training tokens."""

    def __init__(self, hashes: list[int], counts: list[int]):
        self.hashes, self.counts = np.array(hashes, np.uint64), np.array(counts, np.int64)
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of heads, -1 for others."""
        if not len(self.sorted):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


class Split:
    """Words (and the start) before more than a bucket's share of tokens: the keys of their parts, and the groups of their pairs."""

    def __init__(self, heads: Heads, parts: np.ndarray, start_parts: int):
        self.parts, self.start_parts = parts, start_parts
        n = np.append(parts, start_parts).astype(np.int64)
        words = np.flatnonzero(n > 1)
        n = n[words]
        of = np.repeat(np.arange(len(words)), n)
        part = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        keys = _part_keys(np.append(heads.hashes, np.uint64(START))[words][of], part.astype(np.uint64))
        order = np.argsort(keys)
        self.keys, self.of = keys[order], of[order]
        self.groups = -(-n // GROUP_PARTS)
        self.first = np.cumsum(self.groups) - self.groups

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the words whose parts these are, -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.of[at], -1)

    def group(self, of: np.ndarray, above: np.ndarray) -> np.ndarray:
        """Groups of pairs."""
        mixed = (above.astype(np.uint64) + np.uint64(1)) * _MIX >> np.uint64(32)
        return self.first[of] + (mixed % self.groups[of].astype(np.uint64)).astype(np.int64)


def _trains(ids: list, mod: int, held: int) -> np.ndarray:
    return np.array([(r := crc_remainder(i, mod)) is not None and r != held for i in ids], bool)


# Seatings.


def _stirling(n: int, discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: the weight of all ways to seat c customers at t tables."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(n):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        out[c + 1, t] = np.logaddexp(out[c, t - 1], out[c, t] + stay)
    return out


_WAYS = {d: _stirling(SMALL, d) for d in (D, E)}


def reseat(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes whose customers arrive in batches that double; fresh: weight of a new table."""
    tables = (customers > 0).astype(np.float64)
    seated = tables.copy()
    while True:
        left = np.flatnonzero(seated < customers)
        if not len(left):
            return tables.astype(np.int64)
        n = np.minimum(seated[left], customers[left] - seated[left])
        chance = fresh[left] / (fresh[left] + seated[left] + n / 2 - discount * tables[left])
        tables[left] += rng.binomial(n.astype(np.int64), np.clip(chance, 0, 1))
        seated[left] += n


def seat(customers: np.ndarray, others: np.ndarray, p: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """New numbers of tables of dishes; others: tables of the restaurant's other dishes, p: the parent's probability of the dish."""
    tables = np.minimum(customers, 1)
    for c in range(2, SMALL + 1):
        some = np.flatnonzero(customers == c)
        if len(some):
            weight = np.cumsum(np.log((strength + discount * (others[some, None] + np.arange(c))) * p[some, None]), axis=1) + _WAYS[discount][c, 1 : c + 1]
            heap = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[some] = 1 + (rng.random((len(some), 1)) * heap[:, -1:] >= heap[:, :-1]).sum(axis=1)
    some = np.flatnonzero(customers > SMALL)
    if len(some):
        tables[some] = reseat(customers[some], (strength + discount * others[some]) * p[some], discount, rng)
    return tables


class Chain:
    """Samples of the seatings in the restaurants of some words and the pairs above them.

    key, above, word: numbers of the word before a token, of the one before that, and of its own; trains: whether it is a customer, or how many. Tokens that
    are none don't change the samples."""

    def __init__(self, key: np.ndarray, above: np.ndarray, word: np.ndarray, trains: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        pairs, pair = np.unique(key << 32 | above, return_inverse=True)
        cells, self.cell = np.unique(pair << 32 | word, return_inverse=True)
        self.pair, cell_word = cells >> 32, cells & 0xFFFFFFFF
        lower, self.lower = np.unique(pairs[self.pair] >> 32 << 32 | cell_word, return_inverse=True)
        self.key, self.word = lower >> 32, lower & 0xFFFFFFFF
        self.count = np.rint(np.bincount(self.cell, trains, len(cells))).astype(np.int64)
        n_keys, n_words, n_pairs, n_lower = int(self.key.max(initial=-1)) + 1, int(self.word.max(initial=-1)) + 1, len(pairs), len(lower)
        # Most dishes have one customer, so one table: only the tables beyond the first are summed anew in a sweep.
        one = np.minimum(self.count, 1)
        many = np.flatnonzero(self.count > 1)
        many_pair, many_lower = self.pair[many], self.lower[many]
        self.many, self.one = many, one
        self.pair_ones, lower_ones = np.bincount(self.pair, one, n_pairs), np.bincount(self.lower, one, n_lower).astype(np.int64)
        met = np.minimum(lower_ones, 1)
        self.key_ones, word_ones, key_customers = np.bincount(self.key, met, n_keys), np.bincount(self.word, met, n_words), np.bincount(self.key, lower_ones, n_keys)
        may = np.union1d(np.flatnonzero(lower_ones > 1), many_lower)  # words' dishes that may have several customers
        may_key, may_word = self.key[may], self.word[may]
        known = (word_ones > 0).sum()
        more, lower_more = np.zeros(len(many), np.int64), np.zeros(len(may), np.int64)
        of_pair, of_key, root, customers, of_customers = self.pair_ones, self.key_ones, word_ones, lower_ones, key_customers
        tables = met.copy()
        self.samples = []
        for i in range(BURN + SAMPLES):
            p = (root - E * (root > 0) + (B + E * known) / (known + 1)) / (B + root.sum())
            k = self.key[many_lower]
            below = (customers[many_lower] - D * tables[many_lower] + (A + D * of_key[k]) * p[self.word[many_lower]]) / (A + of_customers[k])
            more = seat(self.count[many], of_pair[many_pair] - 1 - more, below, D, A, rng) - 1
            of_pair = self.pair_ones + np.bincount(many_pair, more, n_pairs)
            customers = lower_ones + np.bincount(many_lower, more, n_lower).astype(np.int64)
            of_customers = key_customers + np.bincount(self.key[many_lower], more, n_keys)
            lower_more = seat(customers[may], of_key[may_key] - 1 - lower_more, p[may_word], D, A, rng) - 1
            tables[may] = 1 + lower_more
            of_key = self.key_ones + np.bincount(may_key, lower_more, n_keys)
            root = word_ones + np.bincount(may_word, lower_more, n_words)
            if i >= BURN:
                self.samples.append((more.astype(np.int32), customers.astype(np.int32), tables.astype(np.int32), of_pair, of_key, of_customers, root))

    def root_customers(self) -> np.ndarray:
        """Tables that the words' restaurants send to the root, by word, on average."""
        return sum(x[-1] for x in self.samples) / SAMPLES

    def average(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each cell, x and y of the averaged probability x + y p(w)."""
        whole = A + np.bincount(self.pair, self.count, len(self.pair_ones))
        x, y, beyond = np.zeros(len(self.count)), np.zeros(len(self.count)), np.zeros(len(self.many))
        for more, customers, tables, of_pair, of_key, of_customers, _ in self.samples:
            below = A + of_customers
            own, rest = (customers - D * tables) / below[self.key], ((A + D * of_key) / below)[self.key]
            back = ((A + D * of_pair) / whole)[self.pair]
            x += back * own[self.lower]
            y += back * rest[self.lower]
            beyond += more
        x += SAMPLES * (self.count - D * self.one) / whole[self.pair]
        x[self.many] -= D * beyond / whole[self.pair[self.many]]
        return x / SAMPLES, y / SAMPLES

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each cell, x and y of the averaged probability x + y p(w | v); of each word's dish, the average of its customers."""
        whole = A + np.bincount(self.pair, self.count, len(self.pair_ones))
        more, customers, of_pair = (sum(x[i] for x in self.samples) / SAMPLES for i in (0, 1, 3))
        x = (self.count - D * self.one) / whole[self.pair]
        x[self.many] -= D * more / whole[self.pair[self.many]]
        return x, ((A + D * of_pair) / whole)[self.pair], customers


def seat_dishes(of: np.ndarray, word: np.ndarray, customers: np.ndarray, root: np.ndarray, ranges: int, seed: int) -> np.ndarray:
    """Average numbers of tables of the dishes of split words in one range of words. root: the root's customers of each word from other words."""
    rng = np.random.default_rng(seed)
    tables, mean = np.ones(len(of), np.int64), np.zeros(len(of))
    known = len(root)
    for i in range(BURN + SAMPLES):
        now = root + np.bincount(word, tables, known)
        # The range's own words stand for those of all ranges.
        p = (now - E * (now > 0) + (B + E * known) / (known + 1)) / (B + now.sum()) / ranges
        of_word = np.bincount(of, tables) * ranges
        tables = seat(customers, of_word[of] - tables, p[word], D, A, rng)
        if i >= BURN:
            mean += tables
    return mean / SAMPLES


class Root:
    """Probabilities of words by their customers. sizes, words: how many words have how many customers."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, draws: int = 32):
        rng = np.random.default_rng(0)
        self.sizes, self.vocabulary = sizes, float(words.sum())
        self.customers = float((sizes * words).sum())
        self.tables = np.ones(len(sizes))
        for _ in range(BURN + SAMPLES):
            total = (self.tables * words).sum()
            others = np.repeat(np.maximum(total - self.tables, 0), draws)
            drawn = seat(np.repeat(sizes, draws), others, np.full(len(others), 1 / (self.vocabulary + 1)), E, B, rng)
            self.tables = drawn.reshape(-1, draws).mean(axis=1)
        self.total = float((self.tables * words).sum())

    def p(self, customers: np.ndarray) -> np.ndarray:
        new = (B + E * self.total) / (self.vocabulary + 1)
        if not len(self.sizes):
            return np.full(len(customers), new / (B + self.customers))
        at = np.minimum(np.searchsorted(self.sizes, customers), len(self.sizes) - 1)
        return (customers - np.where(customers > 0, E * self.tables[at], 0) + new) / (B + self.customers)


def whole_customers(mean: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Averages of tables as whole customers; a word with training tokens has one at least."""
    return np.where(count > 0, np.maximum(np.rint(mean), 1), 0).astype(np.int64)


# Tasks.


def _batch_rows(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)


def _table(rows: list[tuple], names: list[str], types: list) -> pa.Table:
    return pa.Table.from_batches([_batch_rows(rows, names, types)])


def find_heads(base: DataFrame, mod: int, held: int, heads: int) -> tuple[Heads, int, int]:
    """The words with most training tokens of all documents, all training tokens, and training texts. A task that holds too many words hands over what it has counted, and goes on."""

    def scan(batches):
        known, counts, texts_met = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for part in shards(batches, "text", SLICE):
            some = _trains(column(part, "doc_id"), mod, held)
            texts = [t for t, s in zip(column(part, "text"), some) if s]
            if not texts:
                continue
            u, c = np.unique(Slice(texts).hash, return_counts=True)
            known, at = np.unique(np.concatenate((known, u)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, c))).astype(np.int64)
            if len(known) > KEPT:
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(counts)], names=["hash", "n"])
                known, counts = known[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(counts)], names=["hash", "n"])

    counted = materialise(base.mapInArrow(trimmed(scan), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    found = counted.orderBy(F.desc("n"), "hash").limit(heads).toArrow()
    every = counted.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hash") == END - (END >> 63 << 64), F.col("n"))).alias("texts")).first()
    return Heads(found["hash"].to_numpy().astype(np.int64).view(np.uint64).tolist(), found["n"].to_pylist()), int(every.n or 0), int(every.texts or 0)


def packed(base: DataFrame, sent, buckets: int, mod: int, held: int, training_only: bool) -> DataFrame:
    """All tokens: one row for each slice and bucket. With texts that don't train, a row for each slice tells of its texts, in a group of its own; without them, their tokens after split words come all the same."""

    def scan(batches):
        heads, split = sent.value
        log_count = np.log10(heads.counts + 0.5)
        number = TaskContext.get().partitionId() << 32
        for part in shards(batches, "text", SLICE):
            ids, texts = column(part, "doc_id"), column(part, "text")
            trains = _trains(ids, mod, held)
            if training_only and not len(split.keys):
                ids, texts = ([v for v, t in zip(c, trains) if t] for c in (ids, texts))
                trains = trains[trains]
            x = Slice(texts)
            place = heads.find(x.hash)
            key, above = x.contexts(place, split.parts, split.start_parts, ids)
            if training_only:
                some = trains[x.doc]
                rest = np.flatnonzero(~some)
                some[rest] = split.find(key[rest]) >= 0
                some = np.flatnonzero(some)
                order = some[np.argsort(key[some], kind="stable")]
            else:
                order = np.argsort(key, kind="stable")
            key, above, w, rank, d = key[order], above[order], x.hash[order], place[order], x.doc[order]
            d = trains[d].astype(np.uint8) if training_only else (d * 2 + trains[d]).astype(np.uint16 if len(ids) < 32768 else np.uint32)
            code = np.where(rank < 0, HEADS, rank).astype(np.uint16)
            bucket = _range(key, buckets)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets)) if len(key) else [0]
            rows = []
            if not training_only:
                some = place >= 0
                known = np.bincount(x.doc[some], minlength=len(ids)), np.bincount(x.doc[some], log_count[place[some]], len(ids))
                rows.append((-1 - number, number, *map(_pack, (*_texts(ids, x.sizes, mod, held), *known)), None, None))
            for a, b in zip(edges[:-1], edges[1:]):
                starts = np.flatnonzero(np.append(True, key[a + 1 : b] != key[a : b - 1]))
                names, n = key[a:b][starts], np.diff(np.append(starts, b - a))
                far = above[a:b] > HEADS
                rows.append((int(bucket[a]), number, names.tobytes(), *map(_pack, (n.astype(np.uint32), np.minimum(above[a:b], HEADS).astype(np.uint16), above[a:b][far], code[a:b])), w[a:b][rank[a:b] < 0].tobytes(), None if training_only and d[a:b].all() else _pack(d[a:b])))
                if len(rows) == 64:
                    yield _batch_rows(rows, _PACKED, _PACKED_TYPES)
                    rows = []
            yield _batch_rows(rows, _PACKED, _PACKED_TYPES)
            number += 1

    return base.mapInArrow(trimmed(scan), "bucket long, slice long, keys binary, counts binary, above binary, far binary, codes binary, words binary, docs binary")


_PACKED = ["bucket", "slice", "keys", "counts", "above", "far", "codes", "words", "docs"]
_PACKED_TYPES = [pa.int64(), pa.int64(), *[pa.binary()] * 7]


def _texts(ids: list, sizes: np.ndarray, mod: int, held: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a slice's result says of its texts: ids, sizes, and which are null or held out."""
    flags = np.array([(i is None) * 2 + (crc_remainder(i, mod) == held) for i in ids], np.uint8)
    return np.array([i or 0 for i in ids], np.int64), sizes, flags


def _docs(packed: bytes | None, n: int) -> np.ndarray:
    """Of each token, twice its text and whether it trains; without texts, whether it trains."""
    if packed is None:
        return np.ones(n, np.uint32)
    return _unpack(packed, {1: np.uint8, 2: np.uint16, 4: np.uint32}[int.from_bytes(packed[:8], "little") // n]).astype(np.uint32)


class Bucket:
    """The tokens of a bucket, by slice, the seatings of its training tokens, and the cells that it has of split words."""

    def __init__(self, table: pa.Table, heads: Heads, split: Split):
        self.answers = table.filter(pc.is_null(table["codes"])).sort_by("slice")
        table = table.filter(pc.is_valid(table["codes"])).sort_by("slice")
        plain = lambda c: np.frombuffer(b"".join(table[c].to_pylist()), np.uint64)
        get = lambda c, t: [_unpack(x, t) for x in table[c].to_pylist()]
        self.slices = table["slice"].to_pylist()
        above = get("above", np.uint16)
        self.sizes = [len(u) for u in above]
        above = np.concatenate(above).astype(np.int64)
        above[above == HEADS] = np.concatenate(get("far", np.uint32))
        keys, key = np.unique(plain("keys"), return_inverse=True)
        key = np.repeat(key, np.concatenate(get("counts", np.uint32)))
        of = split.find(keys)[key]
        self.head = np.concatenate(get("codes", np.uint16)).astype(np.int32)
        self.head[self.head == HEADS] = -1
        words = np.empty(len(above), np.uint64)
        words[self.head < 0] = plain("words")
        words[self.head >= 0] = heads.hashes[self.head[self.head >= 0]]
        self.names, self.word = np.unique(words, return_inverse=True)
        docs = np.concatenate([_docs(x, n) for x, n in zip(table["docs"].to_pylist(), self.sizes)])
        self.doc, trains = docs >> 1, (docs & 1).astype(bool)
        self.number = int(table["bucket"][0].as_py())
        del words, table, docs
        self.of_word = np.bincount(self.word, trains, len(self.names)).astype(np.int64)
        self.alone, self.split = np.flatnonzero(of < 0), np.flatnonzero(of >= 0)
        # Numbers keep the order of what they stand for, so tokens that don't train leave the samples as they are.
        some = self.alone
        self.chain = Chain(key[some], above[some], self.word[some], trains[some], self.number)
        some = self.split
        pairs, pair = np.unique(of[some] << 32 | above[some], return_inverse=True)
        cells, self.cell = np.unique(pair << 32 | self.word[some], return_inverse=True)
        pair, word = pairs[cells >> 32], cells & 0xFFFFFFFF
        self.cell_of, self.cell_above, self.cell_word = pair >> 32, pair & 0xFFFFFFFF, self.names[word]
        self.cell_count = np.bincount(self.cell, trains[some], len(cells)).astype(np.int64)
        self.cell_group = split.group(self.cell_of, self.cell_above)
        dishes, self.dish = np.unique(self.cell_of << 32 | word, return_inverse=True)
        self.dish_of, self.dish_word = dishes >> 32, self.names[dishes & 0xFFFFFFFF]

    def average(self, ranges: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, x and y of its probability x + y p(w). sums: of split words, customers and tables."""
        x, y = np.empty(len(self.word)), np.empty(len(self.word))
        for out, values in zip((x, y), self.chain.average()):
            out[self.alone] = values[self.chain.cell]
        if len(self.split):
            rows = self.answers.to_pylist()  # in the order of groups and ranges
            told = lambda c: np.concatenate([_unpack(r[c], np.float32) for r in rows if r[c] is not None]).astype(np.float64)
            first, back, own = np.empty(len(self.cell_of)), np.empty(len(self.cell_of)), np.empty(len(self.dish_of))
            order = np.argsort(self.cell_group, kind="stable")
            first[order], back[order] = told("above"), told("docs")
            own[np.argsort(_range(self.dish_word, ranges), kind="stable")] = told("counts")
            customers, tables = sums[self.cell_of].T
            x[self.split] = (first + back * own[self.dish] / (A + customers))[self.cell]
            y[self.split] = (back * (A + D * tables) / (A + customers))[self.cell]
        return x, y


def _by_range(hashes: np.ndarray, buckets: int):
    """The order of hashes by range, and the edges of ranges."""
    order = np.argsort(hashes, kind="stable")
    bucket = _range(hashes[order], buckets)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets)) if len(order) else [0]
    return [(int(bucket[a]), order[a:b]) for a, b in zip(edges[:-1], edges[1:])]


_WORDS = ["range", "group", "bucket", "of", "above", "words", "tables", "counts"]
_WORDS_TYPES = [*[pa.int64()] * 3, *[pa.binary()] * 5]
_WORDS_SCHEMA = ", ".join(f"{c} {'binary' if i > 2 else 'long'}" for i, c in enumerate(_WORDS))
_TEXT = ["ids", "sizes", "flags", "known", "base"]
_PARTS = ["slice", "docs", *_TEXT, "logs"]
_PARTS_TYPES = [pa.int64(), *[pa.binary()] * 7]
_PARTS_SCHEMA = "slice long, docs binary, ids binary, sizes binary, flags binary, known binary, base binary, logs binary"
_MET = ["range", "slice", "docs", *_TEXT, "logs", "words", "x", "y", "tables", "counts"]
_MET_SCHEMA = ", ".join(f"{c} {'binary' if i else 'long'}" for i, c in enumerate(_MET))
_MET_TYPES = [pa.int64(), *[pa.binary()] * 13]


def ask(frame: DataFrame, sent, ranges: int) -> DataFrame:
    """Customers that the root has of each word from words that aren't split, and its training tokens, by range of words. Of split words the cells of
    each bucket, by group of pairs, and the dishes that it wants to know, by range."""

    def tables(table: pa.Table) -> pa.Table:
        x = Bucket(table, *sent.value)
        met = np.flatnonzero(x.of_word)
        mean = np.zeros(len(x.names))
        found = x.chain.root_customers()
        mean[: len(found)] = found
        out = [(at, None, None, None, None, x.names[some].tobytes(), mean[some].tobytes(), x.of_word[some].tobytes()) for at, some in ((at, met[i]) for at, i in _by_range(x.names[met], ranges))]
        order = np.argsort(x.cell_group, kind="stable")
        groups, starts = np.unique(x.cell_group[order], return_index=True)
        for group, some in zip(groups.tolist(), np.split(order, starts[1:])):
            out.append((None, group, x.number, None, _pack(x.cell_above[some].astype(np.uint32)), _pack(x.cell_word[some]), None, _pack(x.cell_count[some])))
        at = _range(x.dish_word, ranges)
        order = np.argsort(at, kind="stable")
        found, starts = np.unique(at[order], return_index=True)
        for at, some in zip(found.tolist(), np.split(order, starts[1:])):
            out.append((at, None, x.number, _pack(x.dish_of[some]), None, _pack(x.dish_word[some]), None, None))
        return _table(out, _WORDS, _WORDS_TYPES)

    return frame.groupBy("bucket").applyInArrow(tables, _WORDS_SCHEMA)


def seat_pairs(cells: DataFrame, sent, ranges: int) -> DataFrame:
    """Seatings of the pairs that end in split words, by the counts of all buckets: each bucket is told x and y of its cells, each range the customers of its dishes."""

    def seated(table: pa.Table) -> pa.Table:
        split = sent.value[1]
        table = table.sort_by("bucket")
        get = lambda c, t: [_unpack(x, t) for x in table[c].to_pylist()]
        group, buckets, counts = table["group"][0].as_py(), table["bucket"].to_pylist(), get("counts", np.int64)
        edges = np.cumsum([0, *map(len, counts)])
        names, word = np.unique(np.concatenate(get("words", np.uint64)), return_inverse=True)
        above = np.concatenate(get("above", np.uint32)).astype(np.int64)
        del table
        chain = Chain(np.zeros(len(word), np.int64), above, word, np.concatenate(counts), group)
        x, y, customers = chain.pairs()
        out = [(None, group, b, None, _pack(x[c].astype(np.float32)), None, None, _pack(y[c].astype(np.float32))) for b, c in zip(buckets, np.split(chain.cell, edges[1:-1]))]
        met = np.flatnonzero(customers)
        of = np.searchsorted(split.first, group, side="right") - 1
        for at, some in _by_range(names[chain.word[met]], ranges):
            out.append((at, None, None, _pack(np.full(len(some), of, np.int64)), None, _pack(names[chain.word[met[some]]]), _pack(customers[met[some]]), None))
        return _table(out, _WORDS, _WORDS_TYPES)

    return cells.groupBy("group").applyInArrow(seated, _WORDS_SCHEMA)


def vocabulary(asked: DataFrame, ranges: int) -> DataFrame:
    """By range of words: customers that the root has of each word, and its training tokens; the tables and customers of split words in the range; and of dishes
    that buckets asked for, customers without the discount."""

    def merged(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own, met, asks = ([r for r in rows if kind == (r["of"] is not None) + (r["bucket"] is not None)] for kind in range(3))
        at = rows[0]["range"]
        plain = lambda c, t: np.frombuffer(b"".join(r[c] for r in own), t)
        get = lambda some, c, t: np.concatenate([np.empty(0, t), *(_unpack(r[c], t) for r in some)])
        names, place = np.unique(plain("words", np.uint64), return_inverse=True)
        count = np.bincount(place, plain("counts", np.int64), len(names)).astype(np.int64)
        # Quarters add up without rounding, in any order.
        mean = np.bincount(place, plain("tables", np.float64), len(names))
        dishes, place = np.unique(get(met, "of", np.int64) << 32 | np.searchsorted(names, get(met, "words", np.uint64)), return_inverse=True)
        customers = np.maximum(np.rint(np.bincount(place, get(met, "tables", np.float64), len(dishes))), 1).astype(np.int64)
        of, word = dishes >> 32, dishes & 0xFFFFFFFF
        tables = seat_dishes(of, word, customers, mean, ranges, at)
        mean += np.bincount(word, tables, len(names))
        out = [(at, None, None, None, None, names.tobytes(), whole_customers(mean, count).tobytes(), count.tobytes())] if len(names) else []
        if len(dishes):
            found, place = np.unique(of, return_inverse=True)
            out.append((at, None, None, _pack(found), None, None, _pack(np.bincount(place, tables)), _pack(np.bincount(place, customers))))
        left = np.append(customers - D * tables, 0)
        for r in asks:
            wanted, hashes = _unpack(r["of"], np.int64), _unpack(r["words"], np.uint64)
            word = np.searchsorted(names, hashes)
            known = np.append(names, np.uint64(0))[word] == hashes
            wanted = wanted << 32 | word
            i = np.searchsorted(dishes, wanted)
            known &= np.append(dishes, -1)[i] == wanted
            out.append((at, None, r["bucket"], None, None, None, None, _pack(left[np.where(known, i, len(dishes))].astype(np.float32))))
        return _table(out, _WORDS, _WORDS_TYPES)

    return asked.groupBy("range").applyInArrow(merged, _WORDS_SCHEMA)


def split_sums(found: DataFrame, n: int) -> np.ndarray:
    """Customers and tables of each split word."""

    def scan(batches):
        for batch in batches:
            for of, tables, customers in zip(*(column(batch, c) for c in ("of", "tables", "counts"))):
                yield pa.RecordBatch.from_arrays([pa.array(_unpack(of, np.int64)), pa.array(_unpack(customers, np.float64)), pa.array(_unpack(tables, np.float64))], names=["of", "customers", "tables"])

    out = np.zeros((n, 2))
    for r in found.mapInArrow(trimmed(scan), "of long, customers double, tables double").groupBy("of").agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables")).collect():
        out[r.of] = r.customers, r.tables
    return out


def make_root(words: DataFrame, heads: Heads) -> tuple[Root, np.ndarray]:
    """The root's probabilities, and its customers of each head. Words are told apart by their customers only, so few rows come to the driver."""
    sent = words.sparkSession.sparkContext.broadcast(heads)

    def scan(batches):
        for batch in batches:
            for names, tables in zip(column(batch, "words"), column(batch, "tables")):
                names, customers = np.frombuffer(names, np.uint64), np.frombuffer(tables, np.int64)
                place = sent.value.find(names)
                some = place >= 0
                sizes, n = np.unique(customers, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(np.full(len(sizes), -1), place[some])), pa.array(np.append(sizes, customers[some])), pa.array(np.append(n, np.ones(some.sum(), np.int64)))], names=["head", "size", "n"])

    found = words.mapInArrow(trimmed(scan), "head long, size long, n long").groupBy("head", "size").agg(F.sum("n").alias("n")).orderBy("head", "size").toArrow()
    head, size, n = (found[c].to_numpy() for c in ("head", "size", "n"))
    customers = np.zeros(len(heads.hashes), np.int64)
    customers[head[head >= 0]] = size[head >= 0]
    return Root(size[head < 0].astype(np.int64), n[head < 0].astype(np.int64)), customers


def score(docs: DataFrame, mod: int = 5, held: int = 1, heads: int = HEADS - 1, buckets: int | None = None) -> DataFrame:
    """For each row of docs(doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    top, train_tokens, texts = find_heads(base, mod, held, heads)
    # By the data alone: the same documents give the same scores however they are dealt out, and a bucket doesn't grow with them.
    buckets = buckets or max(LEAST_BUCKETS, -(-train_tokens // BUCKET_TOKENS))
    ranges = max(16, buckets // 4)
    share = max(train_tokens, 1)
    split = Split(top, np.where(top.hashes == END, 1, -(-top.counts * buckets // share)), -(-texts * buckets // share))
    sent = spark.sparkContext.broadcast((top, split))
    asked = ask(packed(base, sent, buckets, mod, held, True), sent, ranges)
    told = None
    if len(split.keys):
        asked = materialise(asked, "asked", "zstd")
        told = materialise(seat_pairs(asked.filter("group IS NOT NULL"), sent, ranges), "pairs", "zstd")
        asked = asked.filter("group IS NULL").unionByName(told.filter("group IS NULL"))
    found = materialise(vocabulary(asked, ranges), "vocabulary")
    words = found.filter("bucket IS NULL AND of IS NULL")
    split_words = spark.sparkContext.broadcast(split_sums(found.filter("bucket IS NULL AND of IS NOT NULL"), len(split.groups)))
    root, customers = make_root(words, top)
    below = float(np.log10(train_tokens + 0.5 * (root.vocabulary + 1)))
    sent_root = spark.sparkContext.broadcast((root, root.p(customers)))

    def sums(sizes, doc, *values):
        """Of runs of tokens: number, texts met, sums of values by text."""
        at = 0
        for i, size in enumerate(sizes):
            if size:
                part = slice(at, at + size)
                met, place = np.unique(doc[part], return_inverse=True)
                yield i, met.astype(np.uint32), tuple(np.bincount(place, v[part], len(met)) for v in values)
            at += size

    def parts_of_bucket(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        if first["bucket"] < 0:  # a slice's texts go on as they are
            return _table([(first["bucket"], np.array([first["slice"]]).tobytes(), None, *[first[c] for c in _PACKED[2:7]], *[None] * 6)], _MET, _MET_TYPES)
        x = Bucket(table, *sent.value)
        p = sent_root.value[1]
        first_part, second = x.average(ranges, split_words.value)
        number = np.repeat(np.arange(len(x.slices)), x.sizes)
        some = x.head >= 0
        h = x.head[some]
        names = np.array(x.slices, np.int64)
        logs = np.log10(first_part[some] + second[some] * p[h]) if len(h) else np.zeros(0)
        out = [(-1 - int(names[i]), np.array([names[i]]).tobytes(), _pack(met), *[None] * 5, _pack(total), *[None] * 5) for i, met, (total,) in sums(np.bincount(number[some], minlength=len(names)), x.doc[some], logs)]
        rare = np.flatnonzero(~some)
        for at, chosen in _by_range(x.names[x.word[rare]], ranges):
            chosen = np.sort(rare[chosen])  # by slice
            met, n = np.unique(number[chosen], return_counts=True)
            out.append((at, _pack(np.concatenate((names[met], n))), _pack(x.doc[chosen]), *[None] * 6, x.names[x.word[chosen]].tobytes(), *(_pack(v[chosen].astype(np.float32)) for v in (first_part, second)), None, None))
        return _table(out, _MET, _MET_TYPES)

    def parts_of_words(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        if rows[0]["range"] < 0:  # a slice's heads
            own = next(r for r in rows if r["docs"] is None)
            logs = np.zeros(len(_unpack(own["sizes"], np.int64)))
            for docs, values in sorted((r["docs"], r["logs"]) for r in rows if r["docs"] is not None):  # in one order whatever the order of rows
                logs[_unpack(docs, np.uint32)] += _unpack(values, np.float64)
            return _table([(int(np.frombuffer(own["slice"], np.int64)[0]), None, *[own[c] for c in _TEXT], _pack(logs))], _PARTS, _PARTS_TYPES)
        own = next((r for r in rows if r["tables"] is not None), None)
        names, tables, counts = (np.frombuffer(own[c] if own else b"", t) for c, t in (("words", np.uint64), ("tables", np.int64), ("counts", np.int64)))
        p = np.append(sent_root.value[0].p(tables), sent_root.value[0].p(np.zeros(1)))
        counts = np.append(counts, 0)
        parts = []  # of each bucket: slices and their sizes, texts, what is known of the words
        for r in rows:
            if r["tables"] is not None:
                continue
            met = np.frombuffer(r["words"], np.uint64)
            at = np.searchsorted(names, met)
            at = np.where(np.append(names, np.uint64(0))[at] == met, at, len(names))
            where, sizes = _unpack(r["slice"], np.int64).reshape(2, -1)
            logs = np.log10(_unpack(r["x"], np.float32).astype(np.float64) + _unpack(r["y"], np.float32).astype(np.float64) * p[at])
            parts.append((np.repeat(where, sizes), _unpack(r["docs"], np.uint32), counts[at], logs))
        if parts:
            where, docs, n, logs = (np.concatenate(c) for c in zip(*parts))
            del parts
            order = np.lexsort((logs, docs, where))  # sums in one order whatever the order of rows
            where, sizes = np.unique(where, return_counts=True)
            n = n[order]
            for i, met, (known, bases, total) in sums(sizes, docs[order], n > 0, np.log10(n + 0.5), logs[order]):
                out.append((int(where[i]), _pack(met), None, None, None, _pack(known.astype(np.int64)), _pack(bases), _pack(total)))
        return _table(out, _PARTS, _PARTS_TYPES)

    final = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def joined(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["docs"] is None)
        ids, tokens, flags, known, bases, logs = (_unpack(own[c], t).copy() for c, t in zip((*_TEXT, "logs"), (np.int64, np.int64, np.uint8, np.int64, np.float64, np.float64)))
        for r in sorted((r for r in rows if r["docs"] is not None), key=lambda r: (r["docs"], r["logs"])):
            at = _unpack(r["docs"], np.uint32)
            known[at] += _unpack(r["known"], np.int64)
            bases[at] += _unpack(r["base"], np.float64)
            logs[at] += _unpack(r["logs"], np.float64)
        return pa.table([pa.array(ids, mask=flags >= 2), pa.array(flags % 2 == 1), pa.array(tokens), pa.array(known), pa.array(np.full(len(tokens), train_tokens)), pa.array(bases - tokens * below), pa.array(logs)], schema=final)

    empty = F.lit(None).cast("binary")
    tokens = packed(base, sent, buckets, mod, held, False)
    if told is not None:
        answers = told.filter("group IS NOT NULL").select("bucket", F.col("group").alias("slice"), "above", F.col("counts").alias("docs"))
        dishes = found.filter("bucket IS NOT NULL").select("bucket", F.col("range").alias("slice"), "counts")
        for some in (answers, dishes):
            tokens = tokens.unionByName(some.select(*(F.col(c) if c in some.columns else empty.alias(c) for c in _PACKED)))
    scored = tokens.groupBy("bucket").applyInArrow(parts_of_bucket, _MET_SCHEMA)
    known = words.select("range", *[empty.alias(c) for c in _MET[1:9]], "words", empty.alias("x"), empty.alias("y"), "tables", "counts")
    return scored.unionByName(known).groupBy("range").applyInArrow(parts_of_words, _PARTS_SCHEMA).groupBy("slice").applyInArrow(joined, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
