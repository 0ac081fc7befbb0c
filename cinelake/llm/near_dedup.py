"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

Signature: CHUNKS chunks of WIDTH minima over a document's shingles, BITS bits of each; a chunk fills one long. The
distance of two signatures is the number of places in which they differ. By the pigeonhole principle two signatures
within CHUNKS * (ERRORS + 1) - 1 = 19 places have a chunk with at most ERRORS = 1 wrong place. So each chunk emits one
key for each place left out; signatures within the threshold share a key for certain, and pairs further apart often
do. At similarity 0.8 a pair without any common key has probability below 2e-6.

1. Documents with equal shingle sets form a class, named by its smallest doc_id; only classes go on.
2. The pivot of a key is the class that meets most others. Each class is paired with the best pivot of its keys: one
   pair for each class, never all pairs of a group. Pairs are confirmed on full shingle sets, and confirmed links give
   components. Texts are dealt out once, and only classes that share a key have their sets written.
3. Keys that still hold several components compare members of different components, in tiles of at most TILE classes. A
   pair leaves the join only under the first key it has in common and if its signatures are close; a long sketch of
   FINE_PLACES minima, 2 bits of each, rules most of the distant pairs out (one at similarity 0.8 with probability below
   1e-5), and what is left is confirmed as well.

Defined results: a null or wordless text has no shingles and no links; a text of fewer words than a shingle is one
shingle; a very long text is read whole, in a slice of its own; a row with a null doc_id takes no part in linking
(component_id null, kept true); rows that repeat a doc_id are each answered and, for linking, count as one document, which is
linked by every text it has; where classes tie for pivot the smaller id is taken, and no tie changes a component, for its name is its
smallest doc_id; columns besides doc_id and text are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import column, input_partitions, materialise, slices, trimmed

CHUNKS, WIDTH, BITS, ERRORS = 10, 5, 11, 1
LANE = BITS + 1  # a spare bit for each place takes the carry
PERMUTATIONS = CHUNKS * WIDTH
#: Signatures further apart are not confirmed: 23 of 50 places differ at similarity 0.8 with probability below 1e-5.
FAR = 23
FINE_PLACES, FINE_FAR = 1024, 205
FINE_LONGS = FINE_PLACES // 32
SLICE = 4 << 20
SKETCHED = 256  # sets sketched at once
TILE = 1000

_rng = np.random.default_rng(20240917)
_MULTIPLY = _rng.integers(0, 2**64, FINE_PLACES, dtype=np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 2**64, FINE_PLACES, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_SIGNS = [f"s{i}" for i in range(CHUNKS)]
_FINE = [f"f{i}" for i in range(FINE_LONGS)]
_FIELDS = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("same", pa.binary()), *((s, pa.int64()) for s in _SIGNS)]
_SCHEMA = "doc_id long, n_shingles long, same binary, " + ", ".join(f"{s} long" for s in _SIGNS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    split = [] if text is None else text.encode("utf-8", "replace").lower().split()
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * _A + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], places: int = PERMUTATIONS, bits: int = BITS) -> np.ndarray:
    """For each non-empty set so many numbers of so many bits."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    flat = np.concatenate(sets)
    out = np.empty((len(sets), places), np.int64)
    for k in range(places):
        least = np.minimum.reduceat((flat ^ _XOR[k]) * _MULTIPLY[k], starts)
        out[:, k] = (_mix(least) >> np.uint64(64 - bits)).astype(np.int64)
    return out


def _pack(signs: np.ndarray, lanes: int, width: int) -> np.ndarray:
    """Places side by side in longs."""
    parts = signs.astype(np.uint64).reshape(len(signs), -1, lanes) << (np.arange(lanes, dtype=np.uint64) * np.uint64(width))
    return np.bitwise_or.reduce(parts, axis=2).view(np.int64)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = [shingles(t, size) for t in column(part, "text")]
                full = [i for i, s in enumerate(sets) if len(s)]
                packed = np.zeros((len(sets), CHUNKS), np.int64)
                if full:
                    packed[full] = _pack(signatures([sets[i] for i in full]), WIDTH, LANE)
                same = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                data = [part.column(part.schema.get_field_index("doc_id")), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), *(pa.array(packed[:, i]) for i in range(CHUNKS))]
                yield pa.RecordBatch.from_arrays(data, schema=pa.schema(_FIELDS))

    return docs.mapInArrow(trimmed(scan), _SCHEMA)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """docs(doc_id, text, pivot) with full shingle sets in place of texts."""
    schema = pa.schema([("id", pa.int64()), ("pivot", pa.int64()), ("set", pa.list_(pa.int64()))])

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = [shingles(t, size).view(np.int64) for t in column(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in ("doc_id", "pivot")] + [pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(trimmed(scan), "id long, pivot long, set array<long>")


def _fine(sets: DataFrame) -> DataFrame:
    """Long sketches of sets(id, set)."""
    schema = pa.schema([("id", pa.int64()), *((f, pa.int64()) for f in _FINE)])

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SKETCHED):
                part = batch.slice(at, SKETCHED)
                held = part.column(part.schema.get_field_index("set"))
                packed = _pack(signatures([x.values.to_numpy().view(np.uint64) for x in held], FINE_PLACES, 2), 32, 2)
                ids = part.column(part.schema.get_field_index("id"))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(packed[:, i])) for i in range(FINE_LONGS))], schema=schema)

    return sets.mapInArrow(trimmed(scan), "id long, " + ", ".join(f"{f} long" for f in _FINE))


def _keys() -> Column:
    """Of a class: the keys of each chunk with each place left out."""

    def place(c: int, p: int):
        return F.shiftrightunsigned(F.col(f"s{c}"), LANE * p).bitwiseAND(F.lit((1 << BITS) - 1))

    keys = []
    for c in range(CHUNKS):
        for out in range(WIDTH):
            key = F.lit(c * WIDTH + out).cast("long")
            for p in range(WIDTH):
                if p != out:
                    key = F.shiftleft(key, BITS).bitwiseOR(place(c, p))
            keys.append(key)
    return F.explode(F.array(*keys))


def _wrong(chunk: int) -> Column:
    """Places of a chunk in which the signatures of l and r differ: a carry for each lane that is not zero."""
    ones = sum(((1 << BITS) - 1) << (LANE * p) for p in range(WIDTH))
    tops = sum(1 << (LANE * p + BITS) for p in range(WIDTH))
    x = F.col(f"l.s{chunk}").bitwiseXOR(F.col(f"r.s{chunk}"))
    return F.bit_count((x + F.lit(ones)).bitwiseAND(F.lit(tops)))


def _close(percent: int) -> Column:
    """Whether sizes and signatures of l and r allow the similarity."""
    distance = sum((_wrong(c) for c in range(1, CHUNKS)), _wrong(0))
    return (F.least("l.n", "r.n") * 100 >= percent * F.greatest("l.n", "r.n")) & (distance <= FAR)


def _first_key(key: Column) -> Column:
    """Whether this key is the first that l and r have in common: so a pair leaves a join once."""
    chain = F
    for c in range(CHUNKS):
        chain = chain.when(_wrong(c) <= ERRORS, F.struct(F.lit(c).alias("c"), _wrong(c).alias("wrong")))
    place = F.shiftrightunsigned(key, BITS * (WIDTH - 1))
    return (chain["c"] == F.floor(place / WIDTH)) & ((chain["wrong"] == 1) | (place % WIDTH == 0))


def _fine_close() -> Column:
    low = F.lit(0x5555555555555555)
    total = None
    for f in _FINE:
        x = F.col(f"l.{f}").bitwiseXOR(F.col(f"r.{f}"))
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
        total = n if total is None else total + n
    return total <= FINE_FAR


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges(a, b); component: the smallest node reachable.

    Alternating large-star and small-star steps; each round is written to the shared folder."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", share=8)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialise(small, "edges", share=8)
        stars = after.groupBy("u").count().where("count > 1").limit(1).count() == 0 and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0
        edges = after
        if stars:
            break
    else:
        raise RuntimeError("components did not settle")
    # Stars are written already; what is returned reads them.
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def link(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """For each row of docs(doc_id, text): n_shingles, component_id, kept."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(_signed(base, size), "signed")
    full = signed.where("same IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialise(full.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), *(F.first(s).alias(s) for s in _SIGNS)), "classes", share=4)
    placed = full.select("doc_id", "n_shingles", "same").join(classes.select("same", "id"), "same").select("doc_id", "n_shingles", "id")
    placed = materialise(placed.unionByName(signed.where("same IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("id"))), "placed", share=4)

    members = _members(classes)
    stars = _stars(members, classes, percent)
    sets = materialise(_sets(_texts(base, members, stars), size), "sets", share=2)
    links = materialise(_similar(stars, sets, percent).unionByName(_shared_ids(placed)), "links", share=8)
    found = components(links)

    cross = materialise(_cross(members, classes, sets, found, percent), "cross", share=8)
    if cross.limit(1).count():
        held = _named(sets, cross).select("id", "set")
        x, y = held.select(F.col("id").alias("a"), F.col("set").alias("x")), held.select(F.col("id").alias("b"), F.col("set").alias("y"))
        more = materialise(cross.join(x, "a").join(y, "b").where(_alike(percent)).select("a", "b"), "more", share=8)
        if more.limit(1).count():
            found = components(links.unionByName(more))
    out = placed.join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _members(classes: DataFrame) -> DataFrame:
    """(id, key, met) of keys that several classes have; met: how many."""
    # Fifty keys a class, nearly all of them different: small partitions keep the maps of partial sums small.
    keyed = classes.repartition(max(12, input_partitions(classes.sparkSession)), "id").select("id", _keys().alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("met")).where("first <> last")
    return materialise(keyed.join(shared.select("key", "met"), "key").select("id", "key", "met"), "members", share=4)


def _stars(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """One pair (a, b) at most for each class b: with the best pivot of its keys, if their signatures allow it."""
    met = members.groupBy("id").agg(F.sum("met").alias("met"))
    ranked = members.select("id", "key").join(met, "id")
    pivots = ranked.groupBy("key").agg(F.min(F.struct((-F.col("met")).alias("rank"), F.col("id").alias("pivot"))).alias("p"))
    best = members.select("id", "key").join(pivots, "key").where("id <> p.pivot").groupBy("id").agg(F.min("p").alias("p")).select(F.col("p.pivot").alias("a"), F.col("id").alias("b"))
    sized = classes.select("id", F.struct("n", *_SIGNS).alias("s"))
    near = best.join(sized.select(F.col("id").alias("b"), F.col("s").alias("r")), "b").join(sized.select(F.col("id").alias("a"), F.col("s").alias("l")), "a")
    return materialise(near.where(_close(percent)).select("a", "b").distinct(), "stars", share=8)


def _texts(base: DataFrame, members: DataFrame, stars: DataFrame) -> DataFrame:
    """Texts of all classes that share a key, with the pivot of each: the one time that texts are dealt out, at every size."""
    ids = members.select("id").distinct().join(stars.select(F.col("b").alias("id"), F.col("a").alias("pivot")), "id", "left")
    return base.join(ids.withColumnRenamed("id", "doc_id").hint("shuffle_hash"), "doc_id").select("doc_id", "text", "pivot")


def _alike(percent: int) -> Column:
    both = F.size(F.array_intersect("x", "y"))
    return 100 * both >= percent * (F.size("x") + F.size("y") - both)


def _similar(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stars' pairs whose full sets are similar enough. A pivot's set is laid out for every TILE of its pairs."""
    tiles = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    hubs = sets.select(F.col("id").alias("a"), F.col("set").alias("x")).join(tiles, "a").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    points = sets.where("pivot IS NOT NULL").select(F.col("pivot").alias("a"), F.col("id").alias("b"), F.col("set").alias("y")).join(tiles, "a")
    points = points.withColumn("tile", F.pmod(F.xxhash64("b"), F.col("tiles")).cast("int")).drop("tiles")
    return points.join(hubs.drop("tiles"), ["a", "tile"]).where(_alike(percent)).select("a", "b")


def _shared_ids(placed: DataFrame) -> DataFrame:
    """Links by ids that several different texts have."""
    some = placed.where("id IS NOT NULL").select("doc_id", "id")
    several = some.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("doc_id")
    return some.join(several, "doc_id", "left_semi").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))


def _cross(members: DataFrame, classes: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that share a key and whose signatures and sketches are close; each pair once.

    Keys of more than TILE classes are cut into tiles: each class meets every tile, in a group of its own."""
    known = members.select("id", "key").join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).where("lo <> hi").select("key", "tiles")
    slim = materialise(known.join(mixed, "key").select("key", "tiles", "id", "component"), "mixed", share=8)
    wanted = sets.join(slim.select("id").distinct(), "id", "left_semi").select("id", "set")
    wide = materialise(classes.select("id", "n", *_SIGNS).join(_fine(wanted), "id"), "sketches", share=8)
    rest = slim.join(wide, "id").select("key", "tiles", F.struct("id", "component", "n", *_SIGNS, *_FINE).alias("l"))
    left = rest.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    right = rest.select("key", F.pmod(F.xxhash64("l.id"), F.col("tiles")).cast("int").alias("tile"), F.col("l").alias("r"))
    near = left.join(right, ["key", "tile"]).where((F.col("l.component") < F.col("r.component")) & _close(percent) & _fine_close() & _first_key(F.col("key")))
    return near.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def _named(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of documents that pairs name."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return sets.join(ids, "id", "left_semi")
