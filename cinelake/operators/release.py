"""Identity of builds: content digests, patches, guards, and routes between builds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinelake.operators.relational import apply_diff, diff, lost_but_alive

DIGEST_VERSION = 1


def tagged(df: DataFrame, name: str) -> Column:
    """A value with its type before it, so that 1, '1', 1.0 and null differ."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        text = F.concat(F.lit("i"), c.cast("long").cast("string"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.concat(F.lit("f"), c.cast("double").cast("string"))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("b"), F.hex(c))
    else:
        text = F.concat(F.lit("t"), c.cast("string"))
    return F.coalesce(text, F.lit("n"))


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.sha2(F.concat(*(x for c in columns for x in (tagged(df, c), F.lit("\x1f")))), 256)


LEAF = 100_000  # hashes of a leaf


def table_digest(df: DataFrame, columns: Sequence[str], leaf: int = LEAF) -> DataFrame:
    """One digest of a table's rows in whatever order they come: (digest, rows).

    A tree over the rows' hashes: leaves are the hashes that begin with the same hex digits, sorted and hashed again; each node above holds the 256
    that share two digits less. The tree is so deep that leaves have about leaf hashes, so no task sees more, however large the table."""
    hashed = df.select(row_digest(df, columns).alias("h"))
    # Equal hashes are counted first, so repeated rows cost one entry.
    counted = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    depth, held = 2, df.count()
    while held > leaf * 16**depth:
        depth += 2
    level = counted.groupBy(F.substring("h", 1, depth).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("x", "h", F.col("n").cast("string")))), "\x1e"), 256).alias("d"), F.sum("n").alias("rows"))
    whole = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: F.concat_ws(":", x["b"], x["d"])), "\x1e"), 256)
    while depth > 2:
        depth -= 2
        level = level.groupBy(F.substring("b", 1, depth).alias("p")).agg(whole.alias("d"), F.sum("rows").alias("rows")).withColumnRenamed("p", "b")
    return level.agg(whole.alias("digest"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def ordered_digest(df: DataFrame, columns: Sequence[str]) -> str:
    """The digest of rows folded in their total order, one after the other, as a small table needs it to compare with other engines."""
    fold = hashlib.sha256()
    for row in df.select(*columns).orderBy(*columns).toLocalIterator():
        for c in columns:
            fold.update(_go_value(row[c]))
            fold.update(b"\x1f")
        fold.update(b"\x1e")
    return fold.hexdigest()


def _go_value(v: object) -> bytes:
    if v is None:
        return b"n"
    if isinstance(v, (bool, int)):
        return b"i%d" % int(v)
    if isinstance(v, float):
        return b"f" + short_float(v).encode()
    if isinstance(v, (bytes, bytearray)):
        return b"b" + bytes(v)
    return b"t" + str(v).encode()


def short_float(v: float) -> str:
    """The shortest text that reads back as v: plain from 1e-4 up to 1e21, else with an exponent of at least two digits."""
    if v != v:
        return "NaN"
    if v in (float("inf"), float("-inf")):
        return "+Inf" if v > 0 else "-Inf"
    if not v:
        return "-0" if str(v)[0] == "-" else "0"
    text = next(s for s in (f"{v:.{p}e}" for p in range(18)) if float(s) == v)
    mantissa, _, power = text.partition("e")
    if not -4 <= int(power) < 21:
        return f"{mantissa}e{power[0]}{int(power[1:]):02d}"
    return format(Decimal(text), "f")


def build_digest(tables: Mapping[str, str], version: int = DIGEST_VERSION) -> str:
    """The digest of a whole build from those of its tables."""
    text = f"content-hash v{version}\n" + "".join(f"{n} {tables[n]}\n" for n in sorted(tables))
    return hashlib.sha256(text.encode()).hexdigest()


def digests(tables: Mapping[str, DataFrame], specs: Mapping[str, Sequence[str]], skip: Iterable[str] = ("person_alias", "meta")) -> tuple[str, dict[str, str]]:
    """(whole, by table); a table without a list of canonical columns is an error."""
    out = {}
    for name, df in tables.items():
        if name in skip or name.endswith("_fts"):
            continue
        if name not in specs:
            raise KeyError(f"table {name} has no canonical columns")
        out[name] = table_digest(df, specs[name]).first()["digest"]
    return build_digest(out), out


def patch(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    return diff(before, after, keys)


def verify_patch(before: DataFrame, changes: DataFrame, after: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the patch, applied to a copy, gives the table that it was made for."""
    columns = before.columns
    made = table_digest(apply_diff(before, changes, keys), columns).first()
    return made == table_digest(after.select(*columns), columns).first()


def apply_chain(table: DataFrame, patches: Sequence[DataFrame], keys: Sequence[str], expected: str | None = None) -> DataFrame:
    """Patches in order; a long chain is cut by a checkpoint after each ten."""
    for i, p in enumerate(patches):
        table = apply_diff(table, p, keys)
        if i % 10 == 9 and table.sparkSession.sparkContext.getCheckpointDir():
            table = table.checkpoint()
    if expected is not None and table_digest(table, table.columns).first()["digest"] != expected:
        raise ValueError("the patched table has another digest")
    return table


def guard_removals(tip: DataFrame, new: DataFrame, alive: DataFrame, key: str) -> None:
    """Refuses a build that drops rows whose page still exists; any number may be added."""
    lost = [r[0] for r in lost_but_alive(tip, new, alive, key).limit(20).collect()]
    if lost:
        raise ValueError(f"rows are gone whose pages are alive: {lost}")


def guard_through(new: str, tip: str) -> None:
    if new < tip:
        raise ValueError(f"the build covers the time up to {new}, the tip up to {tip}")


# Catalogs are a few hundred entries: plain Python on the driver.


@dataclass(frozen=True)
class Edge:
    source: str
    suffix: str = ""
    size: int = 0


@dataclass
class Build:
    id: str
    kind: str  # full or daily
    through: str = ""
    parent: str = ""
    bridge_from: str = ""
    epoch: int = 0
    size: int = 0
    edges: list[Edge] = field(default_factory=list)

    def routes(self) -> list[Edge]:
        """Patches that lead here; an old entry names only its parent, or where it bridges from."""
        if self.edges:
            return self.edges
        before = self.bridge_from if self.kind == "full" else self.parent
        return [Edge(before)] if before else []


def ordered(builds: Iterable[Build]) -> list[Build]:
    return sorted(builds, key=lambda b: (b.through, b.id))


def nth_back(builds: Iterable[Build], n: int) -> str:
    """The build so many places before the tip; '' where the catalog is shorter. Places count, not days, for days may be skipped."""
    chain = ordered(builds)
    return chain[-1 - n].id if 0 <= n < len(chain) else ""


def newer(a: Build, b: Build) -> bool:
    return (a.through, a.id) > (b.through, b.id)


def cheapest(builds: Sequence[Build], held: str, target: str) -> tuple[str, list[tuple[str, str]], int] | None:
    """The way with the fewest bytes: (full build to start from or '', [(build, suffix)], bytes); None if there is none.

    A way starts at what is held or at any full build, follows patches forward, and stays within the target's epoch."""
    by_id = {b.id: b for b in builds}
    if target not in by_id:
        return None
    era = by_id[target].epoch
    best: dict[str, tuple[int, str, tuple[str, str] | None]] = {}  # id -> bytes, seed, (from, suffix)
    if held in by_id and by_id[held].epoch == era:
        best[held] = (0, "", None)
    for b in builds:
        if b.kind == "full" and b.size > 0 and b.epoch == era and (b.id not in best or b.size < best[b.id][0]):
            best[b.id] = (b.size, b.id, None)
    for b in ordered(x for x in builds if x.epoch == era):
        for e in b.routes():
            if e.source in best and (b.id not in best or best[e.source][0] + e.size < best[b.id][0]):
                best[b.id] = (best[e.source][0] + e.size, "", (e.source, e.suffix))
    if target not in best:
        return None
    steps, at = [], target
    while best[at][2] is not None:
        source, suffix = best[at][2]
        steps.append((at, suffix))
        at = source
    return best[at][1], steps[::-1], best[target][0]


def why_no_chain(builds: Sequence[Build], held: str, target: str) -> str:
    by_id = {b.id: b for b in builds}
    if not held:
        return "nothing is held to patch from"
    at = target
    while at != held:
        if at not in by_id:
            return f"the catalog has no entry {at}"
        b = by_id[at]
        before, what = (b.bridge_from, "bridge_from") if b.kind == "full" else (b.parent, "parent")
        if not before:
            return f"{at} names no {what}, so the chain stops there"
        at = before
    return "the chain is unbroken"
