"""Releases in a folder: full builds, daily patches, a catalog, and a consumer that rides them to the tip.

Tables are parquet; a patch is a table of record differences. A build is never changed once its entry stands in the catalog, and the
catalog, written last, is what makes it visible. A consumer's state file is its commit point."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from cinelake.operators import release
from cinelake.operators.relational import apply_diff
from cinelake.sources import files

# The keys that records of a table are told apart by.
KEYS = {
    "credits": ("person_id", "work_id", "work_type", "role"),
    "person_alias": ("wiki",),
    "franchise_members": ("franchise_id", "id", "kind"),
    "sequels": ("id", "kind", "next_id"),
    "external_ids": ("id", "kind", "source", "value"),
}
GUARDED = ("movies", "television_series", "events")


def keys_of(table: str) -> tuple[str, ...]:
    return KEYS.get(table, ("id",))


class Releases:
    def __init__(self, spark: SparkSession, folder: str, specs: Mapping[str, Sequence[str]]):
        self.spark, self.folder, self.specs = spark, folder.rstrip("/"), specs

    # Small files

    def _read(self, name: str) -> dict:
        path = f"{self.folder}/{name}"
        return json.loads(files.read_text(self.spark, path)) if files.exists(self.spark, path) else {}

    def _write(self, name: str, value: dict) -> None:
        files.write_text(self.spark, f"{self.folder}/{name}", json.dumps(value, indent=1, sort_keys=True))

    def catalog(self) -> list[release.Build]:
        return [release.Build(**(b | {"edges": [release.Edge(**e) for e in b["edges"]]})) for b in self._read("catalog.json").get("builds", [])]

    def _publish(self, build: release.Build, whole: str, tables: dict[str, str]) -> None:
        root = f"{self.folder}/{build.id}"
        held = [{"name": r.path.partition(f"/{build.id}/")[2], "bytes": r.bytes, "sha256": r.sha256} for r in files.checksums(self.spark, root).collect()]
        named = sorted((f for f in held if f["name"].endswith(".parquet")), key=lambda f: f["name"])
        self._write(f"{build.id}/manifest.json", {"content_hash_version": release.DIGEST_VERSION, "content_hash": whole, "tables": tables, "bytes": build.size, "files": named})
        self._write("catalog.json", {"builds": [asdict(b) for b in release.ordered([*self.catalog(), build])]})

    def tip(self) -> release.Build | None:
        return max(self.catalog(), key=lambda b: (b.through, b.id), default=None)

    # Publishing

    def publish_full(self, id_: str, through: str, tables: Mapping[str, DataFrame], epoch: int = 0, alive: DataFrame | None = None) -> release.Build:
        """A complete build. Within an epoch it bridges from the tip: its patch is verified, and rows of living pages may not go."""
        tip = self.tip()
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{id_}/full/{name}.parquet")
        held = {n: self.spark.read.parquet(f"{self.folder}/{id_}/full/{n}.parquet") for n in tables}
        bridge, edges = "", []
        if tip is not None and tip.epoch == epoch:
            release.guard_through(through, tip.through)
            before = self.tables_of(tip.id)
            for name in GUARDED:
                if alive is not None and name in before and name in held:
                    release.guard_removals(before[name], held[name], alive, "id")
            bridge, edges = tip.id, [self._patch(id_, tip.id, before, held)]
        whole, by_table = release.digests(held, self.specs)
        build = release.Build(id_, "full", through, bridge_from=bridge, epoch=epoch, size=files.size(self.spark, f"{self.folder}/{id_}/full"), edges=edges)
        self._publish(build, whole, by_table)
        return build

    def publish_daily(self, id_: str, through: str, tables: Mapping[str, DataFrame], rollups: Sequence[str] = ()) -> release.Build:
        """A patch from the tip, and further ones from older builds that returning consumers may hold."""
        tip = self.tip()
        if tip is None:
            raise ValueError("publish a full build first")
        release.guard_through(through, tip.through)
        edges = [self._patch(id_, base, self.tables_of(base), tables) for base in dict.fromkeys([tip.id, *rollups])]
        whole, by_table = release.digests(tables, self.specs)
        build = release.Build(id_, "daily", through, parent=tip.id, epoch=tip.epoch, edges=edges)
        self._publish(build, whole, by_table)
        return build

    def _patch(self, id_: str, base: str, before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]) -> release.Edge:
        """Writes the differences of every table and applies them to a copy: they must give what they were made for."""
        for name, new in after.items():
            old = before[name] if name in before else new.limit(0)
            path = f"{self.folder}/{id_}/from-{base}/{name}.parquet"
            release.patch(old, new.select(*old.columns), keys_of(name)).write.parquet(path)
            if not release.verify_patch(old, self.spark.read.parquet(path), new, keys_of(name)):
                raise ValueError(f"the patch of {name} doesn't give the table it was made for")
        return release.Edge(base, f"from-{base}", files.size(self.spark, f"{self.folder}/{id_}/from-{base}"))

    # Reading

    def tables_of(self, id_: str, held: str = "", held_tables: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """The tables of a build, along the cheapest route from what is held or from a full build."""
        builds = self.catalog()
        route = release.cheapest(builds, held, id_)
        if route is None:
            raise ValueError(f"no route to {id_}: {release.why_no_chain(builds, held, id_)}")
        seed, steps, _ = route
        if seed:
            found = files.list_tables(self.spark, f"{self.folder}/{seed}/full")
            tables = {n: self.spark.read.parquet(p) for n, p in found.items()}
        else:
            tables = dict(held_tables or {})
        for build, suffix in steps:
            for name, path in files.list_tables(self.spark, f"{self.folder}/{build}/{suffix}").items():
                changes = self.spark.read.parquet(path)
                if name not in tables:
                    columns = [*keys_of(name), *(c.removeprefix("new_") for c in changes.columns if c.startswith("new_"))]
                    tables[name] = changes.limit(0).selectExpr(*(c if c in changes.columns else f"new_{c} AS {c}" for c in columns))
                tables[name] = apply_diff(tables[name], changes, keys_of(name))
        return tables

    def update(self, consumer: str, target: str = "") -> str:
        """Brings a consumer's folder to a build (the tip); the digest is checked before its state names it."""
        state_path = f"{consumer.rstrip('/')}/state.json"
        state = json.loads(files.read_text(self.spark, state_path)) if files.exists(self.spark, state_path) else {}
        goal = target or (self.tip().id if self.tip() else "")
        held = state.get("current", "")
        if not goal or goal == held and state.get("content_hash") == self._read(f"{goal}/manifest.json").get("content_hash"):
            return held
        if held and state.get("content_hash") != self._read(f"{held}/manifest.json").get("content_hash"):
            held = ""  # the build that is held was rewritten: start from a full one
        own = {n: self.spark.read.parquet(p) for n, p in files.list_tables(self.spark, f"{consumer}/{held}").items()} if held else {}
        for name, df in self.tables_of(goal, held, own).items():
            df.write.mode("overwrite").parquet(f"{consumer}/{goal}/{name}.parquet")
        made = {n: self.spark.read.parquet(p) for n, p in files.list_tables(self.spark, f"{consumer}/{goal}").items()}
        whole, _ = release.digests(made, self.specs)
        if whole != self._read(f"{goal}/manifest.json")["content_hash"]:
            raise ValueError(f"{goal} came out with another digest; {held or 'nothing'} stays current")
        files.write_text(self.spark, state_path, json.dumps({"current": goal, "content_hash": whole}))
        return goal
