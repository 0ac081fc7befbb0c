"""Incremental upkeep: a day's pages replace what they claimed before, and nothing else changes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.sources import files

RETENTION_DAYS = 42


def replace(held: DataFrame, touched: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """Rows of untouched pages, and the new claims of touched ones. Applying it twice changes nothing."""
    return held.join(touched.select(key).distinct(), key, "left_anti").unionByName(claims)


def known_pages(held: DataFrame, pages: DataFrame, claims: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Of a day's pages those that matter: held before, or claiming something now; with their claims."""
    matter = held.select(key).unionByName(claims.select(key)).distinct()
    return pages.join(matter, key, "left_semi"), claims


def day_of(name: str) -> str | None:
    """The day (YYYYMMDD) in the name of a change file."""
    m = re.search(r"(?<!\d)(\d{8})(?!\d)", name)
    return m[1] if m else None


def next_day(day: str) -> str:
    return (datetime.strptime(day, "%Y%m%d") + timedelta(days=1)).strftime("%Y%m%d")


class Store:
    """Versioned tables in a folder. A day writes new tables, and then one small state file of its own, which commits it; nothing that an
    earlier state names is touched before that, so a crash leaves the store as it was."""

    def __init__(self, spark: SparkSession, folder: str, versions: int = 2):
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), max(1, versions)

    def _path(self, table: str, version: str) -> str:
        return f"{self.folder}/{table}/v={version}"

    def _states(self) -> list[tuple[int, str]]:
        """(number, path) of all commits, oldest first."""
        path = f"{self.folder}/_states"
        names = [p for p, _, is_dir in files.listing(self.spark, path) if not is_dir] if files.exists(self.spark, path) else []
        return sorted((int(m[1]), p) for p in names if (m := re.search(r"/(\d+)\.json$", p)))

    def state(self) -> dict[str, str]:
        found = self._states()
        return json.loads(files.read_text(self.spark, found[-1][1])) if found else {}

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._path(table, self.state()["version"]))

    def commit(self, tables: dict[str, DataFrame], version: str, **meta: str) -> None:
        before = self._states()
        if before and self.state()["version"] == version:
            raise ValueError(f"version {version} is in use")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self._path(name, version))
        number = before[-1][0] + 1 if before else 1
        files.write_text(self.spark, f"{self.folder}/_states/{number:012d}.json", json.dumps(self.state() | meta | {"version": version}, sort_keys=True))
        self._prune()

    def _prune(self) -> None:
        """Removes what only commits before the last few name."""
        states = self._states()
        held = {json.loads(files.read_text(self.spark, p))["version"] for _, p in states[-self.versions :]}
        for _, path in states[: -self.versions]:
            old = json.loads(files.read_text(self.spark, path))["version"]
            if old not in held:
                for table, _, is_dir in files.listing(self.spark, self.folder):
                    if is_dir and not table.endswith("/_states"):
                        files.remove(self.spark, f"{table}/v={old}")
            files.remove(self.spark, path)


def apply_day(store: Store, day: str, pages: DataFrame, recognise: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> bool:
    """Applies one day's pages; a day that was applied before is left alone, an earlier one is refused, and so is one that
    doesn't follow the last: its change files are kept for RETENTION_DAYS, after which a full dump has to be imported.

    recognise: pages (id, ns, title, text) -> claims (page_id, ...) and links (from_id, field, target)."""
    done = store.state().get("incr_through", "")
    if day == done:
        return False
    if day < done:
        raise ValueError(f"day {day} comes after {done} was applied")
    if done and day != (following := next_day(done)):
        gap = (datetime.strptime(day, "%Y%m%d") - datetime.strptime(done, "%Y%m%d")).days
        raise ValueError(f"day {following} is missing: " + ("apply it first" if gap <= RETENTION_DAYS else "its files are no longer kept, import a full dump"))
    held, links = store.read("claims"), store.read("links")
    if not held.limit(1).count():
        raise ValueError("the store is empty: import a full dump first")
    claims, found_links = recognise(pages)
    touched, claims = known_pages(held, pages.select(F.col("id").alias("page_id")), claims, "page_id")
    new_links = replace(links.withColumnRenamed("from_id", "page_id"), touched, found_links.withColumnRenamed("from_id", "page_id"), "page_id").withColumnRenamed("page_id", "from_id")
    store.commit({"claims": replace(held, touched, claims, "page_id"), "links": new_links}, day, incr_through=day)
    return True


def follow(spark: SparkSession, store: Store, feed: str, schema: str, recognise, checkpoint: str, row_tag: str = "page"):
    """Runs all waiting day files through apply_day, one file a batch, in the order of their days.

    The file source orders by time of modification, so each batch's day is checked against what was applied."""
    stream = spark.readStream.format("xml").option("rowTag", row_tag).option("maxFilesPerTrigger", 1).schema(schema).load(feed).withColumn("_file", F.input_file_name())

    def batch(df: DataFrame, _: int) -> None:
        days = sorted({d for r in df.select("_file").distinct().collect() if (d := day_of(r[0].rpartition("/")[2]))})
        for day in days:
            apply_day(store, day, df.where(F.contains("_file", F.lit(day))).drop("_file"), recognise)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
