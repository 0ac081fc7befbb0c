"""SQL over attached databases: each group of tables under a name of its own, joined across by one statement."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class Database:
    """Views of several databases; sql() names them as {database}.table, and everything else is Spark SQL.

    Views are temporary and named apart, so two databases may hold tables of equal names."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, Mapping[str, DataFrame]]):
        self.spark, self.mark = spark, uuid.uuid4().hex[:8]
        self.tables = {db: dict(group) for db, group in tables.items()}
        for db, group in self.tables.items():
            for name, df in group.items():
                df.createOrReplaceTempView(self._view(db, name))

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **attached: str) -> Database:
        """Every parquet table of a folder as database main, and of further folders under their names."""
        from cinelake.sources.files import list_tables

        return cls(spark, {db: {n: spark.read.parquet(p) for n, p in list_tables(spark, path).items()} for db, path in ({"main": folder} | attached).items()})

    def _view(self, db: str, name: str) -> str:
        return f"v_{self.mark}_{db}_{name}"

    def sql(self, statement: str, **args) -> DataFrame:
        named = re.sub(r"\{(\w+)\}\.(\w+)", lambda m: self._view(m[1], m[2]), statement)
        return self.spark.sql(named, args=args or None)

    def close(self) -> None:
        for db, group in self.tables.items():
            for name in group:
                self.spark.catalog.dropTempView(self._view(db, name))

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()
