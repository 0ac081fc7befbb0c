"""Functions, aggregates and table functions of a caller's own, for use in SQL over the tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def scalar(spark: SparkSession, name: str, f: Callable, returns: str, pure: bool = True) -> None:
    """A function of values, run on Arrow batches; an impure one is never moved or merged by the optimizer."""
    udf = F.pandas_udf(lambda *columns: pd.Series([f(*row) for row in zip(*columns)]), returns)
    spark.udf.register(name, udf if pure else udf.asNondeterministic())


def aggregate(spark: SparkSession, name: str, make: Callable[[], object], returns: str) -> None:
    """An aggregate from objects with step(value) and done()."""

    def run(values: pd.Series) -> object:
        state = make()
        for v in values:
            state.step(v)
        return state.done()

    spark.udf.register(name, F.pandas_udf(run, returns, F.PandasUDFType.GROUPED_AGG))


def table(spark: SparkSession, name: str, f: Callable[..., Iterable[tuple]], returns: str) -> None:
    """A table function: rows for each call."""

    class Rows:
        def eval(self, *args):
            yield from f(*args)

    spark.udtf.register(name, F.udtf(Rows, returnType=returns))


def collated(c: Column, name: str = "UNICODE_CI") -> Column:
    """A text column that compares by one of Spark's collations."""
    return F.collate(c, name)


def password_digest(kind: str, password: str, salt: str = "") -> bytes:
    """Digests of user tables: sha1, sha256, sha384, sha512, and with an s before them salted."""
    salted = kind.startswith("ss")
    return hashlib.new(kind[1:] if salted else kind, (password + (salt if salted else "")).encode()).digest()
