"""Session settings, and shipping of this package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}
BATCH_ROWS = 512
_shipped: set[str] = set()


def session(app: str = "cinelake", **settings: str) -> SparkSession:
    """A session with this engine's settings; further ones by keyword, dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def ship(spark: SparkSession, texts: bool = True) -> None:
    """Once for each application, hands the package to the executors' Python workers.

    texts: rows of text are read and go to Python in batches of BATCH_ROWS, which bounds what either side holds; else batches are as
    Spark has them."""
    for name in BATCHES:
        if texts:
            spark.conf.set(name, BATCH_ROWS)
        else:
            spark.conf.unset(name)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), "cinelake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only where they are one process a folder of our own does."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cinelake-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df as compressed parquet in the shared folder, read again: made once, and each reader takes only the columns and the rows that it asks for."""
    path = f"{shared_folder(df.sparkSession)}/cinelake/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
