"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and driver and executors are one process (tests) a folder of our own is made; a cluster without
    a shared folder is an error, for its executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cinelake-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_paths: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    _paths.append(f"{shared_dir(spark)}/cinelake/{tag}-{uuid.uuid4().hex}")
    return _paths[-1]


def written() -> int:
    """How many intermediate tables this process has named so far; a mark for sweep()."""
    return len(_paths)


def sweep(spark: SparkSession, mark: int, keep: str | None = None) -> None:
    """Removes the intermediate tables named since a mark, but one. Only for tables that nothing reads any more."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for path in _paths[mark:]:
        if path != keep:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    _paths[mark:] = [keep] if keep is not None else []


def last_path() -> str:
    return _paths[-1]


def materialise(df: DataFrame, tag: str, compression: str = "snappy", share: int = 0) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs no rerun.

    With a share only every so many shuffle partitions get a file, after the work is done: for tables that are a small part of the input."""
    if share:
        df = df.repartition(max(8, input_partitions(df.sparkSession) // share))
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_remainder(doc_id: object, mod: int) -> int | None:
    """crc32 of the id written as text, modulo mod; null ids have none."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


def input_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Hands freed memory back to the system: a worker process outlives its task, and others need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(scan):
    """A task's function that trims when it ends."""

    def run(batches):
        try:
            yield from scan(batches)
        finally:
            trim()

    return run


def slices(batch: pa.RecordBatch, column: str, limit: int):
    """Parts of a batch of about limit bytes of text each; a longer text is a part of its own."""
    lengths = [0 if v is None else len(v) for v in batch.column(batch.schema.get_field_index(column)).to_pylist()]
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def shards(batches, name: str, limit: int):
    """Batches put together, or cut, to about limit bytes of text each."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, name, limit):
            if held and size + part.nbytes > limit:
                yield _joined(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
