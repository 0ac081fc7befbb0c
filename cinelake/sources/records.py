"""Record files and vector files: compressed JSON in 256 shards, and quantised embeddings in one binary file."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions import expr

#: Fixed value: how a vector file begins.
MAGIC = b"fsvec1\n"


def write_records(df: DataFrame, folder: str, key: str = "page_id") -> None:
    """Rows as compressed JSON lines, in folders named by two hex digits of their ids."""
    df.withColumn("shard", expr.record_shard(key)).repartition("shard").write.mode("overwrite").partitionBy("shard").option("compression", "gzip").json(folder)


def read_records(spark: SparkSession, folder: str, schema: str, key: str = "page_id") -> DataFrame:
    """Records of all shards; a record without an id is no entity."""
    return spark.read.schema(schema).json(f"{folder}/*").where(F.coalesce(F.col(key), F.lit(0)) != 0)


def vector_file(ids: list[int], levels: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    bounds = np.stack((np.asarray(lo, "<f4"), np.asarray(hi, "<f4")), axis=1)
    return MAGIC + struct.pack("<II", len(ids), levels.shape[1]) + bounds.tobytes() + np.asarray(ids, "<i4").tobytes() + levels.astype(np.uint8).tobytes()


def parse_vectors(data: bytes, name: str = "file") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, levels, lo, hi); a file whose length isn't what its head says is refused."""
    if data[: len(MAGIC)] != MAGIC or len(data) < len(MAGIC) + 8:
        raise ValueError(f"{name} is no vector file")
    count, dims = struct.unpack_from("<II", data, len(MAGIC))
    at = len(MAGIC) + 8
    if not count or not dims or len(data) != at + dims * 8 + count * (4 + dims):
        raise ValueError(f"{name} holds {len(data)} bytes for {count} vectors of {dims}")
    bounds = np.frombuffer(data, "<f4", 2 * dims, at).reshape(dims, 2)
    ids = np.frombuffer(data, "<i4", count, at + dims * 8)
    return ids, np.frombuffer(data, np.uint8, count * dims, at + dims * 8 + 4 * count).reshape(count, dims), bounds[:, 0], bounds[:, 1]


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of vector files, as unit vectors of the levels."""

    def scan(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, levels, lo, hi = parse_vectors(data, name)
                for a in range(0, len(ids), 4096):
                    x = lo + levels[a : a + 4096] * ((hi - lo) / np.float32(255))
                    x = x / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-30)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 4096].astype(np.int64)), pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(scan, "id long, embedding array<float>")
