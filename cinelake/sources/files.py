"""Files and folders through Spark's own file systems, so that any store it reads works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, bool]]:
    """(path, bytes, whether it is a folder) of what a folder holds, by name."""
    fs, p = _fs(spark, path)
    return sorted((s.getPath().toString(), s.getLen(), s.isDirectory()) for s in fs.listStatus(p))


def list_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names and paths of a folder's parquet tables."""
    out = {}
    for path, _, _ in listing(spark, folder):
        name = path.rstrip("/").rpartition("/")[2]
        if name.endswith(".parquet"):
            out[name.removesuffix(".parquet")] = path
    return out


# How the inputs of a full build are named.
DUMPS = {
    "articles": ("pages-articles-multistream.xml.bz2",),
    "index": ("pages-articles-multistream-index.txt.bz2", "pages-articles-multistream-index.txt"),
    "page_props": ("page_props.sql.gz",),
    "images": ("image.sql.gz",),
}


def find_dumps(spark: SparkSession, folder: str) -> dict[str, str]:
    """The inputs of a full build by kind; all that are missing are named at once."""
    names = [p for p, _, is_dir in listing(spark, folder) if not is_dir]
    found = {kind: next((p for p in reversed(names) if p.endswith(ends)), None) for kind, ends in DUMPS.items()}
    if missing := [k for k, p in found.items() if p is None]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(f'{k} (*{DUMPS[k][0]})' for k in missing)}")
    return found


def size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file beside its place and renames it over what stood there: a reader finds the old data or the new, never none."""
    fs, p = _fs(spark, path)
    beside = p.suffix(".partial")
    out = fs.create(beside, True)
    out.write(bytearray(data))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(p), over)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or a folder with all that it holds."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of a file, or of all files below a folder; files are hashed side by side, each of up to 2 GB."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def copy_verified(spark: SparkSession, source: str, target: str, sha256: str) -> None:
    """Copies a file beside its place, compares its digest, and only then renames it; what differs is removed and refused."""
    (fs, p), (to, t) = _fs(spark, source), _fs(spark, target)
    partial = t.suffix(".partial")
    jvm = spark.sparkContext._jvm
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, partial, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    found = checksums(spark, partial.toString()).first()["sha256"]
    if found != sha256:
        to.delete(partial, False)
        raise ValueError(f"{source} has the digest {found}, not {sha256}")
    to.rename(partial, t)
