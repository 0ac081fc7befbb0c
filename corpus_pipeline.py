"""The corpus pipeline: five operators of cinelake.llm, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm import decontaminate, near_dedup, packing, quality, secrets
from cinelake.llm._util import DOC_COLUMNS, last_path, materialise, sweep, written
from cinelake.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are judged like others, by their features; very long texts are judged whole; equal texts get equal
    decisions, repeated rows each their own; a tie at the threshold is kept; further columns go; an empty table gives an empty table."""
    ship(spark)
    return quality.keep(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id. Links are those of shingles of five words.

    Rows of one id are one document, linked by every text it has; if it stays, each of its different texts stays once, with the
    least of its other columns. Rows with a null id are all kept, as are, each for itself, texts without words; very long texts
    are compared whole; further columns go, whatever their names; an empty table gives an empty table."""
    ship(spark)
    found = near_dedup.link(docs, size=5).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct().hint("shuffle_hash")
    rest = F.min(F.struct("lang", "source", "n_chars")).alias("rest")
    # Both steps deal rows out by doc_id, so texts move once.
    some = docs.join(found, "doc_id", "left_semi").groupBy("doc_id", "text").agg(rest).select("doc_id", "text", "rest.*")
    return some.unionByName(docs.where("doc_id IS NULL").select(*DOC_COLUMNS)).select(*DOC_COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark passages go; a document of which nothing remains goes.

    Null and empty texts hold no passage and stay as they are; very long texts are searched whole; overlapping passages are one
    span; repeated rows are each cut; further columns go; an empty table, or an empty benchmark, changes nothing."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced by their kind.

    Null texts become empty ones; very long texts are scanned whole; where spans overlap the one that begins first is replaced, of
    equal starts the longer one; repeated rows are each redacted and count as one repository; further columns go; an empty table
    gives an empty table."""
    ship(spark)
    return secrets.redact(docs)


def lexical_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with the columns of packing.NAMES; null and empty texts are the end id alone, and see packing for the rest."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("lexical_packing", lexical_packing),
]

#: SQL expresses neither the learned classifier nor the packing; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep. What a stage has written on its way goes as soon as its result is written."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, name, "zstd")
            sweep(spark, mark, last_path())
    return docs
