"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns what is left; a stage's result is written as Parquet and read back as
the next one's documents. All but the last return the columns of docs, whatever they are; columns that a stage would use
for its own ends are out of the way in a struct.

Defined results: documents with a null text fail the quality rules. Near duplicates: one document of each group stays, the
one with the smallest id; a null id is replaced by a hash of the text for this choice. Rows with one id are one document only if their
texts are near duplicates; equal rows count once.
A document of which nothing is left after repeated strings or benchmark passages are cut goes; an empty table gives an
empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidspark.llm import bpe, decontaminate, near_copies, quality_rules, suffix_dedup
from vidspark.llm.common import materialize

#: Near duplicates have a Jaccard similarity of 0.8 or more over shingles of five words. SimHash fingerprints of these that
#: differ in so many bits link texts first; every link is verified, and texts further apart are found by ``near_copies``.
SHINGLE_WORDS, MAX_BITS = 5, 4


def _whole(docs: DataFrame) -> DataFrame:
    """docs as one struct, next to its text."""
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("text").alias("text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _whole(docs).withColumns({"_id": F.coalesce(F.col("_row.doc_id").cast("long"), F.xxhash64("text")),
                                     "_node": F.xxhash64(F.coalesce("text", F.lit("")))})
    labels = near_copies.linked(rows.select(F.col("_node").alias("node"), "text"), SHINGLE_WORDS, MAX_BITS)
    texts = rows.groupBy(F.col("_node").alias("node")).agg(F.min("_id").alias("_id")).join(labels, "node", "left")
    first = texts.groupBy(F.coalesce("label", "node")).agg(F.min(F.struct("_id", F.col("node").alias("_node"))).alias("f"))
    order = Window.partitionBy("_id", "_node").orderBy(F.xxhash64("text"))  # more than one: repeated rows
    kept = rows.join(first.select("f.*"), ["_id", "_node"]).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return kept.select("_row.*")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean_documents(docs, items).where(
        F.col("text").isNull() | F.col("text").rlike(quality_rules.WORD))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the decoded text."""
    return bpe.digests(bpe.round_trip(docs.select("doc_id", "text")))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", benchmark),
    ("bpe_encoding", encoded),
]

#: Fingerprints and byte-pair encoding are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
