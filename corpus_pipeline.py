"""The pipeline over ``documents``: STAGES in order, each stage's result written as Parquet and reread.

Quality rules drop what they reject; of each near-duplicate group one document stays; personal data is
replaced in the texts; documents are replicated to the sources' target weights and shuffled; the copies
are encoded. All stages but the last return the columns of ``documents``.

Near duplicates are judged by sets of five words; op10's contract asks for two in its own query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tekstra.llm import bpe, mixing, near_dedup, pii, quality_rules
from tekstra.sources.shared import forget, new_path, stored_since
from tekstra.sources.spread import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs, words=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the bytes that the ids decode to; a row for each copy."""
    return bpe.encode_decode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE", encoded),
]

#: Tokenisers and trained models are beyond SQL; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table, and what it stored on the way, is deleted when the next stage is written; the last one stays for the caller."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        mark, path = stored_since(), new_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        old = [x for x in stored_since(mark) if x != path] + ([before] if before else [])
        if old:
            forget(spark, *old)
        before = path
    return docs
