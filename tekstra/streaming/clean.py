"""Cleaning as a stream: the stateless part of the cleaning plan, and copies dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def cleaned_stream(docs: DataFrame) -> DataFrame:
    """Normalizes and judges arriving documents; works on streams and tables alike."""
    docs = docs.withColumn("text", T.normalized("text"))
    return docs.withColumn("reason", F.when(F.col("text") == "", "empty").otherwise(T.quality_reason("text"))).where("reason = ''").drop("reason")


def unseen(docs: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Drops texts that came within the watermark's delay; state is bounded by it. Only hashes are kept."""
    hashed = docs.withColumn("__h", F.sha1("text")).withWatermark(time, delay)
    return hashed.dropDuplicatesWithinWatermark(["__h"]).drop("__h")
