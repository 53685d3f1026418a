"""The cleaning plan: normalize, judge, check the language, drop copies, split. Every row keeps its first failing stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, langid
from ..sources.shared import stored


def cleaned(docs: DataFrame, ord: str = "doc_id", per_language: int = 400, algorithm: str = "blake2b", wiki_sources: str = "(?:wiki|wikisource)$", check_language: bool = True, order: list[str] | None = None) -> DataFrame:
    """All rows with outcome: "accepted", a rejection's reason, "exact_duplicate" or "near_duplicate"; accepted rows have a split.

    What several branches read (the judged texts, the flags) is a stored table, so texts are normalized and judged once.
    Only rows that pass quality and language take part in the search for copies, and only rows that
    are no exact copies in that for near ones.
    """
    raw = docs
    plain = T.normalized("text")
    wiki = F.col("source").rlike(wiki_sources)
    docs = docs.withColumn("text", plain)
    docs = docs.withColumn("text", F.when(wiki, T.normalized(T.without_wiki_markup("text"))).otherwise(F.col("text")))
    docs = stored(docs.withColumn("outcome", F.when(F.col("text") == "", "empty").otherwise(T.quality_reason("text"))))
    if check_language:
        first = order[0] if order else raw.agg(F.min("lang")).first()[0]
        profile = langid.profiles(langid.training_rows(raw, ord, "lang", per_language))
        gated = langid.gate(docs.where("outcome = ''"), profile, ord, first, order=order)
        wrong = stored(gated.where("wrong_language").select(ord, F.lit(True).alias("__wrong")))
        docs = docs.join(wrong, ord, "left").withColumn("outcome", F.when((F.col("outcome") == "") & F.col("__wrong"), "wrong_language").otherwise(F.col("outcome"))).drop("__wrong")
    passed = docs.where("outcome = ''")
    exact = stored(dedup.exact_duplicates(passed, ord).select(ord, "exact_dup"))
    near = dedup.near_duplicates(passed.join(exact.where("not exact_dup"), ord, "left_semi"), ord, algorithm=algorithm)
    flags = stored(exact.join(near.select(ord, "near_dup"), ord, "left"))
    outcome = F.when(F.col("outcome") != "", F.col("outcome")).when(F.col("exact_dup"), "exact_duplicate").when(F.col("near_dup"), "near_duplicate").otherwise("accepted")
    out = docs.join(flags, ord, "left").withColumn("outcome", outcome).drop("exact_dup", "near_dup")
    return out.withColumn("split", F.when(F.col("outcome") == "accepted", T.doc_split(F.concat_ws(":", "source", F.col(ord).cast("string")))))


def counters(rows: DataFrame) -> DataFrame:
    """A1: documents, characters and words by language, outcome and split; their sum is the input."""
    return rows.groupBy("lang", "outcome", F.coalesce("split", F.lit("")).alias("split")).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(T.word_count("text")).alias("words"))
