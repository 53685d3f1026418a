"""Language identification by character trigrams: profiles from the corpus, log-probabilities, margins."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNSEEN = math.log(1 / 1e9)
MARGIN = 0.5


def letters(text: Column) -> Column:
    """What trigrams are taken of: [a-z0-9 ], single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +", " "))


def trigrams(text: Column) -> Column:
    """Overlapping trigrams of [a-z0-9 ]; a lookahead finds them in one pass."""
    return F.regexp_extract_all(letters(text), F.lit("(?=(...))"), 1)


def has_trigrams(text: Column) -> Column:
    """Whether there is any trigram. Said of the text, so that a filter by it needs no scores and stops at the first one."""
    return F.lower(text).rlike("[a-z0-9]{3}|[a-z0-9][^a-z0-9]++[a-z0-9]")


def training_rows(docs: DataFrame, ord: str, lang: str, per_language: int, source: str | None = None) -> DataFrame:
    """Of each language, and each source of it, the first rows; per_language is shared evenly by sources.

    The bound on the row number is a constant, so tasks drop what is beyond it before rows are shuffled.
    """
    if source is None:
        return docs.withColumn("__rn", F.row_number().over(Window.partitionBy(lang).orderBy(ord))).where(F.col("__rn") <= per_language).drop("__rn")
    n = docs.groupBy(lang).agg(F.count_distinct(source).alias("__n"))
    rn = F.row_number().over(Window.partitionBy(lang, source).orderBy(ord))
    return docs.withColumn("__rn", rn).where(F.col("__rn") <= per_language).join(n, lang).where(F.col("__rn") <= F.floor(F.lit(per_language) / F.greatest("__n", F.lit(1)))).drop("__rn", "__n")


def profiles(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Plang, gram, logp with add-one smoothing."""
    counts = docs.select(F.col(lang).alias("plang"), F.explode(trigrams(F.col(text))).alias("gram")).groupBy("plang", "gram").agg(F.count("*").alias("c"))
    totals = counts.groupBy("plang").agg(F.sum("c").alias("total"), F.count("*").alias("v"))
    return counts.join(totals, "plang").select("plang", "gram", F.log((F.col("c") + 1) / (F.col("total") + F.col("v") + 1)).alias("logp"))


SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789 "
_PLACE = np.zeros(256, np.int64)
_PLACE[list(SIGNS.encode())] = range(len(SIGNS))


def places(grams: np.ndarray) -> np.ndarray:
    """Numbers of the trigrams of a row of bytes, in 0..37 ** 3."""
    c, n = _PLACE[grams], len(SIGNS)
    return (c[:-2] * n + c[1:-1]) * n + c[2:]


def with_scores(docs: DataFrame, profile: DataFrame, text: str = "text", out: str = "scores") -> tuple[list[str], DataFrame]:
    """The languages, and the rows with an array of the mean log-probability of their trigrams in each; null without trigrams.

    A profile has 37 ** 3 grams a language at most, so all of them are one dense table of 400 kB a language
    that goes to the tasks; rows are scored where they are and nothing is shuffled.
    """
    rows = profile.collect()
    langs = sorted({r["plang"] for r in rows})
    table = np.full((len(langs), len(SIGNS) ** 3), UNSEEN)
    for r in rows:
        table[langs.index(r["plang"]), places(np.frombuffer(r["gram"].encode(), np.uint8))[0]] = r["logp"]

    @F.arrow_udf("array<double>")
    def mean(texts: pa.Array) -> pa.Array:
        found = [table[:, places(np.frombuffer(x.encode(), np.uint8))].mean(axis=1) if x and len(x) > 2 else None for x in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.float64()))

    return langs, docs.withColumn(out, mean(letters(F.col(text))))


def scores(docs: DataFrame, profile: DataFrame, ord: str, text: str = "text") -> DataFrame:
    """Ord, plang, score; documents without any trigram don't appear."""
    langs, rows = with_scores(docs.select(ord, text), profile, text, "__s")
    rows = rows.where("__s IS NOT NULL").select(ord, F.posexplode("__s").alias("__at", "score"))
    return rows.select(ord, F.get(F.array(*map(F.lit, langs)), F.col("__at")).alias("plang"), "score")


def best(langs: list[str], scored: Column, order: list[str] | None) -> Column:
    """P9, P10 in a row: struct of pred and margin (null without scores). Ties go to the language fitted first (``order``, else by name)."""
    place = [order.index(x) if order and x in order else len(order or ()) + k for k, x in enumerate(langs)]
    ranked = F.sort_array(F.transform(scored, lambda s, i: F.struct((-s).alias("neg"), F.get(F.array(*map(F.lit, place)), i).alias("place"), F.get(F.array(*map(F.lit, langs)), i).alias("plang"))))
    pick = lambda r: F.struct(F.get(r, F.lit(0))["plang"].alias("pred"), F.coalesce(F.get(r, F.lit(1))["neg"] - F.get(r, F.lit(0))["neg"], F.lit(0.0)).alias("margin"))
    return F.when(scored.isNotNull(), F.get(F.transform(F.array(ranked), pick), F.lit(0)))


def wrong_language(pred: Column, lang: Column, margin: Column) -> Column:
    """P11, as it is written: a margin that is not a number doesn't reject."""
    return (pred != lang) | F.when(F.isnan(margin), F.lit(False)).otherwise(margin < MARGIN)


def gate(docs: DataFrame, profile: DataFrame, ord: str, first: str, lang: str = "lang", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """Adds pred, margin, wrong_language. Documents without trigrams get the language fitted first and a margin of NaN."""
    langs, rows = with_scores(docs, profile, text, "__scores")
    rows = rows.withColumn("__best", best(langs, F.col("__scores"), order))
    rows = rows.withColumns({"pred": F.coalesce("__best.pred", F.lit(first)), "margin": F.coalesce("__best.margin", F.lit(float("nan")))}).drop("__scores", "__best")
    return rows.withColumn("wrong_language", wrong_language(F.col("pred"), F.col(lang), F.col("margin")))
