"""Deduplication by order: the first of equal or near-equal documents stays. No sequential state.

``ord`` names the column that orders documents; results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import blake2b_signature
from ..sources.shared import stored

SIGNATURE, SHARED, SHINGLE, MAX_CHARS = 12, 8, 5, 250_000


def exact_duplicates(docs: DataFrame, ord: str, text: str = "text") -> DataFrame:
    """Adds exact_dup, true for all but the first document of a text.

    The firsts come from an aggregation, which combines before the shuffle, so a text that a third of
    the documents share is no heavy window; only hashes move.
    """
    hashed = docs.withColumn("__h", F.sha1(F.coalesce(text, F.lit(""))))
    firsts = hashed.groupBy("__h").agg(F.min(ord).alias("__first"))
    return hashed.join(firsts, "__h").withColumn("exact_dup", F.col(ord) > F.col("__first")).drop("__h", "__first")


def exact_dedup(docs: DataFrame, ord: str, text: str = "text") -> DataFrame:
    return exact_duplicates(docs, ord, text).where(~F.col("exact_dup")).drop("exact_dup")


def with_signature(docs: DataFrame, text: str, algorithm: str, out: str) -> DataFrame:
    """Adds the twelve smallest hashes of a text's shingles, repeated ones included.

    Shingles are runs of five words of [a-z0-9], of the words whose lengths, with a space each, sum to
    250,000 at most: a word is kept while its end in the joined words lies within. What a lambda looks
    into is a column of its own, so it is computed once.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    joined = F.concat(F.array_join(words, " "), F.lit(" "))
    within = F.regexp_replace(F.substring(joined, 1, MAX_CHARS), "[^ ]*$", "")
    docs = docs.withColumn("__w", F.when(F.length(text) < MAX_CHARS, words).otherwise(F.filter(F.split(within, " "), lambda w: w != "")))
    if algorithm == "blake2b":
        return docs.withColumn(out, blake2b_signature("__w", SHINGLE, SIGNATURE)).drop("__w")
    starts = F.slice("__w", F.lit(1), F.greatest(F.size("__w") - F.lit(SHINGLE - 1), F.lit(0)))
    docs = docs.withColumn("__h", F.transform(starts, lambda w, i: F.substring(F.md5(F.concat_ws(" ", w, *(F.get("__w", i + k) for k in range(1, SHINGLE)))), 1, 16)))
    return docs.withColumn(out, F.slice(F.sort_array("__h"), 1, SIGNATURE)).drop("__w", "__h")


def near_duplicates(docs: DataFrame, ord: str, text: str = "text", algorithm: str = "blake2b") -> DataFrame:
    """Adds near_dup, true where eight entries or more of the signature stand in signatures before.

    A signature counts as seen whether or not its document is kept; so "seen before" is "the first
    document with that hash comes before", an aggregation and a join. Signatures are a stored table, so
    they are computed once. Minima combine before they are shuffled, and the join is one that AQE splits
    where a shingle is in a third of all documents.
    """
    signed = stored(with_signature(docs.select(F.col(ord).alias("__ord"), F.col(text).alias("__t")), "__t", algorithm, "s").select("__ord", "s"))
    entries = signed.select("__ord", F.explode("s").alias("h"))
    firsts = entries.groupBy("h").agg(F.min("__ord").alias("first"))
    shared = entries.join(firsts, "h").where(F.col("first") < F.col("__ord")).groupBy("__ord").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED)
    flagged = shared.select(F.col("__ord").alias(ord), F.lit(True).alias("__near"))
    return docs.join(flagged, ord, "left").withColumn("near_dup", F.coalesce("__near", F.lit(False))).drop("__near")


def cross_source(examples: DataFrame, ord: str = "ord") -> DataFrame:
    """Adds first_source (of the pair of prompt and target), duplicate, and prompt_seen (kept, but its prompt came before).

    The first row of a prompt is the first of its pair, so a kept row's prompt was seen if any row of the
    prompt comes before. Firsts are aggregated minima that are joined back by hash: a prompt that a third
    of all rows share is no window, and texts don't move for it.
    """
    hashed = examples.withColumns({"__p": F.sha1(F.coalesce("prompt", F.lit(""))), "__t": F.sha1(F.coalesce("target", F.lit("")))})
    pairs = hashed.groupBy("__p", "__t").agg(F.min(F.struct(F.col(ord).alias("ord"), "source")).alias("__first"))
    prompts = pairs.groupBy("__p").agg(F.min("__first.ord").alias("__prompt_first"))
    rows = hashed.join(pairs.join(prompts, "__p"), ["__p", "__t"])
    rows = rows.withColumns({"duplicate": F.col(ord) > F.col("__first.ord"), "first_source": F.col("__first.source")})
    return rows.withColumn("prompt_seen", ~F.col("duplicate") & (F.col(ord) > F.col("__prompt_first"))).drop("__p", "__t", "__first", "__prompt_first")


def cross_source_report(examples: DataFrame, ord: str = "ord") -> DataFrame:
    """D9's counters: kind, n."""
    flagged = cross_source(examples, ord)
    sources = F.array_join(F.sort_array(F.array_distinct(F.array("first_source", "source"))), "|")
    kinds = F.when(F.col("duplicate"), F.array(F.lit("rejected_duplicates"), F.concat(F.lit("dup_pair_"), sources))).when(F.col("prompt_seen"), F.array(F.lit("kept"), F.lit("prompt_only_duplicates"))).otherwise(F.array(F.lit("kept")))
    return flagged.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
