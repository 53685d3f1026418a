"""Reports: one pass each, by conditional aggregates or grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .tokens import MASK, UNK


def corpus_stats(docs: DataFrame) -> DataFrame:
    """A2: documents, characters, words and split counts of each language."""
    splits = [F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(T.word_count("text")).alias("words"), *splits)


def example_stats(examples: DataFrame) -> DataFrame:
    """A5: examples, unique and effective tokens, longest, for (split, lang), (split, source) and all, in one pass."""
    measures = [F.count("*").alias("examples"), F.sum("n_supervised").cast("long").alias("unique_tokens"), F.sum(F.col("n_supervised") * F.col("copies")).cast("long").alias("effective_tokens"), F.max(F.size("ids")).cast("long").alias("max_length")]
    sets = [[F.col("split"), F.col("lang")], [F.col("split"), F.col("source")], []]
    return examples.groupingSets(sets, "split", "lang", "source").agg(*measures)


def unk_rates(examples: DataFrame) -> DataFrame:
    """Share of unknown tokens in prompts and in targets."""
    count = lambda ids: F.sum(F.size(F.filter(ids, lambda i: i == UNK)))
    prompt, target = F.slice("ids", F.lit(1), F.col("target_start")), F.slice("ids", F.col("target_start") + 1, F.size("ids"))
    rate = lambda ids: F.round(count(ids) / F.greatest(F.lit(1), F.sum(F.size(ids))), 6)
    return examples.agg(rate(prompt).alias("prompt_unk_rate"), rate(target).alias("target_unk_rate"))


def label_identity(examples: DataFrame) -> DataFrame:
    """Share of supervised places whose label is the place's own token."""
    pairs = F.zip_with("ids", "labels", lambda i, x: F.when(x != MASK, (i == x).cast("int")))
    known = F.filter(pairs, lambda p: p.isNotNull())
    return examples.agg(F.round(F.sum(F.aggregate(known, F.lit(0), lambda a, x: a + x)) / F.greatest(F.lit(1), F.sum(F.size(known))), 6).alias("identity_fraction"), F.sum(F.size(known)).cast("long").alias("supervised"))


def token_gate(examples: DataFrame, least: int = 1_000_000) -> DataFrame:
    """Unique supervised tokens of the train split against a minimum."""
    return examples.agg(F.coalesce(F.sum(F.when(F.col("split") == "train", F.col("n_supervised"))), F.lit(0)).cast("long").alias("tokens")).withColumn("passes", F.col("tokens") >= least)


def step_tokens(batches: DataFrame, by: str) -> DataFrame:
    """Supervised tokens, and all with padding, of each batch."""
    return batches.groupBy(by).agg(F.sum(F.size(F.filter("labels", lambda x: x != MASK))).cast("long").alias("supervised"), F.sum(F.size("ids")).cast("long").alias("total"))


def reply_metrics(ids: Column, text: Column, eos: int, specials: list[int]) -> list[Column]:
    """A13."""
    leak = [s for s in specials if s not in (eos, UNK)]
    return [
        F.size(ids).cast("long").alias("tokens"),
        F.coalesce(F.try_element_at(ids, F.lit(-1)) == eos, F.lit(False)).alias("eos_terminated"),
        F.exists(ids, lambda i: i.isin(leak)).alias("role_leak"),
        F.size(F.filter(ids, lambda i: i == UNK)).cast("long").alias("unk_tokens"),
        (F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))).cast("long").alias("replacement_chars"),
        T.repetition_score(text).alias("repetition_score"),
    ]


def reply_report(replies: DataFrame) -> DataFrame:
    """A14, from rows of A13 with text and prompt_lang. Both language rates divide by all replies, as reported."""
    n = F.greatest(F.lit(1), F.count("*"))
    rate = lambda c, k=4: F.round(F.sum(c.cast("long")) / n, k)
    in_own = lambda lang: (F.col("prompt_lang") == lang) & (T.language_guess("text")["estimate"] == lang)
    return replies.agg(
        F.count("*").alias("n_responses"),
        rate(F.col("tokens") == 0).alias("empty_response_rate"),
        rate(F.col("eos_terminated")).alias("eos_termination_rate"),
        rate(F.col("role_leak")).alias("role_token_leakage_rate"),
        F.round(F.sum("unk_tokens") / F.greatest(F.lit(1), F.sum("tokens")), 6).alias("unk_rate"),
        F.round(F.sum("replacement_chars") / F.greatest(F.lit(1), F.sum(F.length("text"))), 6).alias("replacement_char_rate"),
        F.round(F.sum("tokens") / n, 2).alias("mean_response_tokens"),
        F.round(F.sum("repetition_score") / n, 4).alias("mean_repetition_score"),
        rate(in_own("fil")).alias("fil_prompts_answered_in_fil"),
        rate(in_own("eng")).alias("eng_prompts_answered_in_eng"),
    )
