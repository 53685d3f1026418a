"""The chat build: examples of four sources through quality, cross-source deduplication, held-out prompts, unknown targets and length, to weighted train rows.

Each example keeps its first failing stage. What several branches read is a stored table; copies and
held-out prompts are flags joined by the examples' order, so texts move once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat, dedup, tokens
from ..sources.shared import stored

#: Sources in the order in which the first of equal examples is kept.
ORDER = ("aya", "oasst1", "dolly", "taskmaster1")
QUALITY = ("empty", "corrupted", "pathological", "aya_mislabeled")


def placed(source: str, rows: DataFrame, target: Column | None = None) -> DataFrame:
    """Examples with ``ord`` over all sources: the source's place, the row's order in it (of one type in all), the target's place in the row."""
    ord = F.struct(F.lit(ORDER.index(source)).alias("source"), F.col("ord").alias("row"), (F.lit(0) if target is None else target).cast("long").alias("target"))
    return rows.select(ord.alias("ord"), "id", F.lit(source).alias("source"), "lang", "split", "turns")


def tidied(turns: str, who: str) -> Column:
    """An array of structs of ``who`` and a text, the texts tidied."""
    return F.zip_with(F.col(turns), T.tidy_all(F.transform(turns, lambda t: t["text"])), lambda t, text: F.struct(t[who].alias(who), text.alias("text")))


def examples(aya: DataFrame, messages: DataFrame, dolly: DataFrame, dialogs: DataFrame) -> DataFrame:
    """All examples of the sources' taken rows, each of which has an ``ord``; turns are tidied."""
    spoken = chat.conversation_examples(dialogs.withColumn("utterances", tidied("utterances", "speaker"))).where("reason = ''")
    spoken = spoken.withColumn("id", F.col("ex_id")).withColumn("lang", F.lit("en"))
    every = [placed("aya", chat.aya_examples(aya)), placed("oasst1", chat.forest_examples(messages)), placed("dolly", chat.dolly_examples(dolly)), placed("taskmaster1", spoken, F.col("target"))]
    rows = every[0]
    for more in every[1:]:
        rows = rows.unionByName(more)
    return rows.withColumn("turns", tidied("turns", "role"))


def built(rows: DataFrame, probes: DataFrame, encode: Callable[[Column], Column], block: int = tokens.BLOCK) -> DataFrame:
    """All examples with outcome ("final" or the first failing stage), first_source and prompt_seen (D9), and what T8 adds to final ones."""
    english = (F.col("source") == "aya") & (F.col("lang") == "eng")
    rows = stored(rows.withColumn("outcome", chat.turn_reason(F.col("turns"), english)))
    passed = rows.where("outcome = ''")
    pairs = passed.select("ord", "source", F.element_at("turns", -2)["text"].alias("prompt"), F.element_at("turns", -1)["text"].alias("target"))
    flags = stored(dedup.cross_source(pairs).select("ord", "first_source", "duplicate", "prompt_seen"))
    unique = passed.join(flags.where("not duplicate").select("ord"), "ord", "left_semi")
    held = stored(chat.probe_hits(unique, probes, "ord").withColumn("probe", F.lit(True)))
    clean = tokens.unknown_target(unique.join(held, "ord", "left_anti"), encode)
    done = tokens.tokenized(clean.where("not target_unk").select("ord", "turns"), encode, block).drop("turns")
    done = stored(clean.where("target_unk").select("ord", "target_unk").unionByName(done.withColumn("target_unk", F.lit(False)), allowMissingColumns=True))
    rows = rows.join(flags, "ord", "left").join(held, "ord", "left").join(done, "ord", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    outcome = F.when(F.col("outcome") != "", F.col("outcome")).when(yes("duplicate"), "duplicate").when(yes("probe"), "eval_probe").when(yes("target_unk"), "target_unk").when(yes("too_long"), "too_long").otherwise("final")
    return rows.withColumn("outcome", outcome).drop("duplicate", "probe", "target_unk", "too_long")


def attrition(rows: DataFrame) -> DataFrame:
    """Stage, n: examples by source, and what each stage rejects and leaves."""
    is_ = lambda *names: F.col("outcome").isin(*names)
    pair = F.concat(F.lit("dup_pair_"), F.array_join(F.sort_array(F.array_distinct(F.array("first_source", "source"))), "|"))
    quality, one = is_(*QUALITY), lambda c, name: F.when(c, F.lit(name) if isinstance(name, str) else name)
    kinds = [
        F.concat("source", F.lit("_examples")),
        one(quality, F.concat(F.lit("rejected_"), "outcome")),
        one(~quality, "after_quality"),
        one(is_("duplicate"), "rejected_duplicates"),
        one(is_("duplicate"), pair),
        one(~quality & ~is_("duplicate"), "after_dedup"),
        one(~is_("duplicate") & F.col("prompt_seen"), "prompt_only_duplicates"),
        one(is_("eval_probe"), "rejected_eval_probes"),
        one(is_("target_unk", "too_long", "final"), "after_probe_exclusion"),
        one(is_("target_unk"), "rejected_target_unk"),
        one(is_("too_long"), "rejected_too_long"),
        one(is_("final"), "final_examples"),
        one(is_("final") & F.col("dropped_turns"), "dropped_oldest_turns"),
    ]
    stages = F.filter(F.array(*kinds), lambda k: k.isNotNull())
    return rows.select(F.explode(stages).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


def train_rows(rows: DataFrame) -> DataFrame:
    """Final examples of the train split with weight and copies."""
    return chat.sampling_weights(rows.where("outcome = 'final' AND split = 'train'"))[1]
