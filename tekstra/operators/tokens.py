"""Token arrays: a character tokenizer, chat encodings with labels, packing under budgets, batches, statistics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.search import numbers_upto
from ..functions.text import characters

#: Ids of the special tokens, and the label that masks.
UNK, PAD, BOS, EOS, SYSTEM, USER, ASSISTANT, MASK = 0, 1, 2, 3, 4, 5, 6, -100
SPECIALS = 7
BLOCK = 256


def char_ids(text: Column | str, alphabet: str) -> Column:
    """7 + place in the alphabet; what isn't in it is unk."""
    text = F.col(text) if isinstance(text, str) else text
    place = lambda c: F.instr(F.lit(alphabet), c)
    return F.transform(characters(text), lambda c: F.when(place(c) > 0, place(c) + (SPECIALS - 1)).otherwise(F.lit(UNK)))


def first_seen_alphabet(docs: DataFrame, ord: str, text: str = "text") -> str:
    """The distinct characters in order of first sight; bounded by the characters in use."""
    seen = docs.select(F.col(ord).alias("o"), F.posexplode(characters(F.col(text))).alias("p", "c")).groupBy("c").agg(F.min(F.struct("o", "p")).alias("at"))
    return "".join(r["c"] for r in seen.orderBy("at").select("c").collect())


def decoded(ids: Column, alphabet: str) -> Column:
    """The text of ids; special ones, unk too, are dropped."""
    return F.array_join(F.transform(F.filter(ids, lambda i: i >= SPECIALS), lambda i: F.substring(F.lit(alphabet), i - F.lit(SPECIALS - 1), F.lit(1))), "")


def piece_ids(model_file: str):
    """T5: a SentencePiece encoder as a function of a column; each Python worker loads the model once, from its path."""
    loaded: dict[str, object] = {}

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        if model_file not in loaded:
            import sentencepiece

            loaded[model_file] = sentencepiece.SentencePieceProcessor(model_file=model_file)
        return pa.array(loaded[model_file].encode([x or "" for x in texts.to_pylist()], num_threads=1), pa.list_(pa.int32()))

    return lambda x: run(F.col(x) if isinstance(x, str) else x)


def ints(*values: int) -> Column:
    return F.array(*map(F.lit, values))


def suffix_that_fits(turns: Column, budget: Column) -> Column:
    """The longest run of last turns whose lengths sum to ``budget`` at most: an array of arrays.

    All turns have a length of one or more, so sums from the end grow, and the turns kept are those
    from the first whose sum fits.
    """
    lengths = F.transform(turns, F.size)
    upto = lambda i: F.aggregate(F.slice(lengths, i + 1, F.greatest(F.size(turns), F.lit(1))), F.lit(0), lambda a, x: a + x)
    return F.filter(turns, lambda t, i: upto(i) <= budget)


def tokenized(examples: DataFrame, encode, block: int = BLOCK) -> DataFrame:
    """Adds ids, labels, target_start, n_supervised, too_long and dropped_turns to examples with ``turns`` (array of role, text).

    The turn before the target counts as the user's whatever its role. Examples whose target doesn't fit
    have null arrays and too_long true.
    """
    role = lambda t: F.when(t["role"] == "user", USER).otherwise(ASSISTANT)
    n = F.size("turns")
    return _finished(
        examples.where(n >= 2).withColumns(
            {
                "__head": F.concat(ints(USER), encode(F.element_at("turns", n - 1)["text"]), ints(ASSISTANT)),
                "__target": encode(F.element_at("turns", -1)["text"]),
                "__older": F.transform(F.slice("turns", F.lit(1), n - 2), lambda t: F.concat(F.array(role(t)), encode(t["text"]))),
            }
        ),
        block,
    )


def _finished(rows: DataFrame, block: int) -> DataFrame:
    core = F.size("__head") + F.size("__target") + 1
    rows = rows.withColumn("too_long", 1 + core > block).withColumn("__kept", F.when(~F.col("too_long"), suffix_that_fits(F.col("__older"), F.lit(block - 1) - core)))
    rows = rows.withColumn("ids", F.when(~F.col("too_long"), F.concat(ints(BOS), F.flatten("__kept"), F.col("__head"), F.col("__target"), ints(EOS))))
    rows = rows.withColumns(
        {
            "target_start": F.when(~F.col("too_long"), F.size("ids") - F.size("__target") - 1),
            "n_supervised": F.when(~F.col("too_long"), F.size("__target") + 1),
            "dropped_turns": F.col("too_long").isNotNull() & ~F.col("too_long") & (F.size("__kept") < F.size("__older")),
        }
    )
    rows = rows.withColumn("labels", F.transform("ids", lambda x, i: F.when((i >= F.col("target_start") - 1) & (i < F.size("ids") - 1), F.get("ids", i + 1)).otherwise(F.lit(MASK))))
    return rows.drop("__head", "__target", "__older", "__kept")


def history_ids(history: Column, encode, system: str = "", block: int = BLOCK) -> Column:
    """The prompt of a history (array of role, text): system text, the last turns that fit, the last turn as the user's, and the assistant's mark."""
    role = lambda t: F.when(t["role"] == "user", USER).otherwise(ASSISTANT)
    start = F.concat(ints(BOS, SYSTEM), encode(F.lit(system))) if system else ints(BOS)
    core = F.concat(ints(USER), encode(F.element_at(history, -1)["text"]), ints(ASSISTANT))
    older = F.transform(F.slice(history, F.lit(1), F.size(history) - 1), lambda t: F.concat(F.array(role(t)), encode(t["text"])))
    return F.concat(start, F.flatten(suffix_that_fits(older, F.lit(block) - F.size(start) - F.size(core))), core)


def prompt_ids(turns: Column, encode) -> Column:
    """All turns, untruncated."""
    role = lambda t: F.when(t["role"] == "user", USER).otherwise(ASSISTANT)
    return F.concat(ints(BOS), F.flatten(F.transform(turns, lambda t: F.concat(F.array(role(t)), encode(t["text"])))), ints(ASSISTANT))


def trimmed_reply(ids: Column, markers: list[int]) -> Column:
    """What comes before the first of the markers."""
    first = F.array_position(F.transform(ids, lambda i: i.isin(markers)), True)
    return F.when(first > 0, F.slice(ids, F.lit(1), (first - 1).cast("int"))).otherwise(ids)


def running_sum(rows: DataFrame, key: str, ord: str, value: str, a_run: int = 500_000) -> DataFrame:
    """Adds upto, the running sum of ``value`` by ``key`` in the order of ``ord`` (a number, unique in a key), without one window over a whole key.

    Orders are cut at quantiles into runs of some ``a_run`` rows, eight at least; sums inside runs and
    sums of runs before add up. The number of runs follows that of the rows, so no task's share grows.
    """
    runs = max(8, rows.count() // a_run + 1)
    cuts = rows.agg(F.percentile_approx(ord, [i / runs for i in range(1, runs)], max(10_000, 20 * runs))).first()[0] or []
    rows = rows.withColumn("__run", numbers_upto(sorted(set(cuts)), ord))
    sums = rows.groupBy(key, "__run").agg(F.sum(value).alias("s"))
    before = sums.withColumn("__before", F.coalesce(F.sum("s").over(Window.partitionBy(key).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inside = F.sum(value).over(Window.partitionBy(key, "__run").orderBy(ord).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__inside", inside).join(before, [key, "__run"]).withColumn("upto", F.col("__before") + F.col("__inside")).drop("__run", "__before", "__inside")


def packed(docs: DataFrame, budgets: dict[str, int], ord: str, lang: str = "lang", n: str = "n") -> DataFrame:
    """The documents of each language up to its token budget; the first one always. Adds upto.

    Counts are positive, so the running sum grows and "stop at the first that doesn't fit" is a filter.
    """
    budget = F.create_map(*(F.lit(x) for pair in budgets.items() for x in pair))[F.col(lang)]
    rows = running_sum(docs, lang, ord, n)
    return rows.where((F.col("upto") <= budget) | (F.col("upto") == F.col(n)))


def batches(examples: DataFrame, ord: str, size: int) -> DataFrame:
    """Batch, and ids and labels padded to the batch's longest."""
    numbered = running_sum(examples.withColumns({"__one": F.lit(1).cast("long"), "__all": F.lit(0)}), "__all", ord, "__one")
    rows = numbered.withColumn("batch", F.floor((F.col("upto") - 1) / size).cast("long")).drop("__one", "__all", "upto")
    longest = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    rows = rows.withColumn("__longest", longest)
    pad = lambda c, by: F.concat(F.col(c), F.array_repeat(F.lit(by), F.col("__longest") - F.size(c)))
    return rows.withColumns({"ids": pad("ids", PAD), "labels": pad("labels", MASK)}).drop("__longest")


def windows(stream: DataFrame, block: int, count: int, seed: int) -> DataFrame:
    """X and y of ``count`` windows at hashed starts over a stream (pos, token). Starts are few; the stream is joined by position."""
    n = stream.count()
    if n < block + 1:
        raise ValueError(f"a stream of {n} tokens is shorter than block + 1")
    starts = stream.sparkSession.range(count).select(F.col("id").alias("row"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n - block)).alias("start"))
    places = starts.select("row", F.posexplode(F.sequence("start", F.col("start") + block)).alias("at", "pos"))
    seg = places.join(stream, "pos").groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda s: s["token"]).alias("seg"))
    return seg.select("row", F.slice("seg", 1, block).alias("x"), F.slice("seg", 2, block).alias("y"))


def checked(examples: DataFrame, block: int = BLOCK) -> DataFrame:
    """Fails on an example whose labels don't match its ids, or that is too long."""
    ok = (F.size("ids") == F.size("labels")) & (F.size("ids") <= block)
    return examples.withColumn("ids", F.when(ok, F.col("ids")).otherwise(F.raise_error(F.lit("an example has bad lengths")).cast("array<int>")))


def tokenizer_stats(rows: DataFrame, encode, decode, text: str = "text") -> DataFrame:
    """Tokens a character and a word, unknown tokens, exact round trips."""
    from ..functions.text import word_count

    rows = rows.select(F.col(text).alias("t")).withColumn("ids", encode(F.col("t")))
    return rows.agg(
        F.sum(F.size("ids")).cast("long").alias("tokens"),
        F.round(F.sum(F.size("ids")) / F.greatest(F.sum(F.length("t")), F.lit(1)), 3).alias("tokens_per_char"),
        F.round(F.sum(F.size("ids")) / F.greatest(F.sum(word_count("t")), F.lit(1)), 3).alias("tokens_per_word"),
        F.sum(F.size(F.filter("ids", lambda i: i == UNK))).cast("long").alias("unk_tokens"),
        F.sum((decode(F.col("ids")) == F.col("t")).cast("int")).cast("long").alias("exact"),
    )


def text_to_stream(rows: DataFrame, encode, ord: str, text: str = "text", bos: bool = True, eos: bool = True) -> DataFrame:
    """Ord, line, ids of each full line."""
    lines = rows.select(F.col(ord), F.posexplode(F.split(text, "\n")).alias("line", "t")).withColumn("t", F.regexp_replace("t", "(?U)^\\s+|\\s+$", "")).where("t <> ''")
    parts = ([ints(BOS)] if bos else []) + [encode(F.col("t"))] + ([ints(EOS)] if eos else [])
    return lines.select(ord, F.col("line").cast("long").alias("line"), F.concat(*parts).alias("ids"))


def unknown_target(examples: DataFrame, encode) -> DataFrame:
    """P25: adds target_unk, whether the target holds a token that the tokenizer doesn't know."""
    return examples.withColumn("target_unk", F.array_contains(encode(F.element_at("turns", -1)["text"]), UNK))


def special_ids(meta: dict) -> dict[str, int]:
    """The ids of the special tokens by name, as a tokenizer's metadata give them; those that it lacks have these fixed values."""
    defaults = {"pad": 0, "bos": 1, "eos": 2, "unk": 3, "system": 4, "user": 5, "assistant": 6}
    return {name: meta.get(f"{name}_id", default) for name, default in defaults.items()}
