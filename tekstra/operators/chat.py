"""Chat data: filters and builders of examples from question-answer rows, message forests and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored

MAX_TARGETS = 4

#: Labels that reject a message.
REJECT_LABELS = ["spam", "sexual_content", "hate_speech", "violence", "not_appropriate", "language_mismatch", "toxicity", "pii"]

#: Prompts held out for evaluation.
EVAL_PROBES = [
    "Kumusta ka?",
    "Bakit mahalaga ang tubig?",
    "Ano ang araw?",
    "Ipaliwanag nang simple kung ano ang gravity.",
    "Pagod ako ngayon. Ano ang pwede kong gawin?",
    "Ano ang pagkakaiba ng ilog at dagat?",
    "Gumawa ng maikling pangungusap tungkol sa mangga.",
    "Ano ang ibig sabihin ng kalayaan?",
    "Mahilig ako sa aso. Ano ang magandang pag-usapan natin?",
    "Ano ang 2 + 2?",
    "Hello, how are you?",
    "Why is water important?",
    "What is the Sun?",
    "Explain gravity simply.",
    "I'm tired today. What can I do?",
    "What is the difference between a river and an ocean?",
    "Write a short sentence about mangoes.",
    "What does freedom mean?",
    "I like dogs. What could we talk about?",
    "What is 2 + 2?",
    "Pangalan ng aso ko ay Bruno.",
    "Ano nga ang pangalan ng aso ko?",
    "My dog's name is Bruno.",
    "What is my dog's name?",
    "Kumain ako ng saging kanina.",
    "Ano ang kinain ko?",
    "Ang paborito kong kulay ay berde.",
    "Anong kulay ang paborito ko?",
    "Nakatira ako sa Maynila.",
    "Saan ako nakatira?",
    "I visited Paris last summer.",
    "Where did I go last summer?",
    "My favorite food is pizza.",
    "What is my favorite food?",
    "I have two cats named Oreo and Luna.",
    "What are my cats' names?",
]


def turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def train_or_val(key: Column | str) -> Column:
    """95 of 100 buckets train."""
    return F.when(T.bucket(key, 100) < 95, "train").otherwise("val")


def content_id(prefix: Column, *parts: Column) -> Column:
    """The first 24 hexadecimal digits of SHA-256 of the parts, joined by bars."""
    return F.concat(prefix, F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


# ---------------------------------------------------------------- filters of sources


def aya_reason(code: Column, kind: Column) -> Column:
    """Why a row is not taken; "" if it is."""
    code, kind = F.lower(T.stripped(code)), T.stripped(kind)
    return F.when(~code.isin("eng", "fil"), "other_language").when(kind == "original-annotations", "").when(F.contains(F.lower(kind), F.lit("re")), "re-annotations").otherwise("other_annotation_type")


def human_reason(lang: Column, synthetic: Column, model: Column, deleted: Column, review: Column, tree: Column, labels: Column) -> Column:
    """The first reason against a message; "" if none. ``labels`` is an array; of a map, take map_keys."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(F.coalesce(lang, F.lit("")) != "en", "language")
        .when(yes(synthetic), "synthetic")
        .when(some(model), "model_name")
        .when(yes(deleted), "deleted")
        .when(~F.coalesce(review, F.lit(True)), "review_result")
        .when(some(tree) & (tree != "ready_for_export"), "tree_state")
        .when(yes(F.arrays_overlap(labels, F.array(*map(F.lit, REJECT_LABELS)))), "labels")
        .otherwise("")
    )


def dolly_reason(instruction: Column, response: Column) -> Column:
    """P21; context isn't looked at."""
    i, r = map(T.stripped, (instruction, response))
    return F.when((i == "") & (r == ""), "empty_both").when(i == "", "empty_instruction").when(r == "", "empty_response").when(T.is_corrupted(i) | T.is_corrupted(r), "corrupt_unicode").otherwise("")


def taskmaster_reason(utterances: Column) -> Column:
    """P22, but for repeated ids: speakers are known by name, others dropped; both must speak."""
    said = lambda who: F.exists(utterances, lambda u: F.lower(T.stripped(u["speaker"])) == who)
    return F.when(F.coalesce(F.size(utterances), F.lit(0)) <= 0, "no_utterances").when(~said("user"), "no_user").when(~said("assistant"), "no_assistant").otherwise("")


def turn_reason(turns: Column, aya_english: Column) -> Column:
    """The first failing check of any turn."""
    some = lambda check: F.exists(turns, lambda t: check(t["text"]))
    a, b = F.element_at(turns, -2)["text"], F.element_at(turns, -1)["text"]
    return F.when(some(lambda t: t == ""), "empty").when(some(T.is_corrupted), "corrupted").when(some(T.is_pathological), "pathological").when(aya_english & ~T.looks_english(a, b), "aya_mislabeled").otherwise("")


# ---------------------------------------------------------------- builders


def carried(rows: DataFrame) -> list[str]:
    """The order of rows, where they have one, goes along with what is built of them."""
    return ["ord"] if "ord" in rows.columns else []


def aya_examples(rows: DataFrame) -> DataFrame:
    """T1."""
    return rows.select(*carried(rows), "id", F.lit("aya").alias("source"), F.col("language_code").alias("lang"), F.array(turn("user", T.tidy("inputs")), turn("assistant", T.tidy("targets"))).alias("turns"), train_or_val("id").alias("split"))


def dolly_examples(rows: DataFrame) -> DataFrame:
    """The context follows the instruction after an empty line."""
    prompt, context, target = T.tidy("instruction"), T.tidy("context"), T.tidy("response")
    rows = rows.withColumns({"__p": prompt, "__c": context, "__t": target}).where("__p <> '' AND __t <> ''")
    whole = F.when(F.col("__c") != "", F.concat("__p", F.lit("\n\n"), "__c")).otherwise(F.col("__p"))
    return rows.select(*carried(rows), "id", F.lit("dolly").alias("source"), F.lit("en").alias("lang"), F.coalesce("category", F.lit("")).alias("category"), F.array(turn("user", whole), turn("assistant", F.col("__t"))).alias("turns"), train_or_val("id").alias("split"))


def chosen_targets(n: Column) -> Column:
    """Which of n assistant turns are targets, from 0: all up to four, else four spread evenly."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(MAX_TARGETS - 1)), lambda k: F.round(k * (n - 1) / (MAX_TARGETS - 1)).cast("int"))
    return F.when(n == 0, F.array().cast("array<int>")).when(n <= MAX_TARGETS, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array_distinct(spread))


def conversation_examples(conversations: DataFrame) -> DataFrame:
    """T4: from id, split, utterances (array of speaker, text): a row for each chosen target with reason ("" if it stands), target (its place) and turns."""
    rows = conversations.withColumn("__said", F.filter(F.transform("utterances", lambda u, i: F.when(u["speaker"] == "assistant", i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("target", F.explode(F.transform(chosen_targets(F.size("__said")), lambda k: F.get("__said", k))))
    role = lambda u: F.when(u["speaker"] == "user", "user").otherwise("assistant")
    rows = rows.withColumn("turns", F.transform(F.slice("utterances", F.lit(1), F.col("target") + 1), lambda u: F.struct(role(u).alias("role"), u["text"].alias("text"))))
    rows = rows.withColumn("__texts", F.transform("turns", lambda t: t["text"]))
    reason = (
        F.when(F.get("utterances", F.lit(0))["speaker"] != "user", "root_not_user")
        .when(F.element_at("__texts", -1) == "", "bad_turns")
        .when(F.array_contains("__texts", ""), "empty_context_turn")
        .when(T.is_corrupted(F.array_join("__texts", " ")), "corrupt_unicode")
        .otherwise("")
    )
    return rows.withColumn("reason", reason).withColumn("ex_id", F.concat(F.lit("tm1-"), F.col("id").cast("string"), F.lit("-"), F.col("target").cast("string"))).drop("__said", "__texts")


def tidy_utterances(rows: DataFrame, conv: str = "conv_id", ord: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations (id, utterances) from one row a turn; roles other than user and assistant are dropped. A conversation is a bounded group."""
    rows = rows.where(F.lower(F.trim(role)).isin("user", "assistant")).select(F.col(conv).alias("id"), F.col(ord).alias("o"), F.lower(F.trim(role)).alias("speaker"), T.tidy(text).alias("text"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("o", "speaker", "text"))).alias("u")).select("id", F.transform("u", lambda u: F.struct(u["speaker"].alias("speaker"), u["text"].alias("text"))).alias("utterances"))


def best_replies(messages: DataFrame) -> DataFrame:
    """Of each parent's assistant messages the one of least rank (none last), then least id; its order is that of the parent's first."""
    key = F.struct(F.coalesce(F.col("rank").cast("long"), F.lit((1 << 62))), "message_id")
    first = [F.min("ord").alias("ord")] if "ord" in messages.columns else []
    best = messages.where("role = 'assistant'").groupBy("parent_id").agg(F.min_by("message_id", key).alias("message_id"), *first).drop("parent_id")
    return messages.drop("ord").join(best, "message_id").select(messages.columns)


def ancestors(messages: DataFrame, key: str = "message_id", parent: str = "parent_id") -> DataFrame:
    """Key and path, the keys from its root down to itself; a parent that isn't there ends the path.

    Paths double: each round joins every unfinished path to that of its top's parent, so a chain of n
    messages takes log2(n) rounds, each a stored table. A cycle of parents is an error.
    """
    nodes = messages.select(F.col(key).alias("id"), F.col(parent).alias("up"))
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("__known"))
    rows = nodes.join(known, "up", "left").select("id", F.when(F.col("__known"), F.col("up")).alias("up"), F.array("id").alias("path"))
    rows = stored(rows)
    while not rows.where("up IS NOT NULL").isEmpty():
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("__next"), F.col("path").alias("__above"))
        more = rows.where("up IS NOT NULL").join(above, "up").select("id", F.col("__next").alias("up"), F.concat("__above", "path").alias("path"))
        if not more.where(F.col("up").isNotNull() & F.array_contains("path", F.col("up"))).isEmpty():
            raise RuntimeError("messages are their own ancestors")
        rows = stored(rows.where("up IS NULL").unionByName(more))
    return rows.select(F.col("id").alias(key), "path")


def forest_examples(messages: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Of each best reply the path from its root, of any depth. max_depth: an error if a path is longer."""
    best = best_replies(messages).select("message_id", "message_tree_id", "split", *carried(messages))
    paths = stored(best.join(ancestors(messages), "message_id"))
    if max_depth is not None and not paths.where(F.size("path") > max_depth).isEmpty():
        raise RuntimeError(f"reply chains deeper than {max_depth}")
    said = messages.select(F.col("message_id").alias("__id"), F.when(F.col("role") == "prompter", "user").otherwise("assistant").alias("role"), T.tidy("text").alias("text"))
    steps = paths.select("message_id", F.posexplode("path").alias("at", "__id")).join(said, "__id")
    turns = steps.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("t"))
    turns = turns.select("message_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    out = paths.join(turns, "message_id").where("turns[0].role = 'user'")
    return out.select(*carried(messages), F.concat(F.lit("oasst-"), "message_id").alias("id"), F.lit("oasst1").alias("source"), F.lit("en").alias("lang"), F.col("message_tree_id").alias("tree_id"), "turns", F.when(F.col("split") == "validation", "val").otherwise("train").alias("split"))


# ---------------------------------------------------------------- held-out prompts, leakage, weights


def probe_hits(examples: DataFrame, probes: DataFrame, key: str = "id") -> DataFrame:
    """The keys of examples one of whose user turns is a probe (column ``text``), whatever its case. Probes are tidied; they are few, and the join says so only if they are."""
    said = examples.select(key, F.explode(F.filter("turns", lambda t: t["role"] == "user")).alias("t")).select(key, F.lower("t.text").alias("__t"))
    wanted = probes.select(F.lower(T.tidy("text")).alias("__t")).distinct()
    return said.join(wanted, "__t", "left_semi").select(key).distinct()


def without_probes(examples: DataFrame, probes: DataFrame, key: str = "id") -> DataFrame:
    return examples.join(probe_hits(examples, probes, key), key, "left_anti")


def eval_probes(spark) -> DataFrame:
    return spark.createDataFrame([(p,) for p in EVAL_PROBES], "text string")


def leaks(examples: DataFrame, key: str) -> DataFrame:
    """Keys that stand in both splits; must be none."""
    return examples.where("split = 'train'").select(key).intersect(examples.where("split = 'val'").select(key))


def sampling_weights(train: DataFrame) -> tuple[dict[tuple[str, bool], float], DataFrame]:
    """Weight and copies of each train row, from token sums by source (few rows).

    While one English source has over half of the effective tokens, the others are raised until it has
    half, ten times at most; Filipino rows are raised to 15% where a factor of four does it.
    """
    sums = {(r["source"], r["fil"]): r["n"] for r in train.groupBy("source", (F.col("lang") == "fil").alias("fil")).agg(F.sum("n_supervised").alias("n")).collect()}
    english = {s: n for (s, fil), n in sums.items() if not fil}
    weight = dict.fromkeys(sorted(english), 1.0)
    for _ in range(10):
        have = {s: english[s] * weight[s] for s in weight}
        total = sum(have.values())
        top = max(have, key=have.get, default=None)
        if top is None or have[top] / max(1.0, total) <= 0.5:
            break
        for s in weight:
            weight[s] *= 1 if s == top else have[top] / max(1.0, total - have[top])
    effective, fil = sum(english[s] * weight[s] for s in weight), sum(n for (_, f), n in sums.items() if f)
    fil_weight = min(4.0, max(1.0, 0.15 / 0.85 * effective / fil)) if fil and effective else 1.0
    weights = {(s, f): weight.get(s, 1.0) * (fil_weight if f else 1.0) for s, f in sums}
    table = train.sparkSession.createDataFrame([(s, f, round(w, 4), max(1, round(w))) for (s, f), w in weights.items()], "source string, __fil boolean, weight double, copies long")
    # As many rows as sources, twice: a bounded table.
    return weights, train.withColumn("__fil", F.col("lang") == "fil").join(F.broadcast(table), ["source", "__fil"]).drop("__fil")


def oversampled(train: DataFrame) -> DataFrame:
    """Each row ``copies`` times, copy from 0."""
    return train.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
