"""Queries of the chat sources, builders, forests and the chat build. Their rows are made of all conversations, by the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat
from ..sources import chat_sources, readers
from ..sources.spread import table
from . import chat_build
from .registry import BUCKET_SQL, CONV_SQL, ENC_SQL, TIDY_SQL, TOKEN_BLOCK, TOKEN_SQL, WORDS_SQL, _HITS, encode, query

STRIP_SQL = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
#: Turns of users and assistants by their place, with the turn before and after; pairs of a user's turn and the assistant's that follows it.
PAIRS_SQL = """
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, lower(trim(role)) AS role, text FROM conversations WHERE lower(trim(role)) IN ('user', 'assistant')),
n AS (SELECT *, lag(text) OVER w AS context, lead(text) OVER w AS reply, lead(role) OVER w AS next FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
pair AS (SELECT * FROM n WHERE role = 'user' AND next = 'assistant')"""


def placed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("role", F.lower(F.trim("role"))).where("role IN ('user', 'assistant')")
    w = Window.partitionBy("conv_id").orderBy("turn")  # a conversation is a bounded group
    rows = rows.withColumns({"pos": (F.row_number().over(w) - 1).cast("long"), "context": F.lag("text").over(w), "reply": F.lead("text").over(w), "next": F.lead("role").over(w)})
    return rows.drop("turn").withColumn("ord", F.struct("conv_id", "pos"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_turns(spark, sf_dir).where("role = 'user' AND next = 'assistant'")


def turns_md5(turns: Column | str) -> Column:
    return F.md5(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a forest: in a conversation the turn at place p answers that at (p - 1) // 2; the place is the rank for every third."""
    rows = placed_turns(spark, sf_dir)
    ident = lambda pos: F.concat(F.col("conv_id").cast("string"), F.lit("-"), pos.cast("string"))
    return rows.select(
        "ord",
        ident(F.col("pos")).alias("message_id"),
        F.when(F.col("pos") > 0, ident(F.floor((F.col("pos") - 1) / 2))).alias("parent_id"),
        F.col("conv_id").cast("string").alias("message_tree_id"),
        F.when(F.col("role") == "user", "prompter").otherwise("assistant").alias("role"),
        F.when(F.col("pos") % 3 == 0, F.col("pos")).cast("int").alias("rank"),
        "text",
        F.when(F.col("conv_id") % 5 == 0, "validation").otherwise("train").alias("split"),
    )


FOREST_SQL = f"""
m AS (SELECT conv_id, pos, conv_id || '-' || pos AS id, CASE WHEN pos > 0 THEN conv_id || '-' || (pos - 1) // 2 END AS up, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, CASE WHEN pos % 3 = 0 THEN pos END AS rank, {TIDY_SQL.format('text')} AS text FROM p),
best AS (SELECT *, min(pos) OVER (PARTITION BY up) AS first_at FROM m WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY up ORDER BY rank NULLS LAST, id) = 1),
climb AS (SELECT id AS target, up, [{{'speaker': role, 'text': text}}] AS turns FROM best UNION ALL SELECT target, m.up, list_concat([{{'speaker': m.role, 'text': m.text}}], turns) FROM climb JOIN m ON m.id = climb.up),
tree AS (SELECT target, turns, conv_id, first_at FROM (SELECT * FROM climb WHERE up IS NULL) JOIN best ON best.id = target WHERE turns[1].speaker = 'user')"""
MD5_SQL = "md5(array_to_string(list_transform({0}, lambda y: y.speaker || ':' || y.text), chr(10)))"


@query("d10_best_replies", f"WITH {PAIRS_SQL}, m AS (SELECT conv_id || '-' || pos AS message_id, CASE WHEN pos > 0 THEN conv_id || '-' || (pos - 1) // 2 END AS parent_id, CASE WHEN pos % 3 = 0 THEN pos END AS rank, role FROM p) SELECT message_id, parent_id FROM m WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY rank NULLS LAST, message_id) = 1")
def d10(spark, sf_dir):
    return chat.best_replies(spoken(spark, sf_dir)).select("message_id", "parent_id")


@query("j1_ancestors", f"WITH RECURSIVE {PAIRS_SQL}, c AS (SELECT conv_id, pos, pos AS top, [conv_id || '-' || pos] AS path FROM p UNION ALL SELECT conv_id, pos, (top - 1) // 2, list_concat([conv_id || '-' || (top - 1) // 2], path) FROM c WHERE top > 0) SELECT conv_id || '-' || pos AS message_id, array_to_string(path, ' ') AS path FROM c WHERE top = 0")
def j1(spark, sf_dir):
    return chat.ancestors(spoken(spark, sf_dir)).select("message_id", F.array_join("path", " ").alias("path"))


@query("t2_forest_examples", f"WITH RECURSIVE {PAIRS_SQL},{FOREST_SQL} SELECT 'oasst-' || target AS id, conv_id::VARCHAR AS tree_id, CASE WHEN conv_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, len(turns) AS n_turns, {MD5_SQL.format('turns')} AS turns_md5 FROM tree")
def t2(spark, sf_dir):
    rows = chat.forest_examples(spoken(spark, sf_dir))
    return rows.select("id", "tree_id", "split", F.size("turns").cast("long").alias("n_turns"), turns_md5("turns").alias("turns_md5"))


AYA_ID_SQL = "'aya-eng-' || substr(sha256('eng|' || text || '|' || reply), 1, 24)"
DOLLY_ID_SQL = f"'dolly-' || substr(sha256({STRIP_SQL.format('text')} || '|' || {STRIP_SQL.format('reply')}), 1, 24)"
PROMPT_SQL = f"{TIDY_SQL.format('text')} || CASE WHEN {TIDY_SQL.format('context')} <> '' THEN chr(10) || chr(10) || {TIDY_SQL.format('context')} ELSE '' END"


def aya_rows(rows: DataFrame) -> DataFrame:
    rows = rows.select("ord", F.lit(" ENG ").alias("language_code"), F.lit("English").alias("language"), F.lit("original-annotations").alias("annotation_type"), F.col("text").alias("inputs"), F.col("reply").alias("targets"))
    return chat_sources.aya(rows).where("reason = ''")


def dolly_rows(rows: DataFrame) -> DataFrame:
    return chat_sources.dolly(rows.select("ord", F.col("text").alias("instruction"), "context", F.col("reply").alias("response"), F.lit(None).cast("string").alias("category"))).where("reason = ''")


@query(
    "t1_t3_pair_examples",
    f"""WITH {PAIRS_SQL}, e AS (SELECT 'aya' AS source, conv_id, pos, {AYA_ID_SQL} AS id, [{{'speaker': 'user', 'text': {TIDY_SQL.format('text')}}}, {{'speaker': 'assistant', 'text': {TIDY_SQL.format('reply')}}}] AS turns FROM pair
    UNION ALL SELECT 'dolly', conv_id, pos, {DOLLY_ID_SQL}, [{{'speaker': 'user', 'text': {PROMPT_SQL}}}, {{'speaker': 'assistant', 'text': {TIDY_SQL.format('reply')}}}] FROM pair)
    SELECT source, conv_id, pos, id, CASE WHEN {BUCKET_SQL.format('id', 100)} < 95 THEN 'train' ELSE 'val' END AS split, {MD5_SQL.format('turns')} AS turns_md5 FROM e""",
)
def t1(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    both = chat.aya_examples(aya_rows(rows)).unionByName(chat.dolly_examples(dolly_rows(rows)).drop("category"))
    return both.select("source", "ord.conv_id", "ord.pos", "id", "split", turns_md5("turns").alias("turns_md5"))


@query(
    "p17_p18_aya_filter",
    f"""WITH {PAIRS_SQL}, r AS (SELECT conv_id, pos, ['eng', ' FIL ', 'fra'][pos % 3 + 1] AS code, CASE conv_id % 4 WHEN 0 THEN 'original-annotations' WHEN 1 THEN 're-annotations' WHEN 2 THEN 'other' END AS kind FROM p)
    SELECT conv_id, pos, CASE WHEN lower(trim(code)) NOT IN ('eng', 'fil') THEN 'other_language' WHEN kind = 'original-annotations' THEN '' WHEN contains(lower(kind), 're') THEN 're-annotations' ELSE 'other_annotation_type' END AS reason FROM r""",
)
def p17(spark, sf_dir):
    code = F.get(F.array(*map(F.lit, ("eng", " FIL ", "fra"))), (F.col("pos") % 3).cast("int"))
    kind = F.get(F.array(*map(F.lit, ("original-annotations", "re-annotations", "other", None))), (F.col("conv_id") % 4).cast("int"))
    rows = placed_turns(spark, sf_dir).select("ord", code.alias("language_code"), F.lit("").alias("language"), kind.alias("annotation_type"), F.col("text").alias("inputs"), F.col("text").alias("targets"))
    return chat_sources.aya(rows).select("ord.conv_id", "ord.pos", "reason")


@query(
    "p19_p20_message_filter",
    f"""WITH {PAIRS_SQL} SELECT conv_id, pos, CASE WHEN conv_id % 10 = 0 THEN 'language' WHEN pos % 7 = 5 THEN 'synthetic' WHEN conv_id % 11 = 3 THEN 'model_name' WHEN conv_id % 13 = 4 THEN 'deleted' WHEN conv_id % 5 = 1 THEN 'review_result' WHEN conv_id % 6 = 2 THEN 'tree_state' WHEN pos % 6 IN (2, 3) THEN 'labels' ELSE '' END AS reason FROM p""",
)
def p19(spark, sf_dir):
    pos, conv = F.col("pos"), F.col("conv_id")
    labels = F.get(F.array(*map(F.lit, (None, '["quality"]', '["humor", "spam"]', '{"toxicity": {"value": 0.1}}', '{"quality": {"spam": 1}}', "0"))), (pos % 6).cast("int"))
    rows = spoken(spark, sf_dir).withColumns({"conv_id": F.col("ord.conv_id"), "pos": F.col("ord.pos")})
    rows = rows.withColumns(
        {
            "lang": F.when(conv % 10 == 0, "de").otherwise("en"),
            "synthetic": pos % 7 == 5,
            "model_name": F.when(conv % 11 == 3, "m").otherwise(""),
            "deleted": conv % 13 == 4,
            "review_result": F.when(conv % 5 == 1, False).when(conv % 5 == 2, True),
            "tree_state": F.when(conv % 6 == 2, "growing").when(conv % 6 != 3, "ready_for_export"),
            "labels": labels,
        }
    )
    return chat_sources.messages(rows).select("ord.conv_id", "ord.pos", "reason")


@query(
    "p21_pair_filter",
    f"""WITH {PAIRS_SQL}, r AS (SELECT conv_id, pos, CASE WHEN pos % 5 = 2 THEN ' ' || chr(10) WHEN conv_id % 7 = 3 THEN text || '�' ELSE text END AS i, CASE WHEN conv_id % 6 <> 2 THEN reply END AS t FROM pair), s AS (SELECT *, {STRIP_SQL.format("coalesce(i, '')")} AS a, {STRIP_SQL.format("coalesce(t, '')")} AS b FROM r)
    SELECT conv_id, pos, CASE WHEN a = '' AND b = '' THEN 'empty_both' WHEN a = '' THEN 'empty_instruction' WHEN b = '' THEN 'empty_response' WHEN contains(a || b, '�') THEN 'corrupt_unicode' ELSE '' END AS reason FROM s""",
)
def p21(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    rows = rows.withColumn("text", F.when(F.col("pos") % 5 == 2, " \n").when(F.col("conv_id") % 7 == 3, F.concat("text", F.lit("�"))).otherwise(F.col("text"))).withColumn("reply", F.when(F.col("conv_id") % 6 != 2, F.col("reply")))
    found = chat_sources.dolly(rows.select("ord", F.col("text").alias("instruction"), "context", F.col("reply").alias("response"), F.lit("").alias("category")))
    return found.select("ord.conv_id", "ord.pos", "reason")


LISTS_SQL = "l AS (SELECT 'self-' || conv_id // 2 AS id, CASE conv_id % 3 WHEN 0 THEN 'train' ELSE 'dev' END AS list FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 <> 1)"


@query(
    "p22_j2_dialogs",
    f"""WITH d AS (SELECT conv_id, 'self-' || conv_id // 2 AS id, list({{'speaker': lower(trim(role)), 'text': {STRIP_SQL.format("text || ' '")}}} ORDER BY turn) AS u FROM conversations GROUP BY conv_id QUALIFY row_number() OVER (PARTITION BY id ORDER BY conv_id) = 1),
    {LISTS_SQL}, v AS (SELECT id, bool_or(list = 'dev') AS val FROM l GROUP BY id), k AS (SELECT *, list_filter(u, lambda y: y.speaker IN ('user', 'assistant')) AS kept FROM d)
    SELECT d.id, CASE WHEN len(list_filter(kept, lambda y: y.speaker = 'user')) = 0 THEN 'no_user' WHEN len(list_filter(kept, lambda y: y.speaker = 'assistant')) = 0 THEN 'no_assistant' ELSE '' END AS reason, len(kept) AS n,
      CASE WHEN v.val THEN 'val' WHEN NOT v.val THEN 'train' WHEN {BUCKET_SQL.format('d.id', 100)} < 95 THEN 'train' ELSE 'val' END AS split, {MD5_SQL.format('kept')} AS turns_md5 FROM k AS d LEFT JOIN v ON v.id = d.id""",
)
def p22(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    said = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("index"), F.concat(F.lit(" "), F.upper("role")).alias("speaker"), F.concat("text", F.lit(" ")).alias("text")))).alias("utterances"))
    name = F.concat(F.lit("self-"), F.floor(F.col("conv_id") / 2).cast("string"))
    lists = rows.select("conv_id").distinct().where("conv_id % 5 <> 1").select(name.alias("id"), F.when(F.col("conv_id") % 3 == 0, "train").otherwise("dev").alias("list"))
    found = chat_sources.dialogs(said.select(F.col("conv_id").alias("ord"), name.alias("conversation_id"), F.lit("x").alias("domain"), "utterances"), lists)
    plain = F.transform("utterances", lambda u: F.struct(u["speaker"].alias("role"), u["text"].alias("text")))
    return found.select("id", "reason", F.size("utterances").cast("long").alias("n"), "split", turns_md5(plain).alias("turns_md5"))


ODD_TEXTS = ("", "bad � text", "z" * 20, "wax baan kuu sheegi doonaa maanta")


@query(
    "p23_turn_filter",
    f"""WITH {PAIRS_SQL}, r AS (SELECT conv_id, pos, CASE WHEN conv_id % 9 < 4 THEN ['', 'bad � text', '{'z' * 20}', 'wax baan kuu sheegi doonaa maanta'][conv_id % 9 + 1] ELSE {TIDY_SQL.format('text')} END AS a, CASE WHEN conv_id % 9 = 3 THEN 'waa wax aad u wanaagsan oo ku saabsan' ELSE {TIDY_SQL.format('reply')} END AS b, pos % 2 = 0 AS eng FROM pair),
    c AS (SELECT conv_id, pos, unnest([a, b]) AS t, generate_subscripts([a, b], 1) AS k FROM r), ch AS (SELECT conv_id, pos, k, t, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM c WHERE t <> ''),
    s AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, pos, k, c ORDER BY i) AS g FROM ch WHERE NOT regexp_matches(c, '^\\s$')),
    run AS (SELECT conv_id, pos, max(n) AS run FROM (SELECT conv_id, pos, k, count(*) AS n FROM s GROUP BY conv_id, pos, k, c, g) GROUP BY ALL), half AS (SELECT conv_id, pos, max(n / len) AS share FROM (SELECT conv_id, pos, k, count(*) AS n, any_value(length(t)) AS len FROM s GROUP BY conv_id, pos, k, c) WHERE len >= 10 GROUP BY ALL)
    SELECT conv_id, pos, CASE WHEN a = '' OR b = '' THEN 'empty' WHEN contains(a || b, '�') THEN 'corrupted' WHEN coalesce(run, 0) >= 15 OR coalesce(share, 0) >= 0.5 THEN 'pathological' WHEN eng AND ({WORDS_SQL.format('a')} >= 4 OR {WORDS_SQL.format('b')} >= 6) AND {_HITS.format('a')} < 2 AND {_HITS.format('b')} < 2 THEN 'aya_mislabeled' ELSE '' END AS reason
    FROM r LEFT JOIN run USING (conv_id, pos) LEFT JOIN half USING (conv_id, pos)""",
)
def p23(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    odd = F.get(F.array(*map(F.lit, ODD_TEXTS)), (F.col("conv_id") % 9).cast("int"))
    a = F.when(F.col("conv_id") % 9 < len(ODD_TEXTS), odd).otherwise(T.tidy("text"))
    b = F.when(F.col("conv_id") % 9 == 3, "waa wax aad u wanaagsan oo ku saabsan").otherwise(T.tidy("reply"))
    rows = rows.select("conv_id", "pos", F.array(chat.turn("user", a), chat.turn("assistant", b)).alias("turns"))
    return rows.select("conv_id", "pos", chat.turn_reason(F.col("turns"), F.col("pos") % 2 == 0).alias("reason"))


@query("j5_s7_unknown_records", "SELECT DISTINCT source || lang AS source_name FROM documents WHERE lang <> 'en'")
def j5(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.concat("source", "lang").alias("source_name"), "lang").distinct()
    return readers.unknown_records(names.select("source_name"), names.where("lang = 'en'").select("source_name"))


# ---------------------------------------------------------------- the chat build

#: Conversations are dealt to the four sources by id; every turn takes part.
BUILD_SQL = f"""
{PAIRS_SQL},{FOREST_SQL},{CONV_SQL},
ex AS (
  SELECT 0 AS place, conv_id AS o1, pos AS o2, 0 AS o3, {AYA_ID_SQL} AS id, 'aya' AS source, 'eng' AS lang, [{{'speaker': 'user', 'text': {TIDY_SQL.format('text')}}}, {{'speaker': 'assistant', 'text': {TIDY_SQL.format('reply')}}}] AS turns FROM pair WHERE conv_id % 4 = 0
  UNION ALL SELECT 1, conv_id, first_at, 0, 'oasst-' || target, 'oasst1', 'en', turns FROM tree WHERE conv_id % 4 = 1
  UNION ALL SELECT 2, conv_id, pos, 0, {DOLLY_ID_SQL}, 'dolly', 'en', [{{'speaker': 'user', 'text': {TIDY_SQL.format(PROMPT_SQL)}}}, {{'speaker': 'assistant', 'text': {TIDY_SQL.format('reply')}}}] FROM pair WHERE conv_id % 4 = 2
  UNION ALL SELECT 3, conv, 0, target, ex_id, 'taskmaster1', 'en', turns FROM ok WHERE conv % 4 = 3),
q AS (SELECT *, turns[-2].text AS prompt, turns[-1].text AS answer, {{'p': place, 'a': o1, 'b': o2, 'c': o3}} AS ord, source = 'aya' AND ({WORDS_SQL.format('turns[-2].text')} >= 4 OR {WORDS_SQL.format('turns[-1].text')} >= 6) AND {_HITS.format('turns[-2].text')} < 2 AND {_HITS.format('turns[-1].text')} < 2 AS mislabeled FROM ex),
g AS (SELECT * FROM q WHERE NOT mislabeled),
d AS (SELECT *, row_number() OVER w > 1 AS dup, first_value(source) OVER w AS fs, row_number() OVER (PARTITION BY prompt ORDER BY ord) > 1 AS seen FROM g WINDOW w AS (PARTITION BY prompt, answer ORDER BY ord)),
pr AS (SELECT DISTINCT lower({TIDY_SQL.format('text')}) AS t FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations WHERE turn = 0 AND length(text) < 80)),
h AS (SELECT *, list_has_any(list_transform(list_filter(turns, lambda y: y.speaker = 'user'), lambda y: lower(y.text)), pl) AS probe FROM d, (SELECT list(t) AS pl FROM pr)),
judged AS (SELECT *, list_contains({ENC_SQL.format('answer')}, 0) AS unk FROM h)"""


def build_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = lambda rows, k, c="conv_id": rows.where(F.col(c) % 4 == k)
    said, two = spoken(spark, sf_dir), pairs(spark, sf_dir)
    dialogs = chat.tidy_utterances(table(spark, sf_dir, "conversations")).withColumns({"ord": F.struct(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("pos")), "split": chat.train_or_val(F.col("id").cast("string"))})
    return chat_build.examples(aya_rows(mine(two, 0)), mine(said, 1, "ord.conv_id"), dolly_rows(mine(two, 2)), mine(dialogs, 3, "id"))


def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "benchmark").select("text").unionByName(table(spark, sf_dir, "conversations").where("turn = 0 AND length(text) < 80").select("text"))
    return chat_build.built(build_examples(spark, sf_dir), probes, lambda text: encode(text), TOKEN_BLOCK)


#: The examples that reach the tokenizer, as T8's SQL takes them.
FINAL_SQL = TOKEN_SQL.format(block=TOKEN_BLOCK).replace("FROM ok WHERE", "FROM (SELECT id AS ex_id, o1 AS conv, turns FROM judged WHERE NOT dup AND NOT probe AND NOT unk) WHERE")


@query(
    "a9_chat_attrition",
    f"""WITH RECURSIVE {BUILD_SQL},{FINAL_SQL},
    k AS (SELECT source || '_examples' AS stage FROM ex UNION ALL SELECT 'rejected_aya_mislabeled' FROM q WHERE mislabeled UNION ALL SELECT 'after_quality' FROM g
      UNION ALL SELECT 'rejected_duplicates' FROM d WHERE dup UNION ALL SELECT 'dup_pair_' || CASE WHEN fs = source THEN fs ELSE least(fs, source) || '|' || greatest(fs, source) END FROM d WHERE dup
      UNION ALL SELECT 'after_dedup' FROM d WHERE NOT dup UNION ALL SELECT 'prompt_only_duplicates' FROM d WHERE NOT dup AND seen
      UNION ALL SELECT 'rejected_eval_probes' FROM judged WHERE NOT dup AND probe UNION ALL SELECT 'after_probe_exclusion' FROM judged WHERE NOT dup AND NOT probe UNION ALL SELECT 'rejected_target_unk' FROM judged WHERE NOT dup AND NOT probe AND unk
      UNION ALL SELECT CASE WHEN too_long THEN 'rejected_too_long' ELSE 'final_examples' END FROM tok UNION ALL SELECT 'dropped_oldest_turns' FROM tok WHERE dropped_turns)
    SELECT stage, count(*) AS n FROM k GROUP BY stage""",
)
def a9(spark, sf_dir):
    return chat_build.attrition(build(spark, sf_dir))


@query(
    "p25_chat_build_examples",
    f"""WITH RECURSIVE {BUILD_SQL},{FINAL_SQL}
    SELECT q.source, q.id, q.o1 AS conv_id, CASE WHEN mislabeled THEN 'aya_mislabeled' WHEN dup THEN 'duplicate' WHEN probe THEN 'eval_probe' WHEN unk THEN 'target_unk' WHEN too_long THEN 'too_long' ELSE 'final' END AS outcome,
    CASE WHEN NOT too_long THEN array_to_string(ids, ' ') END AS ids, CASE WHEN NOT too_long THEN array_to_string(labels, ' ') END AS labels
    FROM q LEFT JOIN (SELECT ord, dup, probe, unk FROM judged) AS f ON f.ord = q.ord LEFT JOIN tok ON tok.ex_id = q.id AND tok.conv = q.o1 AND NOT dup AND NOT probe AND NOT unk""",
)
def p25(spark, sf_dir):
    said = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    rows = build(spark, sf_dir)
    return rows.select("source", "id", F.col("ord.row.conv_id").alias("conv_id"), "outcome", said("ids"), said("labels"))
