"""Local copies of the four chat sources, as rows with ``reason`` ("" where a row is taken) and the columns that builders take.

Files are JSON lines, JSON arrays or Parquet, with the sources' own columns; a missing column reads as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat
from . import readers

AYA = "language_code string, language string, annotation_type string, inputs string, targets string"
#: labels is an array of names or an object whose keys are names; it is read as it stands.
MESSAGES = "message_id string, parent_id string, message_tree_id string, role string, rank int, text string, lang string, synthetic boolean, model_name string, deleted boolean, review_result boolean, tree_state string, labels string"
DOLLY = "instruction string, context string, response string, category string"
DIALOGS = "conversation_id string, domain string, utterances array<struct<index: long, speaker: string, text: string>>"


def scan(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """The rows of a file or folder in the order of files and of rows in them, as ``ord``. array: each file is one JSON array."""
    rows = spark.read.schema(schema)
    rows = rows.parquet(path) if path.endswith(".parquet") else rows.option("multiLine", array).option("mode", "FAILFAST").json(path)
    return rows.withColumn("ord", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")))


def label_names(labels: Column) -> Column:
    """The names of labels given as an array or as an object (its keys, not what is under them); none of anything else."""
    listed = F.from_json(labels, "array<string>")
    keys = F.json_object_keys(labels)
    return F.coalesce(F.when(F.ltrim(labels).startswith("{"), keys).when(F.ltrim(labels).startswith("["), listed), F.array().cast("array<string>"))


def aya(rows: DataFrame) -> DataFrame:
    code = F.lower(T.stripped("language_code"))
    said = [F.coalesce(c, F.lit("None")) for c in ("inputs", "targets")]
    ident = chat.content_id(F.concat(F.lit("aya-"), code, F.lit("-")), code, *said)
    return rows.select(*chat.carried(rows), ident.alias("id"), F.lit("aya").alias("source"), code.alias("language_code"), F.coalesce("language", F.lit("")).alias("language"), "inputs", "targets", chat.aya_reason(F.col("language_code"), F.col("annotation_type")).alias("reason"))


def messages(rows: DataFrame, split: str | None = None) -> DataFrame:
    """split: that of the file; else the rows have a column of it."""
    reason = chat.human_reason(*map(F.col, ("lang", "synthetic", "model_name", "deleted", "review_result", "tree_state")), label_names(F.col("labels")))
    rows = rows.withColumn("split", F.lit(split)) if split else rows
    return rows.select(*chat.carried(rows), "message_id", "parent_id", "message_tree_id", "role", "rank", "text", "split", reason.alias("reason"))


def dolly(rows: DataFrame) -> DataFrame:
    i, c, r = map(T.stripped, ("instruction", "context", "response"))
    ident = chat.content_id(F.lit("dolly-"), i, r)
    return rows.select(*chat.carried(rows), ident.alias("id"), F.lit("dolly").alias("source"), F.lit("en").alias("lang"), F.coalesce("category", F.lit("")).alias("category"), i.alias("instruction"), c.alias("context"), r.alias("response"), chat.dolly_reason(F.col("instruction"), F.col("response")).alias("reason"))


def split_lists(spark: SparkSession, path: str) -> DataFrame:
    """id and list (train, dev or test: the file's name) of CSV files with a head, the id in the first column."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(T.stripped(F.col(f"`{rows.columns[0]}`")).alias("id"), F.regexp_extract(F.input_file_name(), "([^/]+)\\.csv$", 1).alias("list"))


def dialogs(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """The first of each id; utterances of user and assistant alone, trimmed; the official split, else that of the id's bucket."""
    rows = readers.first_of_id(rows.withColumnRenamed("conversation_id", "id").where("id IS NOT NULL"), "id", "ord")
    named = F.transform("utterances", lambda u: F.struct(u["index"].alias("index"), F.lower(T.stripped(u["speaker"])).alias("speaker"), T.stripped(u["text"]).alias("text")))
    rows = rows.withColumn("reason", chat.taskmaster_reason(F.col("utterances"))).withColumn("utterances", F.filter(named, lambda u: u["speaker"].isin("user", "assistant")))
    file = F.when(F.col("id").startswith("self"), "self").otherwise("woz")
    return readers.dialog_splits(rows, lists).select("ord", "id", F.lit("taskmaster1").alias("source"), F.lit("en").alias("lang"), F.coalesce("domain", F.lit("")).alias("domain"), file.alias("file"), "utterances", "split", "reason")
