"""Sources: JSON lines, wiki dumps, book catalogs, byte files, token binaries, manifests."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import markup

DOCUMENT = "source string, doc_id string, title string, text string, lang string"
SOURCE_RECORD = "source_name string, source_url string, source_type string, language string, license string, retrieval_date string, raw_size_bytes long, sha256 string, status string, notes string, title string"
MESSAGE = "message_id string, parent_id string, message_tree_id string, role string, rank int, text string, split string"
SKIPPED_TITLES = "^(?:File|Image|Category|Template|Media|Wikipedia|Help|Portal|Special|Module):"  # fixed values


def json_lines(spark: SparkSession, path: str, schema: str | Ty.StructType = DOCUMENT) -> DataFrame:
    """One object a line, blank lines skipped; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def texts_of(docs: DataFrame) -> DataFrame:
    """S3: the texts, "" where there is none."""
    return docs.select(F.coalesce("text", F.lit("")).alias("text"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Source records; none if there is no such path. Asks Spark's file system, so any store works."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], SOURCE_RECORD)
    return json_lines(spark, path, SOURCE_RECORD)


def metadata(spark: SparkSession, path: str, required: bool = False) -> dict:
    """A JSON object from any store; {} if there is no such path, unless it is required."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        if required:
            raise FileNotFoundError(f"required metadata are missing: {path}")
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def unknown_records(new: DataFrame, known: DataFrame) -> DataFrame:
    """Records whose source isn't in the manifest yet."""
    return new.join(known.select("source_name"), "source_name", "left_anti")


def wiki_dump(spark: SparkSession, path: str, source: str, lang: str) -> DataFrame:
    """Articles of a MediaWiki dump (bzip2 splits): main namespace, no redirects, no special titles, 50 characters of prose at least."""
    page = "title string, ns string, id string, redirect struct<_title: string>, revision array<struct<text: struct<_VALUE: string>>>"
    rows = spark.read.format("xml").option("rowTag", "page").schema(page).load(path)
    text = F.element_at("revision", -1)["text"]["_VALUE"]
    rows = rows.where("ns = '0' AND redirect IS NULL").where(~F.col("title").rlike(SKIPPED_TITLES)).where(F.trim(text) != "")
    rows = rows.select(F.lit(source).alias("source"), F.col("id").alias("doc_id"), "title", markup.prose_of_wikitext(text).alias("text"), F.lit(lang).alias("lang"))
    return rows.where(F.length("text") >= 50)


def book_catalog(spark: SparkSession, path: str, first: int = 400) -> DataFrame:
    """The first English texts of a catalog in CSV (gzip as well): number and title."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    english = F.arrays_overlap(F.transform(F.split("Language", ","), lambda x: F.trim(x)), F.array(F.lit("en"), F.lit("en_US"), F.lit("en-GB")))
    rows = rows.where(english & (F.col("Type") == "Text") & F.col("`Text#`").rlike("^\\d+$"))
    title = F.substring(F.regexp_replace("Title", "\\r\\n|[\\r\\n]", " "), 1, 120)
    return rows.withColumn("__at", F.monotonically_increasing_id()).orderBy("__at").limit(first).select(F.col("`Text#`").cast("long").alias("number"), title.alias("title"))


def books(spark: SparkSession, path: str, most: int, source: str = "gutenberg", lang: str = "en") -> DataFrame:
    """Bodies of local e-texts, 10,000 characters at least, the first ``most`` by path. Bytes are decoded as UTF-8, else Windows-1252."""
    rows = spark.read.format("binaryFile").load(path).select("path", markup.body_of_book(markup.text_of_bytes("content")).alias("text"))
    rows = rows.where(F.length("text") >= 10_000).orderBy("path").limit(most)
    return rows.select(F.lit(source).alias("source"), F.regexp_extract("path", "([^/]+?)(?:\\.[^./]*)?$", 1).alias("doc_id"), F.lit("").alias("title"), "text", F.lit(lang).alias("lang"))


def token_binary(spark: SparkSession, path: str, start: float = 0.0, end: float = 1.0) -> DataFrame:
    """Pos and token of files of little-endian 16-bit tokens, each file's share from start to end. A file is one task's; write a corpus as many."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(content, "<u2")
                lo, hi = int(len(ids) * start), int(len(ids) * end)
                for at in range(lo, hi, 1 << 20):
                    part = ids[at : min(hi, at + (1 << 20))].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at - lo, at - lo + len(part)), pa.int64()), pa.array(part)], names=["path", "pos", "token"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos long, token int")


def checked_binary(spark: SparkSession, path: str, expected: int | None = None) -> int:
    """The tokens in a binary; fails if it is missing, of odd size, or not of the expected count."""
    found = spark.read.format("binaryFile").load(path).agg(F.sum("length"), F.max(F.col("length") % 2)).first()
    if found[0] is None or found[1]:
        raise ValueError(f"{path}: no whole 16-bit tokens")
    n = found[0] // 2
    if expected is not None and n != expected:
        raise ValueError(f"{path}: {n} tokens, not {expected}")
    return n


def capped(spark: SparkSession, path: str, most: int = 2 << 30) -> str:
    """S9's cap, for local copies: the path, if its bytes are within the cap."""
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"{path} has {size} bytes, over {most}")
    return path


def dialog_splits(dialogs: DataFrame, lists: DataFrame) -> DataFrame:
    """A dialog's official split: dev and test are val, before train; else by its bucket. ``lists`` has id and list."""
    from ..operators.chat import train_or_val

    ranked = lists.groupBy("id").agg(F.max(F.col("list").isin("dev", "test")).alias("__val"))
    return dialogs.join(ranked, "id", "left").withColumn("split", F.when(F.col("__val"), "val").when(~F.col("__val"), "train").otherwise(train_or_val(F.col("id").cast("string")))).drop("__val")


def first_of_id(rows: DataFrame, key: str, ord: str) -> DataFrame:
    """Of repeated ids the first row; an aggregated minimum that is joined back, so a hot id is no window."""
    firsts = rows.groupBy(key).agg(F.min(ord).alias("__first"))
    return rows.join(firsts, key).where(F.col(ord) == F.col("__first")).drop("__first")
