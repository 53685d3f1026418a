"""Sinks: JSON lines, corpus text, token binaries, hashes of files, the sources' page."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, *partition_by: str, mode: str = "errorifexists") -> int:
    """K1 to K3: one object a line, text as UTF-8; returns the rows written, counted on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    out = df.observe(seen, F.count("*").alias("n")).write.mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).json(path)
    return seen.get["n"]


def write_corpus_text(docs: DataFrame, path: str, ord: str, languages: list[str]) -> tuple[int, int]:
    """K4: texts, each followed by an empty line, by language and then by ``ord``; returns documents and characters."""
    place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang"))
    rows = docs.where(place > 0)
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text") + 2), F.lit(0))).first()
    rows.orderBy(place, ord).select(F.concat("text", F.lit("\n")).alias("value")).write.text(path)
    return n, chars


def corpus_text_hash(spark: SparkSession, path: str) -> str:
    """K4: SHA-256 of the corpus text, its parts in order."""
    return hash_of_all(spark, f"{path}/part-*")


#: Bytes of tokens in a row of a token table, and in a range that one task writes.
PART_BYTES, RANGE_BYTES = 32 << 20, 256 << 20


def write_token_binary(rows: DataFrame, path: str, ord: str, ids: str = "ids", files: int | None = None) -> DataFrame:
    """Writes the tokens in the order of ``ord`` (a number) as bytes of 16-bit tokens, into a table (part, tokens, sha256, content), and returns its summary.

    A task takes a range of the order, of RANGE_BYTES where ``files`` doesn't say how many, and writes rows
    of PART_BYTES and less than one document more. Parts in order make the stream; ``join_parts`` puts
    them into one file where one is wanted.
    """
    ranged = rows.select(F.col(ord).cast("long").alias("o"), F.col(ids).alias("ids"))
    if files is None:
        files = 2 * (ranged.agg(F.sum(F.size("ids"))).first()[0] or 0) // RANGE_BYTES + 1

    def run(batches):
        first, parts, size = None, [], 0

        def part():
            content = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([len(content) // 2], pa.int64()), pa.array([hashlib.sha256(content).hexdigest()]), pa.array([content], pa.binary())], names=["part", "tokens", "sha256", "content"])

        for batch in batches:
            for o, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                first = o if first is None else first
                parts.append(tokens.values.to_numpy(zero_copy_only=False).astype("<u2").tobytes() if len(tokens) else b"")
                size += len(parts[-1])
                if size >= PART_BYTES:
                    yield part()
                    first, parts, size = None, [], 0
        if first is not None:
            yield part()

    ranged.repartitionByRange(files, "o").sortWithinPartitions("o").mapInArrow(run, "part long, tokens long, sha256 string, content binary").write.parquet(path)
    return rows.sparkSession.read.parquet(path).select("part", "tokens", "sha256")


def join_parts(spark: SparkSession, path: str, file: str) -> str:
    """Writes the parts of a token table into one local file, a part at a time, and returns its SHA-256."""
    h, table = hashlib.sha256(), spark.read.parquet(path)
    with open(file, "wb") as out:
        for row in table.select("part").orderBy("part").toLocalIterator():
            content = table.where(F.col("part") == row["part"]).first()["content"]
            h.update(content)
            out.write(content)
    return h.hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """K7: path, length and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def hash_of_all(spark: SparkSession, path: str) -> str:
    """K7: SHA-256 of all files' bytes in the order of their paths, a file at a time."""
    h = hashlib.sha256()
    for row in spark.read.format("binaryFile").load(path).orderBy("path").select("content").toLocalIterator():
        h.update(row["content"])
    return h.hexdigest()


def sources_page(records: DataFrame, ord: str) -> str:
    """K6: the sources as a page of Markdown. Records are few."""
    shown = F.coalesce(F.when(F.col("title") != "", F.col("title")), "source_name")
    cells = [shown, *map(F.col, ("language", "source_type", "license", "retrieval_date", "status"))]
    rows = records.orderBy(ord).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("cells"), F.concat_ws(": ", F.concat(F.lit("- "), shown), "source_url").alias("link")).collect()
    return "\n".join([PAGE_HEAD, *(r.cells for r in rows), "", "## URLs", "", *(r.link for r in rows), ""])


def disk_usage(spark: SparkSession, *paths: str) -> DataFrame:
    """A3: path, files and bytes of each folder, with all that is under it but hidden files; no content is read."""
    one = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).select(F.lit(p).alias("path"), "files", "bytes")
    return functools.reduce(DataFrame.unionByName, map(one, paths))


#: Fixed value: how the page begins.
PAGE_HEAD = """# Corpus Sources and Licensing

Every source used to build the training corpus is recorded here and in
`sources.jsonl`. Text is used only from public-domain or permissively
licensed human-written sources.

| Source | Language | Type | License | Retrieved | Status |
|---|---|---|---|---|---|"""


def first_records(records: DataFrame, ord: str) -> DataFrame:
    """A4: the first record of each source."""
    return records.groupBy("source_name").agg(F.min_by(F.struct(*records.columns), ord).alias("r")).select("r.*")


def tokens_of(ids: np.ndarray) -> bytes:
    return np.asarray(ids, "<u2").tobytes()
