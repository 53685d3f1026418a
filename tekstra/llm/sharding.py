"""Sharding by sampled splitters.

Records are ordered by (text hash, id), so equal texts lie together. A size-weighted sample of keys,
drawn by hash, gives quantile boundaries; records are range-partitioned by them; ranges that came out
overfull are sampled again, denser, and subdivided. Exact bytes and rows before each range, and a
running sum inside it, give each record's place in the global order, and the place gives the shard.
So shards have near equal bytes whatever the keys are, and no task holds more than a range.

A group of equal texts stays in one shard unless it has over a fiftieth of a shard's bytes: a boundary
goes before its group, but groups with several boundaries are cut by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.search import pairs_upto
from .common import stored

SHARDS = 8
#: Ranges for each shard at least, records in a range at most (on average), samples for each range, times the mean at which a range is overfull.
RANGES_A_SHARD, ROWS_A_RANGE, SAMPLES_A_RANGE, OVERFULL = 8, 2_000_000, 40, 2.0
#: Equal rows that one task turns back into rows.
COPIES = 100_000
#: Part of a shard up to which a group of equal texts is kept whole.
WHOLE_GROUP = 1 / 50
LEAST = -(1 << 63)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for all rows equal in id and text, with their number n; bytes: of all of them."""
    body = F.make_valid_utf8(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("tie"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
    )
    return rows.groupBy("doc_id", "tie", "size", "text_crc32", "h").agg(F.count("*").alias("n")).withColumn("bytes", F.col("size") * F.col("n"))


def sample(rows: DataFrame, a_key: float, salt: int) -> list[tuple[int, int, float]]:
    """Keys drawn with probability bytes / a_key (at most 1), by hash; each with the bytes it stands for. Their number is bounded by bytes / a_key."""
    u = F.pmod(F.xxhash64("h", "tie", F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)
    return [(r.h, r.tie, max(r.bytes, a_key)) for r in rows.where(u * a_key < F.col("bytes")).select("h", "tie", "bytes").collect()]


def boundaries(drawn: list[tuple[int, int, float]], a_range: float) -> list[tuple[int, int]]:
    """Keys at the quantiles: the first boundary inside a group of equal texts goes before the group."""
    drawn = sorted(drawn)
    out: list[tuple[int, int]] = []
    weight, due, last = 0.0, a_range, None
    for h, tie, stands_for in drawn:
        if weight >= due:
            out.append((h, tie) if h == last else (h, LEAST))
            last = h
            due = (weight // a_range + 1) * a_range
        weight += stands_for
    return sorted(set(out))


def ranged(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    return rows.withColumn("range", pairs_upto(bounds, "h", "tie"))


def assigned(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row.

    Null text: empty (size 1). Malformed UTF-8 reads as U+FFFD. A null id sorts last. Repeated rows are
    records of their own; which of two identical rows has which slot is open. They go through the ranges
    as one row with their number, so no task orders a third of all rows because they are equal. An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    rows = stored(keyed(docs, key, text))
    n, total, most = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    ranges = max(shards * RANGES_A_SHARD, n // ROWS_A_RANGE + 1)
    a_range = max(1.0, total / ranges)
    bounds = boundaries(sample(rows, max(1.0, a_range / SAMPLES_A_RANGE), 1), a_range)
    for deeper in (1, 2, 3):
        placed = ranged(rows, bounds)
        stats = {r["range"]: (r.c, r.n, r.bytes) for r in placed.groupBy("range").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()}
        overfull = [k for k, (c, _, b) in stats.items() if c > 1 and (b > OVERFULL * a_range or c > OVERFULL * max(ROWS_A_RANGE, n / ranges * 4))]
        if not overfull or deeper == 3:
            break
        finer = a_range / SAMPLES_A_RANGE / 8**deeper
        bounds = sorted({*bounds, *boundaries(sample(placed.where(F.col("range").isin(overfull)), max(1.0, finer), 1 + deeper), a_range / 2)})
    before, starts = (0, 0), []
    for k in range(len(bounds) + 1):
        starts.append((k, *before))
        before = before[0] + stats.get(k, (0, 0, 0))[1], before[1] + stats.get(k, (0, 0, 0))[2]
    # As many rows as ranges: a bounded table.
    starts_of = spark.createDataFrame(starts, "range int, rows_before long, bytes_before long")
    order = Window.partitionBy("range").orderBy("h", "tie")
    group = Window.partitionBy("range", "h")
    running = lambda c: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c)
    local = placed.withColumns({"rows_inside": running("n"), "bytes_inside": running("bytes")})
    local = local.withColumns({"first": F.min("bytes_inside").over(group), "group": F.sum("bytes").over(group)})
    local = local.join(F.broadcast(starts_of), "range")
    if most > COPIES:  # many equal rows: their copies are made by many tasks
        local = local.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))).repartition("range", "h", "tie", "from")
    else:
        local = local.withColumn("from", F.lit(0).cast("long"))
    local = local.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("n") - 1, F.col("from") + COPIES - 1))))
    inside = F.when(F.col("group") * shards <= total * WHOLE_GROUP, F.col("first")).otherwise(F.col("bytes_inside") + F.col("copy") * F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor((F.col("bytes_before") + inside) * shards / F.lit(max(1, total)))).cast("int")
    local = stored(local.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("rows_inside") + F.col("copy")).alias("at")))
    firsts = local.groupBy("shard").agg(F.min("at").alias("first"))
    return local.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> None:
    """Writes the documents under path/shard=N, in the order of their slots. Ids must be unique here."""
    places = assigned(docs, shards, key, text).select(F.col("doc_id").alias("__id"), F.col("shard").alias("shard"), F.col("slot").alias("__slot"))
    joined = docs.join(places, F.col(key).eqNullSafe(F.col("__id"))).drop("__id")
    joined.repartitionByRange(shards, "shard", "__slot").sortWithinPartitions("shard", "__slot").drop("__slot").write.partitionBy("shard").parquet(path)


def op6(docs: DataFrame) -> DataFrame:
    return assigned(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
