"""Samples, shuffles and evaluation subsets by hash: stateless, the same on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, *keys: Column | str) -> Column:
    """A pseudo-random order: SHA-256 of seed and keys."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k for k in keys)), 256)


def sample_each(docs: DataFrame, n: int, key: str, by: str = "lang", seed: int = 1234, excerpt: int = 300) -> DataFrame:
    """Of each language n documents without replacement, by a seeded hash, with an excerpt."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("__r", key))
    return docs.withColumn("__r", seeded(seed, key)).withColumn("rank", rank).where(F.col("rank") <= n).select(by, key, F.col("rank").cast("long").alias("rank"), F.substring("text", 1, excerpt).alias("excerpt"))


def indices(n: int, size: int, seed: int) -> list[int]:
    """N places in 0..size-1, with replacement, by a multiplicative rule (fixed values)."""
    return [(seed * 2654435761 + i * 40503) % 2**31 % size for i in range(n)]


def deterministic_sample(rows: DataFrame, n: int, seed: int, ord: str) -> DataFrame:
    """Draw, and the row at its place in the order of ``ord``. The places are few; rows are numbered over runs of the order."""
    from .tokens import running_sum

    size = rows.count()
    if not size:
        return rows.withColumn("draw", F.lit(0).cast("long")).limit(0)
    numbered = running_sum(rows.withColumns({"__one": F.lit(1).cast("long"), "__all": F.lit(0)}), "__all", ord, "__one").withColumn("__at", F.col("upto") - 1).drop("__one", "__all", "upto")
    drawn = rows.sparkSession.createDataFrame(list(enumerate(indices(n, size, seed))), "draw long, __at long")
    return numbered.join(drawn, "__at").drop("__at")


def evaluation_subset(rows: DataFrame, batch: int, iterations: int, key: str, seed: int) -> DataFrame:
    """Batch * iterations rows at most, by a seeded hash."""
    return rows.withColumn("__r", seeded(seed, key)).orderBy("__r").limit(batch * iterations).drop("__r")


def epoch_order(rows: DataFrame, seed: int, epoch: int, *keys: str) -> DataFrame:
    """Adds order_key; an epoch's order follows from seed and epoch alone, so a run resumes anywhere."""
    return rows.withColumn("order_key", seeded(seed, F.lit(str(epoch)), *keys))


def epoch_places(rows: DataFrame, seed: int, epoch: int, key: str, a_slice: int = 500_000) -> DataFrame:
    """Adds place (from 1), a row's number in the epoch's order. The order is by a hash, so slices by its first digits are even; their number follows that of the rows."""
    ordered = epoch_order(rows, seed, epoch, key)
    digits = max(2, math.ceil(math.log(max(1, rows.count() / a_slice), 16)))
    ordered = ordered.withColumn("__slice", F.substring("order_key", 1, digits))
    sizes = ordered.groupBy("__slice").agg(F.count("*").alias("n"))
    # One row a slice.
    before = sizes.select("__slice", F.coalesce(F.sum("n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__slice").orderBy("order_key", key))
    return ordered.withColumn("__inside", inside).join(before, "__slice").withColumn("place", F.col("__before") + F.col("__inside")).drop("__slice", "__before", "__inside", "order_key")


def kept_logits(rows: DataFrame, logits: str, temperature: float, top_k: int | None, top_p: float | None, out: str = "ids") -> DataFrame:
    """Adds the ids that sampling may draw, likeliest first: the k largest, ties kept, and of those the ones before which at most top_p of the probability lies.

    What a lambda looks into is a column of its own, so that nothing is computed anew for each element.
    """
    entries = F.transform(F.col(logits).cast("array<double>"), lambda x, i: F.struct((-x / (temperature or 1.0)).alias("neg"), i.alias("id")))
    rows = rows.withColumn("__o", F.sort_array(entries))
    if top_k:
        rows = rows.withColumn("__edge", F.get("__o", F.least(F.lit(top_k), F.size("__o")) - 1)["neg"]).withColumn("__o", F.filter("__o", lambda e: e["neg"] <= F.col("__edge"))).drop("__edge")
    if top_p and 0 < top_p < 1:
        rows = rows.withColumn("__top", F.get("__o", F.lit(0))["neg"])
        rows = rows.withColumn("__w", F.transform("__o", lambda e: F.struct(F.exp(F.col("__top") - e["neg"]).alias("w"), e["id"].alias("id"))))
        rows = rows.withColumn("__total", F.aggregate("__w", F.lit(0.0), lambda a, e: a + e["w"]))
        start = F.struct(F.lit(0.0).alias("before"), F.array().cast("array<int>").alias("ids"))
        step = lambda a, e: F.struct((a["before"] + e["w"]).alias("before"), F.when(a["before"] <= top_p * F.col("__total"), F.concat(a["ids"], F.array(e["id"]))).otherwise(a["ids"]).alias("ids"))
        return rows.withColumn(out, F.aggregate("__w", start, step)["ids"]).drop("__o", "__top", "__w", "__total")
    return rows.withColumn(out, F.transform("__o", lambda e: e["id"])).drop("__o")


def learning_rate(step: Column, max_iters: int, warmup: int, lr: float, min_lr: float) -> Column:
    """Linear warm-up, then a half cosine."""
    ratio = (step - warmup) / max(1, max_iters - warmup)
    return F.when(step < warmup, lr * (step + 1) / max(1, warmup)).when(step > max_iters, F.lit(min_lr)).otherwise(min_lr + 0.5 * (1 + F.cos(ratio * math.pi)) * (lr - min_lr))


def running_loss(losses: Column) -> Column:
    """The moving average 0.9 old, 0.1 new, over an ordered array; its last value."""
    return F.aggregate(losses, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(0.9 * a + 0.1 * x))


def retention(base_loss: Column, baseline: float, eligible: float = 1.10, stop: float = 1.15) -> tuple[Column, Column]:
    """hard_stop and eligible."""
    return base_loss > baseline * stop, base_loss <= baseline * eligible
