"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture's characters and so a mean repetition rate. Every
document draws its number of copies from the Poisson distribution of that mean, by inverting the
distribution function at a number hashed from seed and id: no state, the same on any cluster, and a
document's draw doesn't depend on other documents. Copies are exploded and shuffled globally by a hash.

A mean above CHUNK is drawn as a sum of equal parts, each from its own hash: sums of Poisson draws are
Poisson, and the table of the distribution function stays short for any mean.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Mean of one draw at most, and the largest count its table has: a draw of mean 16 is above 96 with probability 1e-40.
CHUNK, TOP = 16.0, 96
#: Sources whose rates may be broadcast: some hundred bytes each, tables included a kilobyte.
MAX_BROADCAST = 50_000
SEED, TEMPERATURE, EPOCHS = 17, 0.5, 1.0


def rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, epochs: float, source: str, text: str) -> DataFrame:
    """source, rate (mean copies), draws, cdf. Sources without a weight share what is left in proportion to characters ** temperature."""
    weights = weights or {}
    sizes = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).cast("double").alias("chars"))
    given = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("source")] if weights else F.lit(None).cast("double")
    sizes = sizes.withColumn("given", given).withColumn("mass", F.when(F.col("given").isNull(), F.pow("chars", F.lit(temperature))))
    sizes = stored(sizes)
    total, masses, fixed = sizes.agg(F.sum("chars"), F.sum("mass"), F.sum("given")).first()
    rest = max(0.0, 1 - (fixed or 0.0)) if weights else 1.0
    share = F.coalesce(F.col("given") / max(1.0, fixed or 0.0), F.lit(rest) * F.col("mass") / (masses or 1.0))
    rate = F.when(F.col("chars") > 0, F.lit(epochs * (total or 0.0)) * share / F.col("chars")).otherwise(F.lit(0.0))
    part = F.greatest(F.col("rate") / F.col("draws"), F.lit(1e-300))
    logs = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(TOP + 1)))
    terms = F.transform(logs, lambda x, k: F.exp(-part + k * F.log(part) - x))
    start = F.array().cast("array<double>")
    cdf = F.aggregate("terms", start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(F.reverse(acc), F.lit(1)), F.lit(0.0)) + x)))
    return sizes.select("source", rate.alias("rate")).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK)).cast("long")).withColumn("terms", terms).select("source", "rate", "draws", cdf.alias("cdf"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts, to 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents' columns in a struct ``doc``, copy (from 1), n_copies, rate and shuffle_key; ordered by the last.

    A null source counts as ""; a null id hashes as "null"; a source without characters has rate 0.
    Repeated rows of one id draw alike. An empty table gives an empty table.
    """
    found = stored(rates(docs, weights, temperature, epochs, source, text))
    if found.count() <= MAX_BROADCAST:
        found = F.broadcast(found)
    ident = F.coalesce(F.col("doc")[key].cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col(source), F.lit("")).alias("source")).join(found, "source")
    drawn = F.transform(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1), lambda j: uniform(F.lit(str(seed)), ident, j.cast("string")))
    draws = F.transform(drawn, lambda u: F.size(F.filter("cdf", lambda x: x <= u)))
    rows = rows.withColumn("n_copies", F.aggregate(draws, F.lit(0), lambda a, x: a + x).cast("long")).where("n_copies > 0")
    rows = rows.select("doc", "rate", "n_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), ident, F.col("copy").cast("string")))
    return rows.select("doc", "copy", "n_copies", "rate", order.alias("shuffle_key")).orderBy("shuffle_key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture, with the documents' columns alone, in its global order."""
    return replicated(docs, **options).select("doc.*")


def op1(docs: DataFrame) -> DataFrame:
    doc = F.col("doc")
    return replicated(docs).select(doc["doc_id"].alias("doc_id"), doc["source"].alias("source"), "copy", "n_copies", F.round("rate", 6).alias("rate"), "shuffle_key", F.sha2(F.coalesce(doc["text"], F.lit("")), 256).alias("text_sha256"))


ORACLE_SQL = f"""
WITH s AS (SELECT coalesce(source, '') AS source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY 1),
w AS (SELECT source, chars, pow(chars, {TEMPERATURE}) AS mass FROM s),
t AS (SELECT sum(chars) AS total, sum(mass) AS masses FROM w),
r AS (SELECT source, CASE WHEN chars > 0 THEN {EPOCHS} * total * (1.0 * mass / masses) / chars ELSE 0 END AS rate FROM w, t),
p AS (SELECT source, rate, greatest(1, ceil(rate / {CHUNK}))::BIGINT AS draws FROM r),
q AS (SELECT source, rate, draws, greatest(rate / draws, 1e-300) AS part FROM p),
k AS (SELECT source, rate, draws, i, exp(-part + i * ln(part) - lgamma(i + 1)) AS term FROM q, range(0, {TOP + 1}) AS g(i)),
c AS (SELECT source, rate, draws, i, sum(term) OVER (PARTITION BY source ORDER BY i) AS cdf FROM k),
l AS (SELECT source, any_value(rate) AS rate, any_value(draws) AS draws, list(cdf ORDER BY i) AS cdf FROM c GROUP BY source),
d AS (SELECT doc_id, documents.source, text, rate, cdf, coalesce(doc_id::VARCHAR, 'null') AS ident, unnest(range(0, draws)) AS j FROM documents JOIN l ON l.source = coalesce(documents.source, '')),
n AS (SELECT doc_id, source, text, ident, rate, sum(len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('{SEED}:' || ident || ':' || j), 1, 13))::BIGINT / {float(1 << 52)}))) AS n_copies FROM d GROUP BY doc_id, source, text, ident, rate),
e AS (SELECT doc_id, source, text, ident, n_copies::BIGINT AS n_copies, rate, unnest(range(1, n_copies::BIGINT + 1)) AS copy FROM n WHERE n_copies > 0)
SELECT doc_id, source, copy, n_copies, round(rate, 6) AS rate, md5('{SEED}:order:' || ident || ':' || copy) AS shuffle_key, sha256(coalesce(text, '')) AS text_sha256 FROM e
"""
