"""A quality classifier: regularised quadratic discriminant analysis of document statistics.

Each whole text gives a vector of statistics, transformed towards normal. The class moments are sums
over all labelled training rows (no sample), gathered as partial sums of batches. Each class has its
own covariance, shrunk towards the pooled one and towards its diagonal; their Cholesky factors are
inverted once and go to the tasks. The score is the logistic of the difference of the classes'
log-densities (Mahalanobis distances and log-determinants) and of the log-prior.

Ids, languages, sources and labels are no inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, utf8

#: Shrinkage: towards the pooled covariance, and of the result towards its diagonal.
POOL, DIAGONAL = 0.3, 0.1
#: Length counts up to about 90 words (as a logarithm): a short text is no outlier then. Chosen on training rows alone.
ENOUGH = 4.5
THRESHOLD = 0.7

NAMES = ("words", "word_length", "longest_word", "marks", "pipes", "stops", "commas", "digits", "capitals", "quotes", "distinct", "top_word", "repeated_lines", "line_length", "entropy", "repeats", "odd_bytes")
D = len(NAMES)
_SETS = {"marks": b"#*$%&<>@^~{}[]\\_=", "pipes": b"|", "stops": b".!?", "commas": b",;:", "digits": b"0123456789", "capitals": bytes(range(65, 91)), "quotes": b"\"'()-", "odd_bytes": bytes(x for x in range(32) if x not in (9, 10, 13))}
_MASKS = np.zeros((256, len(_SETS)))
for _at, _set in enumerate(_SETS.values()):
    _MASKS[list(_set), _at] = 1


def statistics(raw: bytes) -> list[float]:
    """The transformed statistics of a whole text, in the order of NAMES; all defined for an empty text."""
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = dict(zip(_SETS, np.log1p(200 * (counts @ _MASKS) / size).tolist(), strict=True))
    p = counts[counts > 0] / size
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = list(zip(words, words[1:], strict=False))
    n1 = max(1, n)
    got = {
        "words": min(float(np.log1p(n)), ENOUGH),
        "word_length": np.log1p(sum(map(len, words)) / n1),
        "longest_word": np.log1p(max(map(len, words), default=0)),
        "distinct": (len(seen) + 1) / (n + 1) * np.log(n + 2),
        "top_word": np.sqrt(max(seen.values(), default=0) / n1),
        "repeated_lines": np.sqrt(1 - len(set(lines)) / max(1, len(lines))) if lines else 0.0,
        "line_length": np.log1p(n / max(1, len(lines))),
        "entropy": float(-(p * np.log2(p)).sum()),
        "repeats": np.sqrt(1 - len(set(pairs)) / len(pairs)) if pairs else 0.0,
        **share,
    }
    return [float(got[x]) for x in NAMES]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [statistics(x) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["key", "x"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key).alias("key"), utf8(text).alias("raw")), make, f"key {kind}, x array<double>")


@dataclass
class Discriminant:
    """prior: log-odds of class 1. For each class: mean, inverse Cholesky factor, log-determinant. None: a class had no rows."""

    prior: float
    classes: list[tuple[np.ndarray, np.ndarray, float]] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        density = [-0.5 * (((x - mean) @ factor.T) ** 2).sum(1) - 0.5 * logdet for mean, factor, logdet in self.classes]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -30, 30)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL, diagonal: float = DIAGONAL) -> Discriminant:
    """From each class's count, sums and sums of products."""
    n = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n.values()) < 2:
        return Discriminant(prior, None)
    means = {k: moments[k][1] / n[k] for k in n}
    own = {k: moments[k][2] / n[k] - np.outer(means[k], means[k]) for k in n}
    pooled = (own[0] * n[0] + own[1] * n[1]) / (n[0] + n[1])
    floor = np.diag(1e-4 + 1e-3 * np.diag(pooled))
    out = []
    for k in (0, 1):
        # A class of few rows leans on the pooled covariance more.
        lean = min(1.0, pool + D / (n[k] + D))
        cov = (1 - lean) * own[k] + lean * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + floor
        lower = np.linalg.cholesky(cov)
        out.append((means[k], np.linalg.inv(lower), float(2 * np.log(np.diag(lower)).sum())))
    return Discriminant(prior, out)


def fitted(rows: DataFrame) -> Discriminant:
    """From rows (label, x): partial sums by batch, summed by class and place."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, D)
            out = []
            for k in (0, 1):
                mine = x[labels == k]
                if len(mine):
                    out.append((k, np.concatenate([[len(mine)], mine.sum(0), (mine.T @ mine).ravel()]).tolist()))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([v for _, v in out], pa.list_(pa.float64()))], names=["label", "sums"])

        return each

    sums = map_batches(rows, make, "label int, sums array<double>").select("label", F.posexplode("sums").alias("at", "value")).groupBy("label", "at").agg(F.sum("value").alias("value"))
    found: dict[int, np.ndarray] = {}
    for r in sums.collect():  # at most 2 x (1 + D + D * D) rows
        found.setdefault(r["label"], np.zeros(1 + D + D * D))[r["at"]] = r["value"]
    return discriminant({k: (v[0], v[1 : D + 1], v[D + 1 :].reshape(D, D)) for k, v in found.items()})


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, held_out, score and predicted for each row.

    Null or empty text: scored like any other, from the statistics of an empty text. A null id is not
    held out and has no label. Labels that are null or neither 0 nor 1 aren't learned from; without
    labels of both classes the score is the prior (0.5 without any). Repeated rows score alike and
    count as often as they come. An empty table gives an empty table.
    """
    found = stored(features(docs, key, text))
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    train = found.where(~held_out(F.col("key"))).join(known, "key").select("label", "x")
    model = fitted(train)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, D)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["key", "score"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    out = map_batches(found, make, f"key {kind}, score double")
    return out.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels)
