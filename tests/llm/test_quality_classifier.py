import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tekstra.llm import quality_classifier as qc


@pytest.fixture(scope="module")
def rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return qc.op7(docs, labels).join(labels, "doc_id", "left").collect()


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    y = np.array(labels)[:] == 1
    return (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_held_out_accuracy(rows):
    mine = [r for r in rows if r.held_out and r.quality is not None]
    assert len(rows) == 1000 and auc([r.score for r in mine], [r.quality for r in mine]) > 0.95
    assert sum(r.predicted == r.quality for r in mine) > 0.93 * len(mine)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_held_out_labels_and_names_change_nothing(spark, documents, rows):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in qc.op7(docs.withColumn("lang", F.lit("xx")).drop("source"), other).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_equals_plain_moments():
    rng = np.random.default_rng(0)
    data = {k: rng.normal(k, 1 + k, (200, qc.D)) for k in (0, 1)}
    model = qc.discriminant({k: (len(x), x.sum(0), x.T @ x) for k, x in data.items()})
    for mean, factor, logdet in model.classes:
        cov = np.linalg.inv(factor.T @ factor)
        assert np.isclose(np.linalg.slogdet(cov)[1], logdet)
    x = rng.normal(0, 1, (5, qc.D))
    want = []
    for mean, factor, logdet in model.classes:
        cov = np.linalg.inv(factor.T @ factor)
        want.append([-0.5 * (v - mean) @ np.linalg.inv(cov) @ (v - mean) - 0.5 * logdet for v in x])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(np.subtract(want[1], want[0]) + model.prior, -30, 30))))


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, None, 0), (2, 7, 0), (3, 1, 1), (3, 1, 1), (4, 0, 0), (5, 0, 0), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    out = qc.op7(odd_docs, labels)
    assert out.count() == odd_docs.count() and all(0 <= r.score <= 1 for r in out.collect())
    assert {r.score for r in qc.op7(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert qc.op7(no_docs, labels).count() == 0


def test_covariances_are_shrunk_as_the_formula_says():
    """Pooling, shrinkage towards the diagonal and the floor, from the rows themselves; scores from solved systems, not from the cached factors."""
    rng = np.random.default_rng(3)
    mix = rng.normal(0, 1, (qc.D, qc.D))
    data = {0: rng.normal(0, 1, (40, qc.D)) @ mix, 1: 0.5 + rng.normal(0, 2, (300, qc.D))}
    model = qc.discriminant({k: (len(x), x.sum(0), x.T @ x) for k, x in data.items()})
    own = {k: np.cov(x.T, bias=True) for k, x in data.items()}
    pooled = (40 * own[0] + 300 * own[1]) / 340
    x, density = rng.normal(0, 1, (50, qc.D)), {}
    for k, n in ((0, 40), (1, 300)):
        lean = min(1.0, qc.POOL + qc.D / (n + qc.D))
        cov = (1 - lean) * own[k] + lean * pooled
        cov = np.where(np.eye(qc.D, dtype=bool), cov, (1 - qc.DIAGONAL) * cov) + np.diag(1e-4 + 1e-3 * np.diag(pooled))
        gap = x - data[k].mean(0)
        density[k] = -0.5 * np.einsum("ij,ij->i", gap, np.linalg.solve(cov, gap.T).T) - 0.5 * np.linalg.slogdet(cov)[1]
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0] + np.log(301 / 41), -30, 30)))
    assert np.abs(model.score(x) - want).max() < 1e-8


def test_statistics_equal_their_definitions():
    import math
    import random
    import re
    from collections import Counter

    rng = random.Random(5)
    texts = ["", " \n", "a", "The cat, the dog. The cat!\nThe cat, the dog. The cat!\n", "x" * 500, "naïve café #$% | {}[] 123", "".join(rng.choices("ab .,\n|#1'Z\x01", k=900))]
    for text in texts:
        raw = text.encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        n, size = len(words), max(1, len(raw))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        pairs = list(zip(words, words[1:]))
        share = lambda chars: math.log1p(200 * sum(raw.count(bytes([c])) for c in chars) / size)  # noqa: B023, E731
        p = [c / size for c in Counter(raw).values()]
        want = {
            "words": min(math.log1p(n), qc.ENOUGH), "word_length": math.log1p(sum(map(len, words)) / max(1, n)), "longest_word": math.log1p(max(map(len, words), default=0)),
            "marks": share(b"#*$%&<>@^~{}[]\\_="), "pipes": share(b"|"), "stops": share(b".!?"), "commas": share(b",;:"), "digits": share(b"0123456789"), "capitals": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "quotes": share(b"\"'()-"), "odd_bytes": share([x for x in range(32) if x not in (9, 10, 13)]),
            "distinct": (len(set(words)) + 1) / (n + 1) * math.log(n + 2), "top_word": math.sqrt(max(Counter(words).values(), default=0) / max(1, n)),
            "repeated_lines": math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0, "line_length": math.log1p(n / max(1, len(lines))), "entropy": -sum(x * math.log2(x) for x in p), "repeats": math.sqrt(1 - len(set(pairs)) / len(pairs)) if pairs else 0,
        }
        assert np.allclose(qc.statistics(raw), [want[k] for k in qc.NAMES], atol=1e-9), text
