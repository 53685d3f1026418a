import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tekstra.llm import mixing


def test_equals_sql(spark):
    for sf in ("0.001", "0.01"):
        path = f"/root/testdata/sf{sf}/documents.parquet"
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        columns = "doc_id source copy n_copies rate shuffle_key text_sha256".split()
        want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({mixing.ORACLE_SQL})").fetchall())
        found = sorted(tuple(r) for r in mixing.op1(spark.read.parquet(path)).select(*columns).collect())
        assert found == want and want


def plain(ident, rate, seed=mixing.SEED):
    draws, total = max(1, math.ceil(rate / mixing.CHUNK)), 0
    for j in range(draws):
        u, k, cdf = int(hashlib.md5(f"{seed}:{ident}:{j}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate / draws)
        while cdf <= u:
            k += 1
            cdf += math.exp(-rate / draws + k * math.log(rate / draws) - math.lgamma(k + 1))
        total += k
    return total


def test_counts_and_large_rates(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.when(F.col("id") < 4, "rare").otherwise("common").alias("source"))
    rows = mixing.replicated(docs, weights={"rare": 0.5, "common": 0.5}).select("doc.doc_id", "doc.source", "n_copies", "rate", "copy").collect()
    counts = {}
    for r in rows:
        assert r.n_copies == plain(r.doc_id, r.rate)
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert all(counts[r.doc_id] == r.n_copies for r in rows)
    rare = sum(c for i, c in counts.items() if i < 4)
    assert {round(r.rate, 3) for r in rows} == {50.0, 0.505} and abs(rare - 200) < 50


def test_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns and out.count() > 0
    assert mixing.mixed(no_docs).count() == 0 and mixing.op1(no_docs).count() == 0
    keys = [r.shuffle_key for r in mixing.op1(odd_docs).collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_matter(documents, parts):
    assert mixing.op1(documents.repartition(parts)).collect() == mixing.op1(documents).collect()
