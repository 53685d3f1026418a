import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tekstra.llm import sharding


def check(docs, near=True):
    rows, found = docs.select("doc_id", "text").collect(), sharding.op6(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if near:
        mean, most = sum(sizes.values()) / 8, max(r.size for r in found)
        assert all(abs(sizes[k] - mean) <= most + mean / 25 for k in range(8)), sizes
    return found


def test_documents(spark, documents):
    check(documents)
    found = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    shards = defaultdict(set)
    for r in found:
        shards[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 3  # groups over a fiftieth of a shard


def test_hot_text_is_cut(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text again")).otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"))
    found = check(docs)
    assert len({r.shard for r in found if r.text_crc32 == zlib.crc32(b"the same text again")}) > 2


def test_overfull_ranges_are_divided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_A_RANGE", 0.2)
    monkeypatch.setattr(sharding, "OVERFULL", 1.1)
    check(spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text")))


def test_odd_rows(odd_docs, no_docs, tmp_path, documents):
    check(odd_docs, near=False)
    assert sharding.op6(no_docs).count() == 0
    sharding.write_shards(documents, str(tmp_path / "out"))
    back = documents.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard").exceptAll(documents).count() == 0 and back.count() == documents.count()


def plain(rows):
    """Shard and slot of each row, the plain way: all rows in order of text hash and id, cut at equal bytes."""
    import xxhash

    items = []
    for r in rows:
        raw = (r.text or "").encode()
        h = xxhash.xxh64_intdigest(raw, seed=42)
        items.append((h - (1 << 64) if h >> 63 else h, (1 << 63) - 1 if r.doc_id is None else r.doc_id, r.doc_id, len(raw) + 1))
    items.sort(key=lambda x: x[:2])
    total, groups, first, at = sum(x[3] for x in items), Counter(), {}, 0
    for h, _, _, size in items:
        groups[h] += size
        first.setdefault(h, at)
        at += size
    out, counts, at = Counter(), Counter(), 0
    for h, _, doc, size in items:
        place = first[h] if groups[h] * 8 <= total / 50 else at
        shard = min(7, int(place * 8 / total))
        out[doc, shard, counts[shard]] += 1
        counts[shard] += 1
        at += size
    return out


def test_equals_the_plain_way(spark, documents, odd_docs):
    hot = spark.createDataFrame([(1, "the same row") for _ in range(300)] + [(None, f"row {i}") for i in range(300)] + [(i, f"text {i % 100}") for i in range(300)], "doc_id long, text string").repartition(4)
    for docs in (documents, odd_docs, hot, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        assert Counter((r.doc_id, r.shard, r.slot) for r in sharding.op6(docs).collect()) == plain(docs.collect())


def test_copies_of_a_hot_row_are_made_by_many_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the same row")] * 500 + [(i, f"text {i}") for i in range(100, 400)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(sharding, "COPIES", 7)
    assert Counter((r.doc_id, r.shard, r.slot) for r in sharding.op6(docs).collect()) == plain(docs.collect())
