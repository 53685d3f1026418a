import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tekstra.llm import near_dedup as nd


def brute(rows, words=2):
    """doc_id -> (size, component) by comparing all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in index[x]:
                shared[j] += 1
            index[x].append(i)
        for j, c in shared.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(s), least.get(root(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(map(repr, brute(rows)))
    found = nd.op10(docs).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in found) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)


def test_documents_equal_brute_force(spark, documents):
    check(documents)
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert nd.op10(no_docs).count() == 0 and nd.deduplicated(no_docs).count() == 0


def test_five_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(d, c) for d, _, c in brute([(r.doc_id, r.text) for r in docs.collect()], 5)}
    assert {(r.id, r.component) for r in nd.memberships(docs, words=5).collect()} == want
    assert {r.doc_id for r in nd.deduplicated(docs, words=5).collect()} == {c for _, c in want}


def test_a_stranger_in_a_large_bucket_costs_as_many_pairs_as_it_has_members(spark, monkeypatch):
    n = 20_000
    node = F.unhex(F.lpad(F.hex("id"), 16, "0"))
    members = spark.range(n + 1).select(node.alias("node"), F.lit(0).alias("band"), F.lit(7).cast("long").alias("value"), F.lit(n + 1).alias("size"))
    near = members.select("node", F.lit(9).cast("long").alias("n"), F.array_repeat(F.lit(1).cast("long"), nd.BANDS).alias("bands"), F.repeat(F.lit("x"), nd.BITS // 8).cast("binary").alias("bits"))
    comps = spark.range(n).select(node.alias("node"), F.unhex(F.lit("00" * 8)).alias("comp"))  # the last one is a stranger
    blocks = nd.open_blocks(members, near, comps).groupBy("i", "j").agg(F.count_if(F.col("own") == F.col("i")).alias("x"), F.count_if(F.col("own") == F.col("j")).alias("y")).collect()
    assert sum(b.x * b.y for b in blocks) < 1_000_000
    assert sum(b.x + b.y for b in blocks) < 2 * n
    # Every pair of nodes in different components stands in exactly one pair of blocks.
    monkeypatch.setattr(nd, "BLOCK", 3)
    comps = spark.range(20).select(node.alias("node"), F.unhex(F.lpad(F.hex(F.pmod("id", F.lit(4)) * F.when(F.col("id") < 12, 0).otherwise(1)), 16, "0")).alias("comp"))
    rows = nd.open_blocks(members.limit(24), near.limit(24), comps).collect()
    groups, comp = defaultdict(list), {}
    for r in rows:
        groups[r.i, r.j].append(r)
        comp[bytes(r.node)] = bytes(r.comp)
    seen = Counter()
    for (i, j), held in groups.items():
        for x in held:
            for y in held:
                if x.own == i and y.own == j and x.comp != y.comp and (i != j or x.node < y.node):
                    seen[frozenset([bytes(x.node), bytes(y.node)])] += 1
    assert seen == {frozenset([x, y]): 1 for x in comp for y in comp if x < y and comp[x] != comp[y]}


def families(n, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], rng.choices(vocabulary, k=120)
    for i in range(n):
        w = list(base if i % 2 else rng.choices(vocabulary, k=rng.randint(1, 12)))
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows


def test_large_group_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 32)  # several blocks a bucket
    check(spark.createDataFrame(families(500), "doc_id long, text string"))


def test_large_groups_of_copies_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT", 5)
    rows = families(120) + [(1000 + i, "the very same words in every one of these rows") for i in range(60)] + [(2000 + i, "the very same words in every one of these") for i in range(4)] + [(3000 + i, None) for i in range(9)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_one_document_of_each_group_stays(spark, odd_docs):
    docs = spark.createDataFrame(families(200) + families(20), "doc_id long, text string").selectExpr("*", "'x' as component", "1 as id")
    found = nd.op10(docs).collect()
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in found})
    assert nd.deduplicated(odd_docs).count() == len(nd.op10(odd_docs).where("n_shingles > 0").select("component_id").distinct().collect()) + 3


def test_unrelated_components_of_one_least_id_stay_apart(spark):
    copies = [" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(61))]
    texts = [(None, "one clean text about rivers"), (None, "another text of quite other words"), (7, "first of two that share an id"), (7, "nothing in common with it"), (None, copies[0]), (None, copies[1]), (None, copies[1])]
    kept = [r.text for r in nd.deduplicated(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert sorted(set(kept) - set(copies)) == sorted(t for _, t in texts[:4])
    assert len(kept) == 5


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for n, both in ((30, 24), (400, 350), (3000, 1000)):
        got = []
        for _ in range(40):
            x = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
            a, b = nd.registers(np.sort(x[:n])), nd.registers(np.sort(x[n - both :]))
            got.append(nd.estimate(a, b, n, n))
        assert abs(np.mean(got) - both / (2 * n - both)) < 0.02
    disjoint = [nd.estimate(nd.registers(rng.integers(0, 2**64, 500, dtype=np.uint64)), nd.registers(rng.integers(0, 2**64, 500, dtype=np.uint64)), 500, 500) for _ in range(50)]
    assert np.mean(disjoint) < 0.002


def test_bitmaps_bound_the_intersection():
    rng = np.random.default_rng(2)
    for n in (1, 50, 3000, 20_000):
        x = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
        a, b = x[: len(x) * 2 // 3], x[len(x) // 3 :]
        p, q = (np.frombuffer(nd.bitmap(s), np.uint64) for s in (a, b))
        assert min(len(a) - np.bitwise_count(p & ~q).sum(), len(b) - np.bitwise_count(q & ~p).sum()) >= len(np.intersect1d(a, b))


def test_sql_says_the_same():
    import duckdb
    import pyarrow.parquet as pq

    for sf in ("0.001", "0.01"):
        path = f"/root/testdata/sf{sf}/documents.parquet"
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        rows = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
        assert sorted(con.sql(f"SELECT doc_id, n_shingles, component_id FROM ({nd.ORACLE_SQL})").fetchall()) == sorted(brute([(r["doc_id"], r["text"]) for r in rows]))
