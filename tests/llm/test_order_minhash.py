import hashlib
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tekstra.llm import order_minhash as om

ALL = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(*values):
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True) if not isinstance(v, bool) else b"", seed=h)
    return h


def chain_occurrence(h36, number):
    return xxhash.xxh64_intdigest(number.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(signed(h36).to_bytes(8, "little", signed=True), seed=42))


def plain(text):
    """The fingerprint, the plain way."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    rows = []
    for at in range(max(len(words) - om.K + 1, 1) if words else 0):
        h = (chain(*words[at : at + om.K]) << om.POSITION) & ALL
        rows.append((signed(h) >> om.POSITION, at))
    seen, values = Counter(), []
    for h, at in sorted(rows):
        v = (chain_occurrence(h & ALL if h >= 0 else h + (1 << 64), seen[h]) << om.POSITION) & ALL
        seen[h] += 1
        values.append((signed(v), at, v >> (64 - om.BUCKET_BITS), (v >> om.POSITION) & ((1 << 31) - 1)))
    out = []
    for b in range(om.BUCKETS):
        mine = sorted(x for x in values if x[2] == b)[: om.L]
        if mine:
            low = [x[3] for x in sorted(mine, key=lambda x: x[1])]
            out.append(f"{b << 32 | chain(*low) & 0xFFFFFFFF:x}")
    return out


def near(a, b):
    either = {x[:-8] for x in a} | {x[:-8] for x in b}
    return len(set(a) & set(b)) / len(either) if either else 1.0


def check(docs):
    rows = sorted(((om.FIRST if r.doc_id is None else r.doc_id), r.text or "") for r in docs.collect())
    found = om.op8(docs).collect()
    ids = Counter(i for i, _ in rows)
    assert Counter(om.FIRST if r.doc_id is None else r.doc_id for r in found) == ids
    by = {r.doc_id: r for r in found}
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        if ids[doc] > 1 or any(ids[i] > 1 for i, t in rows if t == following):
            continue
        half = len(text) // 2
        edited, r = text[: len(text) - half] + following[:half], by[None if doc == om.FIRST else doc]
        a, b = plain(text), plain(edited)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (".".join(sorted(a, key=lambda x: int(x[:-8] or "0", 16))), ".".join(sorted(b, key=lambda x: int(x[:-8] or "0", 16)))) or sorted(r.fingerprint.split(".")) == sorted(a)
        assert abs(r.near_edited - near(a, b)) < 1e-12 and abs(r.near_next - near(a, plain(following))) < 1e-12


def test_equals_brute_force(spark, documents, odd_docs, no_docs, monkeypatch):
    check(documents)
    check(odd_docs.where("length(text) < 20000 or text is null"))
    assert om.op8(no_docs).count() == 0
    monkeypatch.setattr(om, "RUN", 23)  # many runs
    check(documents)
    check(spark.createDataFrame([(5, "one only text of some words")], "doc_id long, text string"))


def test_order_and_repeats_matter(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [base, base[100:] + base[:100], base[:190] + ["x"] * 10, base + base, ["a"] * 50, ["a"] * 60, []]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint.split(".") for r in om.op8(docs).collect()}
    assert near(got[0], got[2]) > 0.6 and near(got[0], got[1]) < near(got[0], got[2]) and got[4] != got[5]
    assert near(got[0], got[3]) < 1


def test_no_python_in_the_plan(documents):
    plan = om.op8(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and plan.count("Window") >= 2


def test_linear_on_repeats(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100_000).alias("text"))
    assert om.fingerprints(docs).select(F.size("fingerprint")).first()[0] == om.BUCKETS


def test_one_row_many_times_and_one_id_of_many_texts(spark, monkeypatch):
    """A third of the rows are one row, a third have no id: both are cut over runs, and each row's next is the one after it in order."""
    monkeypatch.setattr(om, "RUN", 50)
    rows = [(7, "the very same row again and again") for _ in range(400)] + [(None, f"row {i} without an id has words") for i in range(400)] + [(i, f"text {i} of some more words") for i in range(100, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = om.op8(docs)
    got = found.collect()
    order = sorted(((om.FIRST if i is None else i, signed(xxhash.xxh64_intdigest(t.encode(), seed=42)), t) for i, t in rows))
    want = Counter()
    for (i, _, t), (_, _, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want[None if i == om.FIRST else i, hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_runs_are_even_and_the_plan_has_one_constant_for_all_bounds(spark, monkeypatch):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of row "), F.col("id")).alias("text"))
    sizes = []
    for run in (10_000, 100):
        monkeypatch.setattr(om, "RUN", run)
        plan = om.op8(docs)._jdf.queryExecution().optimizedPlan()
        sizes.append(plan.treeString().count("\n"))
        bounds = om.run_bounds(docs.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("tie"), F.lit(1).cast("long").alias("bytes")), 20_000, 20_000, 20_000 // run + 1)
        starts = [0, *(b[0] for b in bounds), 20_000]
        assert max(b - a for a, b in zip(starts, starts[1:], strict=False)) < 2 * run
    assert sizes[0] == sizes[1]
