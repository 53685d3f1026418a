"""Order MinHash fingerprints, in DataFrame functions alone.

A text's k-mers are its runs of K words, each numbered by its occurrence, so that repeated k-mers are
told apart. Their hashes fall into BUCKETS by leading bits; of each bucket the L smallest are selected,
put back into text order, and the tuple is hashed. Two texts agree in a bucket only if they share the
smallest k-mers there and have them in the same order: the likeness follows edit distance, not just
common words. A fingerprint has (bucket, tuple hash) for each bucket that has a k-mer.

Arrays of longs carry all of it: a hash of HASH bits above a position of POSITION bits, so that plain
sorting of longs orders by hash and keeps the place. An array that a lambda looks into is a column of
its own, referred to twice at least, which keeps the optimizer from computing it anew for each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.search import pair_at, pairs_upto
from .common import stored

K, L, BUCKET_BITS = 3, 2, 5
BUCKETS = 1 << BUCKET_BITS
POSITION = 28
HASH = 64 - POSITION
PLACES = (1 << POSITION) - 1
#: Documents, and bytes of text, in a run of consecutive rows that one task windows over, on average; runs at most (beyond that they grow: a task streams its run); samples for each run's bounds.
RUN, RUN_BYTES, MAX_RUNS, SAMPLES = 8_000, 16 << 20, 100_000, 40
FIRST = -(1 << 63)

BLANKS = "[\\x20\\x09-\\x0D]+"


def with_fingerprint(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds for each text column (name -> name) an array of longs: bucket << 32 | 32 bits of the tuple's hash."""
    keep = df.columns
    t = {name: f"__{name}_{{}}".format for name in texts.values()}
    df = df.withColumns({t[n]("w"): F.split(F.regexp_replace(F.col(c), f"^{BLANKS}|{BLANKS}$", ""), BLANKS) for c, n in texts.items()})
    df = df.withColumns({t[n]("h"): kmers(F.col(t[n]("w"))) for n in texts.values()})
    df = df.withColumns({t[n]("v"): numbered(F.col(t[n]("h"))) for n in texts.values()})
    df = df.withColumns({t[n]("s"): smallest(F.col(t[n]("v"))) for n in texts.values()})
    df = df.withColumns({n: tuples(F.col(t[n]("s"))) for n in texts.values()})
    return df.select(*keep, *texts.values())


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def kmers(words: Column) -> Column:
    """Sorted: hash of each k-mer, its position below. Fewer than K words make one k-mer; no words, none."""
    n = F.size(words)
    starts = F.slice(words, 1, F.greatest(n - F.lit(K - 1), F.lit(1)))
    hashed = F.transform(starts, lambda w, i: F.shiftleft(F.xxhash64(w, *(F.get(words, i + j) for j in range(1, K))), POSITION).bitwiseOR(i.cast("long")))
    return F.when((n == 1) & (F.get(words, F.lit(0)) == ""), F.array().cast("array<bigint>")).otherwise(F.sort_array(hashed))


def numbered(hashes: Column) -> Column:
    """Sorted: hash of (k-mer, occurrence), its position below. An occurrence's number is how far back its k-mer's run begins, found by halving steps."""
    steps = F.array(*(F.lit(1 << p) for p in range(POSITION - 1, -1, -1)))

    def of(x: Column, i: Column) -> Column:
        same = lambda back: F.shiftright(F.get(hashes, i - back), POSITION) == F.shiftright(x, POSITION)
        number = F.when(same(F.lit(1)), F.aggregate(steps, F.lit(0), lambda acc, step: F.when(same(acc + step), acc + step).otherwise(acc))).otherwise(F.lit(0))
        return F.shiftleft(F.xxhash64(F.shiftright(x, POSITION), number), POSITION).bitwiseOR(x.bitwiseAND(long(PLACES)))

    return F.sort_array(F.transform(hashes, of))


def bucket(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BUCKET_BITS)


def smallest(values: Column) -> Column:
    """Of each bucket the L smallest, sorted by (bucket, position), 31 bits of the hash below."""
    chosen = F.filter(values, lambda x, i: F.coalesce(bucket(F.get(values, i - F.lit(L))) != bucket(x), F.lit(True)))
    rest = 64 - BUCKET_BITS - POSITION
    turned = F.transform(chosen, lambda x: F.shiftleft(bucket(x), 64 - BUCKET_BITS).bitwiseOR(F.shiftleft(x.bitwiseAND(long(PLACES)), rest)).bitwiseOR(F.shiftright(x, POSITION).bitwiseAND(long((1 << rest) - 1))))
    return F.sort_array(turned)


def tuples(chosen: Column) -> Column:
    rest = long((1 << 64 - BUCKET_BITS - POSITION) - 1)
    starts = F.filter(F.transform(chosen, lambda x, i: F.when(F.coalesce(bucket(F.get(chosen, i - F.lit(1))) != bucket(x), F.lit(True)), i)), lambda i: i.isNotNull())

    def hashed(i: Column) -> Column:
        x = F.get(chosen, i)
        others = [F.when(bucket(F.get(chosen, i + j)) == bucket(x), F.get(chosen, i + j).bitwiseAND(rest)) for j in range(1, L)]
        return F.shiftleft(bucket(x), 32).bitwiseOR(F.xxhash64(x.bitwiseAND(rest), *others).bitwiseAND(long((1 << 32) - 1)))

    return F.transform(starts, hashed)


def written(fingerprint: Column) -> Column:
    """As text: hexadecimal entries joined by dots."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.hex(x))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of buckets that agree, of those that either has; 1 for two empty fingerprints."""
    buckets = lambda x: F.transform(x, lambda e: F.shiftright(e, 32))
    either = F.size(F.array_union(buckets(a), buckets(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint (array<bigint>) of each whole text; null or empty text: an empty array."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_fingerprint(rows, {"text": "fingerprint"}).select(key, "fingerprint")


def run_bounds(keys: DataFrame, n: int, total: int, parts: int) -> list[tuple[int, int]]:
    """Keys (id, tie) at which runs of about equal bytes begin: quantiles of a sample that is drawn by hash, with a chance in proportion to a key's bytes.

    The sample has about SAMPLES keys a run, so it is bounded by the number of tasks, not of documents.
    """
    each = total / (parts * SAMPLES)
    u = F.pmod(F.xxhash64("id", "tie", F.lit(8)), F.lit(1 << 52)) / float(1 << 52)
    drawn = sorted((r.id, r.tie, max(r.bytes, each)) for r in keys.where(u * each < F.col("bytes")).select("id", "tie", "bytes").collect())
    out, upto, due = [], 0.0, total / parts
    for ident, tie, weight in drawn:
        if upto >= due:
            out.append((ident, tie))
            due = (upto // (total / parts) + 1) * (total / parts)
        upto += weight
    return out


def in_runs(rows: DataFrame, bounds: list[tuple[int, int]], least: tuple[int, int]) -> DataFrame:
    """Adds run and guest. Each run has as a guest the row that follows its last one (the first of all, after the last run), and is a partition of its own.

    The bounds are one constant of the plan, whatever their number.
    """
    at_start = (F.col("id") == F.lit(least[0])) & (F.col("tie") == F.lit(least[1]))
    own = F.struct(F.col("run"), F.lit(False).alias("guest"))
    before = F.struct(F.when(at_start, F.lit(len(bounds))).otherwise(F.col("run") - 1).alias("run"), F.lit(True).alias("guest"))
    first = at_start | pair_at(bounds, F.col("run") - 1, "id", "tie")
    rows = rows.withColumn("run", pairs_upto(bounds, "id", "tie")).withColumn("at", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    return rows.drop("run").withColumns({"run": F.col("at.run"), "guest": F.col("at.guest")}).drop("at").repartitionById(len(bounds) + 1, "run")


def op8(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    Null text: empty. Malformed UTF-8 reads as U+FFFD. A null id comes before all others; rows of one id
    follow each other by their text's hash, whichever run they fall in. Rows equal in id and text take
    part once, with their number, so a third of all rows may be one: all but the last of them have
    themselves as next. A single row is its own next. An empty table gives an empty table.
    """
    text = F.make_valid_utf8(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    keys = stored(rows.groupBy("id", "tie").agg(F.count("*").alias("n"), (F.max(F.octet_length("text")) + 1).cast("long").alias("bytes")))
    n, total, most, least = keys.agg(F.count("*"), F.sum("bytes"), F.max("n"), F.min(F.struct("id", "tie"))).first()
    n, total, most, least = n, total or 1, most or 1, tuple(least or (FIRST, 0))
    if most > 1:
        again = keys.where("n > 1").select("id", "tie")
        many = rows.join(again, ["id", "tie"], "left_semi").groupBy("id", "tie").agg(F.min("text").alias("text"), F.count("*").alias("n"))
        rows = rows.join(again, ["id", "tie"], "left_anti").withColumn("n", F.lit(1).cast("long")).unionByName(many)
    parts = min(MAX_RUNS, max(n // RUN + 1, total // RUN_BYTES + 1, min(n // 64 + 1, 2 * docs.sparkSession.sparkContext.defaultParallelism)))
    # The text's own fingerprint before rows move, where the tables' splits balance the work; the edited text's after.
    rows = in_runs(with_fingerprint(rows, {"text": "a"}), run_bounds(keys, n, total, parts), least)
    order = Window.partitionBy("run").orderBy("guest", "id", "tie")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = lambda following: F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr(following, F.lit(1), half))
    rows = rows.withColumn("edited", edited(F.lead("text").over(order)))
    # A row that comes n times is followed n - 1 times by itself.
    texts = {"edited": "b"}
    if most > 1:
        rows, texts = rows.withColumn("edited_alike", F.when(F.col("n") > 1, edited(F.col("text")))), texts | {"edited_alike": "b_alike"}
    rows = with_fingerprint(rows, texts)
    one = F.struct(F.sha2("edited", 256).alias("sha"), F.col("b").alias("b"), F.lit(1).cast("long").alias("times"), F.lit(False).alias("alike"))
    cases = F.array(one)
    if most > 1:
        alike = F.struct(F.sha2("edited_alike", 256).alias("sha"), F.col("b_alike").alias("b"), (F.col("n") - 1).alias("times"), F.lit(True).alias("alike"))
        cases = F.when(F.col("n") > 1, F.array(one, alike)).otherwise(cases)
    rows = rows.select("id", "run", "guest", "tie", F.length("text").cast("long").alias("n_chars"), "a", cases.alias("cases")).withColumn("next", F.lead("a").over(order)).where("not guest")
    rows = rows.select("id", "n_chars", "a", "next", F.explode("cases").alias("e")).select("*", "e.sha", "e.b", "e.alike", "e.times")
    if most > 1:
        rows = rows.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return rows.select(
        F.when(F.col("id") != FIRST, F.col("id")).alias("doc_id"),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        written(F.col("a")).alias("fingerprint"),
        written(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        F.when(F.col("alike"), F.lit(1.0)).otherwise(likeness(F.col("a"), F.col("next"))).alias("near_next"),
    )
