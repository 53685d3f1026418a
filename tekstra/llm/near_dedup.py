"""Near-duplicate detection by HyperMinHash.

A document's set is its distinct word shingles. Its sketch has BANDS x ROWS registers; a register keeps
the smallest hash of its own hash function as the count of leading zeros and MANTISSA further bits (one
function per register, so that short texts leave none empty). Documents with one set are one node.
Nodes that share all registers of a band are candidates; the Jaccard index estimated from the
registers, corrected for their chance collisions, sifts candidates, and the full sets confirm links.

No pair inside a known component is ever looked at: first each bucket's members are held against its
most central node alone (the one whose own buckets are fullest); then only buckets that still span
several components are compared, a pair in its first shared band only. There the members outside the
bucket's largest component go against each other and against that component, block by block; the
largest one never goes against itself, so a stranger in a bucket costs as many pairs as the bucket has
members. A bitmap of each set gives a bound that no intersection exceeds, so that few pairs that are no
links go on. Texts are fetched only for pairs that sizes and sketches leave over.

With 32 bands of 4, a link of similarity 0.8 shares no band with probability 5e-8, and falls under
the sieve (0.6) with probability 1e-8; more similar ones are missed less.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, map_batches, small_batches, stored, utf8

BANDS, ROWS, MANTISSA = 32, 4, 10
WORDS, SIMILARITY = 2, 80
#: How far under the similarity an estimate may be for the full sets still to be compared.
MARGIN = 0.2
#: Nodes of a bucket that one task compares with each other or with as many others.
BLOCK = 1024
#: Rows of one set from which on its node is joined to them apart from the others.
HOT = 1000
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1
MAX_WORDS = 200_000
#: Bits of a set's bitmap.
BITS = 4096

_RNG = np.random.default_rng(20240229)
MULTIPLY = _RNG.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


class _Words(dict):
    """word -> its 64-bit hash, as bytes."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MAX_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_digest(word)
        return found


@functools.cache
def word_hashes() -> _Words:
    return _Words()


def shingles(raw: bytes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the whole text; A-Z count as a-z. Fewer words than ``width``: all as one."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(word_hashes().__getitem__, words)), np.uint64)
    width = min(width, len(words))
    mixed = np.full(len(h) - width + 1, width, np.uint64)
    for at in range(width):
        mixed = (mixed ^ h[at : at + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each register's smallest hash, in 16 bits."""
    x, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        least = np.minimum(least, (x[None, at : at + 4096] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1))
    bits = np.frexp(least.astype(np.float64))[1].astype(np.uint64)
    rest = least.astype(np.uint64) << (np.uint64(33) - bits) & np.uint64(0xFFFFFFFF)
    return ((np.uint64(32) - bits) << np.uint64(MANTISSA) | rest >> np.uint64(32 - MANTISSA)).astype(np.uint16)


@functools.lru_cache(100_000)
def level_shares(n: int) -> np.ndarray:
    """How likely the smallest of n hashes has 0, 1, 2, ... leading zeros."""
    edges = (1 - 0.5 ** np.arange(34)) ** n
    return np.maximum(np.diff(edges), 0)


def chance(n: int, m: int) -> float:
    """How likely a register of two disjoint sets of n and m shingles agrees."""
    # Sizes to three bits after the first: the correction is under a thousandth anyway.
    n, m = (max(1, x >> max(0, x.bit_length() - 4) << max(0, x.bit_length() - 4)) for x in (n, m))
    return float((level_shares(n) * level_shares(m)).sum() / (1 << MANTISSA))


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard index from two sketches, corrected for registers that agree by chance."""
    c = chance(n, m)
    return max(0.0, (float((a == b).mean()) - c) / (1 - c))


def bitmap(hashes: np.ndarray) -> bytes:
    """BITS bits, one set for each shingle."""
    out = np.zeros(BITS, np.uint8)
    out[(hashes & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def with_bitmap(rows: DataFrame, words: int = WORDS) -> DataFrame:
    def make():
        claim("near", word_hashes.cache_clear)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits = pa.array([bitmap(shingles(x, words)) for x in batch.column(3).to_pylist()], pa.binary())
            return pa.RecordBatch.from_arrays([*batch.columns, bits], names=[*batch.schema.names, "bits"])

        return each

    return map_batches(rows.select("node", "n", "bands", "raw"), make, "node binary, n long, bands array<long>, raw binary, bits binary")


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """id (LAST for null), text_hash, n_shingles, node (the set's 128-bit hash; null for an empty set), bands."""

    def make():
        claim("near", word_hashes.cache_clear)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, node, bands = [], [], []
            for raw in batch.column(2).to_pylist():
                s = shingles(raw, words)
                n.append(len(s))
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(registers(s).view(np.int64) if len(s) else None)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "text_hash", "n_shingles", "node", "bands"])

        return each

    rows = docs.select(*row_key(key, text), utf8(text).alias("raw"))
    return map_batches(rows, make, "id long, text_hash long, n_shingles long, node binary, bands array<long>")


def row_key(key: str, text: str) -> list:
    """What names a row: its id and its text's hash."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")]


def sifted(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes, and whose estimate from the sketches, leave a link possible. No text is read."""
    side = {s: near.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bands").alias(f"bands_{s}")) for s in ("a", "b")}
    rows = pairs.join(side["b"], "b").join(side["a"], "a").where(100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", "bands_a", "bands_b")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            x, y = (batch.column(i).flatten().to_numpy().reshape(len(n), BANDS).view(np.uint16) for i in (4, 5))
            share, low = (x == y).mean(axis=1) if len(n) else np.empty(0), SIMILARITY / 100 - MARGIN
            # The correction only lowers the share.
            keep = [bool(s >= low) and (s - (c := chance(int(p), int(q)))) / (1 - c) >= low for s, p, q in zip(share.tolist(), n, m, strict=True)]
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return each

    return map_batches(rows, make, "a binary, b binary")


def verified(pairs: DataFrame, near: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) that are links: sifted by size and estimate, confirmed on full sets."""
    side = {s: near.select(F.col("node").alias(s), F.col("raw").alias(f"raw_{s}")) for s in ("a", "b")}
    rows = sifted(pairs, near).join(side["b"], "b").join(side["a"], "a").select("a", "b", "raw_a", "raw_b")

    def make():
        claim("near", word_hashes.cache_clear)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            last, sa, keep = None, None, []
            for a, ra, rb in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if a != last:
                    last, sa = a, shingles(ra, words)
                sb = shingles(rb, words)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * both >= SIMILARITY * (len(sa) + len(sb) - both))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return each

    return map_batches(rows, make, "a binary, b binary")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, comp (the smallest node reachable) for every node in a link: large and small stars in turn, each round written to the shared folder."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        for large in (True, False):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
            least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
            star = both.join(least, "u")
            if large:
                star = star.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                star = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            edges = star.where("u <> v").distinct()
        edges = stored(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def open_blocks(members: DataFrame, near: DataFrame, comps: DataFrame) -> DataFrame:
    """What ``compare`` takes: of the buckets that still span several components the members, in each pair of blocks (i, j) that is compared.

    Blocks below ``others`` hold members outside the bucket's largest component; they are paired with
    all blocks, those of the largest component with these alone.
    """
    labelled = members.drop("size").join(comps, "node", "left").select("band", "value", "node", F.coalesce("comp", "node").alias("comp"))
    held = labelled.groupBy("band", "value", "comp").agg(F.count("*").alias("c"))
    spans = held.groupBy("band", "value").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("size")).where("size > main.c")
    spans = spans.select("band", "value", F.col("main.comp").alias("main"), F.ceil((F.col("size") - F.col("main.c")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("main.c") / BLOCK).cast("int").alias("mains"))
    rows = labelled.join(spans, ["band", "value"])
    place = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    outside = F.col("comp") != F.col("main")
    # Sketches are joined before rows are copied to blocks: a node then has no more rows in that join than bands.
    rows = rows.join(near.select("node", "n", "bands", "bits"), "node")
    rows = rows.withColumn("own", F.when(outside, place("others")).otherwise(F.col("others") + place("mains")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(outside, F.col("mains")).otherwise(0))))
    return rows.select("band", "value", "node", "comp", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "n", "bands", "bits")


def open_pairs(members: DataFrame, near: DataFrame, comps: DataFrame) -> DataFrame:
    """Candidate pairs across components, from the buckets that still span several: each pair once, in its first shared band."""
    return open_blocks(members, near, comps).groupBy("band", "value", "i", "j").applyInArrow(compare, "a binary, b binary")


def compare(group: pa.Table) -> pa.Table:
    """One block, or one block against another, of one bucket."""
    band, i, j = (group[c][0].as_py() for c in ("band", "i", "j"))
    node, n, own = group["node"].to_pylist(), group["n"].to_numpy(), group["own"].to_numpy()
    comp = np.unique(np.array([x.hex() for x in group["comp"].to_pylist()]), return_inverse=True)[1]
    bands = np.array(group["bands"].combine_chunks().values.to_numpy()).reshape(len(node), BANDS)
    registers_of = bands.view(np.uint16)
    bits = np.frombuffer(b"".join(group["bits"].to_pylist()), np.uint64).reshape(len(node), -1)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    out: tuple[list[bytes], list[bytes]] = ([], [])
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        ok = comp[rows][:, None] != comp[right][None, :]
        if i == j:
            ok &= rows[:, None] < right[None, :]
        sizes = np.minimum(n[rows][:, None], n[right][None, :]) * 100 >= SIMILARITY * np.maximum(n[rows][:, None], n[right][None, :])
        x, y = np.nonzero(ok & sizes)
        for part in range(0, len(x), 20_000):
            p, q = rows[x[part : part + 20_000]], right[y[part : part + 20_000]]
            first = (bands[p] == bands[q]).argmax(axis=1) == band
            p, q = p[first], q[first]
            # Each bit that only one set has is a shingle that the other lacks: so many at most are common.
            common = np.minimum(n[p] - np.bitwise_count(bits[p] & ~bits[q]).sum(axis=1), n[q] - np.bitwise_count(bits[q] & ~bits[p]).sum(axis=1))
            possible = 100 * common >= SIMILARITY * (n[p] + n[q] - common)
            p, q = p[possible], q[possible]
            share = (registers_of[p] == registers_of[q]).mean(axis=1)
            low = SIMILARITY / 100 - MARGIN
            for k in np.flatnonzero(share >= low):
                a, b = int(p[k]), int(q[k])
                c = chance(int(n[a]), int(n[b]))
                if (share[k] - c) / (1 - c) >= low:
                    a, b = sorted((node[a], node[b]))
                    out[0].append(a)
                    out[1].append(b)
    return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["a", "b"])


def memberships(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """id, text_hash, n_shingles, component, alone, comp: one row for each row. The component is the smallest id reachable over links.

    Several components may have one smallest id, by null or repeated ids; comp is a component's own key (null where alone).

    words: the length of a shingle; fewer words make one shingle of all. Malformed UTF-8 reads as U+FFFD.
    Null or empty text: no shingles, linked with nothing, a component of its own. A null id counts as
    larger than any (LAST). Repeated rows share a node and so a component. Rows of one id but different
    texts are different nodes. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    rows = stored(sketches(docs, key, text, words))
    nodes = stored(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct("id", "text_hash")).alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    banded = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(banded.join(shared, ["band", "value"]))
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = members.join(weights, "node").groupBy("band", "value").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot"))
    chosen = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "n", "bands", "row.id", "row.text_hash")
    near = docs.select(*row_key(key, text), utf8(text).alias("raw")).join(chosen, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
    near = stored(with_bitmap(near, words))
    stars = members.join(pivots, ["band", "value"]).where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(verified(stars, near, words))
    comps = components(links)
    more = verified(stored(open_pairs(members, near, comps)), near, words)
    # What is one component already needs no second look: the rest of the links join components.
    label = {s: comps.select(F.col("node").alias(s), F.col("comp").alias(f"comp_{s}")) for s in ("a", "b")}
    joined = more.join(label["a"], "a", "left").join(label["b"], "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(joined))
    firsts = nodes.select("node", "copies", "row.id")
    least = firsts.join(comps, "node").groupBy("comp").agg(F.min("id").alias("component"))
    labelled = firsts.join(comps.join(least, "comp").select("node", "component", "comp"), "node", "left").select("node", "copies", F.coalesce("component", "id").alias("component"), F.coalesce("comp", "node").alias("comp"))
    labelled = stored(labelled)
    # Copies of one set may be a third of all rows. Such nodes are few, one for HOT rows at most, so their table is joined apart: small, it is broadcast; large, AQE splits the copies.
    own = ("node", "component", "comp")
    hot = stored(labelled.where(F.col("copies") > HOT).select(*own))
    others = rows.join(hot.select("node"), "node", "left_anti").join(labelled.where(F.col("copies") <= HOT).select(*own), "node", "left")
    found = others.unionByName(rows.join(hot, "node"))
    return found.select("id", "text_hash", "n_shingles", F.coalesce("component", "id").alias("component"), F.col("node").isNull().alias("alone"), "comp")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """The rows that stay, with all their columns: of each component the row of least (id, text hash), once; all rows without words stay."""
    found = memberships(docs, key, text, words)
    firsts = found.where("not alone").groupBy("comp").agg(F.min(F.struct("id", "text_hash")).alias("row")).select("row.*").unionByName(found.where("alone").select("id", "text_hash").distinct())
    a, b = row_key(key, text)
    own = docs.withColumns({"__tekstra_id": a, "__tekstra_hash": b})
    kept = own.join(firsts.select(F.col("id").alias("__tekstra_id"), F.col("text_hash").alias("__tekstra_hash")), ["__tekstra_id", "__tekstra_hash"], "left_semi")
    return kept.dropDuplicates(["__tekstra_id", "__tekstra_hash"]).select(docs.columns)


def op10(docs: DataFrame) -> DataFrame:
    null = F.lit(None).cast("long")
    out = memberships(docs).select(F.when(F.col("id") != LAST, F.col("id")).otherwise(null).alias("doc_id"), "n_shingles", F.when(F.col("component") != LAST, F.col("component")).otherwise(null).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


#: DuckDB SQL for op10's rows. Candidates share one of the rarest shingles of each: two sets of similarity 0.8 have at
#: least 0.8 of either in common, so one shingle among the first n - ceil(0.8 n) + 1 in any one order.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
p AS (SELECT doc_id, g FROM e JOIN f USING (g) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, g) <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p AS x JOIN p AS y ON x.g = y.g AND x.doc_id < y.doc_id),
i AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS inter, len(x.s) + len(y.s) AS total FROM c JOIN s AS x ON x.doc_id = a JOIN s AS y ON y.doc_id = b),
l AS (SELECT a, b FROM i WHERE 100 * inter >= 80 * (total - inter)),
k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, k.b FROM r JOIN k ON k.a = r.b)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) ON a = doc_id
"""
