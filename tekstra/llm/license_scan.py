"""License scans: exact phrases, and fuzzy search for short notices.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of non-ASCII characters; the search
runs over the words joined by single spaces, so layout doesn't matter. Exact phrases give the base
labels. For the fuzzy search each notice is split into k + 1 seeds: by the pigeonhole principle a
passage within k edits of it holds a seed exactly. Places with a seed are candidates; ``regex``
verifies a window around each with bounded errors and reports the span and its edits.
"""

from __future__ import annotations

import functools
import heapq
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, utf8

#: Phrases and labels of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices (normalised), their labels, and the edits that each may take.
NOTICES = [
    ("released under the mit license", "mit", 4),
    ("licensed under the mit license", "mit", 4),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("licensed under the gnu general public license", "gpl", 4),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under cc by nc", "cc-by-nc", 2),
    ("licensed under cc by sa", "cc-by-sa", 2),
    ("licensed under cc by nd", "cc-by-nd", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("creative commons attribution sharealike", "cc-by-sa", 4),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    ("subject to the terms of the mozilla public license", "mpl", 5),
    ("released into the public domain", "public-domain", 3),
    ("all rights reserved", "proprietary", 1),
]

#: Maps a byte to itself, A-Z to lower case, and what is in no word to a space.
TO_WORDS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    errors: int

    @functools.cached_property
    def seeds(self) -> list[tuple[int, bytes]]:
        """errors + 1 parts that make up the notice, and where each starts."""
        n, parts = len(self.text), self.errors + 1
        cuts = [n * i // parts for i in range(parts + 1)]
        return [(a, self.text[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]

    @functools.cached_property
    def patterns(self) -> list[regex.Pattern]:
        """For 0, 1, ... edits at most."""
        return [regex.compile(f"(?:{regex.escape(self.text)}){{e<={k}}}" if k else regex.escape(self.text)) for k in range(self.errors + 1)]

    @functools.cached_property
    def letters(self) -> list[tuple[str, int]]:
        return sorted(Counter(self.text).items())

    def best(self, text: str, lo: int, hi: int) -> regex.Match | None:
        """A match of fewest edits in text[lo:hi]. An edit costs one letter at most, so a stretch that lacks more letters than edits has none."""
        lacking = 0
        for letter, n in self.letters:
            if (have := text.count(letter, lo, hi)) < n:
                lacking += n - have
                if lacking > self.errors:
                    return None
        return next((m for pattern in self.patterns[lacking:] if (m := pattern.search(text, lo, hi))), None)


@functools.cache
def notices(rows: tuple[tuple[str, str, int], ...]) -> list[Notice]:
    return [Notice(*x) for x in rows]


@functools.cache
def seed_patterns(rows: tuple[tuple[str, str, int], ...]) -> list[tuple[Notice, int, bytes, int]]:
    """Every seed of every notice: notice, where the seed starts in it, seed, length of the notice."""
    return [(x, at, seed, len(x.text)) for x in notices(rows) for at, seed in x.seeds]


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word indexes at which the phrase's words stand consecutively."""
    found, at, words, counted = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        found.append(words)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return found


def fuzzy(joined: bytes, rows: tuple[tuple[str, str, int], ...]) -> list[tuple[str, int, int, int, float]]:
    """label, first word, end word (exclusive), edits, score: of each notice the best matches first, then those that lie beside them.

    Every match holds a seed, so it lies in that seed's window; no window is longer than its notice and
    its edits on either side, and the time is linear in the text and in the candidates.
    """
    hit = {seed for _, _, seed, _ in seed_patterns(rows) if seed in joined}
    if not hit:
        return []
    text = joined.decode()
    windows: dict[Notice, set[tuple[int, int]]] = {}
    for notice, offset, raw, length in seed_patterns(rows):
        seed = raw.decode()
        at = text.find(seed) if raw in hit else -1
        while at >= 0:
            windows.setdefault(notice, set()).add((max(0, at - offset - notice.errors), min(len(text), at - offset + length + notice.errors)))
            at = text.find(seed, at + 1)
    spaces = [at for at, c in enumerate(text) if c == " "]
    found = []
    for notice, spans in windows.items():
        for i, j, edits in matches(text, notice, sorted(spans)):
            first = bisect_left(spaces, i + 1 + (text[i] == " ")) - 1
            found.append((notice.label, first, first + len(text[i:j].split()), edits, 1 - edits / len(notice.text)))
    return standing(found)


def matches(text: str, notice: Notice, windows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """start, end, edits: matches that don't overlap. A window whose best match overlaps a better one is searched again in what is left of it."""
    least, queue = len(notice.text) - notice.errors, []

    def search(lo: int, hi: int) -> None:
        if hi - lo >= least and (m := notice.best(text, lo, hi)):
            heapq.heappush(queue, (sum(m.fuzzy_counts), m.start(), m.end(), lo, hi))

    # Seeds of one match have windows that start within twice its edits: those are searched as one.
    at = 0
    while at < len(windows):
        lo, hi = windows[at]
        while at < len(windows) and windows[at][0] <= lo + 2 * notice.errors:
            hi = max(hi, windows[at][1])
            at += 1
        search(lo, hi)
    out: list[tuple[int, int, int]] = []  # in order of place
    while queue:
        edits, i, j, lo, hi = heapq.heappop(queue)
        a = bisect_left(out, (lo,))
        a -= a > 0 and out[a - 1][1] > lo
        b = bisect_left(out, (hi,))
        if not any(x < j and i < y for x, y, _ in out[a:b]):
            insort(out, (i, j, edits))
            continue
        edge = lo
        for x, y, _ in out[a:b]:
            search(edge, x)
            edge = max(edge, y)
        search(edge, hi)
    return out


def standing(found: list[tuple[str, int, int, int, float]]) -> list[tuple[str, int, int, int, float]]:
    """Where notices of several labels overlap, those that match best stand. Spans are short, so a span's overlaps start near it."""
    longest = max((x[2] - x[1] for x in found), default=0)
    starting: dict[int, list[tuple[str, int, int, int, float]]] = {}
    for x in sorted(found, key=lambda x: (-x[4], x)):
        near = (y for at in range(x[1] - longest, x[2]) for y in starting.get(at, ()))
        if all(x[0] == y[0] or x[4] == y[4] or y[2] <= x[1] for y in near):
            starting.setdefault(x[1], []).append(x)
    return sorted(x for kept in starting.values() for x in kept)


def scan_text(raw: bytes, rows: tuple[tuple[str, str, int], ...]) -> tuple:
    words = raw.translate(TO_WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    exact = {label: places(joined, phrase.encode()) for phrase, label in PHRASES.items()}
    starts = [x for at in exact.values() for x in at]
    base = sorted({label for label, at in exact.items() if at})
    spans = fuzzy(joined, rows)
    labels = sorted({*base, *(x[0] for x in spans)})
    score = 1.0 if starts else max((x[4] for x in spans), default=0.0)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, spans


SPANS = "array<struct<label:string,first_word:bigint,end_word:bigint,edits:bigint,score:double>>"


def scan(docs: DataFrame, notices_of: list[tuple[str, str, int]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: counts, labels, score and the fuzzy spans of the whole text.

    Null or empty text: no words, no labels, score 0. Malformed UTF-8 reads as U+FFFD. Null keys and repeated rows each give one row;
    other columns are left out. An empty table gives an empty table.
    """
    rows = tuple(notices_of or NOTICES)
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64()), ("score", pa.float64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [scan_text(x, rows) for x in batch.column(1).to_pylist()]
            found = [(*x[:7], [dict(zip(("label", "first_word", "end_word", "edits", "score"), s, strict=True)) for s in x[7]]) for x in found]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [()] * 8, kinds, strict=True))], names=["key", *names])

        return each

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"
    return map_batches(docs.select(F.col(key).alias("key"), utf8(text).alias("raw")), make, schema).withColumnRenamed("key", key)


def op2(docs: DataFrame) -> DataFrame:
    return scan(docs).withColumn("n_spans", F.size("spans").cast("long")).withColumn("spans", F.to_json("spans"))
