"""Quality rules by tokeniser fertility: what public vocabularies make of a text's words.

Three measures over all words of the whole text: characters per token (for a multilingual byte-level
BPE and for a piece BPE with byte fallback), the share of tokens that are byte fallback, and the
entropy of the tokens. Each has a band for the document's language, or else for its main script; a
text outside a band is rejected. Few words say little about bands, so those texts fall to the base
rule alone (fewer than 50 words), as do texts that mostly repeat themselves.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import claim, map_batches, slices, small_batches, utf8

MIN_WORDS, MAX_REPEATED_SHARE = 50, 0.5
#: Words whose tokens a worker keeps in each of two generations.
MAX_WORDS = 150_000

#: Bands: least and most characters per token (multilingual byte BPE), the same (piece BPE), least ratio of the two, most
#: byte fallback, least and most bits of token entropy. By language, else by script, else "any".
BANDS = {
    "en": (2.20, 7.0, 1.70, 7.0, 0.90, 0.15, 4.0, 14.0),
    "de": (2.25, 7.0, 1.70, 7.0, 0.90, 0.15, 4.0, 14.0),
    "fr": (1.95, 7.0, 1.70, 7.0, 0.90, 0.15, 4.0, 14.0),
    "es": (2.05, 7.0, 1.70, 7.0, 0.90, 0.15, 4.0, 14.0),
    "latin": (1.80, 7.0, 1.30, 7.0, 0.85, 0.15, 3.5, 14.0),
    "cyrillic": (0.80, 7.0, 0.80, 7.0, 0.30, 0.30, 3.5, 14.0),
    "greek": (0.60, 7.0, 0.60, 7.0, 0.30, 0.40, 3.5, 14.0),
    "arabic": (0.50, 7.0, 0.40, 7.0, 0.20, 0.60, 3.5, 14.0),
    "cjk": (0.25, 4.0, 0.25, 4.0, 0.20, 0.80, 3.5, 14.0),
    "any": (0.20, 8.0, 0.20, 8.0, 0.10, 0.95, 3.0, 14.0),
}

SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


@functools.cache
def script_of(char: str) -> str:
    """The script of a letter by its Unicode name; "" for what is no letter."""
    if not char.isalpha():
        return ""
    name = unicodedata.name(char, "").split(" ")[0]
    return {"CJK": "cjk", "HIRAGANA": "cjk", "KATAKANA": "cjk", "HANGUL": "cjk", "LATIN": "latin", "CYRILLIC": "cyrillic", "GREEK": "greek", "ARABIC": "arabic"}.get(name, "any")


def main_script(text: str) -> str:
    if text.isascii():
        return "latin"
    counts: Counter[str] = Counter()
    for char in set(text):
        if script := script_of(char):
            counts[script] += text.count(char)
    return min(counts, key=lambda s: (-counts[s], s)) if counts else "any"


#: Stands for one token of the byte BPE in a word's packed record; larger than any piece's id.
MARK = 1 << 30


class Fertility:
    """Tokens of words under both vocabularies, kept for words seen before."""

    def __init__(self, pieces: str = "piece_bpe_32k.model", ranks: str = "byte_bpe_multi_50k.tiktoken"):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        self.is_byte = np.array([self.model.IsByte(i) for i in range(self.model.GetPieceSize())])
        self.encode = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(ranks)), special_tokens={}).encode_ordinary
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """word -> its record: ids of its pieces, then a MARK for each token of the byte BPE, as int32; for all the words given."""
        found, missing = {}, []
        memo, older = self.memo, self.older
        for word in words:
            got = memo.get(word)
            if got is None:
                got = older.get(word)
                if got is None:
                    missing.append(word)
                    continue
                memo[word] = got
            found[word] = got
        texts = [w.decode() for w in missing]
        for word, text, ids in zip(missing, texts, self.model.encode(texts, num_threads=1) if texts else [], strict=True):
            found[word] = memo[word] = array("i", ids + [MARK] * len(self.encode(" " + text))).tobytes()
        if len(memo) > MAX_WORDS:
            self.older, self.memo = memo, {}
        return found


@functools.cache
def fertility() -> Fertility:
    return Fertility()


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, end = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + 3 - max(at, end)
            end = at + 3
    return total


def measure(raw: bytes, lang: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, characters per token (two), byte share, entropy, band."""
    words = raw.split()
    n = len(words)
    chars = len(raw.decode()) - (len(raw) - len(raw.translate(None, BLANKS)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or repeated > MAX_REPEATED_SHARE * n
    if not n:
        return 0, 0, symbols, 0, 0, True, False, None, None, None, None, None
    model = fertility()
    ids = np.sort(np.frombuffer(b"".join(map(model.learn(set(words)).__getitem__, words)), np.int32))
    cut = int(np.searchsorted(ids, MARK))
    ids, n_multi = ids[:cut], len(ids) - cut
    edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
    counts, kinds = np.diff(edges), ids[edges[:-1]]
    shares = counts / cut
    entropy = float(-(shares * np.log2(shares)).sum()) + 0.0
    multi, piece = (chars + n) / n_multi, (chars + n) / cut  # a token takes the space before its word
    share = float(counts[model.is_byte[kinds]].sum() / cut)
    key = lang if lang in BANDS else main_script(raw.decode())
    a, b, c, d, ratio, most_bytes, low, high = BANDS[key]
    inside = a <= multi <= b and c <= piece <= d and multi >= ratio * piece and share <= most_bytes and min(low, math.log2(len(ids)) * 0.6) <= entropy <= high
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, failed, not failed and inside, multi, piece, share, entropy, key


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, chars_per_piece double, byte_share double, token_entropy double, band string"


def columns(measured: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 4 + [pa.string()]
    return [pa.array(x, k) for x, k in zip(zip(*measured, strict=True) if measured else [()] * 12, kinds, strict=True)]


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """One row for each row: its key, counts, verdicts and fertility measures.

    Malformed UTF-8 reads as U+FFFD. Null or empty text, or blanks alone: no words, so base_failed and not kept, measures null. Null or
    unknown language: the band of the main script. Repeated rows are measured alike; other columns are
    left out. An empty table gives an empty table.
    """

    def make():
        claim("quality", fertility.cache_clear)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [measure(raw, lang) for raw, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns(found)], names=["key"] + [x.split()[0] for x in COLUMNS.split(", ")])

        return each

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("raw"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"))
    return map_batches(rows, make, f"key {kind}, {COLUMNS}").withColumnRenamed("key", key)


def passes(text: Column | str, lang: Column | str) -> Column:
    """The verdict alone, as a column to filter by."""

    @F.arrow_udf("boolean")
    def verdict(raw: pa.Array, lang: pa.Array) -> pa.Array:
        claim("quality", fertility.cache_clear)
        batch = pa.RecordBatch.from_arrays([raw, lang], names=["raw", "lang"])
        return pa.array([measure(r, k)[6] for part in slices(batch) for r, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], pa.bool_())

    return verdict(utf8(text), F.col(lang) if isinstance(lang, str) else lang)


def kept(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that pass, with all their columns."""
    small_batches(docs.sparkSession)
    return docs.where(passes(text, lang))


def op9(docs: DataFrame) -> DataFrame:
    return measures(docs)
