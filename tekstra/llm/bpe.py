"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Encoding. A sequence of tokens is the BPE encoding of its bytes iff each token encodes to itself
and each pair of neighbours encodes to that pair. That makes a nondeterministic transducer: its
state is the last whole token and the bytes of the token under way; a token may end where it is
compatible with the one before. ``Transducer`` determinises it on demand by the subset
construction with output residuals: a state holds every live hypothesis (bytes under way, tokens
not yet emitted), and what all hypotheses agree on is emitted. A token is thus emitted after a
lookahead of at most the longest token. States and transitions are kept; they and the memo are dropped
when they reach a fixed size (they are caches: results don't depend on them). A piece's last byte
leads to no state: it emits what the one hypothesis that ends there has due.

Decoding. ``Utf8Stream`` runs an incremental UTF-8 state machine over the ids' bytes; its state is
the bytes of the unfinished character, so ids may come in any chunks.
"""

from __future__ import annotations

import base64
import codecs
import contextlib
import functools
import gc
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, map_batches, utf8

#: Entries at which the encoder's caches start anew; of pieces, the last generation stays.
MAX_STATES, MAX_PIECES, MAX_PAIRS = 200_000, 300_000, 500_000
#: White space as the pattern means it (the Unicode property), to be put into a class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE by its definition: join the neighbours of lowest rank, leftmost first, until none can be."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        longer = {b[:n] for b in ranks for n in range(len(b))}
        node = {b: n for n, b in enumerate(longer | ranks.keys() - {b""})}
        self.root = node[b""]
        #: By node of the tokens' trie and byte: the node there, its token (-1: none), whether tokens go on from it.
        self.arcs: list[dict[int, tuple[int, int, bool]]] = [{} for _ in node]
        for b, n in node.items():
            if b:
                self.arcs[node[b[:-1]]][b[-1]] = n, ranks.get(b, -1), b in longer
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        #: States by their hypotheses. A state is a dictionary: the next state and the tokens emitted, by byte; the hypotheses, by -1.
        self.number: dict[tuple, dict] = {}
        self.reset()

    def reset(self) -> None:
        for state in self.number.values():
            state.clear()  # states refer to each other in circles
        hypotheses = -1, ((self.root, ()),)
        self.start = {-1: hypotheses}
        self.number = {hypotheses: self.start}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, or where merges don't make it."""
        if token not in self.made_of:
            raw = self.bytes_of[token]
            parts = [] if len(raw) == 1 else merge(raw, {b: r for i in range(len(raw)) for j in range(i + 1, len(raw) + 1) if (r := self.ranks.get(b := raw[i:j])) is not None and (j - i < len(raw) or j - i == 1)})
            self.made_of[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.made_of[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b can follow a (-1: nothing) in an encoding.

        Both are undone, the later merge first: the pair is an encoding unless, at some moment of the
        merges, the tokens that then touch at the border would merge before either takes its next merge.
        """
        key = a + 1 << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = (len(self.bytes_of[b]) == 1 or self.halves(b) is not None) and (a < 0 or self.touching(a, b))
        return ok

    def touching(self, a: int, b: int) -> bool:
        ranks, raw, made_of, until = self.ranks.get, self.bytes_of, self.made_of, 1 << 60
        while True:
            joined = ranks(raw[a] + raw[b])
            if joined is not None and joined < until:
                return False
            left = made_of[a] if a in made_of else self.halves(a)
            right = made_of[b] if b in made_of else self.halves(b)
            if left is None and right is None:
                return True
            # Of equal rank, the left merge comes first: at the border it then still holds when b is undone.
            if right is None or left is not None and a > b:
                until, a = a, left[1]
            else:
                until, b = b + 1, right[0]

    def step(self, at: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """The transition from state ``at``, made and kept. Its hypotheses stand longest bytes under way first."""
        last, alive = at[-1]
        arcs, pairs = self.arcs, self.pairs.get
        found: list[tuple[int, tuple[int, ...]]] = []
        whole = None
        for node, due in alive:
            arc = arcs[node].get(byte)
            if arc is None:
                continue
            node, token, more = arc
            # An encoding is unique, so where one token ends, no other does.
            if whole is None and token >= 0:
                before = due[-1] if due else last
                ok = pairs(before + 1 << 32 | token)
                if ok or ok is None and self.compatible(before, token):
                    whole = *due, token
            if more:
                found.append((node, due))
        if whole is not None:
            found.append((self.root, whole))
        out = found[0][1] if found else ()
        if out:
            for _, due in found:
                while due[: len(out)] != out:
                    out = out[:-1]
            if out:
                last = out[-1]
                found = [(node, due[len(out) :]) for node, due in found]
        # Only what is under way the longest can have nothing due: all others go on from its tokens.
        if not found or found[0][1]:
            last = -1
        hypotheses = last, tuple(found)
        to = self.number.get(hypotheses)
        if to is None:
            to = self.number[hypotheses] = {-1: hypotheses}
        at[byte] = to, out
        return to, out

    def end(self, at: dict, byte: int) -> tuple[int, ...]:
        """What is emitted from state ``at`` when ``byte`` is the last: of the transition, only the hypothesis that ends there."""
        last, alive = at[-1]
        for node, due in alive:
            _, token, _ = self.arcs[node].get(byte, (0, -1, False))
            if token >= 0 and self.compatible(due[-1] if due else last, token):
                return *due, token
        return ()

    def run(self, piece: bytes) -> list[int]:
        if len(self.number) >= MAX_STATES:
            self.reset()
        ids: list[int] = []
        at = self.start
        for byte in piece[:-1]:
            try:
                at, out = at[byte]
            except KeyError:
                at, out = self.step(at, byte)
            if out:
                ids += out
        if piece:
            ids += self.end(at, piece[-1])
        return ids


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without Python's search for circular garbage: it would go through all states and memos again and again, and finds none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Memo(dict[str, tuple[int, ...]]):
    """Ids by piece, encoded where they aren't known yet; looked up without a step of the interpreter where they are."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]]):
        self.encode = encode
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Splits a text by the pattern and encodes each piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        exact = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.ranks, self.split_any = ranks, regex.compile(exact).findall
        self.split_ascii = re.compile(exact.replace(r"\p{L}+", "[A-Za-z]+").replace(r"\p{N}+", "[0-9]+").replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")).findall
        # Latin-1 has the letters below and the numbers 00B2, 00B3, 00B9, 00BC to 00BE.
        letters, numbers = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
        self.split_latin = re.compile(exact.replace(r"\p{L}+", f"[{letters}]+").replace(r"\p{N}+", f"[{numbers}]+").replace(r"\p{L}", letters).replace(r"\p{N}", numbers)).findall
        self.transducer = Transducer(ranks)
        self.memo = Memo(self.piece)

    def split(self, text: str) -> list[str]:
        """The pattern's matches. The narrower patterns match the same where all characters are theirs; they are faster."""
        if text.isascii():
            return self.split_ascii(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else tuple(self.transducer.run(raw))

    def __call__(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(map(self.memo.__getitem__, self.split(text))))


class Utf8Stream:
    """Decodes ids that come in chunks. State: the bytes of an unfinished character (three at most); broken bytes give U+FFFD."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def end(self) -> str:
        return self.machine.decode(b"", True)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def encoder(name: str) -> Encoder:
    """The encoder of a public vocabulary, once per Python worker; its files are on every machine."""
    import public_tokenizers

    return Encoder(read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def decode(ids: Iterable[int], name: str, chunk: int = 4096) -> Iterator[str]:
    """The text of ids, in pieces, as they come."""
    stream = Utf8Stream(encoder(name).transducer.bytes_of)
    ids = list(ids)
    for at in range(0, len(ids), chunk):
        yield stream.feed(ids[at : at + chunk])
    yield stream.end()


def encode_decode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids array<int>, decoded binary: each whole text's ids and the bytes they decode to.

    Null or empty text: no ids, empty bytes. Null keys, repeated rows and other columns: each row
    gives one row; other columns are left out. An empty table gives an empty table.
    """

    def make():
        claim("bpe", encoder.cache_clear)
        encode = encoder(vocabulary)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            with uncollected():
                ids = [encode(x.decode()) for x in batch.column(1).to_pylist()]
                back = ["".join(decode(x, vocabulary)).encode() for x in ids]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())], names=["key", "ids", "decoded"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key).alias("key"), utf8(text).alias("raw")), make, f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def op5(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``encode_decode``."""
    return encode_decode(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
