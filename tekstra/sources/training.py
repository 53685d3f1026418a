"""Tokenizer training (T16): SentencePiece over a bounded, ordered sample of sentences that streams to the driver."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols that are never split.
SYMBOLS = ["<pad>", "<bos>", "<eos>", "<system>", "<user>", "<assistant>"]


def train_pieces(docs: DataFrame, ord: str, text: str = "text", vocabulary: int = 8000, kind: str = "bpe", sentences: int = 1_000_000, coverage: float = 0.9995) -> bytes:
    """The model's bytes. The first ``sentences`` lines in order are read, one at a time."""
    import sentencepiece

    lines = docs.select(ord, F.posexplode(F.split(text, "\n")).alias("line", "t")).where(F.trim("t") != "").orderBy(ord, "line").limit(sentences).select("t")
    out = io.BytesIO()
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=(r["t"] for r in lines.toLocalIterator()), model_writer=out, vocab_size=vocabulary, model_type=kind, character_coverage=coverage, split_digits=True, user_defined_symbols=SYMBOLS, bos_id=-1, eos_id=-1, pad_id=-1, unk_id=0, hard_vocab_limit=False, minloglevel=2, num_threads=4)
    return out.getvalue()
