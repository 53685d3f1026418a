import gc
import hashlib
import random

import public_tokenizers
import tiktoken

from tekstra.llm import bpe

NAME = "byte_bpe_50k.tiktoken"


def library(name=NAME):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(name)), special_tokens={})


def test_transducer_equals_library_on_odd_texts():
    rng, ours, theirs = random.Random(3), bpe.encoder(NAME), library()
    chars = list("aeiou thrnls'’\n\t  0123.,;-_*#@<|>éüñß日本語𝔘́\xa0\x1c\x85²½ªº") + ["'s", "the", "ing", "<|endoftext|>"]
    for n in range(800):
        text = "".join(rng.choices(chars, k=n % 90))
        assert ours(text) == theirs.encode_ordinary(text), repr(text)
    for text in ("a" * 5000, "ab" * 3000, "\n" * 999, " " * 1001 + "x"):
        assert ours(text) == theirs.encode_ordinary(text)


def test_every_token_and_multilingual_vocabulary():
    ours, theirs = bpe.encoder("byte_bpe_multi_50k.tiktoken"), library("byte_bpe_multi_50k.tiktoken")
    tokens = [b.decode("utf-8", "ignore") for b in list(ours.ranks)[::7]]
    for a, b in zip(tokens, tokens[1:], strict=False):
        assert ours(a + b) == theirs.encode_ordinary(a + b)


def test_full_caches_do_not_change_results(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 20)
    ours, text = bpe.Encoder(bpe.read_ranks(public_tokenizers.path(NAME)), public_tokenizers.PATTERN), "streaming transducers emit tokens after bounded lookahead " * 5
    assert ours(text) == library().encode_ordinary(text)


def test_new_words_equal_library():
    rng, ours, theirs = random.Random(5), bpe.Encoder(bpe.read_ranks(public_tokenizers.path(NAME)), public_tokenizers.PATTERN), library()
    parts = ["th", "er", "ing", "wh", "ou", "ción", "sch", "eau", "é", "ß", "ment", "rst", "q", "7", "aa"]
    text = " ".join("".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(20_000))
    assert ours(text) == theirs.encode_ordinary(text)


def test_the_last_byte_makes_no_state():
    transducer = bpe.Transducer(bpe.read_ranks(public_tokenizers.path(NAME)))
    for n, piece in enumerate((b"z", b"zq", b"zqj", b"zqj", b"zqk"), 1):
        assert b"".join(map(transducer.bytes_of.get, transducer.run(piece))) == piece
        assert len(transducer.number) == min(n, 3)


def test_nothing_is_tried_beside_a_token_that_fits(monkeypatch):
    transducer, tried = bpe.Transducer(bpe.read_ranks(public_tokenizers.path(NAME))), []
    step, compatible = transducer.step, transducer.compatible
    monkeypatch.setattr(transducer, "step", lambda at, byte: tried.append([]) or step(at, byte))
    monkeypatch.setattr(transducer, "compatible", lambda a, b: tried[-1].append(compatible(a, b)) or tried[-1][-1])
    transducer.run(b" internationalisationallyx")
    assert len(tried) > 20 and any(map(any, tried)) and not any(True in of_step[:-1] for of_step in tried[:-1])


def test_dropped_states_are_freed_without_the_collector():
    transducer = bpe.Transducer(bpe.read_ranks(public_tokenizers.path(NAME)))
    transducer.run(b"abababababababababab")
    states = list(transducer.number.values())
    transducer.reset()
    assert len(states) > 2 and not any(states) and transducer.run(b"ab") == library().encode_ordinary("ab")
    with bpe.uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()


def test_decoder_takes_any_chunks():
    text = "naïve 👩‍👧 日本語 ok"
    ids = bpe.encoder(NAME)(text)
    for chunk in (1, 2, 3, 100):
        assert "".join(bpe.decode(ids, NAME, chunk)) == text
    stream = bpe.Utf8Stream({0: b"\xe6\x97", 1: b"\xa5", 2: b"\xff"})
    assert stream.feed([0]) + stream.feed([1, 2, 0]) + stream.end() == "日��"


def test_round_trip_of_documents(odd_docs, no_docs, documents):
    theirs = library()
    for docs in (odd_docs, documents):
        found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op5(docs).collect()}
        want = set()
        for r in docs.collect():
            ids = theirs.encode_ordinary(r.text or "")
            want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert found == want and bpe.op5(docs).count() == docs.count()
    assert bpe.op5(no_docs).count() == 0
