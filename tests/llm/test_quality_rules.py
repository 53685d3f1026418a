from collections import Counter

import pytest

from tekstra.llm import quality_rules as q


def base(text):
    """The contract's base columns, the plain way."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    marked = [False] * len(words)
    windows = Counter(zip(words, words[1:], words[2:]))
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            marked[i : i + 3] = [True] * 3
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, rep = len(words), sum(marked)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, rep, n < 50 or 100 * rep > 50 * n


def test_base_columns_equal_the_plain_way(odd_docs, documents):
    for docs in (odd_docs, documents):
        want = Counter((r.doc_id, *base(r.text)) for r in docs.collect())
        found = q.op9(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == want
        assert all(not (r.base_failed and r.kept) for r in found)


def test_clean_documents_are_kept_and_symbol_noise_goes(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = q.op9(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    noise = [r.kept for r in rows if r.quality == 0 and r.n_symbols > 0.15 * r.word_chars]
    assert all(clean) and len(clean) > 200 and noise and not any(noise)


@pytest.mark.parametrize("lang,text", [("en", "The quick brown fox jumps over the lazy dog while many people watch and wonder how it could ever be so fast "), (None, "Съешь же ещё этих мягких французских булок да выпей чаю и потом расскажи об этом всем своим друзьям "), ("xx", "Η γρήγορη αλεπού πηδά πάνω από το τεμπέλικο σκυλί και όλοι κοιτούν με μεγάλη απορία ")])
def test_ordinary_text_of_any_script_passes(lang, text):
    words = text.split()
    text = " ".join(" ".join(words[i:] + words[:i])[: 20 + 7 * i] for i in range(len(words)))
    got = q.measure(text.encode(), lang)
    assert got[5] or got[6], got


def test_byte_fallback_and_monotony_are_rejected():
    runes = " ".join(chr(0x16A0 + i % 70) + chr(0x16A0 + i * 7 % 70) for i in range(100)).encode()
    assert q.measure(runes, None)[9] > 0.4
    hexes = " ".join(f"{i * 2654435761 % 2**64:x}$%{i}" for i in range(100)).encode()
    assert not q.measure(hexes, "en")[6]


def test_filter_keeps_all_columns(odd_docs, no_docs):
    out = q.kept(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == 0
    assert q.op9(no_docs).count() == 0 and q.kept(no_docs).count() == 0


def test_small_caches_do_not_change_results(monkeypatch):
    text = ("some words come again and some do not " * 3 + " ".join(f"w{i}" for i in range(60))).encode()
    want = q.measure(text, "en")
    monkeypatch.setattr(q, "MAX_WORDS", 3)
    q.fertility.cache_clear()
    assert q.measure(text, "en") == want == q.measure(text, "en")


def plain(text, lang):
    """The method's measures and its verdict, word by word from the vocabularies themselves."""
    import math
    import re

    import public_tokenizers
    import sentencepiece
    import tiktoken

    from tekstra.llm import bpe

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    multi = tiktoken.Encoding("m", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})

    def measure(text, lang):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if not words:
            return None, None, None, None, None, False
        ids = [i for w in words for i in pieces.encode(w)]
        n_multi = sum(len(multi.encode_ordinary(" " + w)) for w in words)
        chars = sum(map(len, words)) + len(words)
        counts = Counter(ids)
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values())
        share = sum(pieces.IsByte(i) for i in ids) / len(ids)
        letters = Counter(q.script_of(c) for c in text if q.script_of(c))
        key = lang if lang in q.BANDS else "latin" if text.isascii() else min(letters, key=lambda k: (-letters[k], k)) if letters else "any"
        a, b, c, d, ratio, most, low, high = q.BANDS[key]
        x, y = chars / n_multi, chars / len(ids)
        kept = a <= x <= b and c <= y <= d and x >= ratio * y and share <= most and min(low, 0.6 * math.log2(len(ids))) <= entropy <= high
        return x, y, share, entropy, key, kept

    return measure(text, lang) if lang is not Ellipsis else measure


def test_measures_and_verdict_equal_the_plain_way(spark, odd_docs):
    measure = plain(None, ...)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").unionByName(odd_docs.select("doc_id", "text", "lang"))
    more = ["Съешь же ещё этих мягких французских булок да выпей чаю " * 9, "日本語のテキストです 漢字と仮名 " * 20, "ᚠᚢᚦ ᚨᚱᚲ ᚷᚹᚺ " * 30, "$% #* && " * 40, "12 34 5678 " * 30]
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(more)], "doc_id long, text string, lang string"))
    want = Counter()
    for r in docs.collect():
        *x, kept = measure(r.text, r.lang)
        want[r.doc_id, *(round(v, 9) if isinstance(v, float) else v for v in x), kept and not base(r.text)[5]] += 1
    found = Counter((r.doc_id, *(round(v, 9) if isinstance(v, float) else v for v in (r.chars_per_token, r.chars_per_piece, r.byte_share, r.token_entropy, r.band)), r.kept) for r in q.op9(docs).collect())
    assert found == want and len({b for _, *_, b, _ in found}) > 5
