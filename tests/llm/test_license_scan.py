import random
import re

import pytest

from tekstra.llm import license_scan as l


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in l.PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [rng.choice("abcé ")], [out[at], "x"]])
    return "".join(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_base_equals_the_plain_way(odd_docs, no_docs, spark):
    texts = ["MIT License, mit-license; MIT LICENSE", "the apache license and the General  Public\nLicense", "mitlicense xmit license mit licenseé", "GNU general public license general public license"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for docs in (odd_docs, more, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        want = sorted((repr(r.doc_id), *map(repr, plain(r.text))) for r in docs.collect())
        found = sorted((repr(r.doc_id), *map(repr, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in l.op2(docs).collect())
        assert found == want
    assert l.op2(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_no_notice_within_its_edits_is_missed(seed):
    rng = random.Random(seed)
    notice, label, k = rng.choice(l.NOTICES)
    text = f"some words {edited(rng, notice, rng.randint(0, k))} and words"
    joined = b" " + b" ".join(text.encode().translate(l.TO_WORDS).split()) + b" "
    inner = joined.decode()
    near = min(distance(notice, inner[a:b]) for a in range(8, 16) for b in range(len(inner) - 16, len(inner) - 5) if b > a)
    found = [x for x in l.fuzzy(joined, ((notice, label, k),))]
    assert bool(found) or near > k
    for x in found:
        assert x[0] == label and 0 <= x[3] <= k and 0 <= x[4] <= 1


def test_best_label_stands_and_score(spark):
    got = l.scan_text(b"Licensed under CC BY-NC 4.0.", tuple(l.NOTICES))
    assert got[4:7] == ("", "cc-by-nc", 1.0)
    got = l.scan_text("Releasd under teh MIT Licence".encode(), tuple(l.NOTICES))
    assert got[1] == 0 and got[5] == "mit" and 0 < got[6] < 1
    assert l.scan_text(b"no notice here at all", tuple(l.NOTICES))[5:7] == ("", 0.0)


def test_worse_matches_before_the_best_are_found():
    for texts, edits in ((["reservd", "reserved", "reserved"], [1, 0, 0]), (["reservd", "reserved", "resrved"], [1, 0, 1])):
        raw = " ".join(f"all rights {x}" for x in texts).encode()
        assert [(x[1], x[2], x[3]) for x in l.scan_text(raw, tuple(l.NOTICES))[7]] == [(3 * k, 3 * k + 3, e) for k, e in enumerate(edits)]


def passages(text, notice, k):
    """Every stretch within k edits of the notice, by the edit distance of each: start, end, edits."""
    n = len(notice)
    out = []
    for a in range(len(text)):
        for b in range(max(a, a + n - k), min(len(text), a + n + k) + 1):
            if abs(b - a - n) <= k and (d := distance(notice, text[a:b])) <= k:
                out.append((a, b, d))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_spans_labels_and_score_by_edit_distance(seed):
    """Best first, each span is a best one of those that overlap no span before it, and no passage is left beside them."""
    rng = random.Random(1000 + seed)
    notice, label, k = rng.choice([x for x in l.NOTICES if len(x[0]) < 45])
    parts = [rng.choice([edited(rng, notice, rng.randint(0, k + 1)), "some words", "né ü", notice[: len(notice) // 2]]) for _ in range(rng.randint(1, 4))]
    joined = b" " + b" ".join(" ".join(parts).encode().translate(l.TO_WORDS).split()) + b" "
    text = joined.decode()
    every = passages(text, notice, k)
    found = sorted(l.matches(text, l.Notice(notice, label, k), sorted({(max(0, a - k), min(len(text), b + k)) for a, b, _ in every})), key=lambda x: (x[2], x[0]))
    left = every
    for a, b, d in found:
        assert d == distance(notice, text[a:b]) == min(x[2] for x in left)
        left = [x for x in left if x[1] <= a or b <= x[0]]
    assert not left
    got = l.scan_text(joined, ((notice, label, k),))
    assert [x[3] for x in got[7]] == [d for _, _, d in sorted(found)]
    assert got[5] == ",".join(sorted({*([got[4]] if got[4] else []), *([label] if found else [])}))
    assert got[6] == (1.0 if got[1] else max((1 - d / len(notice) for _, _, d in found), default=0.0))
    for (a, b, d), (_, first, end, edits, score) in zip(sorted(found), got[7], strict=True):
        assert first == text[1 : a + 1 + (text[a] == " ")].count(" ") and end == first + len(text[a:b].split())
        assert (edits, score) == (d, 1 - d / len(notice))


def test_many_notices_take_linear_time():
    import time

    raw = b"all rights reserved licensed under the mit license text all rights reservd "
    took = []
    for n in (2_000, 50_000):
        start = time.perf_counter()
        got = l.scan_text(raw * n, tuple(l.NOTICES))
        took.append(time.perf_counter() - start)
        assert sum(x[0] == "proprietary" for x in got[7]) == 2 * n
    assert took[1] < 60 * max(took[0], 0.05), took
