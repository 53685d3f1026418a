import hashlib
import random
import re

import numpy as np
import pytest

from tekstra.llm import pii

#: The contract's patterns, applied as they stand.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_equals_the_patterns(documents):
    rng = random.Random(1)
    texts = [r.text for r in documents.collect()] + [pii.made_example(rng)[0] for _ in range(1500)]
    texts += ["".join(rng.choices("0123456789..@@+-() ab%_\n", k=60)) for _ in range(3000)] + ["a@b@c.d@e.f.g", "1.2.3.4.5.6.7.8.9", "0001.2.3.255", "@@a.b", "x@-.-", "4111 1111-1111 1111", "+1 (555) 123-4567."]
    for text in texts:
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_are_linear():
    for text in ("x" * 300_000, "1" * 100_000, "1." * 60_000, "+1" + " " * 100_000, "a@" * 50_000, "@" * 50_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def test_gradients():
    small = pii.Tagger(hidden=3, embed=2)
    small.w = {k: v.astype(np.float64) for k, v in small.w.items()}
    x, y = pii.labelled(2, 3)
    x, y = x[:, :12], y[:, :12]
    scores, kept = small.forward(x, True)
    _, d, move = small.likelihood(scores, y, x > 0)
    grad = small.backward(d, kept) | {"move": move}
    for name, at in (("wx", (0, 1, 5)), ("wh", (1, 2, 4)), ("b", (0, 0, 3)), ("out", (2, 1)), ("bias", (0,)), ("move", (0, 3))):
        losses = []
        for shift in (1e-3, -1e-3):
            small.w[name][at] += shift
            losses.append(small.likelihood(small.forward(x)[0], y, x > 0)[0] * (x > 0).sum() / len(x))
            small.w[name][at] -= shift
        assert abs((losses[0] - losses[1]) / 2e-3 - grad[name][at]) < 0.02 * max(1, abs(grad[name][at])), name


def test_held_out_accuracy(tagger):
    x, y = pii.labelled(300, 999)
    hit = n = said = 0
    for (tags, sure), gold in zip(tagger.decode(list(tagger.forward(x)[0])), y, strict=True):
        a, b = set(pii.spans_of(tags, sure)), set(pii.spans_of(gold, np.ones(len(gold))))
        hit, n, said = hit + len(a & b), n + len(b), said + len(a)
    assert hit / n > 0.6 and hit / said > 0.85


def test_tagger_adds_what_patterns_miss_and_little_else(tagger, spark):
    text = "the reader wrote here +1 (269) 555-3296 4524132264652876 and left"
    assert pii.base_spans(text) == []
    ((base, spans),) = pii.scanned(tagger, [text])
    assert base == [] and {k for k, _, _ in spans} >= {"phone"}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    found = pii.scanned(tagger, [r.text for r in rows])
    base, every = sum(len(b) for b, _ in found), sum(len(s) for _, s in found)
    assert base <= every <= 1.1 * base + 3 and all(set(b) <= set(s) for b, s in found)


def test_windows_do_not_matter_much_and_spans_at_borders_are_whole(tagger):
    for before in range(0, 150, 7):
        text = "0 " * (before // 2) + "write to jane.roe@example.org now please"
        assert ("email", text.index("jane"), text.index(" now")) in pii.scanned(tagger, [text])[0][1]


def test_query_and_redaction(odd_docs, no_docs, spark):
    for r in pii.op3(odd_docs).collect():
        assert len(r.base_sha256) == 64
    more = spark.createDataFrame([(1, "card 4111 1111 1111 1111, ip 10.0.0.1, bob@x.org", 47, "t"), (2, None, None, "t")], "doc_id long, text string, n_chars long, spans string")
    (r,) = pii.op3(more.where("doc_id = 1")).collect()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 0)
    assert r.base_sha256 == hashlib.sha256(b"email:39:48,ip:29:37,card:5:24").hexdigest()
    out = pii.redacted(more)
    assert out.columns == more.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, "card <CARD>, ip <IP>, <EMAIL>", 29), (2, None, None)]
    assert pii.op3(no_docs).count() == 0 and pii.redacted(no_docs).count() == 0 and pii.redacted(odd_docs).count() == odd_docs.count()


def test_training_is_repeatable():
    a, b = pii.Tagger(), pii.Tagger()
    assert a.train(steps=3) == b.train(steps=3)


def test_forms_without_digit_or_at_sign_are_found_in_any_context(tagger, spark):
    for form in ("jane.doe(at)example.com", "jane.doe[at]example.com"):
        for after in (" and the lazy dog" * 6, " 7" + " and the lazy dog" * 6):
            text = "the quick brown fox " * 6 + form + after
            assert pii.base_spans(text) == [] and pii.scanned(tagger, [text])[0][1] == [("email", 120, 143)]
            docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
            assert pii.op3(docs).first().spans == "email:120:143" and form not in pii.redacted(docs).first().text


def test_every_character_is_in_a_window(tagger, monkeypatch):
    seen = []
    real = pii.Tagger.scores
    monkeypatch.setattr(pii.Tagger, "scores", lambda self, x: seen.append(int((x > 0).sum())) or real(self, x))
    monkeypatch.setattr(pii.Tagger, "decode", lambda self, scores: [(np.ones(len(s), np.int64), np.zeros(len(s))) for s in scores if seen.append(len(s)) is None])
    pii.tagged(tagger, ["only words here " * 40])
    assert seen == [1152, 640]


def test_blocks_equal_one_pass_over_each_text(tagger, monkeypatch):
    x = np.concatenate([pii.labelled(6, 77)[0].reshape(-1), pii.classes("plain words only " * 30)])
    whole = tagger.scores(np.resize(x, (10, 128))).reshape(-1, pii.TAGS)
    assert np.abs(tagger.scores(x[None, :128]) - tagger.forward(x[None, :128])[0]).max() < 1e-4
    texts = [whole[:700], whole[700:701], whole[:0], whole[300:1100]]
    move = (tagger.w["move"] + pii.ALLOWED).astype(np.float64)
    for run_up in (64, 1):  # one character's run-up is wrong often, and must not show
        monkeypatch.setattr(pii, "RUN_UP", run_up)
        monkeypatch.setattr(pii, "BLOCK", 32 if run_up == 1 else 256)
        for s, (tags, sure) in zip(texts, tagger.decode(texts), strict=True):
            if not len(s):
                assert len(tags) == 0
                continue
            best, back, alpha, beta = [s[0] + pii.START], [], [s[0] + pii.START], [np.zeros(pii.TAGS)]
            for t in range(1, len(s)):
                back.append((best[-1][:, None] + move).argmax(0))
                best.append((best[-1][:, None] + move).max(0) + s[t])
                alpha.append(pii.lse(alpha[-1][:, None] + move, 0) + s[t])
            for t in range(len(s) - 1, 0, -1):
                beta.append(pii.lse(move + s[t] + beta[-1], 1))
            want = [int(best[-1].argmax())]
            for b in reversed(back):
                want.append(int(b[want[-1]]))
            assert tags.tolist() == want[::-1]
            share = np.exp(np.array(alpha) + np.array(beta[::-1]) - pii.lse(alpha[-1], 0))[np.arange(len(s)), tags]
            assert not tags.any() or np.abs(share - sure).max() < 1e-4


def test_windows_left_out_change_nothing(tagger):
    """The network over every window, the CRF held to outside where no span can pass the check: the same spans."""
    rng = random.Random(8)
    texts = ["".join(rng.choice([pii.made_example(rng)[0], " quiet words without any sign " * rng.randint(1, 9), "a@b at c.de 1.2.3.4 "]) for _ in range(rng.randint(1, 6))) for _ in range(120)] + ["", "x", "call 555-123-4567", "jane(at)x.org"]
    quick = pii.tagged(tagger, texts, where=[pii.possible(t) for t in texts])
    for text, got in zip(texts, quick, strict=True):
        codes = pii.classes(text)
        cuts = range(0, max(1, len(text) - 64), 64) if text else ()
        scores = np.zeros((len(text), pii.TAGS), np.float32)
        for s in cuts:
            x = np.zeros((1, 128), np.int64)
            x[0, : len(codes[s : s + 128])] = codes[s : s + 128]
            e = min(s + 128, len(text))
            lo, hi = (s + 32 if s else 0), (e - 32 if e < len(text) else e)
            scores[lo:hi] = tagger.scores(x)[0, lo - s : hi - s]
        shut = np.ones(len(text), bool)
        for a, b in pii.possible(text):
            shut[a:b] = False
        scores[shut, 1:] = -1e4
        ((tags, sure),) = tagger.decode([scores])
        assert pii.spans_of(tags, sure) == got, text


def test_every_span_that_passes_the_check_lies_in_a_stretch():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choices(["1", "23", "4.5", ".", "-", " ", "+", "(", ")", "@", "at", "(at)", " at ", "[dot]", "a", "b-c", ".de", "\n"], k=rng.randint(1, 14)))
        stretches = pii.possible(text)
        assert all(a < b for a, b in stretches) and all(x[1] < y[0] for x, y in zip(stretches, stretches[1:], strict=False))
        for a in range(len(text)):
            for b in range(a + 1, len(text) + 1):
                if any(pii.plausible(k, text[a:b]) for k in pii.KINDS):
                    assert any(x <= a and b <= y for x, y in stretches), (text, text[a:b])
    rng = random.Random(4)
    for _ in range(3000):
        text = " ".join("".join(rng.choices("0123456789", k=rng.randint(1, 7))) + rng.choice(["", ".", "-", ") ", " ("]) for _ in range(rng.randint(2, 7)))
        for m in re.finditer(r"[+(]?[0-9]", text):
            for b in range(m.end(), len(text) + 1):
                if any(pii.plausible(k, text[m.start() : b]) for k in pii.KINDS):
                    assert any(x <= m.start() and b <= y for x, y in pii.possible(text)), (text, text[m.start() : b])


def test_labelled_forms_can_pass_the_check_and_stand_in_stretches():
    rng, n, passed = random.Random(21), 0, 0
    for _ in range(300):
        text, spans = pii.made_example(rng)
        for kind, a, b in spans:
            n, passed = n + 1, passed + pii.plausible(kind, text[a:b])
            assert kind != "email" or pii.plausible(kind, text[a:b]), text[a:b]
    assert passed > 0.97 * n


def test_long_digit_texts(tagger):
    import time

    rng = random.Random(6)
    text = " ".join("".join(rng.choices("0123456789", k=rng.randint(3, 9))) for _ in range(100_000))
    start = time.perf_counter()
    pii.scanned(tagger, [text])
    assert time.perf_counter() - start < 30
    for odd in ("(at)" * 50_000, " at a" * 50_000, "a@" * 50_000, "1 " * 100_000, "+1(" * 50_000, "a.b@c.d" * 30_000):
        pii.possible(odd)


def test_malformed_utf8_reads_as_replacement_characters(spark):
    docs = spark.sql("select 1L doc_id, cast(X'FF61' as string) text, 2L n_chars union all select 2L, cast(concat(X'FF', cast(' mail a.b@c.de' as binary)) as string), 9L")
    assert [r.spans for r in pii.op3(docs).orderBy("doc_id").collect()] == ["", "email:7:15"]
    assert sorted(r.text for r in pii.redacted(docs).collect()) == ["� mail <EMAIL>", "�a"]


def test_tags_and_marginals_equal_all_paths(tagger):
    """Viterbi and marginals against every sequence of tags, one by one, for pieces with and without text borders."""
    import itertools

    rng = np.random.default_rng(6)
    move = (tagger.w["move"] + pii.ALLOWED).astype(np.float64)
    for n, first, last in ((1, True, True), (3, True, True), (4, False, False), (4, True, False), (4, False, True)):
        scores = rng.normal(0, 2, (n, pii.TAGS)).astype(np.float32)
        paths = np.array(list(itertools.product(range(pii.TAGS), repeat=n)))
        value = scores[np.arange(n), paths].sum(1) + move[paths[:, :-1], paths[:, 1:]].sum(1) + (pii.START[paths[:, 0]] if first else move[0, paths[:, 0]]) + (0 if last else move[paths[:, -1], 0])
        best = paths[value.argmax()]
        ((tags, sure),) = tagger.decode([scores], [(first, last)])
        assert tags.tolist() == best.tolist()
        weight = np.exp(value - value.max())
        share = [weight[paths[:, t] == best[t]].sum() / weight.sum() for t in range(n)]
        assert not best.any() or np.abs(sure - share).max() < 1e-4
