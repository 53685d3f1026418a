"""Operators against sequential models."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tekstra.operators import chat, dedup, langid, sampling, stats, tokens
from tekstra.plans import cleaning

ABC = "abcdefghijklmnopqrstuvwxyz .!?"
encode = lambda t: tokens.char_ids(t, ABC)


def ids(text):
    return [7 + ABC.index(c) if c in ABC else 0 for c in text]


def grams(text):
    kept, total = [], 0
    for w in re.findall("[a-z0-9]+", text.lower()):
        if total + len(w) + 1 > 250_000:
            break
        total += len(w) + 1
        kept.append(w)
    return [" ".join(kept[i : i + 5]) for i in range(len(kept) - 4)]


@pytest.mark.parametrize("algorithm", ["md5", "blake2b"])
def test_near_duplicates_equal_a_sequential_model(spark, algorithm):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 50)}" for _ in range(80)]
    rows = []
    for i in range(60):
        w = list(base) if i % 3 else [f"v{rng.randint(0, 30)}" for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 6)):
            if w:
                w[rng.randrange(len(w))] = f"u{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    rows.append((60, "long " * 60_000))
    rows.append((61, "long " * 60_000 + "tail"))
    seen, want = set(), {}
    for i, t in rows:
        h = (lambda g: hashlib.blake2b(g.encode(), digest_size=8).hexdigest()) if algorithm == "blake2b" else (lambda g: hashlib.md5(g.encode()).hexdigest()[:16])
        s = sorted(map(h, grams(t)))[:12]
        want[i] = sum(x in seen for x in s) >= 8
        seen.update(s)
    docs = spark.createDataFrame(rows, "i long, text string").repartition(5)
    assert {r.i: r.near_dup for r in dedup.near_duplicates(docs, "i", algorithm=algorithm).collect()} == want
    assert any(want.values())


def test_cross_source(spark):
    rows = [(0, "aya", "p", "t"), (1, "dolly", "p", "t"), (2, "aya", "p", "u"), (3, "aya", "q", "t"), (4, "aya", "p", "t")]
    got = {r.kind: r.n for r in dedup.cross_source_report(spark.createDataFrame(rows, "ord int, source string, prompt string, target string")).collect()}
    assert got == {"kept": 3, "rejected_duplicates": 2, "dup_pair_aya|dolly": 1, "dup_pair_aya": 1, "prompt_only_duplicates": 1}


def test_language_gate(spark):
    train = [(i, lang, t) for i, (lang, t) in enumerate([("en", "the cat sat on the mat and the dog ran over the hill"), ("tl", "ang pusa ay umupo sa banig at ang aso ay tumakbo sa burol")] * 3)]
    docs = spark.createDataFrame(train, "i long, lang string, text string")
    profile = langid.profiles(docs)
    new = spark.createDataFrame([(1, "en", "the dog sat on the hill"), (2, "en", "ang aso ay umupo sa burol"), (3, "en", "!!"), (4, "tl", "!!")], "i long, lang string, text string")
    got = {r.i: (r.pred, r.wrong_language) for r in langid.gate(new, profile, "i", "en", order=["en", "tl"]).collect()}
    assert got == {1: ("en", False), 2: ("tl", True), 3: ("en", False), 4: ("en", True)}
    counts = Counter(g for _, lang, t in train if lang == "en" for g in (lambda s: [s[i : i + 3] for i in range(len(s) - 2)])(t))
    logp = {g: math.log((c + 1) / (sum(counts.values()) + len(counts) + 1)) for g, c in counts.items()}
    text = "the dog xyz"
    want = sum(logp.get(text[i : i + 3], math.log(1e-9)) for i in range(len(text) - 2)) / (len(text) - 2)
    one = spark.createDataFrame([(1, text)], "i long, text string")
    assert langid.scores(one, profile, "i").where("plang = 'en'").first().score == pytest.approx(want)


def test_training_rows(spark):
    docs = spark.createDataFrame([(i, "en", f"s{i % 2}") for i in range(20)], "i long, lang string, source string")
    assert {r.i for r in langid.training_rows(docs, "i", "lang", 4).collect()} == {0, 1, 2, 3}
    assert {r.i for r in langid.training_rows(docs, "i", "lang", 5, "source").collect()} == {0, 1, 2, 3}


def tokenized_plain(turns, block):
    core = [5, *ids(turns[-2][1]), 6, *ids(turns[-1][1]), 3]
    if 1 + len(core) > block:
        return None
    kept, dropped = [], False
    for role, text in reversed(turns[:-2]):
        t = [5 if role == "user" else 6, *ids(text)]
        if sum(map(len, kept)) + len(t) > block - 1 - len(core):
            dropped = True
            break
        kept.insert(0, t)
    out = [2, *(x for t in kept for x in t), *core]
    start = len(out) - len(turns[-1][1]) - 1
    return out, [out[i + 1] if start - 1 <= i < len(out) - 1 else -100 for i in range(len(out))], start, len(turns[-1][1]) + 1, dropped


def test_tokenized_and_batches(spark):
    rng = random.Random(4)
    rows = []
    for i in range(80):
        turns = [("user" if rng.random() < 0.6 else "assistant", "".join(rng.choices(ABC + "é", k=rng.randint(0, 14)))) for _ in range(rng.randint(2, 7))]
        rows.append((i, turns))
    df = spark.createDataFrame(rows, "i long, turns array<struct<role:string,text:string>>")
    out = tokens.tokenized(df, encode, 30).collect()
    for r in out:
        want = tokenized_plain([tuple(t) for t in r.turns], 30)
        assert (None if r.too_long else (r.ids, r.labels, r.target_start, r.n_supervised, r.dropped_turns)) == want
    assert any(r.too_long for r in out) and any(r.dropped_turns for r in out)
    kept = tokens.checked(tokens.tokenized(df, encode, 30).where("not too_long"), 30)
    padded = tokens.batches(kept, "i", 8).collect()
    for b in {r.batch for r in padded}:
        mine = [r for r in padded if r.batch == b]
        assert len({len(r.ids) for r in mine}) == 1 and len(mine) <= 8 and all(len(r.ids) == len(r.labels) for r in mine)
    with pytest.raises(Exception, match="bad lengths"):
        tokens.checked(kept.withColumn("labels", F.array(F.lit(1))), 30).select("ids").collect()


def test_history_prompt_trim_and_alphabet(spark):
    turns = [("user", "abc"), ("assistant", "d"), ("user", "e")]
    df = spark.createDataFrame([(turns,)], "h array<struct<role:string,text:string>>")
    got = df.select(tokens.history_ids(F.col("h"), encode, "", 9).alias("a"), tokens.history_ids(F.col("h"), encode, "s", 256).alias("b"), tokens.prompt_ids(F.col("h"), encode).alias("c"), tokens.trimmed_reply(tokens.ints(1, 2, 6, 3, 9), [6, 3]).alias("d"), tokens.trimmed_reply(tokens.ints(1, 2), [6]).alias("e")).first()
    assert got.a == [2, 6, *ids("d"), 5, *ids("e"), 6]
    assert got.b == [2, 4, *ids("s"), 5, *ids("abc"), 6, *ids("d"), 5, *ids("e"), 6] and got.c == [2, *got.b[3:]]
    assert got.d == [1, 2] and got.e == [1, 2]
    docs = spark.createDataFrame([(1, "ba𝔘"), (0, "cab")], "i long, text string")
    assert tokens.first_seen_alphabet(docs, "i") == "cab𝔘"
    assert docs.where("i = 1").select(tokens.decoded(tokens.char_ids("text", "cab𝔘"), "cab𝔘").alias("t")).first().t == "ba𝔘"


def test_packing_equals_a_sequential_model(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["en", "tl"]), rng.randint(1, 60)) for i in range(300)]
    used, want = Counter(), set()
    stopped = set()
    for i, lang, n in rows:
        budget = {"en": 900, "tl": 20}[lang]
        if lang in stopped:
            continue
        if used[lang] + n > budget and used[lang] > 0:
            stopped.add(lang)
            continue
        used[lang] += n
        want.add(i)
    got = tokens.packed(spark.createDataFrame(rows, "i long, lang string, n long"), {"en": 900, "tl": 20}, "i")
    assert {r.i for r in got.collect()} == want


def test_windows_and_stream(spark):
    stream = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") * 3).cast("int").alias("token"))
    for r in tokens.windows(stream, 8, 20, 1).collect():
        assert len(r.x) == len(r.y) == 8 and r.x[1:] == r.y[:-1] and all(b - a == 3 for a, b in zip(r.x, r.y))
    with pytest.raises(ValueError):
        tokens.windows(stream.limit(5), 8, 2, 1)


def test_forest(spark):
    m = [("r", None, "prompter", None, "hi"), ("a", "r", "assistant", 1, "no"), ("b", "r", "assistant", 0, "yes"), ("c", "b", "prompter", None, "more"), ("d", "c", "assistant", None, "x"), ("e", "c", "assistant", None, "w"), ("f", "gone", "assistant", 0, "orphan")]
    df = spark.createDataFrame([(i, p, "t", role, rank, text, "validation") for i, p, role, rank, text in m], "message_id string, parent_id string, message_tree_id string, role string, rank int, text string, split string")
    got = {r.id: [tuple(t) for t in r.turns] for r in chat.forest_examples(df).collect()}
    assert got == {"oasst-b": [("user", "hi"), ("assistant", "yes")], "oasst-d": [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "x")]}
    assert {r.message_id for r in chat.best_replies(df).collect()} == {"b", "d", "f"}


def test_forest_loses_no_deep_chain_silently(spark):
    m = [(f"m{k}", f"m{k - 1}" if k else None, "t", "assistant" if k % 2 else "prompter", None, str(k), "train") for k in range(6)]
    df = spark.createDataFrame(m, "message_id string, parent_id string, message_tree_id string, role string, rank int, text string, split string")
    assert {r.id: len(r.turns) for r in chat.forest_examples(df, 6).collect()} == {"oasst-m1": 2, "oasst-m3": 4, "oasst-m5": 6}
    with pytest.raises(RuntimeError, match="deeper"):
        chat.forest_examples(df, 3)


def test_forest_of_any_depth_in_few_rounds(spark):
    n = 1000
    rows = [(f"m{k}", f"m{k - 1}" if k else None, "t", "assistant" if k % 2 else "prompter", None, f"text {k}", "train") for k in range(n)]
    df = spark.createDataFrame(rows, "message_id string, parent_id string, message_tree_id string, role string, rank int, text string, split string").repartition(3)
    found = {r.id: r.turns for r in chat.forest_examples(df.where("message_id <> 'm500'")).collect()}
    assert len(found) == 250 and [t.text for t in found["oasst-m499"]] == [f"text {k}" for k in range(500)]  # what follows the gap begins with an assistant
    deep = {r.message_id: r.path for r in chat.ancestors(df).collect()}
    assert deep["m999"] == [f"m{k}" for k in range(n)] and deep["m0"] == ["m0"]
    loop = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", None)], "message_id string, parent_id string")
    with pytest.raises(RuntimeError, match="own ancestors"):
        chat.ancestors(loop)


def test_running_sums_and_epoch_places_over_many_runs(spark):
    rows = spark.range(2000).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("k"), (F.col("id") % 5 + 1).alias("n"))
    got = {r.i: r.upto for r in tokens.running_sum(rows, "k", "i", "n", a_run=9).collect()}
    sums = Counter()
    for r in rows.orderBy("i").collect():
        sums[r.k] += r.n
        assert got[r.i] == sums[r.k]
    places = sampling.epoch_places(rows.select("i"), 3, 1, "i", a_slice=2).collect()
    order = [r.i for r in sampling.epoch_order(rows.select("i"), 3, 1, "i").orderBy("order_key").collect()]
    assert [r.i for r in sorted(places, key=lambda r: r.place)] == order and sorted(r.place for r in places) == list(range(1, 2001))


def test_chat_build(spark):
    from tekstra.plans import chat_build

    turns = "array<struct<role:string,text:string>>"
    good = [("user", "what is the sun and why"), ("assistant", "it is a star")]
    rows = [
        (0, "aya", "eng", "train", good, "final"),
        (1, "dolly", "en", "train", good, "duplicate"),
        (2, "dolly", "en", "train", [("user", "what is the sun and why"), ("assistant", "a star")], "final"),
        (3, "aya", "eng", "val", [("user", "wax baan kuu sheegi doonaa"), ("assistant", "waa wax aad u wanaagsan oo ku")], "aya_mislabeled"),
        (4, "oasst1", "en", "train", [("user", "held out?"), ("assistant", "yes it is")], "eval_probe"),
        (5, "oasst1", "en", "train", [("user", "and now"), ("assistant", "é")], "target_unk"),
        (6, "oasst1", "en", "train", [("user", "and now"), ("assistant", "so it goes on and on " * 9)], "too_long"),
        (7, "oasst1", "en", "train", [("user", ""), ("assistant", "x")], "empty"),
        (8, "oasst1", "en", "val", [("user", "a first turn that is long " * 5), ("assistant", "well"), ("user", "so"), ("assistant", "yes")], "final"),
    ]
    df = spark.createDataFrame([(i, str(i), s, lang, split, t) for i, s, lang, split, t, _ in rows], f"n long, id string, source string, lang string, split string, turns {turns}").withColumn("ord", F.struct("n")).drop("n")
    out = chat_build.built(df, spark.createDataFrame([("HELD  out?",)], "text string"), encode, 90)
    assert {int(r.id): r.outcome for r in out.collect()} == {i: o for i, *_, o in rows}
    n = {r.stage: r.n for r in chat_build.attrition(out).collect()}
    assert n == {"aya_examples": 2, "dolly_examples": 2, "oasst1_examples": 5, "rejected_aya_mislabeled": 1, "rejected_empty": 1, "after_quality": 7, "rejected_duplicates": 1, "dup_pair_aya|dolly": 1, "after_dedup": 6, "prompt_only_duplicates": 2, "rejected_eval_probes": 1, "after_probe_exclusion": 5, "rejected_target_unk": 1, "rejected_too_long": 1, "final_examples": 3, "dropped_oldest_turns": 1}
    train = {r.id: r for r in chat_build.train_rows(out).collect()}
    assert set(train) == {"0", "2"} and all(r.copies >= 1 and r.n_supervised == len(r.turns[-1].text) + 1 for r in train.values())


def test_guards_and_metadata(spark, tmp_path):
    from tekstra.operators import guards
    from tekstra.sources import readers

    guards.retention_factors(1.1, 1.15)
    guards.replay_source("data/train.bin")
    guards.free_folder(spark, str(tmp_path))
    guards.within_limits(26 << 30, 1)
    config = {"vocab_size": 8000, "pad_id": 1, "bos_id": 2, "eos_id": 3, "unk_id": 0}
    guards.matching_config(config, {"tokenizer_vocab_size": 8000, "special_token_ids": {"pad": 1}}, {"vocab_size": 8000, "unk_id": 0})
    (tmp_path / "best.pt").write_text("x")
    for f, *args in [(guards.retention_factors, 1.2, 1.1), (guards.retention_factors, 0, 1), (guards.replay_source, "x/test.bin"), (guards.free_folder, spark, str(tmp_path)), (guards.within_limits, 1, 1), (guards.within_limits, 26 << 30, 9 << 30), (guards.matching_config, config, {"special_token_ids": {"eos": 4}}, {}), (guards.matching_config, config, {}, {"vocab_size": 1})]:
        with pytest.raises(ValueError):
            f(*args)
    (tmp_path / "m.json").write_text('{\n"pad_id": 9, "x": [1]}')
    assert readers.metadata(spark, str(tmp_path / "m.json")) == {"pad_id": 9, "x": [1]} and readers.metadata(spark, str(tmp_path / "no")) == {}
    with pytest.raises(FileNotFoundError):
        readers.metadata(spark, str(tmp_path / "no"), required=True)
    assert tokens.special_ids({"pad_id": 9}) == {"pad": 9, "bos": 1, "eos": 2, "unk": 3, "system": 4, "user": 5, "assistant": 6}


def test_builders_and_filters(spark):
    aya = spark.createDataFrame([("a1", "eng", " what  is\nit ", "x")], "id string, language_code string, inputs string, targets string")
    assert [tuple(t) for t in chat.aya_examples(aya).first().turns] == [("user", "what is it"), ("assistant", "x")]
    dolly = spark.createDataFrame([("d1", "do", "ctx", "r", "c"), ("d2", "do", None, "r", None), ("d3", " ", "c", "r", "c")], "id string, instruction string, context string, response string, category string")
    assert {r.id: r.turns[0].text for r in chat.dolly_examples(dolly).collect()} == {"d1": "do\n\nctx", "d2": "do"}
    cases = [("eng", "original-annotations", ""), ("fra", "original-annotations", "other_language"), (" FIL ", "re-annotations", "re-annotations"), ("eng", "x", "other_annotation_type"), (None, None, "other_language")]
    df = spark.createDataFrame(cases, "c string, k string, want string")
    assert df.where(chat.aya_reason(F.col("c"), F.col("k")) != F.col("want")).count() == 0
    human = [("en", None, None, None, None, None, None, ""), ("en", True, None, None, None, None, None, "synthetic"), ("en", False, "m", None, None, None, None, "model_name"), ("en", None, None, True, None, None, None, "deleted"), ("en", None, None, None, False, None, None, "review_result"), ("en", None, None, None, True, "growing", None, "tree_state"), ("en", None, None, None, True, "ready_for_export", ["spam"], "labels"), ("de", True, None, None, None, None, None, "language")]
    df = spark.createDataFrame(human, "l string, s boolean, m string, d boolean, r boolean, t string, labels array<string>, want string")
    assert df.where(chat.human_reason(*map(F.col, ("l", "s", "m", "d", "r", "t", "labels"))) != F.col("want")).count() == 0
    df = spark.createDataFrame([("a", "b", ""), (" ", None, "empty_both"), ("", "b", "empty_instruction"), ("a", "", "empty_response"), ("a�", "b", "corrupt_unicode")], "i string, r string, want string")
    assert df.where(chat.dolly_reason(F.col("i"), F.col("r")) != F.col("want")).count() == 0
    turns = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([([("user", "hi"), ("assistant", "yes")], False, ""), ([("user", ""), ("assistant", "y")], False, "empty"), ([("user", "a�"), ("assistant", "y")], False, "corrupted"), ([("user", "z" * 20), ("assistant", "y")], False, "pathological"), ([("user", "wax baan kuu sheegi"), ("assistant", "waa wax aad")], True, "aya_mislabeled")], f"turns {turns}, eng boolean, want string")
    assert df.where(chat.turn_reason(F.col("turns"), F.col("eng")) != F.col("want")).count() == 0
    df = spark.createDataFrame([([("User ", "a"), ("assistant", "b")], ""), ([], "no_utterances"), ([("user", "a")], "no_assistant"), ([("assistant", "a")], "no_user")], "u array<struct<speaker:string,text:string>>, want string")
    assert df.where(chat.taskmaster_reason(F.col("u")) != F.col("want")).count() == 0


def test_conversation_targets(spark):
    for n in range(0, 30):
        want = list(range(n)) if n <= 4 else sorted({round(k * (n - 1) / 3) for k in range(4)})
        assert spark.range(1).select(chat.chosen_targets(F.lit(n)).alias("c")).first().c == want
    u = [("user", "a"), ("assistant", ""), ("user", "b"), ("assistant", "c")]
    df = spark.createDataFrame([(1, "train", u), (2, "val", u[1:])], "id long, split string, utterances array<struct<speaker:string,text:string>>")
    assert {(r.ex_id, r.reason) for r in chat.conversation_examples(df).collect()} == {("tm1-1-1", "bad_turns"), ("tm1-1-3", "empty_context_turn"), ("tm1-2-0", "root_not_user"), ("tm1-2-2", "root_not_user")}


def test_probes_and_leaks(spark):
    rows = [("a", [("user", "what IS the sun?"), ("assistant", "x")], "train"), ("b", [("user", "other"), ("assistant", "What is the Sun?")], "val"), ("b", [("user", "q"), ("assistant", "r")], "train")]
    df = spark.createDataFrame(rows, "id string, turns array<struct<role:string,text:string>>, split string")
    assert {r.id for r in chat.without_probes(df, chat.eval_probes(spark)).collect()} == {"b"}
    assert {r.id for r in chat.leaks(df, "id").collect()} == {"b"}


def test_weights_and_copies(spark):
    rows = [("dolly", "en", 900), ("aya", "en", 50), ("oasst1", "en", 50), ("aya", "fil", 10)]
    _, out = chat.sampling_weights(spark.createDataFrame(rows, "source string, lang string, n_supervised long"))
    got = {(r.source, r.lang): (r.weight, r.copies) for r in out.collect()}
    assert got == {("dolly", "en"): (1.0, 1), ("aya", "en"): (9.0, 9), ("oasst1", "en"): (9.0, 9), ("aya", "fil"): (36.0, 36)}
    assert chat.oversampled(out).count() == 1 + 9 + 9 + 36


def test_samples(spark):
    rows = spark.range(50).select(F.col("id").alias("i"))
    got = {r.draw: r.i for r in sampling.deterministic_sample(rows, 30, 1337, "i").collect()}
    assert got == {k: (1337 * 2654435761 + k * 40503) % 2**31 % 50 for k in range(30)}
    assert sampling.evaluation_subset(rows, 8, 2, "i", 1).count() == 16 and sampling.evaluation_subset(rows, 8, 200, "i", 1).count() == 50
    a, b = ([r.i for r in sampling.epoch_order(rows, 1, e, "i").orderBy("order_key").collect()] for e in (0, 1))
    assert sorted(a) == sorted(b) == list(range(50)) and a != b


def test_learning_rate_loss_and_retention(spark):
    df = spark.createDataFrame([(0,), (9,), (10,), (55,), (100,), (101,)], "s long")
    got = [r.v for r in df.select(sampling.learning_rate(F.col("s"), 100, 10, 1.0, 0.1).alias("v")).collect()]
    assert got == pytest.approx([0.1, 1.0, 1.0, 0.55, 0.1, 0.1])
    row = spark.range(1).select(sampling.running_loss(F.array(F.lit(2.0), F.lit(1.0))).alias("l"), *(c.alias(n) for c, n in zip(sampling.retention(F.lit(3.4), 3.0), "se"))).first()
    assert row.l == pytest.approx(1.9) and (row.s, row.e) == (False, False)


def test_reply_metrics(spark):
    df = spark.createDataFrame([([7, 0, 3], "ano ang", "fil"), ([], "", "eng"), ([6, 7], "the � x", "eng")], "ids array<int>, text string, prompt_lang string")
    rows = df.select("text", "prompt_lang", *stats.reply_metrics(F.col("ids"), F.col("text"), 3, list(range(7))))
    assert [(r.tokens, r.eos_terminated, r.role_leak, r.unk_tokens, r.replacement_chars) for r in rows.collect()] == [(3, True, False, 1, 0), (0, False, False, 0, 0), (2, False, True, 0, 1)]
    r = stats.reply_report(rows).first()
    assert (r.n_responses, r.empty_response_rate, r.eos_termination_rate, r.fil_prompts_answered_in_fil, r.eng_prompts_answered_in_eng) == (3, 0.3333, 0.3333, 0.3333, 0.3333)


def test_cleaning_conserves_rows_and_ignores_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (cleaning.cleaned(d, algorithm="md5").select("doc_id", "outcome", "split").collect() for d in (docs, docs.repartition(7)))
    assert sorted(a) == sorted(b) and len(a) == docs.count() and len({r.outcome for r in a}) > 3
