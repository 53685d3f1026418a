"""Text functions and markup against plain Python on what fixtures lack: entities, odd spaces and line ends, runs, markup."""

import html
import random
import re
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from tekstra.functions import markup
from tekstra.functions import text as T

ODD = ["", " ", "a", "café &amp; &lt;b&gt;   x", "a b c\x85d\r\ne\rf", "﻿start\x00\x07end\t\ttab", "é" * 20, "aaaaab" * 3, "x" * 400, "no \x0b vertical \x1c sep", "日本語　テキスト", "a\n\n  \nb", "&#65;&eacute;&nbsp;z", "_it_ is", "<p>tag</p> <br/>"]


def run(spark, f, values=ODD):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def normalized(t):
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", html.unescape(unicodedata.normalize("NFC", t))).replace("﻿", "")
    return "\n".join(x for ln in t.splitlines() if (x := re.sub("[ \t  -​]+", " ", ln).strip()))


def pathological(t):
    if len(t) < 2:
        return False
    chars = [c for c in set(t) if not c.isspace()]
    return any(max(map(len, re.findall(re.escape(c) + "+", t))) >= 15 or (len(t) >= 10 and t.count(c) / len(t) >= 0.5) for c in chars)


@pytest.mark.parametrize(
    "ours,plain",
    [
        (T.normalized, normalized),
        (T.tidy, lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFC", t)).strip()),
        (T.without_tags, lambda t: re.sub("<[^>]+>", "", t)),
        (T.without_underscores, lambda t: t.replace("_", "")),
        (T.without_blank_lines, lambda t: "\n\n".join(x for x in t.split("\n") if x.strip())),
        (T.word_count, lambda t: len(t.split())),
        (T.repeated_char_ratio, lambda t: min(1.0, sum(len(m[0]) for m in re.finditer(r"(.)\1{4,}", t)) / max(1, len(t)))),
        (T.is_pathological, pathological),
    ],
)
def test_equals_plain(spark, ours, plain):
    rng = random.Random(2)
    more = ["".join(rng.choices("ab \n", weights=[8, 2, 1, 1], k=n)) for n in range(0, 60)]
    # The C0 separators count as white space to Python alone.
    values = [v for v in ODD + more if "\x1c" not in v or ours is T.normalized]
    assert run(spark, ours, values) == [plain(v) for v in values]


def test_line_ratios(spark):
    text = ["a\na\nb\n\n", "", "long enough a line here\nshort", "x\r\ny y"]
    assert run(spark, T.duplicate_line_ratio, text) == [pytest.approx(1 / 3), 0.0, 0.0, pytest.approx(1 / 3)]
    assert run(spark, T.prose_line_ratio, text) == [0.0, 0.0, 0.5, 0.0]


def test_quality_rules_in_order(spark):
    prose = "This is an ordinary sentence about the river and the sea, number {}.\n"
    good = "".join(prose.format(i) for i in range(20))
    cases = {good: "", "short": "too_short", "a" * 1000: "repetitive_chars", prose * 10: "duplicate_lines", "".join(f"w {i}\n" for i in range(200)): "non_prose", good + "Retrieved from x": "boilerplate", "Categories: x " + good: "boilerplate", good + "\nCategories: x": ""}
    assert run(spark, T.quality_reason, list(cases)) == list(cases.values())


def test_wiki_markup(spark):
    values = ["'''Bold''' and ''it'' [[a|b]] [[c]] {{t|x}} [[File:x.jpg|thumb|20px|a caption]] ( ) end", "thumb | left|x\nright | y 100px |"]
    assert run(spark, T.without_wiki_markup, values) == ["Bold and it b c   a caption  end", " | left|x\n y "]


def test_english(spark):
    rows = [("What is the sun and why is it hot", "It is a star", True), ("wax baan kuu sheegi doonaa maanta", "waa wax aad u wanaagsan oo ku saabsan", False), ("привет", "it is the one", False), ("Hi", "yes", True)]
    df = spark.createDataFrame(rows, "p string, t string, ok boolean")
    assert df.where(T.looks_english("p", "t") != F.col("ok")).count() == 0


def recursive(text, a, b):
    """Balanced deletion by a recursive pattern."""
    a, b = re.escape(a), re.escape(b)
    return regex.sub(f"(?s)({a}(?:(?!{a}|{b}).|(?1))*{b})", "", text)


def test_balanced_deletion():
    rng = random.Random(0)
    for a, b in (("{{", "}}"), ("{|", "|}")):
        for n in range(3000):
            text = "".join(rng.choices("{}|x", k=n % 24))
            assert markup.strip_balanced(text, a, b) == recursive(text, a, b), text
    assert markup.strip_balanced("{{x " * 20_000, "{{", "}}") == "{{x " * 20_000


def test_wikitext(spark):
    text = "<!-- no -->{{Infobox|a={{b}}}}\n'''x''' is [[y|the y]] and [[z]].<ref name=a>r</ref><ref b/> {|\n|t\n|}\n== Head ==\n* item [http://a.b label] [http://c.d] https://e.f\n[[File:q.jpg|thumb]]&amp; end <nowiki>k</nowiki>"
    assert run(spark, markup.prose_of_wikitext, [text]) == ["'''x''' is the y and z.\nHead\nitem label\n& end k"]


def links(text):
    return re.sub(r"\[\[([^\]]+)\]\]", lambda m: m[1].partition("|")[2] if "|" in m[1] else m[1], text)


def test_links_keep_what_follows_their_first_bar(spark):
    rng = random.Random(9)
    values = ["".join(rng.choices(["[[", "]]", "[", "]", "|", "a", "b c"], k=rng.randint(1, 12))) for _ in range(400)]
    values = [v for v in values if v.strip()]
    tidy = lambda t: "\n".join(x for ln in t.splitlines() if (x := re.sub(r"[ \t]+", " ", ln).strip()))
    assert run(spark, markup.prose_of_wikitext, values) == [tidy(links(v)) for v in values]


def test_wikitext_rows_without_braces_stay_in_the_jvm_and_headings_end_at_line_ends_alone(spark):
    text = "= A =\n== B\u2028c ==\r\n* x\u00a0\n#;: y &eacute; http://a.b/c\u2003d"
    assert run(spark, markup.prose_of_wikitext, [text]) == ["A\nB\nc\nx\ny é \u2003d"]


def test_books(spark):
    a = "head\n*** START OF THIS PROJECT GUTENBERG EBOOK X ***\nbody _one_\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\ntail"
    b = "preamble\n***\nsecond\n ****  \nthe text\nEnd of the Project Gutenberg Etext of x"
    assert run(spark, markup.body_of_book, [a, b, "plain"]) == ["body one", "the text", "plain"]
    both = "x\n***\n*** start of the project gutenberg ebook y *** one\n***\ntwo\f ***START: FULL LICENSE*** z *** END OF PROJECT GUTENBERG EBOOK ***"
    assert run(spark, markup.body_of_book, [both, "***", "", "a\n***\n"]) == ["one\n***\ntwo", "", "", ""]
    rows = spark.createDataFrame([(bytearray("café".encode()),), (bytearray(b"caf\xe9 \x93q\x94"),), (bytearray(b"\x81"),)], "b binary")
    assert [r.v for r in rows.select(markup.text_of_bytes("b").alias("v")).collect()] == ["café", "café “q”", "\x81"]


def test_repetition_and_language_guess(spark):
    assert run(spark, T.repetition_score, ["a b a b a", "a b", "", "one two three four"]) == [0.5, 0.0, 0.0, 0.0]
    got = run(spark, T.language_guess, ["ano ang araw sa", "the sun is hot", "123"])
    assert [(g.estimate, g.tl_hits, g.tl_ratio) for g in got] == [("fil", 3, 0.75), ("eng", 0, 0.0), ("unknown", 0, 0.0)]
