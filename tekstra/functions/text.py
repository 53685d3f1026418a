"""Text functions as columns: normalization, markup, measures. Native but for NFC and character references."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Line ends as Unicode text has them; Java's and RE2's classes lack some.
LINE_END = "\\r\\n|[\\n\\x0B\\x0C\\r\\x1C-\\x1E\\x85\\u2028\\u2029]"
BLANK_ENDS = "(?U)^\\s+|\\s+$"

#: What counts as wiki boilerplate. ^ and $ are bound to the whole document.
BOILERPLATE = "(?i)Jump to navigation|^\\s*Categories:|Wikimedia|Hidden categories|Retrieved from|CS1 errors|stub\\b|^\\{\\{Infobox|For other uses|Coordinates:|Help:|This article does not cite|^\\s*\\[\\s*edit\\s*\\]\\s*$"

#: English function words, Filipino markers, and scripts other than Latin.
ENGLISH_WORDS = (
    "the a an of to in is was for on and with as are be by at from it or that this which what why who how does do did were will would can could should "
    "may might must have has had been being am not no nor but if then than so because although though when where there here all any both each either "
    "few many more most much several some such only own same very just too also again further"
).split()
FILIPINO_WORDS = (
    "ang ng mga sa ko ka mo namin ninyo ako ikaw siya kayo tayo kami kita yan iyon ito ba po opo hindi oo at o ngunit dahil kaya "
    "ngayon bukas kahapon gawin pwede ano bakit saan kailan sino paano gusto kailangan mabuti masama"
).split()
NON_LATIN = "[\\u0400-\\u04FF\\u0600-\\u06FF\\u4E00-\\u9FFF\\u3040-\\u30FF\\uAC00-\\uD7AF\\u0E00-\\u0E7F]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def through_python(change):
    """A text function of Python as a column; it sees only the texts that ``needed`` names, others pass."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else change(x) for x in texts.to_pylist()], pa.string())

    def apply(x: Column | str, needed: str) -> Column:
        x = col(x)
        return F.coalesce(run(F.when(x.rlike(needed), x)), x)

    return apply


_composed = through_python(lambda x: unicodedata.normalize("NFC", x))
_composed_unescaped = through_python(lambda x: html.unescape(unicodedata.normalize("NFC", x)))


def composed(x: Column | str) -> Column:
    """NFC; ASCII texts don't leave the JVM."""
    return _composed(x, "[^\\x00-\\x7F]")


def characters(x: Column) -> Column:
    """The code points of a text, one string each."""
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))


def stripped(x: Column | str) -> Column:
    """Without white space at the ends; null gives ""."""
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), BLANK_ENDS, "")


def lines(x: Column) -> Column:
    """The lines of a text, without a last empty one."""
    return F.split(x, LINE_END)


def full_lines(x: Column) -> Column:
    return F.filter(lines(x), lambda ln: ln.rlike("(?U)\\S"))


def normalized(x: Column | str) -> Column:
    """NFC, character references, no control characters or byte-order marks, white space collapsed, empty lines dropped."""
    x = _composed_unescaped(x, "[^\\x00-\\x7F]|&")
    x = F.regexp_replace(x, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\uFEFF]", "")
    x = F.regexp_replace(F.regexp_replace(x, "[ \\t\\u00A0\\u2000-\\u200B]+", " "), LINE_END, "\n")
    # White space around line ends, blank lines with it: only where a run of it begins, so long runs cost no more than their length.
    x = F.regexp_replace(x, "(?U)(?<!\\s)[\\s&&[^\\n]]*+\\n\\s*+", "\n")
    return F.regexp_replace(x, BLANK_ENDS, "")


def without_tags(x: Column | str) -> Column:
    """N2."""
    return F.regexp_replace(col(x), "<[^>]+>", "")


def without_underscores(x: Column | str) -> Column:
    """N3."""
    return F.replace(col(x), F.lit("_"), F.lit(""))


def without_blank_lines(x: Column | str) -> Column:
    """Lines that aren't blank, an empty line between them."""
    return F.array_join(F.filter(F.split(col(x), "\n"), lambda ln: ln.rlike("(?U)\\S")), "\n\n")


#: N5 in order: pattern, replacement. Fixed values.
WIKI_STEPS = [
    ("\\{\\{[^{}]*\\}\\}", " "),
    ("(?i)\\[\\[\\s*(?:File|Image|Talaksan)\\s*:[^\\[\\]]*\\|([^\\[\\]\\|]*)\\]\\]", "$1"),
    ("\\[\\[[^\\[\\]]*\\|([^\\[\\]]*)\\]\\]", "$1"),
    ("\\[\\[([^\\[\\]]*)\\]\\]", "$1"),
    ("\\[\\[|\\]\\]", ""),
    ("\\{\\{|\\}\\}", " "),
    ("'''''", ""),
    ("''''", ""),
    ("'''", ""),
    ("''", ""),
    ("(?iU)\\bthumb\\s*\\|?\\b", ""),
    ("(?iU)\\b\\d{1,4}px\\s*\\|?", ""),
    ("(?imU)^\\s*(?:left|right|center|frame|thumb|none|\\d{1,4}px|\\d{1,4}x\\d{1,4}px)\\s*\\|", ""),
    ("(?U)\\(\\s*\\)", ""),
]


def without_wiki_markup(x: Column | str) -> Column:
    """Templates, links, quotes and image parameters of wiki text."""
    x = col(x)
    for pattern, by in WIKI_STEPS:
        x = F.regexp_replace(x, pattern, by)
    return x


def tidy(x: Column | str) -> Column:
    """NFC, white space to single spaces, trimmed; null gives ""."""
    return F.regexp_replace(F.regexp_replace(composed(F.coalesce(col(x), F.lit(""))), "(?U)\\s+", " "), "^ | $", "")


@F.arrow_udf(ArrayType(StringType()))
def _composed_all(rows: pa.Array) -> pa.Array:
    return pa.array([None if x is None else [unicodedata.normalize("NFC", t or "") for t in x] for x in rows.to_pylist()], pa.list_(pa.string()))


def tidy_all(texts: Column) -> Column:
    """N10 of each text of an array; arrays of ASCII texts don't leave the JVM."""
    texts = F.transform(texts, lambda t: F.coalesce(t, F.lit("")))
    texts = F.coalesce(_composed_all(F.when(F.exists(texts, lambda t: t.rlike("[^\\x00-\\x7F]")), texts)), texts)
    return F.transform(texts, lambda t: F.regexp_replace(F.regexp_replace(t, "(?U)\\s+", " "), "^ | $", ""))


def word_count(x: Column | str) -> Column:
    """Words between Unicode white space."""
    x = F.regexp_replace(col(x), BLANK_ENDS, "")
    return F.when(x == "", F.lit(0)).otherwise(F.size(F.split(x, "(?U)\\s+"))).cast("long")


def repeated_char_ratio(x: Column | str) -> Column:
    """Share of characters in runs of five or more of one."""
    x = col(x)
    runs = F.regexp_extract_all(x, F.lit("([^\\n])\\1{4,}"), 0)
    return F.least(F.lit(1.0), F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r)) / F.greatest(F.length(x), F.lit(1)))


def let(value: Column, of) -> Column:
    """``of(value)``, with the value computed once however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def duplicate_line_ratio(x: Column | str) -> Column:
    """Share of full lines that came before; compared as they are."""
    return let(full_lines(col(x)), lambda full: F.when(F.size(full) == 0, F.lit(0.0)).otherwise((F.size(full) - F.size(F.array_distinct(full))) / F.size(full)))


def prose_line_ratio(x: Column | str) -> Column:
    """Share of full lines of 20 characters or more."""
    return let(full_lines(col(x)), lambda full: F.when(F.size(full) == 0, F.lit(0.0)).otherwise(F.size(F.filter(full, lambda ln: F.length(ln) >= 20)) / F.size(full)))


def is_boilerplate(x: Column | str) -> Column:
    """P4."""
    return col(x).rlike(BOILERPLATE)


def quality_reason(x: Column | str) -> Column:
    """P5: the first rule that fails, "" if none."""
    x = col(x)
    return (
        F.when(F.length(x) < 300, "too_short")
        .when(F.length(x) > 1_500_000, "too_long")
        .when(repeated_char_ratio(x) > 0.35, "repetitive_chars")
        .when(duplicate_line_ratio(x) > 0.30, "duplicate_lines")
        .when(prose_line_ratio(x) < 0.55, "non_prose")
        .when(is_boilerplate(x), "boilerplate")
        .otherwise("")
    )


def is_corrupted(x: Column | str) -> Column:
    """P13."""
    return F.contains(col(x), F.lit("�"))


def is_pathological(x: Column | str) -> Column:
    """A run of 15 of one character that is no space, or one that is half of ten characters or more."""
    x = col(x)
    chars = characters(F.regexp_replace(x, "(?U)\\s+", ""))
    half = F.ceil(F.length(x) / 2).cast("int")

    def fills_half(s: Column) -> Column:
        """s: sorted. A run of half of the text's length covers one of the two places in the middle of as many."""
        reaches = lambda c: F.coalesce(F.get(s, F.array_position(s, c).cast("int") + half - 2) == c, F.lit(False))
        return reaches(F.get(s, half - 1)) | reaches(F.get(s, half))

    most = let(F.sort_array(chars), fills_half)
    return F.when(F.length(x) < 2, F.lit(False)).otherwise(x.rlike("(?U)([^\\s])\\1{14,}") | ((F.length(x) >= 10) & most))


def english_hits(x: Column | str) -> Column:
    """How many of the function words stand between spaces."""
    padded = F.concat(F.lit(" "), F.lower(col(x)), F.lit(" "))
    return F.size(F.filter(F.array(*map(F.lit, ENGLISH_WORDS)), lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" ")))))


def looks_english(prompt: Column | str, target: Column | str) -> Column:
    """P16."""
    prompt, target = col(prompt), col(target)
    few = (english_hits(prompt) < 2) & (english_hits(target) < 2)
    return ~F.concat(prompt, F.lit(" "), target).rlike(NON_LATIN) & ~(((word_count(prompt) >= 4) | (word_count(target) >= 6)) & few)


def repetition_score(x: Column | str) -> Column:
    """Share of word pairs that came before; 0 under three words."""
    words = F.regexp_extract_all(F.lower(col(x)), F.lit("(?U)\\S+"), 0)
    pairs = F.regexp_extract_all(F.array_join(words, " "), F.lit("(?=(?:^|(?<= ))(\\S+ \\S+))"), 1)
    return F.when(F.size(words) < 3, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(pairs)) / F.size(pairs))


def language_guess(x: Column | str) -> Column:
    """Struct of estimate, tl_hits, tl_ratio."""
    words = F.regexp_extract_all(F.lower(col(x)), F.lit("[a-z']+"), 0)
    marks = F.array(*map(F.lit, FILIPINO_WORDS))
    hits = F.size(F.filter(words, lambda w: F.array_contains(marks, w)))
    share = hits / F.greatest(F.size(words), F.lit(1))
    guess = F.when(F.size(words) == 0, "unknown").when(share >= 0.25, "fil").otherwise("eng")
    return F.struct(guess.alias("estimate"), hits.cast("long").alias("tl_hits"), F.round(share, 4).alias("tl_ratio"))


def bucket(key: Column | str, divisor: int) -> Column:
    """The first 32 bits of SHA-256, modulo."""
    return (F.conv(F.substring(F.sha2(col(key), 256), 1, 8), 16, 10).cast("long") % divisor).cast("long")


def doc_split(key: Column | str) -> Column:
    """D6."""
    b = bucket(key, 100)
    return F.when(b < 98, "train").when(b < 99, "val").otherwise("test")
