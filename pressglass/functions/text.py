"""Text functions: column in, column out."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as in Unicode-aware regular expressions.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
#: White space that isn't a single space already: only this has to be replaced for single spaces between words.
ODD_WS = rf"(?! ){WS}+| {WS}+"
# Letters of one look that are folded for Urdu, and marks that are dropped.
URDU_FROM, URDU_TO = "يكةأإآ", "یکہااا"
URDU_MARKS = "[ً-ْٰ]"
ARABIC_SCRIPT = "[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@lru_cache
def nfc_class() -> str:
    """A character class of all that NFC may change: what has another composed form by itself, marks, and what joins what
    stands before it.  Taken from the Unicode tables that nfc() uses."""
    second = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # vowels and finals of Hangul
    may = set()
    for c in range(sys.maxunicode + 1):
        char = chr(c)
        parts = unicodedata.decomposition(char).split()
        if unicodedata.combining(char) or parts and parts[0][0] != "<" and unicodedata.normalize("NFC", char) != char:
            may.add(c)
        if len(parts) == 2 and parts[0][0] != "<":
            second.add(int(parts[1], 16))
    ranges: list[list[int]] = []
    for c in sorted(may | second):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    # A class is tried range by range, so ranges stand in blocks, each behind the one range that holds all of it.
    def of(some: list[list[int]]) -> str:
        return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in some)

    blocks = [ranges[i : i + 20] for i in range(0, len(ranges), 20)]
    inner = "".join(f"[{of([[x[0][0], x[-1][1]]])}&&[{of(x)}]]" for x in blocks)
    return f"[{of([[ranges[0][0], ranges[-1][1]]])}&&[{inner}]]"


def composed(text: Column) -> Column:
    """NFC. Only texts with characters that NFC may change are handed to Python."""
    return F.coalesce(nfc(F.when(text.rlike(nfc_class()), text)), text)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def single_spaced(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, ODD_WS, " ")


def squash_ws(text: Column) -> Column:
    return F.trim(single_spaced(text))


def fold_letters(text: Column) -> Column:
    return F.translate(text, URDU_FROM, URDU_TO)


def normalize_text(text: Column, language: Column | str = "en", compose: bool = True) -> Column:
    """The form in which texts and keywords meet: Urdu letters folded and marks dropped, else lower case; one space between words."""
    text = F.coalesce(text, F.lit(""))
    text = composed(text) if compose else text
    # Letters are looked up one by one only in texts that have such.
    folded = F.when(text.rlike(f"[{URDU_FROM}]"), fold_letters(text)).otherwise(text)
    urdu = squash_ws(F.regexp_replace(folded, URDU_MARKS, ""))
    other = F.trim(F.lower(single_spaced(text)))
    if isinstance(language, str):
        return urdu if language == "ur" else other
    return F.when(language == "ur", urdu).otherwise(other)


def script_language(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike(ARABIC_SCRIPT), "ur").otherwise("en")


def keyword_language(text: Column, requested: Column) -> Column:
    """The script decides: Arabic script is Urdu, anything else English, whatever was asked for."""
    return F.when(script_language(text) == "ur", "ur").when(F.lower(F.trim(requested)) == "en", "en").otherwise("en")


def quoted(text: Column) -> Column:
    r"""A literal inside a regular expression: \Q...\E, with any \E in it taken apart."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def keyword_pattern(normal_keyword: Column) -> Column:
    """Whole-word pattern of a normal form; null (never true) for a blank one."""
    body = F.array_join(F.transform(F.split(normal_keyword, " "), quoted), f"{WS}+")
    return F.when(F.trim(normal_keyword) != "", F.concat(F.lit(f"(?<!{WORD})"), body, F.lit(f"(?!{WORD})")))


def whole_word_match(text: Column, keyword: Column, language: Column | str = "en") -> Column:
    return F.coalesce(F.rlike(normalize_text(text, language), keyword_pattern(normalize_text(keyword, language))), F.lit(False))


def word_tokens(normal_text: Column) -> Column:
    return F.regexp_extract_all(normal_text, F.lit(f"({WORD}+)"), F.lit(1))


def signs_and_words(normal_text: Column) -> Column:
    """The words of a normal form, and each other sign but spaces, in order."""
    return F.regexp_extract_all(normal_text, F.lit(rf"({WORD}+|[^\p{{L}}\p{{N}}_ ])"), F.lit(1))


def longest_token(text: Column) -> Column:
    """The longest of the words between spaces, the first of equally long ones."""
    words = F.split(squash_ws(text), " ")
    return F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))


def _around(normal: Column, needle: Column, width: int) -> Column:
    at = F.instr(normal, needle)
    half, n = width // 2, F.length(normal)
    start = F.greatest(F.lit(0), at - 1 - half)
    end = F.least(n, at - 1 + F.length(needle) + half)
    piece = F.trim(F.substring(normal, start + 1, end - start))
    return F.when(at > 0, F.concat(F.when(start > 0, "…").otherwise(""), piece, F.when(end < n, "…").otherwise("")))


def snippet(text: Column, keywords: list[str], width: int = 200) -> Column:
    """Around the first keyword that occurs (as a substring of either normal form), else the beginning."""
    needles = [(normalize_text(F.lit(k), lang, compose=False), lang) for k in keywords for lang in ("en", "ur")]

    def of(x: Column) -> Column:  # both forms are made once
        return F.coalesce(*[_around(x[lang], needle, width) for needle, lang in needles], F.lit(None).cast("string"))

    same = composed(F.coalesce(text, F.lit("")))
    forms = F.transform(F.array(same), lambda t: F.struct(normalize_text(t, "en", compose=False).alias("en"), normalize_text(t, "ur", compose=False).alias("ur")))
    plain = strip(F.left(single_spaced(F.coalesce(text, F.lit(""))), F.lit(width)))
    return F.coalesce(F.get(F.transform(forms, of), F.lit(0)), plain)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlight(text: Column, keywords: list[str]) -> Column:
    """HTML with keywords marked: mark-up signs dropped, the longest variant first, case-insensitive."""
    clean = strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[#*`_]+", " "), rf"{WS}{{2,}}", " "))
    variants = {v for k in keywords if k and k.strip() for v in (k.strip(), " ".join(k.lower().split()), " ".join(k.split()))}
    if not variants:
        return escape_html(clean)
    longest_first = sorted(variants, key=lambda v: (-len(v), v))
    pattern = "(?iu)(" + "|".join("\\Q" + v.replace("\\E", "\\E\\\\E\\Q") + "\\E" for v in longest_first) + ")"
    # Private-use signs stand for the marks while the text is escaped; such signs of its own go first.
    signed = F.regexp_replace(F.regexp_replace(clean, "[\ue000\ue001]", ""), pattern, "\ue000$1\ue001")
    return F.replace(F.replace(escape_html(signed), F.lit("\ue000"), F.lit("<mark>")), F.lit("\ue001"), F.lit("</mark>"))


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 if either side has none."""
    x, y = (F.array_distinct(F.filter(F.split(squash_ws(c), " "), lambda w: w != "")) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def strip_model_wrapping(text: Column) -> Column:
    """Without <think> parts (an open one takes all that follows) and code fences."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", "")
    return F.trim(F.regexp_replace(F.trim(bare), r"^```[A-Za-z]*\s*|\s*```$", ""))


def coerce_sentiment(label: Column, vocabulary: tuple[str, ...] = ("Positive", "Negative", "Neutral")) -> Column:
    t = F.trim(F.coalesce(label, F.lit("")))
    capital = F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, 2, 1 << 30)))
    return F.when(capital.isin(*vocabulary), capital).otherwise("")


def parse_scores(reply: Column, vocabulary: tuple[str, ...] = ("Positive", "Critical", "Neutral")) -> Column:
    """struct(relevance, sentiment, summary) of a model's JSON reply; null if it is no such JSON."""
    got = F.from_json(strip_model_wrapping(reply), "relevance double, sentiment string, summary string", {"mode": "PERMISSIVE"})
    label = coerce_sentiment(got["sentiment"], vocabulary)
    return F.when(got["relevance"].isNotNull(), F.struct(got["relevance"].alias("relevance"), F.when(label != "", label).otherwise("Neutral").alias("sentiment"), F.coalesce(got["summary"], F.lit("")).alias("summary")))


def media_path(path: Column) -> Column:
    """What follows the last /storage/ of a path; paths without it as they are."""
    tail = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"(?i)^.*/storage/(.*)$", 1)
    return F.when(tail != "", tail).otherwise(path)
