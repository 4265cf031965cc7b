"""Scalar text expressions, all JVM-side."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Unicode counts as white space, and the information separators.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
_ASCII = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FULL_WIDTH = "".join(chr(ord(c) + 0xFEE0) for c in _ASCII)


def constant_map(values: dict, kind: str) -> Column:
    """A map column of a dictionary, as one literal that the optimizer folds."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), kind)


def strip(c: Column | str) -> Column:
    """Without surrounding white space of any kind."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def narrow(c: Column | str) -> Column:
    """Full-width Latin letters and digits as ordinary ones."""
    return F.translate(c, FULL_WIDTH, _ASCII)


def normalised_term(c: Column | str) -> Column:
    """A term in the form in which terms are compared: stripped, narrow, in lower case."""
    return F.lower(narrow(strip(c)))


def normalised_terms(words: Column | str) -> Column:
    """An array of words as normalised terms, without null and blank ones; null stays null."""
    return F.filter(F.transform(words, normalised_term), lambda t: t.isNotNull() & (t != ""))


# Patterns of tokens and sentences; white space is spelled out, as regex dialects differ in it.
SPACE_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in WHITE_SPACE)
TOKEN_PATTERN = rf"[a-zA-Z0-9]+(?:[.\-@][a-zA-Z0-9]+)*|[^{SPACE_CLASS}]"
SENTENCE_END = rf"[。！？!?；;\n]+|(?<=[.!?])[{SPACE_CLASS}]+"
ENGLISH_TOKEN = r"[a-zA-Z]+(?:'[a-zA-Z]+)?|[.,!?]"
HAN = r"[\x{4e00}-\x{9fff}]"
#: Punctuation left out before n-grams are counted.
GRAM_BREAKS = rf"[{SPACE_CLASS}，。！？、；：'（）《》【】,.!?;:()\"]+"


def has_han(c: Column | str) -> Column:
    return F.coalesce(F.rlike(c, F.lit(HAN)), F.lit(False))


def tokens(text: Column | str) -> Column:
    """Words of letters and digits, every other character for itself, no white space; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def sentences(text: Column | str) -> Column:
    """Parts between sentence ends, stripped, without empty ones; null gives an empty array."""
    parts = F.transform(F.split(text, SENTENCE_END), strip)
    return F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>"))


def single_spaced(text: Column | str) -> Column:
    return strip(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "))


def without_stop_words(words: Column | str, stop: list[str]) -> Column:
    """An array of words without stop words (as spelled), single characters other than Chinese ones, and blanks."""
    stops = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    return F.filter(words, lambda w: w.isNotNull() & ~F.array_contains(stops, w) & ((F.length(w) >= 2) | has_han(w)) & (strip(w) != ""))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays of numbers, 0 where one is null, empty or all zero; the length is that of the shorter."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p.cast("double") * q.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, p: s + p)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def map_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two sparse vectors (maps of term to weight), 0 where one is null, empty or all zero."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    shared = F.transform(F.map_keys(a), lambda k: a[k] * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))
    norm = F.sqrt(total(F.transform(F.map_values(a), lambda v: v * v))) * F.sqrt(total(F.transform(F.map_values(b), lambda v: v * v)))
    return F.coalesce(F.when(norm > 0, total(shared) / norm), F.lit(0.0))


def english_sentence(text: Column | str) -> Column:
    """Stripped, the first letter a capital, with a full stop unless it ends in an end mark; empty stays empty."""
    s = strip(text)
    capital = F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))
    return F.when(s == "", s).otherwise(F.when(F.rlike(s, F.lit("[.!?]$")), capital).otherwise(F.concat(capital, F.lit("."))))


def label(c: Column | str, names: dict[str, str]) -> Column:
    """The name of a code, or the code itself."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_element_at(constant_map(names, "map<string,string>"), c), c)


def annotated(text: Column | str, entities: Column | str) -> Column:
    """The text with every (start, end, type) entity of an array between <TYPE> and </TYPE>, from the last to the first."""
    text, entities = (F.col(c) if isinstance(c, str) else c for c in (text, entities))
    backwards = F.sort_array(entities, asc=False)
    return F.aggregate(
        backwards,
        text,
        lambda s, e: F.concat(F.substr(s, F.lit(1), e.start), F.lit("<"), e.type, F.lit(">"), F.substr(s, e.start + 1, e.end - e.start), F.lit("</"), e.type, F.lit(">"), F.substr(s, e.end + 1)),
    )
