"""Records that differ only in form, collapsed by dictionary encoding.

Texts are taken apart into (name, value) fields, or one unnamed field. Every distinct raw string is put into its canonical
form once, every distinct canonical form gets an integer, and a record becomes the sorted tuple of its fields' integers.
Only these tuples and 16-byte digests are shuffled after the first step; copies are grouped by tuple.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hot import HOT, join_with_hot
from ..session import written

_WIDTH = regex.compile(r"[　＀-￯]")
_DROPPED = regex.compile(r"[\s\p{Z}\p{C}\p{P}\p{Default_Ignorable_Code_Point}]")
_POINT = regex.compile(r"(?<=\p{Nd})\.(?=\p{Nd})")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}]")
_BREAKS = regex.compile(r"[;；\n\r  \x85]+")
_NAMED = regex.compile(r"\s*([^:：]{1,60}?)\s*[:：](.*)", regex.S)
#: Stands for a decimal point while punctuation is dropped; a private-use character that no text keeps.
_KEPT = "﷐"


def canonical(text: str) -> str:
    """Without white space, invisible characters and punctuation (a decimal point stays), case-folded, of ordinary width and composed."""
    text = _WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = _INVISIBLE.sub("", text.replace(_KEPT, ""))
    text = _POINT.sub(_KEPT, text)
    text = _DROPPED.sub(lambda m: m.group() if m.group() == _KEPT else "", text)
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold())
    return text.replace(_KEPT, ".")


def fields(text: str) -> list[tuple[str, str]]:
    """(name, value) items of a JSON object or of a list of at least two `name: value` items; else [('', text)]."""
    bare = text.strip().strip("﻿").strip()
    if bare[:1] == "{":
        try:
            value = json.loads(bare, parse_float=str, parse_int=str, object_pairs_hook=lambda x: x)
        except ValueError:
            value = None
        if isinstance(value, list):

            def items(prefix: str, pairs) -> list[tuple[str, str]]:
                out = []
                for k, v in pairs:
                    name = f"{prefix}\x00{k}" if prefix else k
                    if isinstance(v, list) and v and all(isinstance(x, tuple) for x in v):
                        out += items(name, v)
                    else:
                        out.append((name, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)))
                return out

            found = items("", value)
            if len(found) > 1:
                return found
    found = []
    for item in _BREAKS.split(text):
        m = _NAMED.fullmatch(item)
        if m and canonical(m.group(1)):
            found.append((m.group(1), m.group(2)))
        elif found and item.strip():
            found[-1] = (found[-1][0], f"{found[-1][1]} {item}")
        elif item.strip():
            return [("", text)]
    return found if len(found) > 1 else [("", text)]


def collapse_forms(df: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """(id, keep_id, copies) for every id with a text: the smallest id of its set of texts equal in form, and the set's size.

    Rows of one id count once (the least text). Null texts and null ids take no part; texts without anything but white space
    and punctuation are equal to one another.
    """
    one = df.filter(F.col(id).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(text).alias("text"))
    records = written(one.select("id", F.unhex(F.md5("text")).alias("raw"), "text"), "forms-records")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, names, values = [], [], []
            for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, value in fields(t):
                    raw.append(r)
                    names.append(name)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(names, pa.string()), pa.array(values, pa.string())], ["raw", "name", "value"])

    # equal raw texts are parsed once: a text that a third of all records have is one row from here on
    texts = written(records.groupBy("raw").agg(F.min("text").alias("text"), F.count("*").alias("n")), "forms-texts")
    items = written(texts.select("raw", "text").mapInArrow(parse, "raw binary, name string, value string").select("raw", *(F.unhex(F.md5(c)).alias(f"{c}_raw") for c in ("name", "value")), "name", "value"), "forms-items")
    uses = items.select(F.explode(F.array(*(F.struct(F.col(f"{c}_raw").alias("raw"), F.col(c).alias("s")) for c in ("name", "value")))).alias("x")).select("x.*")
    strings = uses.groupBy("raw").agg(F.min("s").alias("s"), F.count("*").alias("n"))

    def canonicalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([canonical(s) for s in batch.column(1).to_pylist()], pa.string()), batch.column(2)], ["raw", "form", "n"])

    forms = written(strings.select("raw", "s", "n").mapInArrow(canonicalise, "raw binary, form string, n long").select("raw", F.unhex(F.md5("form")).alias("form"), "n"), "forms-strings")
    # the dictionary: one integer for each distinct canonical form, fixed by writing it
    dictionary = written(forms.groupBy("form").agg(F.count("*").alias("raws")).withColumn("code", F.monotonically_increasing_id()), "forms-dictionary")
    totals = forms.agg(F.sum("n").alias("uses"), F.count("*").alias("strings")).crossJoin(records.agg(F.count("*").alias("records"))).first()
    often = lambda c, total: F.col(c) >= max(1.0, (total or 0) / HOT)
    codes = written(join_with_hot(forms, dictionary, "form", often("raws", totals.strings)).select("raw", "code", "n"), "forms-codes")
    # names such as the empty one, and common values, are in a large share of the items: their codes are broadcast
    named = items.select("raw", "name_raw", "value_raw")
    for c in ("name", "value"):
        named = join_with_hot(named, codes.select(F.col("raw").alias(f"{c}_raw"), F.col("code").alias(c), F.col("n").alias("_n")), f"{c}_raw", often("_n", totals.uses)).drop("_n", f"{c}_raw")
    tuples = named.groupBy("raw").agg(F.sort_array(F.collect_list(F.struct("name", "value"))).alias("tuple"))
    keyed = written(tuples.join(texts.select("raw", "n"), "raw"), "forms-keyed")
    # tuples of distinct raw texts, so many copies of one text are one row here, and a set's size is the sum of theirs
    sets = written(keyed.groupBy("tuple").agg(F.sum("n").alias("copies"), F.count("*").alias("raws")).withColumn("set", F.monotonically_increasing_id()), "forms-sets")
    of_raw = written(join_with_hot(keyed, sets, "tuple", often("raws", totals.records)).select("raw", "set", "copies", "n"), "forms-of-raw")
    placed = written(join_with_hot(records.select("id", "raw"), of_raw, "raw", often("n", totals.records)).select("id", "set", "copies"), "forms-placed")
    # the smallest id of a set is found by partial sums, sets with many records are joined by broadcast
    kept = placed.groupBy("set").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    return join_with_hot(placed, kept, "set", often("n", totals.records)).select("id", "keep_id", "copies")
