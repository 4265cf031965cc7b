"""Dictionary translation from English to Chinese, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ENGLISH_TOKEN, constant_map
from ..models.lexicon import DEFAULT, Lexicon


def to_chinese(text: Column | str, lexicon: Lexicon = DEFAULT) -> Column:
    """Known words translated, others and end marks kept, all without spaces; digits and other signs are dropped."""
    table = constant_map(lexicon.en_zh, "map<string,string>")
    tokens = F.regexp_extract_all(text, F.lit(ENGLISH_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), t)), "")
