"""Named entities: patterns, then known names, then names by their form; what overlaps an accepted one is dropped."""

from __future__ import annotations

import re
from bisect import bisect_left

from .lexicon import Lexicon
from .segment import Segmenter

# Entity patterns in order of priority.
PATTERNS = [
    ("DATE", r"\d{4}[年/\-]\d{1,2}[月/\-]\d{1,2}日?"),
    ("DATE", r"\d{1,2}月\d{1,2}日"),
    ("TIME", r"\d{1,2}[:：]\d{2}(?:[:：]\d{2})?"),
    ("MONEY", r"\d+(?:\.\d+)?(?:万元|亿元|人民币|美元|港元|港币|欧元|日元|英镑|元)"),
    ("PERCENT", r"百分之[零一二三四五六七八九十百]+|\d+(?:\.\d+)?%"),
    ("NUMBER", r"\d+(?:\.\d+)?"),
]


class EntityFinder:
    def __init__(self, lexicon: Lexicon, segmenter: Segmenter):
        self.lexicon, self.segmenter = lexicon, segmenter
        self.patterns = [(kind, re.compile(p)) for kind, p in PATTERNS]
        known = {w: kind for kind, ws in (("PERSON", lexicon.persons), ("LOCATION", lexicon.locations), ("ORGANIZATION", lexicon.organizations)) for w in ws}
        self.known = known
        # the longest name that begins at a place, places within a name found are passed over
        self.names = re.compile("|".join(sorted(map(re.escape, known), key=len, reverse=True)) or r"(?!)")

    def by_form(self, word: str) -> str | None:
        if len(word) < 2 or not all("一" <= c <= "鿿" for c in word):
            return None
        lex = self.lexicon
        if any(word.endswith(s) and len(word) > len(s) for s in lex.organization_suffixes):
            return "ORGANIZATION"
        if any(word.endswith(s) and len(word) > len(s) for s in lex.location_suffixes):
            return "LOCATION"
        named = len(word) <= 3 and word[0] in lex.surnames and word not in lex.dictionary and not word.endswith(lex.titles)
        return "PERSON" if named and (len(word) == 2 or word[1] in lex.given_characters) else None

    def find(self, text: str | None, words: list[str] | None = None) -> list[tuple[int, int, str, str]]:
        """(start, end, text, type) in order of start; offsets count code points. words: of the text, if they are known."""
        if not text:
            return []
        found: list[tuple[int, int, str]] = []  # disjoint, in order
        starts: list[int] = []

        def offer(start: int, end: int, kind: str) -> None:
            i = bisect_left(starts, start)
            if (i == 0 or found[i - 1][1] <= start) and (i == len(found) or starts[i] >= end):
                found.insert(i, (start, end, kind))
                starts.insert(i, start)

        for kind, pattern in self.patterns:
            for m in pattern.finditer(text):
                offer(*m.span(), kind)
        for m in self.names.finditer(text):
            offer(*m.span(), self.known[m.group()])
        at = 0
        for word in self.segmenter.cut(text) if words is None else words:
            place = text.find(word, at)
            at = (at if place < 0 else place) + len(word)
            if kind := self.by_form(word):
                offer(at - len(word), at, kind)
        return [(s, e, text[s:e], k) for s, e, k in found]


def annotate(text: str, entities: list[tuple[int, int, str, str]]) -> str:
    """The text with each entity between <TYPE> and </TYPE>; nothing is escaped."""
    for start, end, _, kind in sorted(entities, reverse=True):
        text = f"{text[:start]}<{kind}>{text[start:end]}</{kind}>{text[end:]}"
    return text
