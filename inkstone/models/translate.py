"""Dictionary translation from Chinese to English."""

from __future__ import annotations

from .lexicon import Lexicon
from .segment import Segmenter

# What is left out of a translation, and words that a phrase may have.
PUNCTUATION = "，。！？、；：\"\"''（）《》【】,.!?;: \n"
PHRASE_WORDS = 4


class Translator:
    def __init__(self, lexicon: Lexicon, segmenter: Segmenter):
        self.segmenter, self.table = segmenter, lexicon.zh_en

    def to_english(self, text: str | None, words: list[str] | None = None) -> str:
        """The longest phrase of up to four words that is known, else the word itself; punctuation is left out. words: of the text, if they are known."""
        words, out, i = self.segmenter.cut(text) if words is None else words, [], 0
        while i < len(words):
            phrase, length = next(((p, k) for k in range(min(PHRASE_WORDS, len(words) - i), 0, -1) if (p := "".join(words[i : i + k])) in self.table), (None, 1))
            if phrase is not None:
                out.append(self.table[phrase])
            elif words[i] not in PUNCTUATION:
                out.append(words[i])
            i += length
        s = " ".join(out).strip()
        if s:
            s = s[0].upper() + s[1:]
            s += "" if s[-1] in ".!?" else "."
        return s
