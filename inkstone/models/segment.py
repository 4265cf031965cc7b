"""Words of a text: the likeliest way through a dictionary, unknown characters joined by a hidden Markov model."""

from __future__ import annotations

import math
import re

from .hmm import Hmm
from .lexicon import Lexicon

# What is a run of Chinese characters, and a token in other text.
RUNS = re.compile(r"[一-鿿]+|[a-zA-Z0-9]+(?:[.\-@][a-zA-Z0-9]+)*|[^\s一-鿿]")
UNKNOWN_WEIGHT, CHARACTER_ADD_K = 0.4, 0.001


class Segmenter:
    def __init__(self, lexicon: Lexicon):
        freq = lexicon.dictionary
        total = max(sum(freq.values()), 1)
        self.score = {w: math.log(f / total) for w, f in freq.items()}
        self.unknown = math.log(UNKNOWN_WEIGHT / total)
        lengths: dict[str, set[int]] = {}
        for w in freq:
            lengths.setdefault(w[0], set()).add(len(w))
        self.lengths = {c: tuple(sorted(x)) for c, x in lengths.items()}
        self.characters = Hmm("BMES", CHARACTER_ADD_K).fit(list(zip(w, "S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E")) for w in freq)

    def cut(self, text: str | None) -> list[str]:
        out: list[str] = []
        for m in RUNS.finditer(text or ""):
            run = m.group()
            if "一" <= run[0] <= "鿿":
                self._cut_run(run, out)
            else:
                out.append(run)
        return out

    def _cut_run(self, run: str, out: list[str]) -> None:
        n = len(run)
        best, size = [0.0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            top = None
            for length in self.lengths.get(run[i], ()):
                known = self.score.get(run[i : i + length]) if i + length <= n else None
                if known is not None and (top is None or known + best[i + length] > top):
                    top, size[i] = known + best[i + length], length
            best[i] = self.unknown + best[i + 1] if top is None else top
        i, pending = 0, ""
        while i < n:
            word = run[i : i + size[i]]
            i += size[i]
            if len(word) == 1 and word not in self.score:
                pending += word
                continue
            if pending:
                out.extend(self.join_unknown(pending))
                pending = ""
            out.append(word)
        if pending:
            out.extend(self.join_unknown(pending))

    def join_unknown(self, characters: str) -> list[str]:
        """Words of a run of characters no dictionary word covers: a new one at every B or S."""
        out: list[str] = []
        for c, tag in zip(characters, self.characters.viterbi(characters)):
            if out and tag in "ME":
                out[-1] += c
            else:
                out.append(c)
        return out
