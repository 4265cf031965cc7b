"""Parts of speech: candidate tags from dictionary and form, the best sequence by a hidden Markov model."""

from __future__ import annotations

import re

from .hmm import Hmm
from .lexicon import Lexicon

TAG_ADD_K = 0.01
_NEVER = float("-inf")
_NUMBER, _DATE, _DIGIT = re.compile(r"[0-9]+(?:[.][0-9]+)?%?"), re.compile(r"[0-9]+[年月日]"), re.compile(r"[0-9]")


class Tagger:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.tags = list(lexicon.tags)
        self.hmm = Hmm(self.tags, TAG_ADD_K).fit([*lexicon.tagged, *([(w, t)] for w, t in lexicon.parts_of_speech.items())])
        self._start, self._trans = self.hmm.start.tolist(), self.hmm.trans.tolist()
        self._known: dict[str, tuple[list[int], list[float], str]] = {}

    def candidates(self, word: str) -> list[str]:
        """Tags a word can have, the first rule that fits decides."""
        lex = self.lexicon
        if word in lex.parts_of_speech:
            return [lex.parts_of_speech[word]]
        if not any(c.isalnum() for c in word):
            return ["x"]
        for known, tag in ((lex.locations, "ns"), (lex.organizations, "nt"), (lex.persons, "nr")):
            if word in known:
                return [tag]
        if _NUMBER.fullmatch(word):
            return ["m"]
        if _DATE.fullmatch(word):
            return ["t"]
        if _DIGIT.search(word):
            return ["m", "n"]
        if word.endswith(lex.location_suffixes):
            return ["ns", "n"]
        if word.endswith(lex.organization_suffixes):
            return ["nt", "n"]
        if len(word) <= 3 and word[0] in lex.surnames:
            return ["nr", "n"]
        return next((list(tags) for suffix, tags in lex.suffix_tags.items() if word.endswith(suffix)), ["n", "v", "a"])

    def tag(self, words: list[str]) -> list[str]:
        """One tag per word. The search keeps only candidate tags, in the order of the tag set (which decides ties)."""
        if not words:
            return []
        options = [self._known.get(w) or self._remember(w) for w in words]
        trans = self._trans
        states, emitted, _ = options[0]
        score = [self._start[s] + e for s, e in zip(states, emitted)]
        back: list[list[int]] = []
        for i in range(1, len(words)):
            before, (states, emitted, _) = states, options[i]
            came, new = [], []
            for s, e in zip(states, emitted):
                best, at = _NEVER, 0
                for j, p in enumerate(before):
                    v = score[j] + trans[p][s]
                    if v > best:
                        best, at = v, j
                came.append(at)
                new.append(best + e)
            back.append(came)
            score = new
        j = max(range(len(score)), key=score.__getitem__)
        if score[j] == _NEVER:
            return [first for _, _, first in options]
        path = [self.tags[options[-1][0][j]]]
        for i in range(len(words) - 1, 0, -1):
            j = back[i - 1][j]
            path.append(self.tags[options[i - 1][0][j]])
        return path[::-1]

    def _remember(self, word: str) -> tuple[list[int], list[float], str]:
        """(states, their emissions, first candidate) of a word."""
        tags = self.candidates(word)
        states = sorted(self.hmm.at[t] for t in tags)
        emission = self.hmm.emission(word)
        if len(self._known) > 500_000:
            self._known.clear()
        self._known[word] = found = (states, [float(emission[s]) for s in states], tags[0])
        return found
