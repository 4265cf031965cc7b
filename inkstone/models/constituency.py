"""Phrase structure by a chart over part-of-speech tags."""

from __future__ import annotations

import json
from functools import lru_cache

from .lexicon import DEFAULT, GRAMMAR, PREFERENCE

#: (node, parent, place among the parent's children, label, word, start, end); the root's parent is -1.
Node = tuple[int, int, int, str, str | None, int, int]


class Grammar:
    """Rules of one or two parts, and the trees they give.

    The chart keeps, for each symbol and each start, the set of ends of its spans as one integer's bits. A span combines with
    all spans that begin at its end by one bitwise or, so a text of n words costs n * n / 2 of these, each over n bits, and
    texts of any length get their trees by the same rules.
    """

    def __init__(self, rules: tuple = GRAMMAR, preference: tuple[str, ...] = PREFERENCE):
        self.preference = [*preference, *(x for x in dict.fromkeys(lhs for lhs, _ in rules) if x not in preference)]
        self.leaf: dict[str, list[str]] = {}
        self.pairs: dict[str, list[tuple[str, str]]] = {}  # label -> (left, right) parts
        followed: dict[str, dict[str, list[str]]] = {}  # left part -> label -> right parts
        for lhs, parts in rules:
            if len(parts) == 1:
                self.leaf.setdefault(parts[0], []).append(lhs)
            else:
                self.pairs.setdefault(lhs, []).append(parts)
                followed.setdefault(parts[0], {}).setdefault(lhs, []).append(parts[1])
        # left -> (whether left + left gives left, the other rules)
        self.followed = [(left, left in by.get(left, ()), [(lhs, tuple(r for r in rights if not r == lhs == left)) for lhs, rights in by.items() if rights != [left] or lhs != left]) for left, by in followed.items()]

    def chart(self, tags: list[str]) -> list[dict[str, int]]:
        """For each start, the ends of each symbol's spans as bits."""
        n = len(tags)
        rows: list[dict[str, int]] = [{} for _ in range(n)]
        for i in range(n - 1, -1, -1):
            row = rows[i]
            for symbol in (tags[i], *self.leaf.get(tags[i], ())):
                row[symbol] = row.get(symbol, 0) | 1 << (i + 1)
            # spans that begin here are complete up to an end once all shorter ones have been combined
            done = {left: 0 for left, _, _ in self.followed}
            moved = True
            while moved:
                moved = False
                for left, chains, makes in self.followed:
                    new = row.get(left, 0) & ~done[left]
                    if not new:
                        continue
                    done[left] |= new
                    reach = 0
                    while new:
                        low = new & -new
                        new ^= low
                        k = low.bit_length() - 1
                        if k == n:
                            break
                        after = rows[k]
                        # what a chain of spans reaches, it reaches from each of its joints
                        if chains and not reach & low:
                            reach |= after.get(left, 0)
                        for lhs, rights in makes:
                            ends = 0
                            for r in rights:
                                ends |= after.get(r, 0)
                            if ends:
                                before = row.get(lhs, 0)
                                if ends & ~before:
                                    row[lhs] = before | ends
                                    moved = True
                    if reach & ~row[left]:
                        row[left] |= reach
                        moved = True
        return rows

    def parse(self, words: list[str], tags: list[str]) -> list[Node]:
        """The tree as nodes in pre-order. All derivations of a span score alike, so the first split gives a label's parts.

        A leaf has its tag as label. A span no rule covers is a flat S of its leaves.
        """
        n = len(words)
        if not n:
            return [(0, -1, 0, "S", None, 0, 0)]
        rows = self.chart(tags)
        nodes: list[Node] = []
        todo = [(0, n, -1, 0)]
        while todo:
            i, j, parent, place = todo.pop()
            me = len(nodes)
            if j - i == 1:
                nodes.append((me, parent, place, tags[i], words[i], i, j))  # a leaf always shows the tag itself
                continue
            end = 1 << j
            label = next((x for x in self.preference if rows[i].get(x, 0) & end), None)
            if label is None:
                nodes.append((me, parent, place, "S", None, i, j))
                todo.extend((k, k + 1, me, k - i) for k in range(j - 1, i - 1, -1))
                continue
            nodes.append((me, parent, place, label, None, i, j))
            split = j
            for left, right in self.pairs[label]:
                split = self._split(rows, left, right, i, j, split)
            todo += [(split, j, me, 1), (i, split, me, 0)]
        return nodes

    @staticmethod
    def _split(rows: list[dict[str, int]], left: str, right: str, i: int, j: int, before: int) -> int:
        """The first place in i..j up to which there is a `left` and from which there is a `right`, if it is before another."""
        places = rows[i].get(left, 0) & ((1 << before) - 1)
        end = 1 << j
        while places:
            low = places & -places
            k = low.bit_length() - 1
            if rows[k].get(right, 0) & end:
                return k
            places ^= low
        return before


@lru_cache(maxsize=8)
def grammar(rules: tuple = GRAMMAR, preference: tuple[str, ...] = PREFERENCE) -> Grammar:
    return Grammar(rules, preference)


def parse(words: list[str], tags: list[str]) -> list[Node]:
    """The tree by the default grammar."""
    return grammar(DEFAULT.grammar, DEFAULT.preference).parse(words, tags)


def bracketed(nodes: list[Node]) -> str:
    """The tree in brackets: (S (NP (n word)) ...)."""
    below: dict[int, list[Node]] = {}
    for x in nodes:
        below.setdefault(x[1], []).append(x)

    def show(x: Node) -> str:
        return f"({x[3]} {x[4]})" if x[4] is not None else f"({x[3]} {' '.join(map(show, below.get(x[0], [])))})"

    return show(nodes[0])


def as_json(nodes: list[Node]) -> str:
    """The tree as nested {label, word, children} objects."""
    parts: list[str] = []
    size = [0] * len(nodes)
    for x in nodes[1:]:
        size[x[1]] += 1
    # written in pre-order with the numbers of children still to come, so trees of any depth need no recursion
    left: list[int] = []
    for x in nodes:
        if left and parts[-1][-1] != "[":
            parts.append(", ")
        parts.append(f'{{"label": {json.dumps(x[3], ensure_ascii=False)}, "word": {json.dumps(x[4], ensure_ascii=False)}, "children": [')
        left.append(size[x[0]])
        while left and not left[-1]:
            parts.append("]}")
            left.pop()
            if left:
                left[-1] -= 1
    return "".join(parts)
