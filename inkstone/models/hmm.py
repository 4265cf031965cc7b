"""A discrete hidden Markov model with add-k smoothing, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np


def _log_shares(counts: np.ndarray) -> np.ndarray:
    """Logarithms of counts over their sum; the library's own, as numpy's can differ in the last bit, which decides ties."""
    values = counts.tolist()
    total = math.fsum(values)
    if total <= 0:
        return np.full(len(values), -math.log(len(values)))
    return np.array([math.log(v / total) if v > 0 else -math.inf for v in values])


class Hmm:
    """Start and transition rows are distributions over states; emissions are normalised per observation, over the states.

    An observation that was never seen has the log of add_k for every state.
    """

    def __init__(self, states: Sequence[str], add_k: float = 0.01):
        self.states = list(states)
        self.at = {s: i for i, s in enumerate(self.states)}
        self.add_k = add_k
        k = len(self.states)
        self.start = np.zeros(k)
        self.trans = np.zeros((k, k))
        self.emit: dict = {}
        self.unseen = np.full(k, math.log(add_k)) if add_k > 0 else np.full(k, -np.inf)

    def fit(self, sequences: Iterable[Sequence[tuple]]) -> "Hmm":
        """Counts of (observation, state) sequences; pairs with an unknown state count nowhere."""
        k = len(self.states)
        start, trans, emit = np.full(k, self.add_k), np.full((k, k), self.add_k), {}
        for seq in sequences:
            path = [self.at.get(s) for _, s in seq]
            if path and path[0] is not None:
                start[path[0]] += 1
            for (obs, _), s in zip(seq, path):
                if s is not None:
                    emit.setdefault(obs, np.full(k, self.add_k))[s] += 1
            for a, b in zip(path, path[1:]):
                if a is not None and b is not None:
                    trans[a, b] += 1
        return self.set_counts(start, trans, emit)

    def set_counts(self, start: np.ndarray, trans: np.ndarray, emit: dict) -> "Hmm":
        """From smoothed counts, as of fit or of an aggregation over a table."""
        self.start = _log_shares(start)
        self.trans = np.array([_log_shares(row) for row in trans])
        self.emit = {o: _log_shares(c) for o, c in emit.items()}
        return self

    def emission(self, obs) -> np.ndarray:
        return self.emit.get(obs, self.unseen)

    def viterbi(self, observations: Sequence) -> list[str]:
        """The likeliest states; of equally likely ones, those that come first."""
        if not len(observations):
            return []
        score = self.start + self.emission(observations[0])
        back = []
        for obs in observations[1:]:
            paths = score[:, None] + self.trans
            best = paths.argmax(0)
            back.append(best)
            score = paths[best, np.arange(len(best))] + self.emission(obs)
        at = int(score.argmax())
        path = [at]
        for best in reversed(back):
            at = int(best[at])
            path.append(at)
        return [self.states[i] for i in reversed(path)]
