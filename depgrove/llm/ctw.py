"""Context-tree weighting over bytes, in numpy.

A byte is eight binary decisions; decision k stands in the node of its first k bits (1..255, as in a heap). Each such node has a tree
of contexts: the byte before, the two before, and so on to `depth` bytes. A tree node holds how often 0 and 1 followed; its
Krichevsky-Trofimov estimate is kt = (n1 + 1/2) / (n0 + n1 + 1). The weighted probability of what a node saw is the estimate's own at
the greatest depth, else half of the estimate's plus half of the product of its children's. For the next bit every depth's
estimate is mixed by its share of that sum; where a context was never seen, what is left goes to 1/2.

Keys: the context's bytes, the latest first, then the byte itself in the lowest eight bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
HALF = np.log(0.5)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series, eight steps further on."""
    y = x + 8
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The log of the estimate's probability of a row of n0 zeros and n1 ones, in any order."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = _runs(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class Level:
    """The nodes of one context depth: for each of the eight decisions sorted ids (context and first bits), counts, and weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.ids, self.n0, self.n1 = [], [], []
        for k in range(8):
            ids = keys >> U(8 - k)
            at = _runs(ids)
            bit = ((keys >> U(7 - k)) & U(1)).astype(bool)
            self.ids.append(ids[at])
            for out, use in ((self.n0, ~bit), (self.n1, bit)):
                out.append(np.add.reduceat(np.where(use, counts, 0).astype(float), at) if len(at) else np.zeros(0))
        self.kt = [(b + 0.5) / (a + b + 1) for a, b in zip(self.n0, self.n1)]
        self.log_weighted: list[np.ndarray] = []

    def parents(self, k: int) -> np.ndarray:
        """The ids of the nodes with one byte less of context."""
        ids = self.ids[k]
        return ((ids >> U(8 + k)) << U(k)) | (ids & U((1 << k) - 1))

    def weigh(self, below: list[np.ndarray] | None) -> None:
        """below: for each decision the sums of the children's logs; None at the greatest depth."""
        own = [log_kt(a, b) for a, b in zip(self.n0, self.n1)]
        if below is None:
            self.log_weighted, self.share = own, [np.ones(len(x)) for x in own]
        else:
            self.log_weighted = [np.logaddexp(HALF + x, HALF + y) for x, y in zip(own, below)]
            self.share = [np.exp(HALF + x - w) for x, w in zip(own, self.log_weighted)]

    def sums(self, below: "Level") -> list[np.ndarray]:
        out = []
        for k in range(8):
            at = np.searchsorted(self.ids[k], below.parents(k))
            out.append(np.bincount(at, below.log_weighted[k], minlength=len(self.ids[k])))
        return out

    def mix(self, mixed: list[np.ndarray], left: list[np.ndarray]) -> None:
        """mixed and left: from the node above, the probability of a 1 so far and the weight that is left, for each node here."""
        self.mixed = [m + x * s * p for m, x, s, p in zip(mixed, left, self.share, self.kt)]
        self.left = [x * (1 - s) for x, s in zip(left, self.share)]
        self.final = [m + x / 2 for m, x in zip(self.mixed, self.left)]


def shorter(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys with one byte less of context."""
    return summed(((keys >> U(16)) << U(8)) | (keys & U(255)), counts)


class Tree:
    """The levels from `depth` up to `top` bytes of context, for the keys that lie below some nodes of depth `top`."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.depth, self.top, self.levels = depth, top, {depth: Level(keys, counts)}
        for d in range(depth - 1, top - 1, -1):
            keys, counts = shorter(keys, counts)
            self.levels[d] = Level(keys, counts)
        self.levels[depth].weigh(None)
        for d in range(depth - 1, top - 1, -1):
            self.levels[d].weigh(self.levels[d].sums(self.levels[d + 1]))

    def mix(self, above: Level | None = None) -> None:
        """Mixes from the top down; above: the mixed level over `top`, or None if top is 0."""
        for d in range(self.top, self.depth + 1):
            level = self.levels[d]
            if above is None:
                level.mix([np.zeros(len(x)) for x in level.ids], [np.ones(len(x)) for x in level.ids])
            else:
                at = [np.searchsorted(above.ids[k], level.parents(k)) for k in range(8)]
                level.mix([m[a] for m, a in zip(above.mixed, at)], [x[a] for x, a in zip(above.left, at)])
            above = level

    def log10(self, keys: np.ndarray, above: dict[int, Level]) -> np.ndarray:
        """log10 of the probability of each key's byte in its context; above: the mixed levels over `top`."""
        levels = {**above, **self.levels}
        out = np.zeros(len(keys))
        for k in range(8):
            p, todo = np.full(len(keys), 0.5), np.arange(len(keys))
            for d in range(self.depth, -1, -1):
                if not len(todo):
                    break
                level = levels[d]
                ids = level.ids[k]
                if not len(ids):
                    continue
                own = keys[todo]
                want = ((own >> U(8 * (self.depth - d + 1))) << U(k)) | ((own & U(255)) >> U(8 - k))
                at = np.minimum(np.searchsorted(ids, want), len(ids) - 1)
                hit = ids[at] == want
                p[todo[hit]] = level.final[k][at[hit]]
                todo = todo[~hit]
            bit = ((keys >> U(7 - k)) & U(1)).astype(bool)
            out += np.log10(np.where(bit, p, 1 - p))
        return out
