"""A vantage-point tree over a block of vectors, searched for the nearest ones of many queries at once.

A node has a vantage point; its vectors are split in two equal halves by their distance to it, and each half remembers the ring of
distances it lies in, so equal vectors make no deep tree. By the triangle inequality nothing in a half is nearer to a query than the query's
distance to the ring. A half is left out if `factor` times that bound is over the query's k-th distance so far: with factor 1 only what
can't be near enough is left out, a larger factor leaves out more.
"""

from __future__ import annotations

import numpy as np

from .blocks import within_runs

LEAF = 64
#: Vectors tried as vantage points of a node, and vectors whose distances to them are compared.
TRIED, COMPARED = 6, 48
#: Rounding of distances and of the products that stand for them.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances along the last axis; the same rows give the same number wherever they stand."""
    with np.errstate(over="ignore"):
        diff = np.ascontiguousarray(a - b)
        return np.sqrt((diff * diff).sum(-1))


class Nearest:
    """The k nearest so far of each query: places in the block and distances, nearest first, ties by place."""

    def __init__(self, queries: int, k: int):
        self.k, self.place, self.at = k, np.full((queries, k), -1, np.int64), np.full((queries, k), np.inf)

    @property
    def far(self) -> np.ndarray:
        return np.where(self.place[:, -1] >= 0, self.at[:, -1], np.inf)

    def add(self, query: np.ndarray, place: np.ndarray, at: np.ndarray) -> None:
        some = np.unique(query)
        held = self.place[some] >= 0
        q = np.concatenate([np.repeat(some, held.sum(1)), query])
        p, d = np.concatenate([self.place[some][held], place]), np.concatenate([self.at[some][held], at])
        order = np.lexsort((p, d, q))
        q, p, d = q[order], p[order], d[order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (p[1:] != p[:-1])])  # a leaf may be seen twice
        q, p, d = q[new], p[new], d[new]
        rank = within_runs(q)
        q, p, d, rank = (v[rank < self.k] for v in (q, p, d, rank))
        self.place[q, rank], self.at[q, rank] = p, d


class Tree:
    def __init__(self, x: np.ndarray, arrays: dict[str, np.ndarray] | None = None):
        self.x = x
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
        self.norm = np.einsum("ij,ij->i", x, x)
        if arrays is not None:
            self.order, self.vantage, self.ring = arrays["order"], arrays["vantage"], arrays["ring"]
            return
        self.order = np.arange(len(x))
        self.vantage = np.zeros(1 << self.depth, np.int64)
        self.ring = np.zeros((2 << self.depth, 2))
        rng = np.random.default_rng(len(x))
        for node in range(1, 1 << self.depth):
            lo, hi = self.span(node)
            own = self.order[lo:hi]
            tried, compared = rng.choice(own, min(TRIED, len(own)), False), rng.choice(own, min(COMPARED, len(own)), False)
            spread = distances(x[tried][:, None, :], x[compared][None, :, :])
            self.vantage[node] = tried[np.argmax(np.nan_to_num(spread).std(1))]
            d = distances(x[own], x[self.vantage[node]])
            by = np.argsort(d, kind="stable")
            self.order[lo:hi], d = own[by], d[by]
            middle = self.span(2 * node)[1] - lo
            self.ring[2 * node], self.ring[2 * node + 1] = (d[0], d[middle - 1]), (d[middle], d[-1])

    def arrays(self) -> dict[str, np.ndarray]:
        return {"order": self.order, "vantage": self.vantage, "ring": self.ring}

    def span(self, node: int) -> tuple[int, int]:
        """The places in `order` of a node's vectors; nodes are numbered as in a heap, from 1."""
        level = int(node).bit_length() - 1
        first = node - (1 << level)
        return first * len(self.x) >> level, (first + 1) * len(self.x) >> level

    def _bound(self, child, low, d):
        """The least distance of a child's vectors to the queries: its parent's, or that to its ring."""
        return np.fmax(np.fmax(low, self.ring[child, ..., 0] - d), d - self.ring[child, ..., 1])

    def _scan(self, q: np.ndarray, which: np.ndarray, leaf: int, found: Nearest, own: np.ndarray) -> None:
        lo, hi = self.span(leaf)
        place = self.order[lo:hi]
        with np.errstate(over="ignore", invalid="ignore"):
            both = np.einsum("ij,ij->i", q[which], q[which])[:, None] + self.norm[place]
            far = found.far[which, None]
            r, c = np.nonzero(~(both - 2 * (q[which] @ self.x[place].T) > far * far + SLACK * both) & (place != own[which, None]))
        if len(r):
            at = distances(q[which[r]], self.x[place[c]])
            near = at <= far[r, 0]
            found.add(which[r[near]], place[c[near]], at[near]) if near.any() else None

    def search(self, q: np.ndarray, k: int, factor: float, own: np.ndarray | None = None) -> Nearest:
        """own: the place of each query in the block, which is no neighbour of it (-1: none)."""
        found, own = Nearest(len(q), k), np.full(len(q), -1) if own is None else own
        near = lambda low, which: factor * low <= found.far[which] * (1 + SLACK)
        at, low = np.ones(len(q), np.int64), np.zeros(len(q))
        for _ in range(self.depth):  # down to the leaf that each query lies nearest to
            d = distances(q, self.x[self.vantage[at]])
            a, b = self._bound(2 * at, low, d), self._bound(2 * at + 1, low, d)
            at, low = np.where(a <= b, 2 * at, 2 * at + 1), np.minimum(a, b)
        for leaf in np.unique(at):
            self._scan(q, np.flatnonzero(at == leaf), leaf, found, own)
        open_ = {1: (np.arange(len(q)), np.zeros(len(q)))}
        for node in range(1, 1 << self.depth):
            which, low = open_.pop(node)
            d = distances(q[which], self.x[self.vantage[node]])
            for child in (2 * node, 2 * node + 1):
                bound = self._bound(child, low, d)
                keep = near(bound, which)
                open_[child] = which[keep], bound[keep]
        for leaf, (which, low) in sorted(open_.items(), key=lambda x: x[1][1].mean() if len(x[1][1]) else 0):
            which = which[near(low, which)]
            if len(which):
                self._scan(q, which, leaf, found, own)
        return found

    def factor(self, k: int, audit: int, target: float) -> float:
        """The largest factor that surely keeps this share of the k nearest of `audit` vectors spread over the block: a neighbour is found if
        factor times the bound of its leaf is at most the k-th distance. 1 at least."""
        n = len(self.x)
        asked = np.unique(np.linspace(0, n - 1, min(audit, n)).astype(int))
        k = min(k, n - 1)
        if k < 1 or not self.depth:
            return 1.0
        leaf = np.zeros(n, np.int64)
        for node in range(1 << self.depth, 2 << self.depth):
            leaf[slice(*self.span(node))] = node
        leaf[self.order] = leaf.copy()
        ratios = []
        for i in asked:
            d = distances(self.x, self.x[i])
            d[i] = np.inf
            nearest = np.argpartition(d, k - 1)[:k]
            low = np.zeros(k)
            for level in range(self.depth):
                node = leaf[nearest] >> (self.depth - level)
                low = self._bound(leaf[nearest] >> (self.depth - level - 1), low, distances(self.x[self.vantage[node]], self.x[i]))
            with np.errstate(divide="ignore", invalid="ignore"):
                ratios.append(np.where(low > 0, d[nearest].max() / low, np.inf))
        ratios = np.sort(np.nan_to_num(np.concatenate(ratios), nan=1.0, posinf=np.finfo(float).max))
        return float(max(1.0, ratios[int((1 - target) * len(ratios))]))
