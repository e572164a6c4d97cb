"""Hierarchical navigable small-world graphs in numpy; insertions and searches advance for many vectors at a time.

Vectors are ordered by level, so the nodes of each layer are the first ones. A search keeps for each query a beam of the best nodes
seen, expands the best few of the beam that are not yet expanded, and ends when none are left.
"""

from __future__ import annotations

import numpy as np

from .text import mix

M = 12  # links that a node chooses on a layer; it holds twice as many
TOGETHER = 512
EXPAND = 4
SPARE = 4


def _best(sims: np.ndarray, n: int) -> np.ndarray:
    """Places of each row's n largest, largest first."""
    if sims.shape[1] > n:
        at = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    else:
        at = np.broadcast_to(np.arange(sims.shape[1]), sims.shape).copy()
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(sims, at, 1), axis=1, kind="stable"), 1)


def _diverse(x: np.ndarray, of: np.ndarray, found: np.ndarray, sims: np.ndarray, n: int) -> np.ndarray:
    """For each row of `of` up to n of the found nodes, best first: a node is passed over if one taken before is nearer to it than the
    row is; places that stay free get the best of those passed over. -1: none."""
    order = np.argsort(-sims, axis=1, kind="stable")
    found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
    rows, width = found.shape
    vectors = x[np.maximum(found, 0)]
    among = vectors @ vectors.transpose(0, 2, 1)
    valid = (found >= 0) & np.isfinite(sims)
    taken, count = np.zeros((rows, width), bool), np.zeros(rows, np.int64)
    for c in range(width):
        near = np.where(taken[:, :c], among[:, c, :c], -np.inf).max(1) if c else np.full(rows, -np.inf)
        take = valid[:, c] & (count < n) & (near < sims[:, c])
        taken[:, c] = take
        count += take
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * width + np.arange(width)
    keep = np.argsort(rank, axis=1, kind="stable")[:, :n]
    return np.where(np.take_along_axis(valid, keep, 1), np.take_along_axis(found, keep, 1), -1)


class Graph:
    def __init__(self, x: np.ndarray, build: bool = True, beam: int = 32):
        """x: unit vectors (float32)."""
        self.x, self.layers = x, []
        if not build:
            return
        n = len(x)
        u = (mix(np.arange(n, dtype=np.uint64) + np.uint64(9)).astype(float) + 1) * 2.0**-64
        level = np.floor(-np.log(u) / np.log(M)).astype(int)
        self.order = np.argsort(-level, kind="stable")  # place in the graph -> place in x as given
        self.x = x = np.ascontiguousarray(x[self.order])
        level = level[self.order]
        for at in range(int(level[0]) if n else 0, -1, -1):
            self.layers.append(self._layer(int((level >= at).sum()), beam))

    def _layer(self, n: int, beam: int) -> np.ndarray:
        x, links = self.x, np.full((n, 2 * M), -1, np.int32)
        done = 1
        while done < n:
            new = np.arange(done, min(n, done + max(1, min(TOGETHER, done))))
            entry = self._descend(x[new], done)
            found, sims, _ = self._search(x[new], entry, links, min(beam, max(8, done)))
            mates = x[new] @ x[new].T
            np.fill_diagonal(mates, -np.inf)
            near = _best(mates, min(M, len(new)))
            found = np.concatenate([found, new[near]], 1)
            sims = np.concatenate([sims, np.take_along_axis(mates, near, 1)], 1)
            links[new, :M] = _diverse(x, new, found, sims, M)[:, :M] if found.shape[1] >= M else np.pad(_diverse(x, new, found, sims, M), ((0, 0), (0, M - found.shape[1])), constant_values=-1)
            self._link_back(links, new)
            done = int(new[-1]) + 1
        return self._reached(links)

    def _reached(self, links: np.ndarray) -> np.ndarray:
        """The layer with spare places, of which nodes that no path from the first one reaches get one, each from its nearest neighbour
        that is reached and has a place left."""
        links = np.concatenate([links, np.full((len(links), SPARE), -1, np.int32)], 1)
        reached, new = np.zeros(len(links), bool), np.zeros(1, np.int64)
        while True:
            while len(new):
                reached[new] = True
                around = links[new].ravel()
                around = np.unique(around[around >= 0])
                new = around[~reached[around]].astype(np.int64)
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return links
            u = lost[0]
            free = np.flatnonzero(reached & (links[:, -1] < 0))
            if not len(free):
                return links
            v = free[np.argmax(self.x[free] @ self.x[u])]
            links[v, 2 * M + int((links[v, 2 * M :] >= 0).sum())] = u
            new = np.array([u])

    def _link_back(self, links: np.ndarray, new: np.ndarray) -> None:
        x = self.x
        target = links[new, :M].ravel()
        source = np.repeat(new, M)[target >= 0]
        target = target[target >= 0]
        sims = np.einsum("ij,ij->i", x[source], x[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
        rank = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        use = rank < 2 * M  # the nearest of the new ones
        nodes = target[first]
        row = np.searchsorted(nodes, target[use])
        more = np.full((len(nodes), 2 * M), -1, np.int64)
        more[row, rank[use]] = source[use]
        more[(more[:, :, None] == links[nodes][:, None, :]).any(2)] = -1
        both = np.concatenate([links[nodes].astype(np.int64), more], 1)
        sims = np.where(both >= 0, np.einsum("ijk,ik->ij", x[np.maximum(both, 0)], x[nodes]), -np.inf)
        links[nodes] = _diverse(x, nodes, both, sims, 2 * M)

    def _descend(self, q: np.ndarray, limit: int | None = None) -> np.ndarray:
        """For each query a near node of the lowest layer that is complete."""
        at = np.zeros(len(q), np.int64)
        for links in self.layers:
            found, _, _ = self._search(q, at, links, 4)
            at = found[:, 0]
        return at

    def _search(self, q: np.ndarray, entry: np.ndarray, links: np.ndarray, beam: int, least: float | None = None):
        """The beams' nodes and similarities, best first; least: also (query, node) of all nodes seen of this similarity or more."""
        x, rows = self.x, len(q)
        seen = np.zeros((rows, len(links)), bool)
        every = np.arange(rows)
        seen[every, entry] = True
        ids = np.full((rows, beam), -1, np.int64)
        sims = np.full((rows, beam), -np.inf, np.float32)
        ids[:, 0], sims[:, 0] = entry, np.einsum("ij,ij->i", x[entry], q)
        expanded = np.zeros((rows, beam), bool)
        hits = [np.stack([every, entry], 1)[sims[:, 0] >= least]] if least is not None else []
        active = every
        while len(active):
            open_ = np.where(expanded[active] | (ids[active] < 0), -np.inf, sims[active])
            pick = _best(open_, min(EXPAND, beam))
            usable = np.isfinite(np.take_along_axis(open_, pick, 1))
            go = usable[:, 0]
            active, pick, usable = active[go], pick[go], usable[go]
            if not len(active):
                break
            node = ids[active[:, None], pick]
            expanded[active[:, None], pick] |= usable
            around = np.where(usable[:, :, None], links[np.where(usable, node, 0)], -1).reshape(len(active), -1).astype(np.int64)
            around.sort(1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
            fresh = (around >= 0) & ~seen[active[:, None], np.maximum(around, 0)]
            seen[np.broadcast_to(active[:, None], around.shape)[fresh], around[fresh]] = True
            near = np.full(around.shape, -np.inf, np.float32)
            r, c = np.nonzero(fresh)
            near[r, c] = np.einsum("ij,ij->i", x[around[r, c]], q[active[r]])
            if least is not None:
                hit = near[r, c] >= least
                hits.append(np.stack([active[r[hit]], around[r, c][hit]], 1))
            all_ids = np.concatenate([ids[active], np.where(fresh, around, -1)], 1)
            all_sims = np.concatenate([sims[active], near], 1)
            all_expanded = np.concatenate([expanded[active], np.zeros(around.shape, bool)], 1)
            keep = _best(all_sims, beam)
            ids[active], sims[active] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_sims, keep, 1)
            expanded[active] = np.take_along_axis(all_expanded, keep, 1)
        return ids, sims, (np.concatenate(hits) if hits else None)

    def within(self, q: np.ndarray, least: float, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the similarity `least` or more that beams of this width see, and the queries whose whole beam is that near.
        own: the node that each query is, if it is one; the search begins there, else it comes down from the top."""
        found, full = [], []
        for i in range(0, len(q), TOGETHER):
            part = q[i : i + TOGETHER]
            entry = self._descend(part) if own is None else own[i : i + TOGETHER]
            _, sims, hits = self._search(part, entry, self.layers[-1], min(beam, len(self.x)), least)
            found.append(hits + [i, 0])
            full.append(np.flatnonzero(sims[:, -1] >= least) + i)
        return np.concatenate(found), np.concatenate(full)
