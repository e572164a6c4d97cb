"""Deep graphs: a search that goes through a whole part of the graph in one step.

Nodes are cut into parts of 2**PART_BITS neighbouring vids. A part's inner edges are one packed row, in a table bucketed by part; edges between parts
are rows bucketed by the node they leave. A round takes the nodes whose distance got smaller, follows inner edges to their end within each
part's task, then the edges between parts by a join. A search that has not ended after ROUNDS rounds goes on over parts of GROWTH more bits, so the number
of rounds follows the logarithm of how often the shortest ways cross from part to part, until parts are as large as a task may hold: at most
PART_EDGES inner edges (a part with more from the first is followed by joins; parts do not grow into one) and PART_STATES nodes times queries.
"""

from __future__ import annotations

import io
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .searches import BITS, Seen, numbered, turned
from .tables import Bucketed, bucketed, buckets, counted_buckets

C = F.col
PART_BITS = 16
PART_EDGES = 4_000_000
PART_STATES = 2**24
ROUNDS, GROWTH = 2, 6
FAR = np.iinfo(np.int64).max


def _packed(table: pa.Table) -> pa.Table:
    """A part's inner edges as offsets by node and ends, nodes counted from the part's first."""
    out = io.BytesIO()
    src, dst = (table[c].to_numpy() for c in ("src", "dst"))
    order = np.lexsort((dst, src))
    np.savez(out, src=src[order], dst=dst[order])
    return pa.table([table["part"].slice(0, 1), pa.array([out.getvalue()], pa.binary())], ["part", "inner"])


def _inner(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part's nodes (ascending), and its edges' ends as places among them: offsets by node, and ends."""
    found = np.load(io.BytesIO(raw))
    src, dst = found["src"], found["dst"]
    nodes = np.union1d(src, dst)
    at = np.searchsorted(nodes, src)
    return nodes, np.searchsorted(at, np.arange(len(nodes) + 1)), np.searchsorted(nodes, dst)


def relaxed(nodes: np.ndarray, offset: np.ndarray, end: np.ndarray, place: np.ndarray, query: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All that the given nodes (as places) reach along inner edges: places, queries and least distances, those given included."""
    some, query = np.unique(query, return_inverse=True)
    q = len(some)
    best = np.full(len(nodes) * q, FAR)
    np.minimum.at(best, place * q + query, distance)
    waiting: dict[int, list[np.ndarray]] = {}
    for d in np.unique(distance):
        waiting[int(d)] = [np.unique((place * q + query)[distance == d])]
    while waiting:
        d = min(waiting)
        now = np.unique(np.concatenate(waiting.pop(d)))
        now = now[best[now] == d]
        at, which = now // q, now % q
        n = offset[at + 1] - offset[at]
        if not n.sum():
            continue
        edge = np.repeat(offset[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        to = end[edge] * q + np.repeat(which, n)
        to = to[best[to] > d + 1]
        if len(to):
            best[to] = d + 1
            waiting.setdefault(d + 1, []).append(to)
    found = np.flatnonzero(best < FAR)
    return found // q, some[found % q], best[found]


def _relax(entries: pa.Table, part: pa.Table) -> pa.Table:
    """The nodes that got nearer and what they reach within their part. A part without inner edges, or without such nodes, adds nothing."""
    names = ["vid", "bit", "distance"]
    if not entries.num_rows or not part.num_rows:
        return entries.select(names) if entries.num_rows else pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64())], names)
    nodes, offset, end = _inner(part["inner"][0].as_py())
    vid, bit, distance = (entries[c].to_numpy() for c in names)
    place = np.minimum(np.searchsorted(nodes, vid), len(nodes) - 1)
    inside = nodes[place] == vid
    at, query, best = relaxed(nodes, offset, end, place[inside], bit[inside], distance[inside])
    return pa.table([np.concatenate([nodes[at], vid[~inside]]), np.concatenate([query, bit[~inside]]).astype(np.int32), np.concatenate([best, distance[~inside]])], names)


class Parts:
    """A graph cut into parts, for searches of one direction."""

    def __init__(self, edges: DataFrame, direction: str, part_bits: int = PART_BITS, part_edges: int = PART_EDGES, n: int | None = None):
        self.bits, self.n, self.direction = part_bits, n or buckets(edges.sparkSession), direction
        self.part_edges, self._coarser = part_edges, None
        rows = turned(edges, direction).distinct().withColumn("part", self.part(C("src")))
        heavy = rows.where(C("part") == self.part(C("dst"))).groupBy("part").count().where(C("count") > part_edges).select("part", F.lit(True).alias("heavy"))
        rows = rows.join(heavy, "part", "left")
        inner = (C("part") == self.part(C("dst"))) & C("heavy").isNull()
        packed = rows.where(inner).groupBy("part").applyInArrow(_packed, "part long, inner binary")
        self.inner = bucketed(packed, "part", "inner_edges", self.n).by_key
        self.between = bucketed(rows.where(~inner).select("src", "dst").repartition(self.n, "src"), "src", "edges_between", self.n).by_key

    def part(self, vid: Column) -> Column:
        return F.shiftright(vid, self.bits)

    def edges(self) -> DataFrame:
        """src, dst of all edges, turned."""
        inner = self.inner.select(F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), "inner").mapInArrow(_unpacked, "src long, dst long")
        return inner.unionByName(self.between)

    def coarser(self, queries: int) -> Parts:
        """The same graph in parts of GROWTH more bits; itself where such a part could be more than a task holds."""
        bits = self.bits + GROWTH
        if queries << bits > PART_STATES:
            return self
        if self._coarser is None:
            sizes = self.edges().select(F.shiftright("src", bits).alias("part"), F.shiftright("dst", bits).alias("to")).where("part = to").groupBy("part").count()
            most = sizes.agg(F.max("count").alias("n")).first().n or 0
            self._coarser = Parts(self.edges(), "dependencies", bits, self.part_edges, self.n) if most <= self.part_edges else self
        return self._coarser

    def distances(self, starts: DataFrame) -> DataFrame:
        """qid, vid, distance (0 at the starts). starts: qid, vid."""
        queries, n = numbered(starts, BITS)
        out = []
        for run in range(max(1, -(-n // BITS))):
            mine = queries.where(C("run") == run).select("qid", "bit")
            found = self._search(starts.join(mine, "qid").select("vid", "bit"), max(1, min(BITS, n - run * BITS)))
            out.append(found.join(mine, "bit").select("qid", "vid", "distance"))
        return reduce(DataFrame.unionByName, out)

    def _search(self, starts: DataFrame, queries: int) -> DataFrame:
        """vid, bit, distance."""
        key = (F.shiftleft(C("vid"), 6) + C("bit")).alias("key")
        least = lambda df: df.groupBy("key").agg(F.min("distance").alias("distance"))
        seen = Seen("key", ["distance"], self.n, least)

        def nearer(rows: DataFrame) -> tuple[Bucketed, dict[str, int]]:
            rows, before = seen.beside(least(rows.select(key, "distance")))
            for (known,) in before:
                rows = rows.where(known.isNull() | (known > C("distance")))
            return counted_buckets(rows.select("key", "distance"), "key", "nearer", self.n)

        node = lambda df: df.select(F.shiftright("key", 6).alias("vid"), C("key").bitwiseAND(63).cast("int").alias("bit"), "distance")
        entries, found = counted_buckets(least(starts.select(key, F.lit(0).cast("long").alias("distance"))), "key", "nearer", self.n)
        if not found["n"]:
            return node(entries.plain)
        cut, rounds = self, 0
        while found["n"]:
            if rounds and rounds % ROUNDS == 0:
                cut = cut.coarser(queries)
            rounds += 1
            at = node(entries.by_key).withColumn("part", cut.part(C("vid")))
            reached = at.groupBy("part").cogroup(cut.inner.groupBy("part")).applyInArrow(_relax, "vid long, bit int, distance long")
            improved, _ = nearer(reached)
            seen.add(improved)
            crossed = node(improved.by_key).join(cut.between, C("vid") == C("src")).select(C("dst").alias("vid"), "bit", (C("distance") + 1).alias("distance"))
            entries, found = nearer(crossed)
        return node(least(seen.rows()))

    def path(self, towards: DataFrame, start: int) -> list[int]:
        """The shortest way from a node along which distances fall to 0, by the smallest vid at each step. towards: vid, distance of one query of
        a search in the other direction. Only the way itself comes to the driver."""
        bits = max(self.bits, self.part_edges.bit_length() - 1)  # a step for each node: a part of them is no larger than one of edges
        edges = self._steps(towards, bits)
        way, at = [start], start
        while True:
            own = edges.where(C("part") == (at >> bits))
            rows = own.mapInArrow(_follow(at), "place long, vid long").orderBy("place").collect()
            if not rows:
                return way
            way += [r.vid for r in rows]
            at = way[-1]

    def _steps(self, towards: DataFrame, bits: int) -> DataFrame:
        """The next node of each on its way, a packed row for each part."""
        to = lambda c: towards.select(C("vid").alias(c), C("distance").alias(f"{c}_distance"))
        edges = self.edges().join(to("src"), "src").join(to("dst"), "dst").where("dst_distance = src_distance + 1")
        steps = edges.groupBy(C("dst").alias("at")).agg(F.min("src").alias("next")).select(F.shiftright("at", bits).alias("part"), C("at").alias("src"), C("next").alias("dst"))
        return bucketed(steps.groupBy("part").applyInArrow(_packed, "part long, inner binary"), "part", "steps", self.n).by_key


def _unpacked(batches):
    for batch in batches:
        for raw in batch.column("inner").to_pylist():
            found = np.load(io.BytesIO(raw))
            yield pa.RecordBatch.from_arrays([pa.array(found["src"]), pa.array(found["dst"])], ["src", "dst"])


def _follow(start: int):
    """Steps from a node on, as far as its part goes."""

    def follow(batches):
        for batch in batches:
            for raw in batch.column("inner").to_pylist():
                found = np.load(io.BytesIO(raw))
                src, dst, way, at = found["src"], found["dst"], [], start
                while (i := int(np.searchsorted(src, at))) < len(src) and src[i] == at:
                    at = int(dst[i])
                    way.append(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(way))), pa.array(way, pa.int64())], ["place", "vid"])

    return follow
