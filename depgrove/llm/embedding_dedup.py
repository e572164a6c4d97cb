"""Near-duplicate embeddings: each label's vectors are dealt to shards, a shard has a navigable small-world graph, and the vectors of
every shard query the graphs of all shards of their label (each pair of shards once, as links are symmetric).

Equal vectors of a label are one node with a number of copies. In its own shard a vector's search begins at itself. A query's beam is made
eight times as wide as long as all of it lies within the wanted similarity. All beams are doubled until the audits pass: all links of
AUDIT queries spread over the shard and of as many that were found to have links are compared with the whole shard, and PROBES vectors
that are made to lie just within the wanted similarity of one node each must find that node, so recall is measured where links are
rare as well. A beam that would cost more than the comparison with the whole shard is replaced by it. Links are verified in double
precision, counted in the task, and leave it as one row per vector with its local root, so their number does not matter; roots are
united to components. A shard holds as many vectors as fit SHARD_BYTES.

Defined results: a vector links with nothing, and is kept, if its label is null or it is null, empty, all zeros, or holds null or
non-finite components; vectors of different lengths do not link; rows with the same vec_id are rows of their own; a null vec_id is no
smallest id, and its row is kept if its component holds no other id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .hnsw import Graph

COSINE = 0.93
SHARD_BYTES = 16 << 20
BEAM = 32
AUDIT, PROBES = 64, 256
#: The share of the probes that must find their node: in another shard, and in the own one, where a search begins at the vector itself.
PROBED, HEALTHY = 0.99, 0.95
#: A beam of a shard's size divided by this costs as much as the comparison with the whole shard, which then takes its place.
DEAR = 64


def _raw(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _build(table: pa.Table) -> pa.Table:
    """A shard's graph, with its nodes in the graph's order."""
    x = np.stack(table.column("embedding").to_pylist()).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    by_node = np.argsort(table.column("node").to_numpy())  # one order, so one graph
    graph = Graph(unit[by_node].astype(np.float32))
    order = by_node[graph.order]
    raw = _raw(node=table.column("node").to_numpy()[order], copies=table.column("copies").to_numpy()[order], x=x[order], layers=np.array(len(graph.layers)), **{f"l{i}": l for i, l in enumerate(graph.layers)})
    return pa.table([table.column(c).slice(0, 1) for c in ("label", "size", "shard")] + [pa.array([raw], pa.binary())], ["label", "size", "shard", "graph"])


def _loaded(raw: bytes):
    found = np.load(io.BytesIO(raw))
    x = found["x"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(unit.astype(np.float32), build=False)
    graph.layers = [found[f"l{i}"] for i in range(int(found["layers"]))]
    return graph, unit, found["node"], found["copies"]


def _verified(pairs: np.ndarray, q: np.ndarray, x: np.ndarray, cosine: float) -> np.ndarray:
    keep = [np.einsum("ij,ij->i", q[p[:, 0]], x[p[:, 1]]) >= cosine for p in np.array_split(pairs, max(1, len(pairs) // 100_000))]
    return pairs[np.concatenate(keep)]


def _scan(q: np.ndarray, which: np.ndarray, x: np.ndarray, cosine: float) -> np.ndarray:
    found = [np.argwhere(q[which[i : i + 256]] @ x.T >= cosine) + [i, 0] for i in range(0, len(which), 256)]
    found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return np.stack([which[found[:, 0]], found[:, 1]], 1)


def _probes(x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and the node of each, of which they lie just within the cosine."""
    node = np.unique(np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int))
    aside = np.random.default_rng(len(x)).normal(size=(len(node), x.shape[1]))
    aside -= np.einsum("ij,ij->i", aside, x[node])[:, None] * x[node]
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    near = min(1.0, cosine + 1e-3)
    return near * x[node] + np.sqrt(1 - near * near) * aside / np.maximum(length, 1e-12), node


def _within(graph: Graph, q: np.ndarray, x: np.ndarray, cosine: float, beam: int) -> np.ndarray:
    """(query, node) of the links that the graph finds with beams of this width, wider where links fill them."""
    n, found, todo, wide = len(x), [], np.arange(len(q)), beam
    while len(todo):
        if wide >= n or (wide > beam and wide * DEAR >= n):
            found.append(_scan(q, todo, x, cosine))
            break
        hits, full = graph.within(q[todo].astype(np.float32), cosine - 1e-4, wide, todo if q is x else None)
        done = np.ones(len(todo), bool)
        done[full] = False
        hits = hits[done[hits[:, 0]]]
        found.append(_verified(np.stack([todo[hits[:, 0]], hits[:, 1]], 1), q, x, cosine))
        todo, wide = todo[full], wide * 8
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _linked(graph: Graph, q: np.ndarray, x: np.ndarray, cosine: float) -> np.ndarray:
    """(query, node) of all links, from the first width of beams that passes the audits."""
    n, beam = len(x), BEAM
    spread = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    probes, node = _probes(x, cosine)
    same = q is x
    while beam < n and (beam <= 2 * BEAM or beam * DEAR < n):
        probed = _within(graph, probes, x, cosine, beam)
        if np.isin(np.arange(len(node)) * n + node, probed[:, 0] * n + probed[:, 1]).mean() >= (HEALTHY if same else PROBED):
            pairs = _within(graph, q, x, cosine, beam)
            others = np.unique(pairs[pairs[:, 0] != pairs[:, 1], 0] if same else pairs[:, 0])
            audited = np.union1d(spread, others[np.unique(np.linspace(0, len(others) - 1, min(AUDIT, len(others))).astype(int))] if len(others) else others)
            truth = _scan(q, audited.astype(int), x, cosine)
            if np.isin(truth[:, 0] * n + truth[:, 1], pairs[:, 0] * n + pairs[:, 1]).all():
                return pairs
        beam *= 2
    return _scan(q, np.arange(len(q)), x, cosine)


def _query(cosine: float):
    def query(table: pa.Table) -> pa.Table:
        """One shard's vectors against the graph of the same or another shard: for each linked node its links and local root."""
        raw = dict(zip(table.column("shard").to_pylist(), table.column("graph").to_pylist()))
        low, high = min(raw), max(raw)
        graph, x, node, copies = _loaded(raw[low])
        if low == high:
            pairs = _linked(graph, x, x, cosine)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            a, b = pairs.min(1), pairs.max(1)
        else:
            _, q, other, more = _loaded(raw[high])
            pairs = _linked(graph, q, x, cosine)
            a, b = pairs[:, 1], pairs[:, 0] + len(node)
            node, copies = np.append(node, other), np.append(copies, more)
        key = np.unique(a * len(node) + b)
        a, b = key // len(node), key % len(node)
        links = np.bincount(a, copies[b], minlength=len(node)) + np.bincount(b, copies[a], minlength=len(node))
        root = np.arange(len(node))
        while True:
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = new[new]
            if (new == root).all():
                break
            root = new
        hit = np.flatnonzero(links)
        return pa.table([pa.array(node[hit]), pa.array(links[hit].astype(np.int64)), pa.array(node[root[hit]])], ["node", "links", "root"])

    return query


def dedup(vectors: DataFrame, cosine: float = COSINE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row. vectors: vec_id, embedding (array of float or double), label. shard_bytes:
    of a shard's vectors in double precision."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", number) & F.exists("embedding", lambda v: v != 0)
    keyed = rows.withColumn("node", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "embedding")))
    own = keyed.where("node IS NOT NULL")
    nodes = own.groupBy("node", "label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumn("size", F.size("embedding"))
    nodes = written(nodes, "vectors")
    shards = nodes.groupBy("label", "size").agg(F.ceil(F.count("*") * 8 * F.col("size") / shard_bytes).alias("shards"))
    dealt = nodes.join(shards, ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("node", F.lit(7)), "shards").cast("int"))
    kind = dict(nodes.dtypes)["label"]
    graphs = dealt.select("label", "size", "shard", "node", "copies", "embedding").groupBy("label", "size", "shard").applyInArrow(_build, f"label {kind}, size int, shard int, graph binary")
    graphs = written(graphs, "graphs")
    names = graphs.select("label", "size", "shard")
    pairs = names.withColumnRenamed("shard", "p").join(names.withColumnRenamed("shard", "q"), ["label", "size"]).where("p <= q")
    sides = pairs.select("label", "size", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("shard"))
    tasks = sides.join(graphs, ["label", "size", "shard"])
    links = written(tasks.groupBy("label", "size", "p", "q").applyInArrow(_query(cosine), "node long, links long, root long"), "vector-links")
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies", "least").join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    found = keyed.select("vec_id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
