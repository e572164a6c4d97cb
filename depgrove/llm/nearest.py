"""Approximate nearest neighbours: a vantage-point tree for each shard of the vectors; blocks of queries search all shards' trees, and each
query's nearest of all shards count.

Each shard reads its factor, by which the triangle inequality is stretched, off an audit: AUDIT of its own vectors are compared with the
whole shard, and the factor is the largest that surely keeps TARGET of their true neighbours; in a search more are kept, as the k-th
distance in one shard is no less than the final one. With factor=1 the search is exact.

Defined results: vectors that are null, empty, all zeros or hold null or non-finite components take no part, as queries or candidates;
vectors meet those of their length only; rows that are equal in id and vector count once, rows with a query's id are its own and no
candidates of it, other rows with one id are rows of their own; a row without an id is a candidate, after all others in ties, but no query;
fewer candidates than k are all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NO_ID, blocks_for, matrix, met, named, packed, vectors
from .common import written
from .vptree import Tree

K = 10
EVERY = 100
SHARD_BYTES = 8 << 20
QUERY_BYTES = 2 << 20
AUDIT, TARGET = 64, 0.97
#: Queries that a tree is searched for at once.
TOGETHER = 1024


def _shard(k: int, factor: float | None):
    def shard(table: pa.Table) -> dict[str, np.ndarray]:
        tree = Tree(matrix(table))
        return {"id": table["id"].to_numpy(), "x": tree.x, "factor": np.array(tree.factor(k, AUDIT, TARGET) if factor is None else factor), **tree.arrays()}

    return shard


def _asked(table: pa.Table) -> dict[str, np.ndarray]:
    return {"id": table["id"].to_numpy(), "x": matrix(table), "key": table["key"].to_numpy()}


def _search(k: int):
    def search(shard: dict, asked: dict) -> pa.Table:
        tree, ids = Tree(shard["x"], shard), shard["id"]
        out = []
        for i in range(0, len(asked["id"]), TOGETHER):
            q, id_, key = (asked[c][i : i + TOGETHER] for c in ("x", "id", "key"))
            same = np.searchsorted(ids, id_, "right") - np.searchsorted(ids, id_)  # rows of the query's id: left out below
            most = k + int(same.max()) if same.max() > 1 else k
            own = np.where(same == 1, np.searchsorted(ids, id_), -1)
            found = tree.search(q, most, float(shard["factor"]), own)
            r, c = np.nonzero((found.place >= 0) & (ids[found.place] != id_[:, None]))
            out.append((key[r], id_[r], ids[found.place[r, c]], found.at[r, c]))
        return pa.table([np.concatenate(c) for c in zip(*out)], ["key", "query_id", "vec_id", "score"])

    return search


def nearest(rows: DataFrame, queries: DataFrame | None = None, k: int = K, factor: float | None = None, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (the Euclidean distance in double precision) of each query's k nearest found. rows, queries:
    vec_id, embedding; queries: by default the rows whose id is divisible by EVERY. factor: None for the audited one of each shard."""
    queries = rows.where(F.col("vec_id") % EVERY == 0) if queries is None else queries
    whole = lambda df: vectors(df).where(F.exists("x", lambda v: v != 0))
    n, m = blocks_for(rows, shard_bytes), blocks_for(queries, query_bytes)
    shards = written(packed(whole(rows), "a", n, _shard(k, factor)), "trees")
    # queries of one id and different vectors are told apart by a key
    asked = whole(queries).where(F.col("id") != NO_ID).withColumn("key", F.xxhash64("id", "x"))
    asked = written(packed(asked, "b", m, _asked), "queries")
    found = met(shards, n, asked, m, _search(k), "key long, query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", named("vec_id"), "score")


def op11_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
