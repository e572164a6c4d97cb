"""Hard negatives: blocks of anchors times blocks of candidates as dense products of whole numbers in float64, twice.

First each pair of blocks gives its best POSITIVES candidates of an anchor's label, which merge to the anchor's positives; then the anchors go out
once more, each with the range of scores that each positive allows, and each pair of blocks gives its best NEGATIVES candidates of other
labels in each range. Products are exact where no partial sum can reach 2**53; rows whose components are too large for that are multiplied in
whole numbers of any length, and a score beyond the range of a long counts as its end.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; vectors meet those of their length only
(an empty one has score 0); rows equal in id, label and vector count once, rows with an anchor's id are its own and no candidates of it; rows
with one id are else rows of their own, as anchors as well; a row without an id is no anchor and stands after all others in ties; an anchor
without positives, or a positive without negatives in its range, has no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NO_ID, blocks_for, matrix, met, named, packed, vectors, within_runs
from .common import written

C = F.col
EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: Tenths of the positive's score that a negative's score has at least and at most.
LEAST, MOST = 3, 9
SCALE = 256
BLOCK_BYTES = 4 << 20
ANCHOR_BYTES = 1 << 20
#: Scores that a task holds at once.
SCORES = 1 << 22
EXACT = 2.0**53
LONG = 2**63 - 1


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs."""
    size = np.abs(x).max(1, initial=0) * max(1, x.shape[1]) * np.abs(a).max(initial=0)
    plain = size < EXACT
    out = np.zeros((len(a), len(x)), np.int64)
    out[:, plain] = (a @ x[plain].T).astype(np.int64)
    if not plain.all():
        whole = lambda m: np.frompyfunc(int, 1, 1)(m)
        out[:, ~plain] = np.clip(whole(a) @ whole(x[~plain]).T, -LONG, LONG).astype(np.int64)
    return out


def _best(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The k places with the highest scores, highest first, ties by place; places ascend."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[-k]
        near = scores >= least
        scores, places = scores[near], places[near]
    return places[np.argsort(-scores, kind="stable")[:k]]


def _candidates(table: pa.Table) -> dict[str, np.ndarray]:
    return {"id": table["id"].to_numpy(), "label": table["label"].to_numpy(), "x": np.nan_to_num(np.floor(SCALE * matrix(table)))}


def _anchors(table: pa.Table) -> dict[str, np.ndarray]:
    return _candidates(table) | {"key": table["key"].to_numpy()}


def _ranged(table: pa.Table) -> dict[str, np.ndarray]:
    longs = pa.list_(pa.int64())
    lists = {c: table[c].cast(longs).combine_chunks() for c in ("least", "most", "positive")}
    return _anchors(table) | {c: v.flatten().to_numpy() for c, v in lists.items()} | {"n": np.diff(lists["least"].offsets.to_numpy())}


def _strips(anchors: dict, candidates: dict):
    """Each anchor's number, its scores and the candidates that are not its own."""
    x, step = candidates["x"], max(1, SCORES // max(1, len(candidates["x"])))
    for i in range(0, len(anchors["id"]), step):
        for j, scores in enumerate(_products(anchors["x"][i : i + step], x), i):
            yield j, scores, candidates["id"] != anchors["id"][j]


def _positives(anchors: dict, candidates: dict) -> pa.Table:
    out = []
    for i, scores, others in _strips(anchors, candidates):
        same = np.flatnonzero(others & (candidates["label"] == anchors["label"][i]))
        best = _best(scores[same], same, POSITIVES)
        out.append((np.full(len(best), anchors["key"][i]), candidates["id"][best], scores[best]))
    return pa.table([np.concatenate(c) for c in zip(*out)], ["key", "positive_id", "positive_score"])


def _negatives(anchors: dict, candidates: dict) -> pa.Table:
    out, ends = [], np.cumsum(anchors["n"])
    for i, scores, others in _strips(anchors, candidates):
        own = slice(ends[i] - anchors["n"][i], ends[i])
        other = others & (candidates["label"] != anchors["label"][i])
        for least, most, positive in zip(anchors["least"][own], anchors["most"][own], anchors["positive"][own]):
            inside = np.flatnonzero(other & (scores >= least) & (scores <= most))
            best = _best(scores[inside], inside, NEGATIVES)
            out.append((np.full(len(best), anchors["key"][i]), np.full(len(best), positive), candidates["id"][best], scores[best]))
    columns = zip(*out) if out else [[np.zeros(0, np.int64)]] * 4
    return pa.table([np.concatenate(c) for c in columns], ["key", "place", "negative_id", "negative_score"])


def mine(rows: DataFrame, every: int = EVERY, block_bytes: int = BLOCK_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. rows: vec_id, embedding, label; anchors are the rows
    whose id is divisible by `every`."""
    label = F.when(C("vec_id") % 7 == 0, (C("label").cast("long") + 1) % 10).otherwise(C("label").cast("long")).alias("label")
    usable = vectors(rows.where("label IS NOT NULL"), label)
    n, m = blocks_for(rows, block_bytes), blocks_for(rows.where(C("vec_id") % every == 0), anchor_bytes)
    candidates = written(packed(usable, "b", n, _candidates), "candidates")
    # rows of one id are told apart by a key
    anchors = written(usable.where((C("id") != NO_ID) & (C("id") % every == 0)).withColumn("key", F.xxhash64("id", "label", "x")), "anchors")
    first = met(packed(anchors, "a", m, _anchors), m, candidates, n, _positives, "key long, positive_id long, positive_score long")
    order = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    best = first.withColumn("place", F.row_number().over(order).cast("long")).where(C("place") <= POSITIVES)
    positives = written(best, "positives")
    ones = F.pmod(C("positive_score"), F.lit(10))
    tens = F.expr("positive_score div 10L") - F.when(C("positive_score") % 10 < 0, 1).otherwise(0)  # in parts, as ten times a long may be none
    least, most = LEAST * tens - F.floor(-LEAST * ones / 10), MOST * tens + F.floor(MOST * ones / 10)
    ranges = positives.groupBy("key").agg(F.collect_list(F.struct(least.cast("long").alias("least"), most.cast("long").alias("most"), C("place").alias("positive"))).alias("r"))
    ranged = anchors.join(ranges, "key").select(*anchors.columns, *[C(f"r.{c}").alias(c) for c in ("least", "most", "positive")])
    second = met(packed(ranged, "a", m, _ranged), m, candidates, n, _negatives, "key long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    chosen = second.withColumn("rank", F.row_number().over(order)).where(C("rank") <= NEGATIVES)
    ids = anchors.select("key", C("id").alias("anchor_id"))
    out = chosen.join(positives, ["key", "place"]).join(ids, "key")
    return out.select("anchor_id", named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score")


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
  s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.x) = len(a.x) WHERE a.vec_id % 100 = 0),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
  n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
  SELECT * FROM n WHERE rank <= 10"""
