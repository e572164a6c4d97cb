"""Nearest neighbours and hard negatives against brute force, in many blocks, with odd rows."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from depgrove.llm import nearest, negatives
from depgrove.llm.vptree import Tree, distances

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    out = [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).round(3).tolist(), int(i % 5)) for i in range(1500)]
    same = out[100][1]
    out += [(2000 + i, same, 0) for i in range(400)]  # copies, all as near
    out += [out[100], out[100], (100, out[7][1], 3), (300, same, 0), (None, same, 0), (None, out[3][1], 3)]
    out += [(3000, None, 1), (3100, [], 1), (3200, [0.0] * 8, 1), (3300, [1.0, None] * 4, 1), (3400, [NAN] * 8, 1), (3500, [INF] * 8, 1), (3600, [1.0, 2.0], 1), (3700, [2.0, 1.0], 1), (3800, same, None), (3900, [1e300] * 8, 2), (4000, [-1e300] * 8, 2), (4100, [1e12] * 8, 2), (4200, [3e12] * 8, 2)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in ("id", "x", "size", "a", "b", "side", "raw", "key", "score", "rank")])


def taking_part(rows, zeros):
    found = {}
    for id_, x, label in rows:
        if x is not None and all(v is not None and math.isfinite(v) for v in x) and (zeros or any(x)):
            found[id_, tuple(x), label] = None
    return list(found)


def by_id(id_):
    return (id_ is None, id_ or 0)


def test_tree_is_exact_and_factors_leave_out():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(3000, 5)), np.repeat(rng.normal(size=(1, 5)), 700, 0)])
    tree, q = Tree(x), np.concatenate([rng.normal(size=(40, 5)), x[3300:3310]])
    want = [sorted(zip(distances(x, v).tolist(), range(len(x))))[:10] for v in q]
    exact = tree.search(q, 10, 1.0)
    assert [list(zip(a, p)) for a, p in zip(exact.at.tolist(), exact.place.tolist())] == want
    factor = tree.factor(10, 64, 0.97)
    assert factor > 1
    hits = np.mean([a <= w[-1][0] for found, w in zip(tree.search(q, 10, factor).at.tolist(), want) for a in found])
    assert hits >= 0.9 > np.mean([a <= w[-1][0] for found, w in zip(tree.search(q, 10, 1e6).at.tolist(), want) for a in found])


def wanted(rows, k=10):
    known = {(id_, x) for id_, x, _ in taking_part(rows, False)}
    out = []
    for id_, x in known:
        if id_ is not None and id_ % 100 == 0:
            near = sorted(((float(distances(np.array(x), np.array(y))), by_id(other), other) for other, y in known if other != id_ and len(y) == len(x)), key=lambda r: r[:2])[:k]
            out += [(id_, i + 1, other, d) for i, (d, _, other) in enumerate(near)]
    return collections.Counter(out)


def test_nearest(table, rows):
    want = wanted(rows)
    for size in (1 << 30, 20_000):  # one shard, and several
        got = nearest.nearest(table, factor=1.0, shard_bytes=size, query_bytes=size).collect()
        assert collections.Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    got = nearest.nearest(table, shard_bytes=20_000, query_bytes=500).collect()
    assert {(r.query_id, r["rank"]) for r in got} == {(q, i) for q, i, _, _ in want}
    far = {}
    for q, _, _, d in want:
        far[q] = max(d, far.get(q, 0))
    assert np.mean([r.score <= far[r.query_id] for r in got]) >= 0.9
    assert nearest.nearest(table.limit(0)).count() == 0


def test_recall_where_nothing_is_near(spark):
    """All vectors about as far from each other as can be: the audit must find that little can be left out."""
    x = np.random.default_rng(9).normal(size=(4000, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    got = nearest.nearest(df, shard_bytes=500_000).collect()
    true = {q: {j for _, j in sorted((d, j) for j, d in enumerate(distances(x, x[q]).tolist()) if j != q)[:10]} for q in range(0, 4000, 100)}
    assert np.mean([r.vec_id in true[r.query_id] for r in got]) >= 0.9 and len(got) == 400


def mined(rows):
    known = {}
    for id_, x, label in taking_part(rows, True):
        if label is not None:
            label = (label + 1) % 10 if id_ is not None and id_ % 7 == 0 else label
            known[id_, label, tuple(math.floor(256 * v) for v in x)] = x
    rows, out = [(*k, v) for k, v in known.items()], collections.Counter()
    end = lambda n: max(-negatives.LONG, min(negatives.LONG, n))
    for id_, label, a, _ in rows:
        if id_ is None or id_ % 100:
            continue
        scored = sorted(((-end(sum(p * q for p, q in zip(a, b))), by_id(other), other, l) for other, l, b, _ in rows if other != id_ and len(b) == len(a)), key=lambda r: r[:2])
        for p, _, positive, _ in [r for r in scored if r[3] == label][:5]:
            inside = [r for r in scored if r[3] != label and 30 * -p <= 100 * -r[0] <= 90 * -p][:10]
            out.update((id_, positive, i + 1, r[2], -p, -r[0]) for i, r in enumerate(inside))
    return out


def test_hard_negatives(table, rows):
    want = mined(rows)
    assert len(want) > 300
    for size in (1 << 30, 20_000):
        got = negatives.mine(table, block_bytes=size, anchor_bytes=size // 10).collect()
        assert collections.Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got) == want
    assert negatives.mine(table.limit(0)).count() == 0


def test_best_scores():
    rng = random.Random(4)
    for n in (0, 3, 200):
        scores = np.array([rng.randrange(7) for _ in range(n)], np.int64)
        assert negatives._best(scores, np.arange(n) * 2, 10).tolist() == [2 * i for i in sorted(range(n), key=lambda i: (-scores[i], i))[:10]]
