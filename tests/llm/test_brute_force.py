"""The fitted models' scores against walks that take one text, tree, word and step at a time."""

import math
import random

import numpy as np
import pyarrow as pa

from depgrove.llm import boosting, gru, quality_rules
from depgrove.llm.text import Texts

RNG = random.Random(21)
TEXTS = [" ".join(RNG.choices(["Grain", "mill,", "stone", "a", "überall", "x9", "flour-bag", "!"], k=RNG.choice([0, 1, 3, 40, 150]))) for _ in range(30)] + ["", "!!!", "abc" * 200]


def test_trees_walked_one_by_one():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    x[:50] = np.round(x[:50])  # ties at the cuts
    trees = boosting.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), trees=12)
    for row, score in zip(x, trees.score(x)):
        total = trees.base
        for f, cut, value in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > cut[node] else 1)
            total += value[node - len(f)]
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_recurrent_network_stepped_one_by_one():
    p = gru.start(7)
    inputs = gru.Inputs(pa.array(TEXTS))
    logit, which = gru.highest(p, inputs)
    vectors = inputs.vectors(p).astype(float)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def window(at, size):
        states = []
        for d in (0, 1):
            h, out = np.zeros(gru.H), {}
            for k in range(size) if d == 0 else reversed(range(size)):
                x = vectors[inputs.word[at + k]] @ p["x"][d] + p["b"][d]
                u = h @ p["h"][d]
                z, r = sigmoid(x[: gru.H] + u[: gru.H]), sigmoid(x[gru.H : 2 * gru.H] + u[gru.H : 2 * gru.H])
                new = np.tanh(x[2 * gru.H :] + r * u[2 * gru.H :])
                h = (1 - z) * new + z * h
                out[k] = h
            states.append(np.stack([out[k] for k in range(size)]))
        states = np.concatenate(states, 1)
        weight = np.exp(states @ p["pool"])
        return float((weight / weight.sum()) @ states @ p["out"] + p["bias"][0])

    seen = {}
    for doc, at, size in zip(inputs.doc.tolist(), inputs.at.tolist(), inputs.size.tolist()):
        seen.setdefault(doc, []).append(window(at, size))
    for i in range(len(TEXTS)):
        if i in seen:
            assert abs(logit[i] - max(seen[i])) < 1e-3
        else:
            assert logit[i] == -np.inf
    assert max(map(len, seen.values())) > 2


def test_regression_summed_one_gram_at_a_time():
    rng = np.random.default_rng(2)
    model = quality_rules.Model(0.02 * rng.normal(size=(quality_rules.KINDS, quality_rules.SLOTS)), 0.3, 1.4, -0.2)
    t = Texts(pa.array(TEXTS))
    got = model.probability(t, t.words())
    for i, text in enumerate(TEXTS):
        one = Texts(pa.array([text]))
        raw = 0.3
        for kind, (_, slots) in enumerate(quality_rules._grams(one, one.words())):
            total = sum(float(model.weights[kind][s]) for s in slots.tolist())
            raw += quality_rules.SCALE * total / max(1, len(slots))
        words, data = text.split(), text.encode()
        assert [len(s) for _, s in quality_rules._grams(one, one.words())] == [len(words), max(0, len(words) - 1), max(0, len(data) - 3)]
        assert math.isclose(got[i], 1 / (1 + math.exp(-(1.4 * raw - 0.2))), rel_tol=1e-5)
