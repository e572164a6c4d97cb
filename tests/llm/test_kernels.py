"""The numpy parts against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from depgrove.llm import boosting, features, gru, packing, quality_rules
from depgrove.llm.hnsw import Graph
from depgrove.llm.pieces import Pieces
from depgrove.llm.text import Texts

AWKWARD = ["", None, " ", "a", "a b c a b c", "x\n\ny z\nx\n x\n", "é ñ o  #*$ |a|\x0b\x0cb", "w " * 60, "\n\n", "a\x85b c\xa0d"]


def drawn(seed, n, alphabet, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_base_counts():
    texts = AWKWARD + drawn(1, 60, "ab \n\té#x", 80)
    t = Texts(pa.array(texts))
    found = features.base_counts(t, t.words())
    for i, x in enumerate(texts):
        x = x or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        seen, again = set(), 0
        for line in x.split("\n"):
            again += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
            seen.add(line)
        runs, covered = Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2)), set()
        for j in range(len(words) - 2):
            if runs[tuple(words[j : j + 3])] > 1:
                covered |= {j, j + 1, j + 2}
        want = (len(words), sum(map(len, words)), sum(x.count(s) for s in "#*$%&|<>"), again, len(covered))
        assert tuple(int(found[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, x
    assert np.isfinite(features.statistics(t)).all()


def test_one_very_long_text():
    t = Texts(pa.array(["ab " * 700_000 + "x" * 2_000_000 + " end"]))
    h = t.words()
    assert len(h) == 700_002 and len(np.unique(h)) == 3


def test_pieces_against_the_library():
    p = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", " a", "  a  ", "▁"] + drawn(2, 800, " \n\t▁aetho,.é😀ｚ中文\x00\x07<0x1>'ß", 60)
    for x, (n, ids, text, agrees) in zip(texts, p.encode_batch(texts)):
        real = p.library.encode(x)
        assert (n, ids, text, agrees) == (len(real), ",".join(map(str, real)), p.library.decode(real), True), x
        assert p.decode(real) == text


def test_packing_against_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["", " "] + drawn(3, 600, [" ", "\n", "\t", "a", "th", "e", ",", "é", "😀", "'s", "中", "\x1c", "\xa0", "İ", "ß", "́", "<|endoftext|>", "12"], 60)
    shard = packing.Shard(pa.array(texts), path, packing.Corpus(np.zeros(0, int), np.zeros(0, int), len(texts), 1000))
    for i, x in enumerate(texts):
        assert shard.ids[shard.bounds[i] : shard.bounds[i + 1]].tolist() == library.encode(x, add_special_tokens=False).ids + [2], x
    pieces = {}
    for sequence in shard.sequences():
        size = sum(n for _, _, n in sequence)
        assert size <= 4096 and size & (size - 1) == 0
        for d, start, n in sequence:
            pieces.setdefault(d, []).append((start, n))
    for i in range(len(texts)):
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at and n > 0
            at += n
        assert at == shard.bounds[i + 1] - shard.bounds[i]


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > -0.2)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert (boosting.fit(x[:0], y[:0]).score(x[:3]) == 0.5).all()


def test_calibration_moves_odds():
    raw = np.linspace(-3, 3, 400)
    y = (raw > 1).astype(float)
    slope, shift = quality_rules._calibrate(raw, y)
    assert slope > 0 and abs(-shift / slope - 1) < 0.2


def test_gradients():
    inputs = gru.Inputs(pa.array(["a b c idiot x y", "the cat sat on", "zz yy xx", "b c"], pa.large_string()))
    p = {k: v.astype(float) for k, v in gru.start().items()}
    y = np.array([1.0, 0, 1, 0])

    def loss(q):
        logit, _ = gru.forward(q, inputs, gru.tables(q, inputs.vectors(q)), np.arange(4))
        return (np.log1p(np.exp(-logit)) * y + np.log1p(np.exp(logit)) * (1 - y)).sum()

    g = gru.gradients(p, inputs, np.arange(4), y, np.ones(4))
    rng = np.random.default_rng(0)
    for k in p:
        for i in rng.choice(np.flatnonzero(np.abs(g[k].ravel()) > 1e-4), 2):
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k].ravel()[i] += 1e-3
            down[k].ravel()[i] -= 1e-3
            assert abs((loss(up) - loss(down)) / 2e-3 - g[k].ravel()[i]) < 2e-3, k


def test_windows_overlap_and_cover():
    inputs = gru.Inputs(pa.array([" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 64, 65, 200)], pa.large_string()))
    for d, n in ((1, 1), (2, 64), (3, 65), (4, 200)):
        at = [(a - inputs.at[inputs.doc == d][0], s) for a, s in zip(inputs.at[inputs.doc == d], inputs.size[inputs.doc == d])]
        assert set().union(*[range(a, a + s) for a, s in at]) == set(range(n))
    assert (inputs.doc != 0).all()


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[1000:] = x[rng.integers(0, 1000, 500)] + 0.1 * rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x.astype(np.float32))
    found, _ = graph.within(graph.x, 0.9, 64)
    truth = np.argwhere(graph.x @ graph.x.T >= 0.9)
    have = {tuple(p) for p in found.tolist()}
    assert sum(tuple(p) in have for p in truth.tolist()) >= 0.97 * len(truth)
