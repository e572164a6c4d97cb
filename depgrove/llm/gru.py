"""A bidirectional gated recurrent network with attention pooling over words and their characters, trained and run in numpy.

A word enters as the vector of its hash's slot plus the mean vector of the slots of its runs of four and six bytes (its ends marked).
Windows of WINDOW words, each STRIDE words after the one before, are read in both directions; the states are pooled with softmax
weights, and the pooled state gives the window's log odds. A document counts as its highest window, in training as in use.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .text import Texts, mix

U = np.uint64
WINDOW, STRIDE = 64, 48
WORD_BITS, CHAR_BITS = 16, 16
E, H = 16, 8
LEAST_TEXTS = 5
#: Letters and digits in lower case; every other ASCII character parts words.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[48:58] = np.arange(48, 58)
LETTERS[97:123] = LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


class _Words(Texts):
    def __init__(self, column):
        super().__init__(column)
        self.data = LETTERS[self.data]


class Inputs:
    """The windows of some texts, their words as places in a table of distinct words, and each distinct word's slots."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        t = _Words(column)
        self.n = t.n
        key, first, self.word = np.unique(t.words(), return_index=True, return_inverse=True)
        self.word_slot = (key >> U(64 - WORD_BITS)).astype(np.int64)
        start, size = t.start[first], (t.end - t.start)[first]
        row = np.full(int((size + 2).sum()), 1, np.uint8)
        begin = np.cumsum(size + 2) - (size + 2)
        inside = np.repeat(begin + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        row[inside] = t.data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        of = np.repeat(np.arange(len(size)), size + 2)
        slots, owners = [], []
        wide = row.astype(U)
        for n in (4, 6):
            m = len(row) - n + 1
            if m <= 0:
                continue
            code = np.zeros(m, U)
            for j in range(n):
                code |= wide[j : j + m] << U(8 * j)
            ok = np.flatnonzero(of[:m] == of[n - 1 :])
            slots.append((mix(code[ok] + U(n)) >> U(64 - CHAR_BITS)).astype(np.int64))
            owners.append(of[ok])
        slot, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (slots, owners))
        order = np.argsort(owner, kind="stable")
        self.char_slot, self.char_word = slot[order], owner[order]
        self.char_count = np.bincount(self.char_word, minlength=len(size))
        words = np.diff(t.word_bounds)
        windows = np.where(words > 0, 1 + np.maximum(0, -(-(words - WINDOW) // STRIDE)), 0)
        self.doc = np.repeat(np.arange(t.n), windows)
        nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.at = t.word_bounds[:-1][self.doc] + nth * STRIDE
        self.size = np.minimum(WINDOW, t.word_bounds[1:][self.doc] - self.at)

    def vectors(self, p: dict) -> np.ndarray:
        out = p["word"][self.word_slot]
        chars = np.zeros_like(out)
        some = np.flatnonzero(self.char_count)
        if len(some):
            chars[some] = np.add.reduceat(p["char"][self.char_slot], (np.cumsum(self.char_count) - self.char_count)[some], axis=0) / self.char_count[some, None]
        return out + chars

    def steps(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For some windows: word places (step, window) and which steps there are."""
        size, at = self.size[windows], self.at[windows]
        step = np.arange(int(size.max()))[:, None]
        there = step < size
        return self.word[np.where(there, at + step, at)], there


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def start(seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    some = lambda *s, by=0.3: (by * rng.normal(size=s)).astype(np.float32)
    return {"word": some(1 << WORD_BITS, E, by=0.05), "char": some(1 << CHAR_BITS, E, by=0.05), "x": some(2, E, 3 * H), "h": some(2, H, 3 * H), "b": np.zeros((2, 3 * H), np.float32), "pool": some(2 * H), "out": some(2 * H, by=0.5), "bias": np.zeros(1, np.float32)}


def _direction(p: dict, d: int, table: np.ndarray, words: np.ndarray, there: np.ndarray, keep: bool):
    steps, n = words.shape
    h, out, tape = np.zeros((n, H), np.float32), np.empty((steps, n, H), np.float32), []
    weights = p["h"][d]
    whole = there.all(1)
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        x, u = table[words[t]], h @ weights
        gates = _sigmoid(x[:, : 2 * H] + u[:, : 2 * H])
        z, r = gates[:, :H], gates[:, H:]
        new = 2 * _sigmoid(2 * (x[:, 2 * H :] + r * u[:, 2 * H :])) - 1
        after = new + z * (h - new)
        if not whole[t]:
            after = np.where(there[t][:, None], after, h)
        if keep:
            tape.append((t, h, z, r, new, u[:, 2 * H :]))
        h = after
        out[t] = h
    return out, tape


def forward(p: dict, inputs: Inputs, tables: list[np.ndarray], windows: np.ndarray, keep: bool = False):
    """The log odds of the windows."""
    words, there = inputs.steps(windows)
    both = [_direction(p, d, tables[d], words, there, keep) for d in (0, 1)]
    states = np.concatenate([both[0][0], both[1][0]], 2)
    weight = np.where(there, states @ p["pool"], -np.inf)
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = (weight[:, :, None] * states).sum(0)
    logit = pooled @ p["out"] + p["bias"][0]
    return logit, (words, there, both[0][1], both[1][1], states, weight, pooled) if keep else None


def tables(p: dict, vectors: np.ndarray) -> list[np.ndarray]:
    return [vectors @ p["x"][d] + p["b"][d] for d in (0, 1)]


def highest(p: dict, inputs: Inputs, most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """For each text its highest window's log odds (without words: -inf), and the window."""
    best, which = np.full(inputs.n, -np.inf), np.full(inputs.n, -1)
    if not len(inputs.doc):
        return best, which
    own = tables(p, inputs.vectors(p))
    logit = np.empty(len(inputs.doc))
    order = np.argsort(inputs.size, kind="stable")
    for i in range(0, len(order), most):
        logit[order[i : i + most]] = forward(p, inputs, own, order[i : i + most])[0]
    order = np.lexsort((-logit, inputs.doc))
    first = np.flatnonzero(np.concatenate([[True], np.diff(inputs.doc[order]) > 0]))
    which[inputs.doc[order][first]] = order[first]
    best[inputs.doc[order][first]] = logit[order][first]
    return best, which


def _rows_added(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
        out[at[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def gradients(p: dict, inputs: Inputs, windows: np.ndarray, y: np.ndarray, weight_of: np.ndarray) -> dict:
    vectors = inputs.vectors(p)
    own = tables(p, vectors)
    logit, (words, there, *tapes, states, weight, pooled) = forward(p, inputs, own, windows, keep=True)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dlogit = ((_sigmoid(logit) - y) * weight_of).astype(np.float32)
    g["bias"][0], g["out"] = dlogit.sum(), pooled.T @ dlogit
    dpooled = dlogit[:, None] * p["out"]
    dstates = weight[:, :, None] * dpooled
    dweight = (states * dpooled).sum(2)
    dscore = weight * (dweight - (weight * dweight).sum(0))
    dstates += dscore[:, :, None] * p["pool"]
    g["pool"] = np.einsum("tbk,tb->k", states, dscore)
    dvectors = np.zeros_like(vectors)
    for d in (0, 1):
        dh, moves = np.zeros((len(windows), H), np.float32), np.zeros((*words.shape, 3 * H), np.float32)
        for t, h, z, r, new, un in reversed(tapes[d]):
            dh = dh + dstates[t, :, d * H : (d + 1) * H]
            on = there[t][:, None]
            do = np.where(on, dh, 0)
            dnew = do * (1 - z) * (1 - new * new)
            dz = do * (h - new) * z * (1 - z)
            dr = dnew * un * r * (1 - r)
            du = np.concatenate([dz, dr, dnew * r], 1)
            moves[t] = np.concatenate([dz, dr, dnew], 1)
            g["h"][d] += h.T @ du
            dh = np.where(on, do * z + du @ p["h"][d].T, dh)
        dtable = _rows_added(len(vectors), words.ravel(), moves.reshape(-1, 3 * H))
        g["b"][d] = dtable.sum(0)
        g["x"][d] = vectors.T @ dtable
        dvectors += dtable @ p["x"][d].T
    used = np.flatnonzero(np.abs(dvectors).sum(1))
    g["word"] = _rows_added(1 << WORD_BITS, inputs.word_slot[used], dvectors[used])
    hit = np.isin(inputs.char_word, used)
    of = inputs.char_word[hit]
    g["char"] = _rows_added(1 << CHAR_BITS, inputs.char_slot[hit], dvectors[of] / inputs.char_count[of, None])
    return g


def _held(inputs: Inputs, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and for characters: how many texts of label 1, and how many in all, hold each slot."""
    text = np.repeat(inputs.doc, inputs.size)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(inputs.size) - inputs.size, inputs.size)
    word = inputs.word[np.repeat(inputs.at, inputs.size) + nth]
    pair = np.unique(text * len(inputs.word_slot) + word)
    text, word = pair // max(1, len(inputs.word_slot)), pair % max(1, len(inputs.word_slot))
    begin = np.cumsum(inputs.char_count) - inputs.char_count
    count = inputs.char_count[word]
    char = inputs.char_slot[np.repeat(begin[word] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    out = []
    for slot, of, bits in ((inputs.word_slot[word], text, WORD_BITS), (char, np.repeat(text, count), CHAR_BITS)):
        pair = np.unique(of << bits | slot)
        at = pair & ((1 << bits) - 1)
        out.append((np.bincount(at, y[pair >> bits], minlength=1 << bits), np.bincount(at, minlength=1 << bits)))
    return out


def _log_odds(texts: pa.Array, y: np.ndarray, together: int = 256) -> list[np.ndarray]:
    """Of each slot: by how much more of the texts of label 1 than of label 0 hold it, as a log."""
    sums = [[np.zeros(1 << bits), np.zeros(1 << bits)] for bits in (WORD_BITS, CHAR_BITS)]
    for i in range(0, len(y), together):
        for total, new in zip(sums, _held(Inputs(texts.slice(i, together)), y[i : i + together])):
            total[0] += new[0]
            total[1] += new[1]
    n1, n0 = y.sum() + 4, (1 - y).sum() + 4
    odds = [np.clip(np.log((one + 2) / n1 / ((all_ - one + 2) / n0)), -3, 3) for one, all_ in sums]
    # a slot of few texts only knows their own labels
    return [np.where(all_ >= LEAST_TEXTS, x, 0).astype(np.float32) for x, (_, all_) in zip(odds, sums)]


def train(texts: pa.Array, y: np.ndarray, steps: int = 200, together: int = 64, rate: float = 0.01) -> dict:
    """Adam over at least so many batches, in whole rounds of a fixed order. The first two places of a slot's vector begin at its log odds."""
    p = start()
    if not len(y) or y.min() == y.max():
        return p | {"bias": np.array([0.0 if not len(y) else (2.0 if y.max() else -2.0)], np.float32), "out": np.zeros_like(p["out"])}
    p["word"][:, 0], p["char"][:, 1] = _log_odds(texts, y)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    rng = np.random.default_rng(8)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    while step < steps:
        order = rng.permutation(len(y))
        for i in range(0, len(order), together):
            part = np.sort(order[i : i + together])
            inputs = Inputs(texts.take(pa.array(part)))
            _, which = highest(p, inputs)
            some = np.flatnonzero(which >= 0)
            step += 1
            if not len(some):
                continue
            g = gradients(p, inputs, which[some], y[part][some], weight[part][some] / len(some))
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return p
