"""Words, lines and their hashes for whole Arrow batches of texts, in numpy.

A word is a longest run of bytes other than space, tab, newline, vertical tab, form feed and carriage return. Hashes are 64-bit
polynomials over random byte values, computed from running sums, then mixed; a second seed gives another 64 bits.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = 1 << 18


@functools.cache
def _tables(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, powers of an odd number and of its inverse modulo 2**64."""
    rng = np.random.default_rng(seed + 20240)
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    base = int(rng.integers(2**62, 2**63)) * 8 + 5 & (2**64 - 1)
    inverse = pow(base, -1, 2**64)
    powers = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)]), dtype=U) for b in (base, inverse)]
    return values, *powers


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of data[start:end] for each span; the spans are in order and do not overlap. Memory for about STEP bytes at a time."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        first = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, first + STEP, "right")))
        last = int(end[j - 1])
        n = STEP if last - first <= STEP else last - first
        values, powers, inverses = _tables(seed, n) if n == STEP else _tables.__wrapped__(seed, n)
        run = np.empty(last - first + 1, U)
        run[0] = 0
        np.cumsum(values[data[first:last]] * powers[: last - first], out=run[1:])
        a, b = start[i:j] - first, end[i:j] - first
        out[i:j] = (run[b] - run[a]) * inverses[np.minimum(a, n - 1)] + (b - a).astype(U) * U(0x9E3779B97F4A7C15)
        i = j
    return mix(out)


class Texts:
    """The texts of a batch: their bytes, the place of each text and of each word."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
        column = column.cast(pa.large_string()).fill_null("")
        self.n = len(column)
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        buffer = column.buffers()[2] if self.n else None
        whole = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
        self.data = whole[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]

    @functools.cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = ~SPACE[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = self.bounds[1:-1]
        edge = edge[(edge > 0) & (edge < len(self.data))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    @property
    def start(self) -> np.ndarray:
        return self._words[0]

    @property
    def end(self) -> np.ndarray:
        return self._words[1]

    @functools.cached_property
    def word_bounds(self) -> np.ndarray:
        """The words of text i are word_bounds[i]:word_bounds[i + 1]."""
        return np.searchsorted(self.start, self.bounds)

    @functools.cached_property
    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(self.n), np.diff(self.word_bounds))

    def words(self, seed: int = 0) -> np.ndarray:
        return span_hash(self.data, self.start, self.end, seed)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """For each text, how many of its bytes have the flag."""
        return np.diff(np.searchsorted(np.flatnonzero(flags), self.bounds))

    def lines(self, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lines between newlines that hold a word: text, start, end, hash."""
        cut = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.bounds[:-1], cut + 1]))
        start = start[np.diff(start, prepend=-1) > 0]
        start = start[start < len(self.data)]
        cut = np.append(cut, len(self.data))
        end = np.minimum(cut[np.searchsorted(cut, start)], self.bounds[np.searchsorted(self.bounds, start, "right")])
        held = np.searchsorted(self.start, end) > np.searchsorted(self.start, start)
        start, end = start[held], end[held]
        doc = np.searchsorted(self.bounds, start, "right") - 1
        return doc, start, end, span_hash(self.data, start, end, seed)


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k successive words; the last k - 1 words begin none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    factor = mix(np.arange(1, k + 1, dtype=U) + U(1000 * (seed + 1))) | U(1)
    out = hashes[:n] * factor[0]
    for j in range(1, k):
        out += hashes[j : j + n] * factor[j]
    return mix(out)


def whole_windows(doc: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows of k words lie in one text."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def repeated(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more in their own text."""
    if not len(key):
        return np.zeros(0, bool)
    mixed = mix(key + doc.astype(U) * U(0x9E3779B97F4A7C15))
    found = np.sort(mixed)
    again = found[1:][found[1:] == found[:-1]]
    if not len(again):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(again, mixed), len(again) - 1)
    return again[at] == mixed


def per_text(n: int, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, minlength=n)
