"""Statistics of whole texts, for whole batches at once; the quality operators and their base rules use them."""

from __future__ import annotations

import numpy as np

from .text import Texts, per_text, repeated, whole_windows, windows

#: The bytes that count as symbols.
SYMBOLS = b"#*$%&|<>"
NAMES = (
    "log_words", "word_length", "upper", "title_words", "digits", "symbols", "bangs", "bars", "stops", "commas", "line_length",
    "dup_lines", "repeat_words", "repeat_five", "distinct_words", "wide", "markup", "spaces", "longest_word", "ends_stop",
)


def _flags(*values) -> np.ndarray:
    out = np.zeros(256, bool)
    for v in values:
        out[v if isinstance(v, slice) else list(v)] = True
    return out


IS = {
    "symbol": _flags(SYMBOLS), "upper": _flags(slice(65, 91)), "digit": _flags(slice(48, 58)), "bang": _flags(b"!?"), "bar": _flags(b"|"),
    "stop": _flags(b"."), "comma": _flags(b",;:"), "lead": ~_flags(slice(0x80, 0xC0)), "wide": _flags(slice(0xC0, 256)), "markup": _flags(b"<>{}=\\/_"),
}


def word_chars(t: Texts) -> np.ndarray:
    """Code points in words."""
    return t.count(IS["lead"][t.data]) - (np.diff(t.bounds) - _inside(t))


def _inside(t: Texts) -> np.ndarray:
    """Bytes in words."""
    return per_text(t.n, t.doc, t.end - t.start).astype(np.int64)


def duplicate_lines(t: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    doc, start, end, key = t.lines()
    order = np.lexsort((start, key, doc))
    d, k = doc[order], key[order]
    again = np.zeros(len(d), bool)
    again[1:] = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    return per_text(t.n, d[again])


def repeat_words(t: Texts, hashes: np.ndarray, k: int) -> np.ndarray:
    """Words in windows of k words that are found twice or more in the text, the first included."""
    n = len(hashes)
    if n < k:
        return np.zeros(t.n, np.int64)
    whole = np.flatnonzero(whole_windows(t.doc, k))
    hit = whole[repeated(t.doc[whole], windows(hashes, k)[whole])]
    covered = np.zeros(n, bool)
    for j in range(k):
        covered[hit + j] = True
    return per_text(t.n, t.doc[covered])


def distinct_words(t: Texts, hashes: np.ndarray) -> np.ndarray:
    """Told apart by 40 bits of their hashes; a batch has fewer than 2**24 texts."""
    if not len(hashes):
        return np.zeros(t.n, np.int64)
    found = np.sort((t.doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    first = np.ones(len(found), bool)
    first[1:] = found[1:] != found[:-1]
    return per_text(t.n, (found[first] >> np.uint64(40)).astype(np.int64))


def base_counts(t: Texts, hashes: np.ndarray) -> dict[str, np.ndarray]:
    return {
        "n_words": np.diff(t.word_bounds),
        "word_chars": word_chars(t),
        "n_symbols": t.count(IS["symbol"][t.data]),
        "n_dup_lines": duplicate_lines(t),
        "n_repeat_words": repeat_words(t, hashes, 3),
    }


def statistics(t: Texts) -> np.ndarray:
    """A row of NAMES for each text; an empty text has zeros."""
    hashes = t.words()
    n_words = np.diff(t.word_bounds)
    words, size = np.maximum(n_words, 1), np.maximum(np.diff(t.bounds), 1)
    line_doc, line_start, line_end, _ = t.lines()
    lines = np.maximum(per_text(t.n, line_doc), 1)
    count = lambda what: t.count(IS[what][t.data])
    longest = np.zeros(t.n)
    if len(t.start):
        longest[n_words > 0] = np.maximum.reduceat(np.minimum(t.end - t.start, 1000), t.word_bounds[:-1][n_words > 0])
    title = IS["upper"][t.data[t.start]] if len(t.start) else np.zeros(0, bool)
    stopped = IS["stop"][t.data[line_end - 1]] if len(line_end) else np.zeros(0, bool)
    columns = [
        np.log1p(n_words), _inside(t) / words, count("upper") / size, per_text(t.n, t.doc, title) / words, count("digit") / size,
        count("symbol") / size, count("bang") / words, count("bar") / words, count("stop") / words, count("comma") / words,
        np.log1p(n_words / lines), duplicate_lines(t) / lines, repeat_words(t, hashes, 3) / words, repeat_words(t, hashes, 5) / words,
        distinct_words(t, hashes) / words, count("wide") / size, count("markup") / size, (size - _inside(t)) / size, longest,
        per_text(t.n, line_doc, stopped) / lines,
    ]
    return np.where(n_words[:, None] > 0, np.stack(columns, 1), 0.0)
