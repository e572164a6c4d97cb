"""Quality rules: counted limits, then a logistic regression over hashed word and character n-grams with calibrated probabilities.

N-grams are single words, pairs of words and runs of four UTF-8 bytes; each kind has its own 2**16 slots, and a text's value in a
slot is the share of its n-grams of that kind that fall there, so that length alone moves no score. The weights are fitted on a
bounded sample of labelled rows (fit_rows) and calibrated on another (calibrate_rows), in one task; neither has rows of the held-out
fold.

Defined results: a null text has no words and so fails the limits; repeated documents are judged one by one; of several labels of one
id the largest counts; without labels every probability is 0.5, which is kept; an empty table gives an empty result; other columns
are ignored by `judge` and kept by `keep_clean`. The sample's shares are sent as 16-bit floats. Lines and windows are told apart by 64-bit hashes within one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, one_label, sampled_rows
from .features import base_counts
from .quality_classifier import _slices
from .text import Texts, whole_windows, windows

BITS = 16
SLOTS = 1 << BITS
KINDS = 3
#: The most labelled rows that are fitted and calibrated on, and bytes that a text among them may have.
FIT_ROWS, CALIBRATE_ROWS, FIT_BYTES = 4_000, 1_500, 1 << 16
#: A document with a lower probability of being good is rejected.
REJECT_BELOW = 0.3
#: Fixed values of the limits: words at least, and repeated words in a hundred words at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
SCALE = 30.0
TOGETHER = 60


def _grams(t: Texts, hashes: np.ndarray):
    """For each kind of n-gram: the text and the slot of each."""
    top = np.uint64(64 - BITS)
    yield t.doc, (hashes >> top).astype(np.int64)
    whole = np.flatnonzero(whole_windows(t.doc, 2))
    yield t.doc[whole], (windows(hashes, 2)[whole] >> top).astype(np.int64)
    n = len(t.data) - 3
    if n <= 0:
        yield np.zeros(0, np.int64), np.zeros(0, np.int64)
        return
    d = t.data.astype(np.uint32)
    code = d[:n] | (d[1 : n + 1] << np.uint32(8)) | (d[2 : n + 2] << np.uint32(16)) | (d[3:] << np.uint32(24))
    code *= np.uint32(2654435761)
    lengths = np.maximum(np.diff(t.bounds) - 3, 0)
    doc = np.repeat(np.arange(t.n), lengths)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(t.bounds[:-1], lengths)
    yield doc, (code[at] >> np.uint32(32 - BITS)).astype(np.int64)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def raw(self, t: Texts, hashes: np.ndarray) -> np.ndarray:
        out = np.full(t.n, self.bias)
        for kind, (doc, slot) in enumerate(_grams(t, hashes)):
            count = np.bincount(doc, minlength=t.n)
            out += SCALE * np.bincount(doc, self.weights[kind][slot], minlength=t.n) / np.maximum(count, 1)
        return out

    def probability(self, t: Texts, hashes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(t, hashes) + self.shift, -30, 30)))


def _sparse(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots (over all kinds) and values of each text."""
    parts = []
    for kind, (doc, slot) in enumerate(_grams(t, t.words())):
        key, count = np.unique(doc * SLOTS + slot, return_counts=True)
        of = key // SLOTS
        parts.append((of, key % SLOTS + kind * SLOTS, SCALE * count / np.maximum(np.bincount(doc, minlength=t.n), 1)[of]))
    doc, slot, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(doc, kind="stable")
    cuts = np.searchsorted(doc[order], np.arange(1, t.n))
    return list(zip(np.split(slot[order].astype(np.uint32), cuts), np.split(value[order].astype(np.float32), cuts)))


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 120, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam over all rows; a step goes through them a few hundred at a time, so that little more than the rows is in memory."""
    w, b = np.zeros(KINDS * SLOTS), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for step in range(1, steps + 1):
        g = np.append(decay * w, 0.0)
        for i in range(0, len(rows), TOGETHER):
            part = rows[i : i + TOGETHER]
            row = np.repeat(np.arange(len(part)), [len(s) for s, _ in part])
            slot, value = np.concatenate([s for s, _ in part]).astype(np.int64), np.concatenate([x for _, x in part]).astype(float)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[slot] * value, minlength=len(part)) + b, -30, 30)))
            r = weight[i : i + TOGETHER] * (p - y[i : i + TOGETHER])
            g[:-1] += np.bincount(slot, r[row] * value, minlength=len(w))
            g[-1] += r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log odds, by Newton's steps over smoothed targets."""
    if y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([raw, np.ones(len(raw))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
        beta = beta - np.clip(step, -1, 1)
    return float(max(beta[0], 0.05)), float(beta[1])


def model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, calibrate_rows: int = CALIBRATE_ROWS) -> Model:
    known = one_label(labels, "quality")
    part = fold("doc_id", 5)
    chosen = bounded_sample(known.where(part >= 2), fit_rows, 10).withColumn("fit", F.lit(True)).unionByName(
        bounded_sample(known.where(part == 1), calibrate_rows, 10).withColumn("fit", F.lit(False))
    )
    rows = sampled_rows(docs, chosen, FIT_BYTES)

    def work(batches):
        for batch in batches:
            for piece in _slices(batch):
                found = _sparse(Texts(piece.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("label"), piece.column("fit"), pa.array([s.tobytes() for s, _ in found], pa.binary()), pa.array([v.astype(np.float16).tobytes() for _, v in found], pa.binary())],
                    ["doc_id", "label", "fit", "slots", "vals"],
                )

    grams = rows.select("doc_id", "label", "fit", "text").mapInArrow(work, "doc_id long, label int, fit boolean, slots binary, vals binary")
    found = grams.groupBy().applyInArrow(_fitted, "weights binary, bias double, slope double, shift double").first()
    if found is None:
        return Model(np.zeros((KINDS, SLOTS)), 0.0)
    return Model(np.frombuffer(found.weights, np.float32).reshape(KINDS, SLOTS), found.bias, found.slope, found.shift)


def _fitted(found: pa.Table) -> pa.Table:
    """The weights, fitted and calibrated in one task on the sample, which is bounded in rows and bytes."""
    order = pc.sort_indices(found.select(["doc_id"]), [("doc_id", "ascending")]).to_numpy()  # one order, so one model
    view = lambda c, d: [np.frombuffer(x.as_buffer(), d) for x in found.column(c)]  # noqa: E731  of the table's own memory
    sparse = list(zip(view("slots", np.uint32), view("vals", np.float16)))
    sparse = [sparse[i] for i in order]
    fit, y = found.column("fit").to_numpy()[order], found.column("label").to_numpy().astype(float)[order]
    w, b, slope, shift = np.zeros(KINDS * SLOTS), 0.0, 1.0, 0.0
    if fit.any():
        w, b = _fit([x for x, f in zip(sparse, fit) if f], y[fit])
        if (~fit).any():
            raw = np.array([w[s.astype(np.int64)] @ v.astype(float) + b for (s, v), f in zip(sparse, fit) if not f])
            slope, shift = _calibrate(raw, y[~fit])
    columns = [pa.array([w.astype(np.float32).tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (b, slope, shift))]
    return pa.table(columns, ["weights", "bias", "slope", "shift"])


def _judged(text: pa.Array, found: Model) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    t = Texts(text)
    hashes = t.words()
    counts = base_counts(t, hashes)
    failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
    p = found.probability(t, hashes)
    return counts, failed, ~failed & (p >= REJECT_BELOW), p


def judge(docs: DataFrame, found: Model) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the probability of being good (score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(found)  # KINDS * SLOTS weights, whatever the input
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def work(batches):
        for batch in batches:
            for piece in _slices(batch):
                counts, failed, kept, p = _judged(piece.column("text"), sent.value)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *(pa.array(counts[n].astype(np.int64)) for n in names), pa.array(failed), pa.array(kept), pa.array(p)],
                    ["doc_id", *names, "base_failed", "kept", "score"],
                )

    return rows.mapInArrow(work, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, score double")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no limit and no verdict rejects, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model(docs, labels))

    def work(batches):
        for batch in batches:
            for piece in _slices(batch):
                yield piece.filter(pa.array(_judged(piece.column("text"), sent.value)[2]))

    return docs.mapInArrow(work, docs.schema)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
