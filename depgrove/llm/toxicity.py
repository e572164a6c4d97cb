"""Toxicity scores: the recurrent network of gru over all overlapping windows of whole texts, the highest window counting.

The network is trained on bounded samples of labelled rows of each label (fit_rows each), and its log odds are calibrated on another
sample; none has rows of the held-out fold. Its weights, of a fixed size, go with the scoring tasks.

Defined results: a null text counts as empty; a text without words has the score 0; repeated rows are scored one by one; of several
labels of one id the largest counts; without labels, or with labels of one kind only, all texts with words have one score; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import bounded_sample, fold, one_label, sampled_rows
from .quality_classifier import _slices
from .quality_rules import _calibrate

#: The most rows of each label that the network is trained on, rows it is calibrated on, and bytes that a text among them may have.
FIT_ROWS, CALIBRATE_ROWS, FIT_BYTES = 3_000, 1_500, 1 << 15
#: A score from here on counts as toxic.
TOXIC = 0.7


class Model:
    def __init__(self, weights: dict, slope: float, shift: float):
        self.weights, self.slope, self.shift = weights, slope, shift

    def score(self, texts: pa.Array) -> np.ndarray:
        logit, _ = gru.highest(self.weights, gru.Inputs(texts))
        return np.where(np.isfinite(logit), 1 / (1 + np.exp(-np.clip(self.slope * np.where(np.isfinite(logit), logit, 0) + self.shift, -30, 30))), 0.0)


def model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, calibrate_rows: int = CALIBRATE_ROWS) -> Model:
    known = one_label(labels, "toxic").where(fold("doc_id", 3) != 1)
    later = F.pmod(F.xxhash64("doc_id", F.lit(90)), F.lit(4)) == 0
    chosen = bounded_sample(known.where(~later & (F.col("label") == 1)), fit_rows, 9).withColumn("fit", F.lit(True))
    chosen = chosen.unionByName(bounded_sample(known.where(~later & (F.col("label") == 0)), fit_rows, 9).withColumn("fit", F.lit(True)))
    chosen = chosen.unionByName(bounded_sample(known.where(later), calibrate_rows, 9).withColumn("fit", F.lit(False)))
    rows = sampled_rows(docs, chosen, FIT_BYTES)
    found = rows.select("doc_id", "label", "fit", "text").toPandas().sort_values(["doc_id", "text"])
    fit, y = found["fit"].to_numpy(bool), found["label"].to_numpy(float)
    text = pa.array(found["text"].tolist(), pa.large_string())
    weights = gru.train(text.filter(pa.array(fit)), y[fit])
    slope, shift = 1.0, 0.0
    if (~fit).any():
        logit, _ = gru.highest(weights, gru.Inputs(text.filter(pa.array(~fit))))
        some = np.isfinite(logit)
        if some.any():
            slope, shift = _calibrate(logit[some], y[~fit][some])
    return Model(weights, slope, shift)


def score(docs: DataFrame, found: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(found)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 3) == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def work(batches):
        for batch in batches:
            for part in _slices(batch):
                p = sent.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= TOXIC).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
