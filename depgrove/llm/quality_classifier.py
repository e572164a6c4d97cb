"""Quality classifier: gradient-boosted trees over statistics of whole texts.

The trees are fitted on a bounded sample of labelled rows (fit_rows), of which only the statistics reach the driver; the flat arrays
of the fitted trees then go with the scoring tasks, a few hundred KB whatever the input.

Defined results: a null text counts as empty and is scored as such; repeated documents are scored one by one; of several labels of
one id the largest counts, and labels that are null or not 0 or 1 are left out; with no labels every score is 0.5; an empty table
gives an empty result; other columns are ignored by `score` and kept by `keep_good`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import bounded_sample, fold, one_label, sampled_rows
from .features import NAMES, statistics
from .text import Texts

#: The most labelled rows that are fitted on, and bytes that a text among them may have.
FIT_ROWS, FIT_BYTES = 20_000, 1 << 18
#: A score from here on counts as good.
GOOD = 0.3


def _slices(batch: pa.RecordBatch, most: int = 1 << 20):
    """The batch in parts of about so many bytes of text."""
    size = batch.column("text").nbytes
    rows = max(1, batch.num_rows * most // max(1, size)) if batch.num_rows else 1
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> boosting.Trees:
    """Fitted on labelled rows outside the held-out fold (remainder 0 of 5)."""
    chosen = bounded_sample(one_label(labels, "quality").where(fold("doc_id", 5) != 0), fit_rows, 5)
    rows = sampled_rows(docs, chosen, FIT_BYTES)

    def work(batches):
        for batch in batches:
            for part in _slices(batch):
                x = statistics(Texts(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *(pa.array(c) for c in x.T)], ["doc_id", "label", *NAMES])

    found = rows.select("doc_id", "label", "text").mapInArrow(work, "doc_id long, label int, " + ", ".join(f"{n} double" for n in NAMES)).toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")  # one order, so one model
    x = np.stack([found.column(n).to_numpy() for n in NAMES], 1)
    return boosting.fit(x[order], found.column("label").to_numpy().astype(float)[order])


def score(docs: DataFrame, trees: boosting.Trees) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 5) == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def work(batches):
        for batch in batches:
            for part in _slices(batch):
                p = trees.score(statistics(Texts(part.column("text"))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= GOOD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that count as good, with all their columns."""
    trees, schema = model(docs, labels, fit_rows), docs.schema

    def work(batches):
        for batch in batches:
            for part in _slices(batch):
                yield part.filter(pa.array(trees.score(statistics(Texts(part.column("text")))) >= GOOD))

    return docs.mapInArrow(work, schema)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
