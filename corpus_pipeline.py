"""The corpus pipeline: quality, near duplicates, repeated passages, packing.

Defined results of all stages: the columns of documents stay, whatever their names, and may be null; an empty table gives an empty result;
rows with one id are rows of their own until the near duplicates are taken out. Each stage's own cases are with its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depgrove.llm import jaccard_join, packing, quality_classifier, quality_rules, substring_dedup
from depgrove.llm.common import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the boosted trees count as good. A null or empty text is scored as an empty one; without labels all have the score
    0.5 and stay."""
    return quality_classifier.keep_good(docs, _labels(spark, sf_dir))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of those, the documents that pass the limits and the calibrated regression. A null or empty text, and one of fewer than 50 words, goes."""
    return quality_rules.keep_clean(docs, _labels(spark, sf_dir))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id (null last), of equal ids the text with the smallest hash, of equal rows one.
    A text without words is like no other."""
    return jaccard_join.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of 20 words or more that an earlier document (a smaller id, null first) or place has. A text of fewer words keeps
    all; words are joined by one space."""
    return substring_dedup.remove(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids, a row per piece. An empty text gives the end id alone; ties between neighbours follow the shard's order."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good),
    ("quality_rules", clean),
    ("jaccard_join", single),
    ("substring_dedup", unrepeated),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
