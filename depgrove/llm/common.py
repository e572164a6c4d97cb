"""Small helpers that the operators share: where to write, fold columns, block numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def in_blocks(docs: DataFrame, block_bytes: int, carried: str | None = None) -> tuple[DataFrame, int]:
    """doc_id, text (null: empty) and block: a hash of id and text over enough blocks that each holds about block_bytes.

    Copies of a text have different ids, and rows without an id or with one id different texts, so no block is larger for a group of
    either, whatever its size; only rows equal in both, which repeat one document, share a block.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))), F.lit(n)).cast("int").alias("block"),
        *([carried] if carried else []),
    )
    return rows, int(n)


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """doc_id and label 0 or 1: of repeated rows the largest label counts; nulls are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(name).cast("int").alias("label"))
    )


def sampled_rows(docs: DataFrame, chosen: DataFrame, longest: int) -> DataFrame:
    """doc_id, the other columns of `chosen` (a bounded sample of labels) and text of the sampled documents: one row for each id, of several
    the smallest text; texts of more than `longest` bytes are no part of the sample, which so has a bound in bytes as well."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    return rows.join(F.broadcast(chosen), "doc_id").groupBy(*chosen.columns).agg(F.min("text").alias("text"))


def bounded_sample(labels: DataFrame, rows: int, salt: int) -> DataFrame:
    """At most so many labelled rows, those with the smallest hash of the id: the same ones in each run."""
    return labels.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(rows)
