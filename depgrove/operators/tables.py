"""Where tables between the steps of an iteration are written."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:  # only where none is named, as in tests
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the folder that spark.checkpoint.dir names: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, dict[str, int]]:
    """The same, with the number of rows (n) and further aggregates, taken while they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()]), name)
    return out, {k: v or 0 for k, v in seen.get.items()}


def unsent(rows: DataFrame) -> DataFrame:
    """Rows as the side of a join that stays where it is shuffled to: by the size of its files, which keep keys in a fraction of their memory, a large table
    may count as small enough to be sent to all tasks, through the driver."""
    return rows.hint("merge")


def buckets(spark) -> int:
    """As many buckets as a shuffle has partitions: what a shuffle brings together then lies as the buckets do."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Bucketed(NamedTuple):
    """A table bucketed by a key: to be joined by the key without a shuffle (`by_key`), and the same rows without that layout (`plain`). Unions
    are of plain ones: a union of bucketed tables counts as laid out by their key, which its partitions are not."""

    by_key: DataFrame
    plain: DataFrame


def bucketed(df: DataFrame, key: str | list[str], name: str, n: int, path: str | None = None, table: str | None = None, by: str | None = None) -> Bucketed:
    """The rows as a table bucketed and sorted by a key, or several, in the shared folder; with `by` bucketed by that one of them only. The catalog of the session
    has it under a name of its own, or under `table`."""
    spark = df.sparkSession
    table = table or f"{name}_{uuid.uuid4().hex}"
    path = path or f"{shared_folder(spark)}/{table}"
    keys = [key] if isinstance(key, str) else key
    df.write.bucketBy(n, *([by] if by else keys)).sortBy(*keys).mode("overwrite").option("path", path).saveAsTable(table)
    by_key = spark.table(table)
    return Bucketed(by_key, spark.read.schema(by_key.schema).parquet(path))


def placed_buckets(spark, schema, path: str, key: str, n: int) -> DataFrame:
    """A folder that `bucketed` wrote, as a table of this session."""
    table = f"placed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def counted_buckets(df: DataFrame, key: str | list[str], name: str, n: int, by: str | None = None, **counts) -> tuple[Bucketed, dict[str, int]]:
    seen = Observation()
    out = bucketed(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()]), key, name, n, by=by)
    return out, {k: v or 0 for k, v in seen.get.items()}
