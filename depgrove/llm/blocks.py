"""Vectors in blocks of bounded size, and every block of one table with every block of another, a task for each pair.

Each block of the one side is sent to all blocks of the other, so what is shuffled is bytes of blocks times blocks, and what a task holds is
two blocks whatever the tables' sizes; a block is dealt by a hash of id and vector, so no id, label or group of near vectors fills one.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null id within tasks: the last of all.
NO_ID = 2**63 - 1


def usable(vector: str) -> Column:
    """Not null, and all components are finite numbers."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(F.forall(vector, number), F.lit(False))


def named(vec_id: str) -> Column:
    """An id read back from a task, null for none."""
    return F.when(F.col(vec_id) != NO_ID, F.col(vec_id)).alias(vec_id)


def vectors(rows: DataFrame, *carried: Column) -> DataFrame:
    """id (NO_ID for null), x (array of double) and size of the usable rows, equal ones once."""
    read = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), *carried, F.col("embedding").cast("array<double>").alias("x"))
    read = read.where(usable("x"))
    return read.groupBy(*read.columns).agg(F.size("x").alias("size"))


def blocks_for(rows: DataFrame, block_bytes: int) -> int:
    return max(1, -(-(rows.agg(F.sum(F.size("embedding") * 8)).first()[0] or 0) // block_bytes))


def packed(rows: DataFrame, name: str, n: int, pack: Callable[[pa.Table], dict[str, np.ndarray]]) -> DataFrame:
    """size, the block's number (column `name`) and raw: what `pack` makes of a block's rows, as arrays by name."""

    def raw(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        np.savez(out, **pack(table.sort_by("id")))
        return pa.table([table["size"].slice(0, 1), table[name].slice(0, 1), pa.array([out.getvalue()], pa.binary())], ["size", name, "raw"])

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", "x"), F.lit(n)).cast("int"))
    return dealt.groupBy("size", name).applyInArrow(raw, f"size int, {name} int, raw binary")


def matrix(table: pa.Table) -> np.ndarray:
    flat = table["x"].combine_chunks().flatten().to_numpy()
    return np.ascontiguousarray(flat.reshape(table.num_rows, -1) if table.num_rows else flat.reshape(0, 0))


def met(left: DataFrame, n_left: int, right: DataFrame, n_right: int, task: Callable[[dict, dict], pa.Table], schema: str) -> DataFrame:
    """The rows that `task` makes of each block of left (size, a, raw) and each of right (size, b, raw) with vectors of one length."""

    def run(table: pa.Table) -> pa.Table:
        raw = dict(zip(table["side"].to_pylist(), table["raw"].to_pylist()))
        if len(raw) < 2:  # a hash left the other block empty
            return empty
        return task(*({k: v for k, v in np.load(io.BytesIO(raw[side])).items()} for side in ("left", "right")))

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    empty = pa.table({c.split()[0]: pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = left.select("size", "a", every(n_right).alias("b"), F.lit("left").alias("side"), "raw")
    sides = sides.unionByName(right.select("size", every(n_left).alias("a"), "b", F.lit("right").alias("side"), "raw"))
    return sides.groupBy("size", "a", "b").applyInArrow(run, schema)


def firsts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def within_runs(values: np.ndarray) -> np.ndarray:
    """The place of each value in its run, from 0."""
    at = firsts(values)
    return np.arange(len(values)) - np.repeat(at, np.diff(np.append(at, len(values))))
