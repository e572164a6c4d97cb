"""Questions that blocks of documents put to the whole corpus, packed.

A block sends its sorted distinct 64-bit keys, with what belongs to each, as one row for each range of keys; a range's rows from all
blocks meet in one task, which answers each block in the order it asked. No key is a group of its own: a key that all documents hold
is sent once by each block. The number of ranges follows the size of the input, so a range's rows stay about as large as a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64


def ranges(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted keys; empty ranges are left out."""
    if not len(keys):
        return []
    of = ((keys >> U(32)) * U(n)) >> U(32)
    at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    return list(zip(of[at].astype(int).tolist(), at.tolist(), [*at[1:].tolist(), len(keys)]))


def rows(found: list[list], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*found)) if found else [[] for _ in names]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All rows' packed values in a row, and how many each row has."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], np.int64)


def in_order(table: pa.Table, dtype, column: str = "answer") -> np.ndarray:
    """A block's answers from all ranges, in the order of its keys."""
    if not table.num_rows:
        return np.zeros(0, dtype)
    return joined(table.sort_by("range").column(column), dtype)[0]
