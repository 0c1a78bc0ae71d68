"""Array columns of Arrow batches as stacks of rows of like lengths, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows worked on at a time, so that what a worker holds doesn't follow the size of Arrow's batches.
ROWS = 1024


def in_slices(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), rows or ROWS):
            yield batch.slice(k, rows or ROWS)


def lengths(column: pa.Array) -> np.ndarray:
    """Of each row's array; -1 for null."""
    return column.value_lengths().fill_null(-1).to_numpy()


def stack(column: pa.Array, rows: np.ndarray, n: int) -> np.ndarray:
    """The arrays of these rows, of n numbers each, as doubles [row, place]; null numbers are NaN."""
    at = column.offsets.to_numpy()
    values = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values[(at[rows] - at[0])[:, None] + np.arange(n)]


def lists(count: int, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """A column of ``count`` rows from pairs of row numbers and their stacks; null for the other rows."""
    sizes = np.full(count, -1, dtype=np.int64)
    for rows, out in found:
        sizes[rows] = out.shape[1]
    at = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
    flat = np.empty(at[-1])
    for rows, out in found:
        flat[at[rows][:, None] + np.arange(out.shape[1])] = out
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat), mask=pa.array(sizes < 0))
