"""Arrays of numbers as NumPy matrices, for functions over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of whole numbers with 0 for nulls, and where it is not null."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def matrix(lists: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n numbers of each array as a line, and which of them are there."""
    values, there = numbers(lists.values)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    inside = np.arange(n) < sizes[:, None]
    at = np.where(inside, lists.offsets.to_numpy()[:-1, None] + np.arange(n), 0)
    return (values[at], inside & there[at]) if len(values) else (np.zeros(inside.shape, np.int64), inside)


def lists(lines: np.ndarray, kind: pa.DataType, none: np.ndarray | None = None, empty: np.ndarray | None = None) -> pa.ListArray:
    """Lines of a matrix as arrays; those of none are null, those of empty have nothing but nulls."""
    n = lines.shape[1]
    values = pa.array(lines.ravel(), mask=None if empty is None else np.repeat(empty, n)).cast(kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1) * n, pa.int32()), values, mask=None if none is None else pa.array(none))
