"""Small numpy helpers for Arrow list columns: flat values plus row lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def flat_list(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows in a row, length of each row) of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False), lengths


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    values, lengths = flat_list(column, dtype)
    if len(lengths) == 0:
        return np.empty((0, 0), dtype)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths in one column")
    return values.reshape(len(lengths), -1)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else lengths


def list_array(values: np.ndarray, lengths: np.ndarray, type_: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, type_))


def sum_rows(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum over each row's values; 0 for an empty row. Works on 1-d and 2-d values."""
    out = np.zeros((len(lengths), *values.shape[1:]), values.dtype)
    filled = lengths > 0
    if filled.any():
        out[filled] = np.add.reduceat(values, starts_of(lengths)[filled], axis=0)
    return out


def take_rows(
    values: np.ndarray, lengths: np.ndarray, index: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``index`` of a ragged table, again as (values, lengths)."""
    picked = lengths[index]
    first = np.repeat(starts_of(lengths)[index] - starts_of(picked), picked)
    return values[first + np.arange(len(first))], picked


def normalised(m: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    if m.size == 0:
        return m
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), floor)
