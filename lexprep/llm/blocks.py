"""Blocks of texts with a dictionary each: the strings of a block as codes into its distinct strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def dictionary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct byte strings in order of first place) of the ranges data[starts[i]:ends[i]], which come in
    order, do not overlap and are not empty. Exact: Arrow compares the bytes, not a hash."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    kept = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)])
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    found = column.dictionary_encode()
    return np.asarray(found.indices), found.dictionary


def joined(values: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(values).astype(kind, copy=False) if values else np.zeros(0, kind)


def block_id(k: int) -> int:
    """A number for the k-th block of this task that no other task gives; the same if the task runs again."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32 | k
