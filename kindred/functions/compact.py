"""Vectors as bytes: some 3 to a term, in place of 12 for its number and weight.

A weight follows from how often its term occurs (tf), in how many documents (df), their number and the vector's
length. Numbers of terms rise with falling df, so both are small steps; steps and tf are written
with 7 bits to a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kindred.functions import weights

COMPACT = "compact"
SCHEMA = "terms binary, n_terms int, n_docs bigint, norm double"


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + counts[i] - 1`` for each i, one after another."""
    ends = counts.cumsum()
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def encode(term_ids: pa.ListArray, df: pa.ListArray, tf: pa.ListArray) -> pa.BinaryArray:
    """Lists of rising numbers with falling ``df``: the steps of both, then ``tf``."""
    length = pc.list_value_length(term_ids).to_numpy()
    ends = length.astype(np.int64).cumsum()
    start = ends - length
    first = start[length > 0]
    columns = [x.flatten().to_numpy().astype(np.int64) for x in (term_ids, df, tf)]
    for column, sign in zip(columns, (1, -1)):
        kept = column[first]
        column[1:] = sign * np.diff(column)
        column[first] = kept
    if any((column < 0).any() for column in columns):
        raise ValueError("terms must be numbered by falling document frequency")
    values = np.empty(3 * len(columns[0]), np.int64)
    for at, column in enumerate(columns):
        values[ranges(3 * start + at * length, length)] = column
    data, sizes = _to_bytes(values)
    offsets = np.r_[0, sizes.cumsum()][np.r_[0, 3 * ends]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def decode(packed: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Length of each vector and, one after another, numbers, ``df`` and ``tf`` of all terms."""
    at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    data = packed.buffers()[2]
    values, lasts = _from_bytes(np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8))
    begun = np.searchsorted(lasts, at - at[0])
    length = np.diff(begun) // 3
    first = (length.cumsum() - length)[length > 0]
    columns = [values[ranges(begun[:-1] + k * length, length)] for k in range(3)]
    for column, sign in zip(columns, (1, -1)):
        kept = column[first]
        column *= sign
        column[first] = kept
        sums = column.cumsum()
        column[:] = sums - np.repeat(sums[first] - kept, length[length > 0])
    return length, *columns


def entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each vector and, one after another, numbers and weights of all terms."""
    packed, n_docs, norm = (vectors.field(name) for name in ("terms", "n_docs", "norm"))
    length, term_ids, df, tf = decode(packed)
    n_docs, norm = np.repeat(n_docs.to_numpy(), length), np.repeat(norm.to_numpy(), length)
    return length, term_ids.astype(np.int32), weights.normalized(tf, df, n_docs, norm)


def _to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest 7 bits first; 128 is added to all bytes of a number but its last."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, int(values.max(initial=0)).bit_length(), 7):
        sizes += values >= 1 << bits
    start = sizes.cumsum() - sizes
    data = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        data[start[has] + k] = (values[has] >> 7 * k & 127) + 128 * (sizes[has] > k + 1)
    return data, sizes


def _from_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and where the last byte of each is."""
    lasts = np.flatnonzero(data < 128)
    start = np.r_[0, lasts[:-1] + 1][: len(lasts)]
    sizes = lasts - start + 1
    values = np.zeros(len(lasts), np.int64)
    for k in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        values[has] |= (data[start[has] + k].astype(np.int64) & 127) << 7 * k
    return values, lasts
