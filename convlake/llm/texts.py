"""Byte-level helpers for Arrow columns of texts.

All of them see whole texts.  A batch is worked on in slices of bounded size, so
that the memory of a task does not follow the number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The six ASCII blanks: space and 0x09-0x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null counts as empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with at most ``most`` bytes of text, or one row."""
    _, at = text_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def words(data: np.ndarray, at: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are not ``blank``; runs never cross rows."""
    inside = ~blank[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(at, start, "right") - 1


def as_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Binary array of data[start:end] for ascending, disjoint, possibly spaced runs."""
    size = end - start
    to = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    gather = np.repeat(start - to[:-1], size) + np.arange(to[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(data[gather]))])


def ragged(values: np.ndarray, at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[at[i]:at[i+1]] for each i of ``pick``, one after the other, and the new offsets."""
    size = (at[1:] - at[:-1])[pick]
    to = np.zeros(len(pick) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    return values[np.repeat(at[:-1][pick] - to[:-1], size) + np.arange(to[-1])], to
