"""Words of whole Arrow text columns as spans of their buffer, found at once, without a Python string per word."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: A-Z to a-z, every other byte to itself.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: the bytes of the ranges (both ends count), and all bytes of characters beyond ASCII."""
    flags = np.zeros(256, dtype=bool)
    for first, last in ranges:
        flags[first : last + 1] = True
    flags[0x80:] = True
    return flags


LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
LETTERS_DIGITS = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, offsets) of consecutive rows that hold about `limit` bytes; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, LOWERED[data[offsets[row] : offsets[end]]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of every run of flagged bytes inside a text."""
    inside = flags[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[offsets] = False
    after = np.zeros(len(data) + 1, dtype=bool)
    after[: len(data)] = inside
    after[offsets] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return start, end - start, np.searchsorted(offsets, start, side="right") - 1
