"""Words of Arrow text columns without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def kept_bytes(kept: set[int]) -> bytes:
    """A table for bytes.translate: kept bytes stay, A-Z become a-z if those are kept, all others become blanks."""
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if b in kept else 32 for b in lower)


def translated(column: pa.Array, table: bytes) -> pa.Array:
    """A string column (nulls as empty) with every byte exchanged."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = memoryview(data)[ends[0] : ends[-1]].tobytes() if data is not None else b""
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(held.translate(table))])


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between white space, one after the other, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(column)
    words, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        empty = np.concatenate(([0], np.cumsum(~full)))
        ends = np.cumsum(lengths)
        lengths = lengths - (empty[ends] - empty[ends - lengths])
        words = words.filter(pa.array(full))
    return words, lengths
