"""Ids of many texts at once: equal units are found in the Arrow buffer, and only distinct ones are encoded.

In a text whose words stand behind single blanks or line feeds every unit is a separator (but for the first one) and a
word, so the units are cut and numbered without a Python object each, and ids are gathered by number. Nothing is
remembered between calls. Other texts are for a coder of single texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .wordbpe import LONGEST, WordMerges, put

# What a byte may be in a text that is cut here: 1 a separator, 2 other white space or the first byte of some beyond ASCII.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x0A]] = 1
KINDS[[*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = 2
MARKS = (0x2E, 0x2C)
# Bytes of letters of U+0041 to U+017F.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, 0xC4, 0xC5, *range(0x80, 0xC0)]] = True


class TextCodes:
    """Little-endian 32-bit ids of texts. encode: ids of a list of units as bytes; other: those of a list of whole texts."""

    def __init__(self, merges: WordMerges, encode: Callable[[list[str]], list[bytes]], other: Callable[[list[str]], list[bytes]]):
        self.merges, self.encode, self.other = merges, encode, other
        self.line, *self.marks = (np.frombuffer(c, "<i4") for c in encode(["\n", *map(chr, MARKS)]))
        if len({len(m) for m in self.marks}) > 1:
            raise ValueError("marks of different lengths")

    def __call__(self, column: pa.Array) -> list[bytes]:
        """column: strings without nulls."""
        column = column.cast(pa.large_string())
        if not len(column):
            return []
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        plain = self._plain(data, ends)
        out: list[bytes] = [b""] * len(column)
        rest = np.flatnonzero(~plain)
        for i, code in zip(rest.tolist(), self.other(column.take(pa.array(rest)).to_pylist()) if len(rest) else [], strict=True):
            out[i] = code
        rows = np.flatnonzero(plain)
        if len(rows):
            kept = column.filter(pa.array(plain))
            for i, code in zip(rows.tolist(), self._ids(kept), strict=True):
                out[i] = code
        return out

    @staticmethod
    def _plain(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Texts that have words behind single blanks or line feeds, and no other white space."""
        kinds = KINDS[data]
        bad = kinds == 2
        bad[1:] |= (kinds[1:] == 1) & (kinds[:-1] == 1)
        upto = np.concatenate(([0], np.cumsum(bad)))
        first, last = ends[:-1], ends[1:]
        full = last > first
        plain = full & (upto[last] == upto[first])
        # A pair of separators over the end of a text counts for the next one: that has a separator in front anyway.
        plain[full] &= (kinds[first[full]] != 1) & (kinds[last[full] - 1] != 1)
        return plain

    def _ids(self, texts: pa.Array) -> list[bytes]:
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        # A unit begins at a separator or where a text begins.
        begins = KINDS[raw] == 1
        begins[ends[:-1]] = True
        begins = np.append(np.flatnonzero(begins), len(raw))
        units = pa.Array.from_buffers(pa.large_string(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(raw)]).dictionary_encode()
        number = units.indices.to_numpy()
        flat, sizes = self._units(units.dictionary)
        starts = np.cumsum(sizes) - sizes
        each = sizes[number]
        upto = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.repeat(starts[number] - upto[:-1], each) + np.arange(int(upto[-1]))].astype("<u4").tobytes()
        edges = (4 * upto[np.searchsorted(begins, ends)]).tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, one after the other, and their numbers: of a line feed, of what stands behind it, and of a mark."""
        _, ends, data = units.buffers()
        ends = np.frombuffer(ends, np.int64)[units.offset : units.offset + len(units) + 1]
        data = np.frombuffer(data, np.uint8)
        begin, end = ends[:-1] + (data[ends[:-1]] == 0x0A), ends[1:]
        lined = begin > ends[:-1]
        letters = begin + (data[begin] == 0x20)
        # Letters of U+0041 to U+017F: two bytes of them are a times and a division sign.
        other = ~LETTERS[data]
        other[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        upto = np.concatenate(([0], np.cumsum(other)))
        last = data[end - 1]
        marked = ((last == MARKS[0]) | (last == MARKS[1])) & (end - 1 > letters)
        stop = end - marked
        word = (stop > letters) & (upto[stop] == upto[letters]) & (stop - begin <= LONGEST)
        marked &= word
        rows, rest = np.flatnonzero(word), np.flatnonzero(~word)
        ids, count = self.merges.merge_spans(data, begin[rows], (stop - begin)[rows])
        raw = data.tobytes()
        codes = self.encode([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(begin[rest].tolist(), end[rest].tolist(), strict=True)])
        middle = np.zeros(len(units), np.int64)
        middle[rows], middle[rest] = count, [len(c) // 4 for c in codes]
        front, back = len(self.line) * lined, np.where(marked, len(self.marks[0]), 0)
        sizes = front + middle + back
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int32)
        put(flat, starts[lined], front[lined], np.tile(self.line, int(lined.sum())))
        put(flat, (starts + front)[rows], count, ids)
        put(flat, (starts + front)[rest], middle[rest], np.frombuffer(b"".join(codes), "<i4"))
        for mark, code in zip(MARKS, self.marks, strict=True):
            own = marked & (last == mark)
            put(flat, (starts + front + middle)[own], back[own], np.tile(code, int(own.sum())))
        return flat, sizes
