"""Work on the bytes of many blobs at once, in the Arrow buffer they arrive in: no row per byte, no shuffle of a blob.

A batch is cut into parts of some megabytes of blobs. A part is one array of bytes with the blobs' limits, and
every kernel is a few numpy passes over it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of blobs, and blobs, that a kernel works on at once; a longer blob is a part of its own.
PART_BYTES, PART_BLOBS = 4 << 20, 8192


class Blobs:
    """Bytes of some blobs, one after the other; blob i is data[starts[i]:stops[i]]. A null blob is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        self.missing = column.is_null().to_numpy(zero_copy_only=False)
        column = column.fill_null(b"")
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        self.starts, self.stops = ends[:-1] - ends[0], ends[1:] - ends[0]
        self.lengths = self.stops - self.starts
        self.count = len(column)

    def owners(self) -> np.ndarray:
        """The blob of each byte."""
        return np.repeat(np.arange(self.count), self.lengths)


Kernel = Callable[[Blobs], tuple[np.ndarray | None, dict[str, pa.Array]]]


def map_blobs(df: DataFrame, ids: Sequence[str], blob: str, kernel: Kernel, fields: Sequence[T.StructField]) -> DataFrame:
    """ids and the columns that a kernel makes of parts of the blobs.

    A kernel gives the blob's number of each of its rows (None: the rows belong to no blob, and there are no
    ids) and the columns. Fields are in its order.
    """
    ids = list(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _parts(batch.column(len(ids)), PART_BYTES, PART_BLOBS):
                part = batch.slice(first, last - first)
                rows, columns = kernel(Blobs(part.column(len(ids))))
                kept = [] if rows is None else [part.column(i).take(pa.array(rows)) for i in range(len(ids))]
                names = [] if rows is None else ids
                yield pa.RecordBatch.from_arrays([*kept, *columns.values()], names=[*names, *columns])

    chosen = df.select(*ids, F.col(blob).alias("_blob"))
    return chosen.mapInArrow(run, T.StructType([*[chosen.schema[i] for i in ids], *fields]))


def _parts(column: pa.Array, most_bytes: int, most_blobs: int) -> Iterator[tuple[int, int]]:
    """Limits of parts of a column of blobs."""
    n = len(column)
    if not n:
        return
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(), dtype=np.int64)))
    first = 0
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + most_bytes, "right")) - 1
        last = min(max(first + 1, last), first + most_blobs, n)
        yield first, last
        first = last


def reached(following: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each place is on a path from a start, by pointer doubling.

    following: the place behind each place; the last one, len(following) - 1, follows itself and ends all paths.
    """
    marks = np.zeros(len(following), bool)
    marks[starts] = True
    while True:
        before = int(marks.sum())
        marks[following[marks]] = True
        if int(marks.sum()) == before:
            marks[-1] = False
            return marks
        following = following[following]


# --- histograms -------------------------------------------------------------------------------------


def _value_counts(blobs: Blobs) -> tuple[np.ndarray, dict[str, pa.Array]]:
    counts = np.bincount(blobs.owners() * 256 + blobs.data, minlength=256 * blobs.count)
    there = np.flatnonzero(counts)
    return there >> 8, {"byte": pa.array((there & 255).astype(np.int32)), "cnt": pa.array(counts[there])}


def value_counts(df: DataFrame, ids: Sequence[str], blob: str) -> DataFrame:
    """(ids, byte, cnt) of each blob."""
    return map_blobs(df, ids, blob, _value_counts, [T.StructField("byte", T.IntegerType()), T.StructField("cnt", T.LongType())])


def _totals(blobs: Blobs) -> tuple[np.ndarray, dict[str, pa.Array]]:
    counts = np.bincount(blobs.owners() * 256 + blobs.data, minlength=256 * blobs.count).reshape(blobs.count, 256)
    full = np.flatnonzero(blobs.lengths)
    counts = counts[full]
    values = np.arange(256)
    there = counts > 0
    columns = {
        "length": pa.array(blobs.lengths[full]),
        "low": pa.array(there.argmax(axis=1).astype(np.int32)),
        "high": pa.array((255 - there[:, ::-1].argmax(axis=1)).astype(np.int32)),
        "s": pa.array(counts @ values),
        "q": pa.array(counts @ (values * values)),
    }
    marks = np.packbits(there, axis=1, bitorder="little").view("<i8").reshape(len(full), 4)
    columns |= {f"marks{i}": pa.array(np.ascontiguousarray(marks[:, i])) for i in range(4)}
    return full, columns


def totals(df: DataFrame, ids: Sequence[str], blob: str) -> DataFrame:
    """(ids, length, low, high, s, q, marks0..3) of each blob with bytes: their sum, sum of squares, and a bit per value."""
    kinds = [T.LongType(), T.IntegerType(), T.IntegerType(), *[T.LongType()] * 6]
    names = ["length", "low", "high", "s", "q", *[f"marks{i}" for i in range(4)]]
    return map_blobs(df, ids, blob, _totals, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])


# --- repeats ----------------------------------------------------------------------------------------


def adjacent_repeats(df: DataFrame, blob: str, shortest: int = 2, longest: int = 8) -> DataFrame:
    """(pattern, repeats): how often each piece of bytes is directly followed by itself, by content; at most 8 bytes."""

    def kernel(blobs: Blobs) -> tuple[None, dict[str, pa.Array]]:
        data, room = blobs.data, np.repeat(blobs.stops, blobs.lengths) - np.arange(len(blobs.data))
        patterns, counts = [], []
        for n in range(shortest, longest + 1):
            if len(data) < 2 * n:
                break
            # A piece repeats where n bytes in a row equal those n places on.
            same = np.concatenate(([0], np.cumsum(data[n:] == data[:-n])))
            at = np.flatnonzero((same[n:] - same[:-n] == n) & (room[: len(same) - n] >= 2 * n))
            if not len(at):
                continue
            pieces = np.zeros((len(at), 8), np.uint8)
            pieces[:, 8 - n :] = data[at[:, None] + np.arange(n)]
            found, times = np.unique(pieces.view(">u8").ravel(), return_counts=True)
            patterns += [f"{v:0{2 * n}X}" for v in found.tolist()]
            counts += times.tolist()
        return None, {"pattern": pa.array(patterns, pa.string()), "repeats": pa.array(counts, pa.int64())}

    fields = [T.StructField("pattern", T.StringType()), T.StructField("repeats", T.LongType())]
    found = map_blobs(df, [], blob, kernel, fields)
    return found.groupBy("pattern").agg(F.sum("repeats").alias("repeats"))


# --- greedy scan ------------------------------------------------------------------------------------


def scan_nonoverlapping(df: DataFrame, ids: Sequence[str], blob: str, pattern: bytes) -> DataFrame:
    """(ids, match, position): greedy left-to-right matches of a pattern of bytes that do not overlap, numbered from 0."""
    width = len(pattern)
    if not width:
        raise ValueError("an empty pattern matches nowhere")

    def kernel(blobs: Blobs) -> tuple[np.ndarray, dict[str, pa.Array]]:
        data = blobs.data
        hit = np.ones(max(0, len(data) - width + 1), bool)
        for i, byte in enumerate(pattern):
            hit &= data[i : i + len(hit)] == byte
        places = np.flatnonzero(hit)
        owner = np.searchsorted(blobs.stops, places, "right")
        whole = places + width <= blobs.stops[owner]
        places, owner = places[whole], owner[whole]
        # Behind each hit comes the first one that it does not overlap, if that is in the same blob.
        following = np.searchsorted(places, places + width)
        other = (following == len(places)) | (owner[np.minimum(following, len(places) - 1)] != owner)
        following = np.append(np.where(other, len(places), following), len(places))
        firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))[: len(places)])
        taken = np.flatnonzero(reached(following, firsts))
        place, of = places[taken], owner[taken]
        start = np.searchsorted(of, of)
        return of, {"match": pa.array((np.arange(len(of)) - start).astype(np.int32)), "position": pa.array(place - blobs.starts[of])}

    return map_blobs(df, ids, blob, kernel, [T.StructField("match", T.IntegerType()), T.StructField("position", T.LongType())])


# --- command streams --------------------------------------------------------------------------------


def expand_commands(df: DataFrame, ids: Sequence[str], blob: str, length: int) -> DataFrame:
    """(ids, data, used, status): what streams of run and literal commands stand for, at most `length` bytes.

    A code of 1 to 127 repeats the next byte so often, a code of 128 or more is followed by 256 - code literal bytes,
    and code 0 stops. status: `length` (so many bytes are there), `stop` (code 0 was read), `end` (no code
    is left), `cut` (the bytes of the last command are missing in whole or part; what is there is given). used: bytes
    read. No more commands are read than it takes, a command that gives more than needed counts whole. A null or empty
    blob is an `end` without data; if length is 0, all are `length`.
    """

    def kernel(blobs: Blobs) -> tuple[np.ndarray, dict[str, pa.Array]]:
        data = blobs.data.astype(np.int64)
        n = len(data)
        stops = np.repeat(blobs.stops, blobs.lengths)
        here = np.arange(n)
        literal = data >= 128
        size = np.where(literal, 257 - data, 2)
        over = here + size > stops
        # All paths end at place n: behind a code 0, a last command and a command that is cut.
        following = np.append(np.where((data == 0) | (here + size >= stops), n, here + size), n)
        at = np.flatnonzero(reached(following, blobs.starts[blobs.lengths > 0])) if n else np.zeros(0, np.int64)
        owner = np.searchsorted(blobs.stops, at, "right")
        code = data[at]
        there = np.minimum(size[at], stops[at] - at) - 1  # bytes behind the code
        gives = np.where(code == 0, 0, np.where(literal[at], there, np.where(there > 0, code, 0)))
        # Commands are read while there are too few bytes.
        first = np.searchsorted(owner, np.arange(blobs.count + 1))
        upto = np.concatenate(([0], np.cumsum(gives)))
        before = upto[:-1] - upto[first[owner]]
        read = before < length
        at, owner, code, gives, before = at[read], owner[read], code[read], gives[read], before[read]
        gives = np.minimum(gives, length - before)
        # Bytes of the result: the same one for a run, one after the other for literals.
        command = np.repeat(np.arange(len(at)), gives)
        step = np.arange(len(command)) - np.repeat(np.cumsum(gives) - gives, gives)
        out = blobs.data[at[command] + 1 + np.where(code[command] >= 128, step, 0)]
        made = np.bincount(owner, gives, blobs.count).astype(np.int64)
        values = pa.Array.from_buffers(pa.large_binary(), blobs.count, [None, pa.py_buffer(np.concatenate(([0], np.cumsum(made)))), pa.py_buffer(out)])
        last = np.searchsorted(owner, np.arange(blobs.count), "right") - 1
        some = last >= 0
        some[some] = owner[last[some]] == np.flatnonzero(some)
        status = np.full(blobs.count, "end", dtype=object)
        used = np.zeros(blobs.count, np.int64)
        k = np.flatnonzero(some)
        place = at[last[k]]
        used[k] = np.where(data[place] == 0, place + 1, np.minimum(place + size[place], stops[place])) - blobs.starts[k]
        status[k] = np.where(data[place] == 0, "stop", np.where(over[place], "cut", "end"))
        status[made >= length] = "length"
        return np.arange(blobs.count), {"data": values.cast(pa.binary()), "used": pa.array(used), "status": pa.array(status.tolist(), pa.string())}

    fields = [T.StructField("data", T.BinaryType()), T.StructField("used", T.LongType()), T.StructField("status", T.StringType())]
    return map_blobs(df, ids, blob, kernel, fields)
