"""Searching many known patterns in many blobs, and comparing sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binary import each_position, let
from ..shared import is_small, written
from .inplace import Blobs, map_blobs

GRAM = 16
MAX_STRIDE = 64
# Patterns of up to this many bytes in all go to every task that reads blobs.
MOST_PATTERN_BYTES = 1 << 20
# Beyond that, up to this many grams of patterns, and candidates, are broadcast.
MOST_SEEDS = 1_000_000
MOST_CANDIDATES = 100_000


def search_patterns(
    blobs: DataFrame, patterns: DataFrame, blob_id: str, blob: str, pattern_id: str, pattern: str, min_length: int = GRAM,
    around: int | None = None,
) -> DataFrame:
    """All positions (from 0, overlaps included) of every pattern in every blob.

    The blobs are only sampled: one gram each `stride` bytes. A pattern of n bytes covers at
    least one sampled gram if n >= gram + stride - 1, wherever it lies. Patterns below
    `min_length` never match; equal patterns are searched once. With `around`, each hit also
    has `near`, its bytes with so many on both sides, `near_at`, where it begins in there,
    and `blob_size`.

    Patterns of at most MOST_PATTERN_BYTES are looked for where the blobs are read, and no blob
    moves; of more, grams meet in an equi-join, and blobs with candidates are read again.
    """
    ids = patterns.select(pattern_id, F.col(pattern).alias("_bytes")).where(
        F.octet_length("_bytes") >= min_length
    )
    unique = ids.select("_bytes").distinct().withColumn("_key", F.sha2("_bytes", 256))
    shortest, known, size = unique.agg(F.min(F.octet_length("_bytes")), F.count("*"), F.sum(F.octet_length("_bytes"))).first()
    extra = [] if around is None else ["near", "near_at", "blob_size"]
    if shortest is None:
        nothing = F.lit(None).cast(dict(ids.dtypes)[pattern_id]).alias(pattern_id)
        kinds = zip(extra, ["binary", "int", "int"], strict=False)
        empty = [F.lit(None).cast(kind).alias(name) for name, kind in kinds]
        return blobs.select(blob_id, nothing, F.lit(0).alias("position"), *empty).where(F.lit(False))
    gram = max(1, min(GRAM, shortest // 2))
    stride = max(1, min(MAX_STRIDE, shortest - gram + 1))
    if size <= MOST_PATTERN_BYTES:
        found = _search_in_place(blobs, unique, blob_id, blob, gram, stride, around)
    else:
        found = _search_by_join(blobs, unique, blob_id, blob, gram, stride, shortest, known, around)
    named = ids.select(pattern_id, F.sha2("_bytes", 256).alias("_key"))
    return found.join(named, "_key").select(blob_id, pattern_id, "position", *extra)


def _hashes(data: np.ndarray, places: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of the gram at each place."""
    result = np.zeros(len(places), np.uint64)
    for k in range(gram):
        result = result * np.uint64(0x9E3779B97F4A7C15) + data[places + k] + np.uint64(1)
    return result


def _each(lengths: np.ndarray, gram: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and offset of the grams each `stride` bytes of byte strings."""
    counts = np.where(lengths >= gram, (lengths - gram) // stride + 1, 0)
    first = np.cumsum(counts) - counts
    return np.repeat(np.arange(len(lengths)), counts), (np.arange(counts.sum()) - np.repeat(first, counts)) * stride


def _search_in_place(blobs: DataFrame, unique: DataFrame, blob_id: str, blob: str, gram: int, stride: int, around: int | None) -> DataFrame:
    """Hits from two passes over the blobs: the first counts how often the grams of patterns are sampled, the
    second looks up one gram of each pattern and remainder of its offset by `stride`, the rarest, and verifies."""
    rows = sorted((r["_key"], bytes(r["_bytes"])) for r in unique.collect())
    keys, patterns = pa.array([k for k, _ in rows]), [p for _, p in rows]
    lengths = np.array([len(p) for p in patterns], np.int64)
    starts = np.cumsum(lengths) - lengths
    owner, offset = _each(lengths, gram, 1)
    grams, which = np.unique(_hashes(np.frombuffer(b"".join(patterns), np.uint8), starts[owner] + offset, gram), return_inverse=True)

    def sampled(part: Blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, at = _each(part.lengths, gram, stride)
        return row, at, _hashes(part.data, part.starts[row] + at, gram)

    def count(part: Blobs):
        hashes = sampled(part)[2]
        place = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
        there, n = np.unique(place[grams[place] == hashes], return_counts=True)
        return None, {"gram": pa.array(there, pa.int32()), "n": pa.array(n, pa.int64())}

    fields = [T.StructField("gram", T.IntegerType()), T.StructField("n", T.LongType())]
    # At most one row per byte of the patterns.
    counted = map_blobs(blobs, [], blob, count, fields).groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(len(grams), np.int64)
    often[counted.column("gram").to_numpy()] = counted.column("n").to_numpy()

    group = owner * stride + offset % stride
    order = np.lexsort((offset, often[which], group))
    rarest = order[np.unique(group[order], return_index=True)[1]]
    rarest = rarest[np.argsort(grams[which[rarest]], kind="stable")]
    seeds, seed_owner, seed_offset = grams[which[rarest]], owner[rarest], offset[rarest]

    def search(part: Blobs):
        row, at, hashes = sampled(part)
        low = np.searchsorted(seeds, hashes, "left")
        n = np.searchsorted(seeds, hashes, "right") - low
        hit = np.repeat(np.arange(len(row)), n)
        seed = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        row, position, mine = row[hit], at[hit] - seed_offset[seed], seed_owner[seed]
        fits = (position >= 0) & (position + lengths[mine] <= part.lengths[row])
        row, position, mine = row[fits], position[fits], mine[fits]
        whole, begin = part.data.tobytes(), part.starts[row] + position
        same = np.fromiter((whole.startswith(patterns[j], a) for j, a in zip(mine.tolist(), begin.tolist(), strict=True)), bool, len(row))
        row, position, mine, begin = row[same], position[same], mine[same], begin[same]
        columns = {"_key": keys.take(pa.array(mine)), "position": pa.array(position, pa.int32())}
        if around is not None:
            start, stop = np.maximum(begin - around, part.starts[row]), np.minimum(begin + lengths[mine] + around, part.stops[row])
            near = [whole[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
            columns |= {"near": pa.array(near, pa.binary()), "near_at": pa.array(begin - start, pa.int32()), "blob_size": pa.array(part.lengths[row], pa.int32())}
        return row, columns

    fields = [T.StructField("_key", T.StringType()), T.StructField("position", T.IntegerType())]
    if around is not None:
        fields += [T.StructField("near", T.BinaryType()), T.StructField("near_at", T.IntegerType()), T.StructField("blob_size", T.IntegerType())]
    return map_blobs(blobs, [blob_id], blob, search, fields)


def _search_by_join(
    blobs: DataFrame, unique: DataFrame, blob_id: str, blob: str, gram: int, stride: int, shortest: int, known: int, around: int | None
) -> DataFrame:
    """Hits from an equi-join of the sampled grams with the grams at the first `stride` offsets of each pattern."""

    def grams(df: DataFrame, content: str, last: Column, step: int, keep: str) -> DataFrame:
        hashed = F.xxhash64(F.expr(f"substring({content}, _at + 1, {gram})"))
        return each_position(df.select(keep, content), "_at", F.lit(0), last, step).select(
            keep, "_at", hashed.alias("_gram")
        )

    seeds = grams(unique, "_bytes", F.lit(stride - 1), 1, "_key").withColumnRenamed("_at", "_shift")
    texts = blobs.select(blob_id, F.col(blob).alias("_content")).where(F.octet_length("_content") >= shortest)
    sampled = grams(texts, "_content", F.octet_length("_content") - gram, stride, blob_id)
    candidates = (
        sampled.join(F.broadcast(seeds) if known * stride <= MOST_SEEDS else seeds, "_gram")
        .select(blob_id, "_key", (F.col("_at") - F.col("_shift")).alias("position"))
        .where(F.col("position") >= 0)
    )
    # The blobs are read once more to verify; they only move if the candidates are many.
    candidates = written(candidates, "candidates")
    # A hint only for few candidates, and only their places: patterns join by key.
    places = F.broadcast(candidates) if is_small(candidates, MOST_CANDIDATES) else candidates
    same = F.expr("substring(_content, position + 1, octet_length(_bytes)) = _bytes")
    found = texts.join(places, blob_id).join(unique, "_key").where(same)
    if around is None:
        return found.select(blob_id, "_key", "position")
    start = F.greatest(F.col("position") - around, F.lit(0))
    stop = F.least(F.col("position") + F.octet_length("_bytes") + around, F.octet_length("_content"))
    return found.select(
        blob_id,
        "_key",
        "position",
        F.substring("_content", start + 1, stop - start).alias("near"),
        (F.col("position") - start).alias("near_at"),
        F.octet_length("_content").alias("blob_size"),
    )


def match_summary(matches: DataFrame, pattern_id: str) -> DataFrame:
    """Matches per pattern that was found at all."""
    return matches.groupBy(pattern_id).agg(F.count("*").alias("matches"))


def prefix_length(a: Column, b: Column) -> Column:
    """Number of leading bytes two binary columns share, by bisection."""
    both = F.struct(a.alias("a"), b.alias("b"))
    return let(both, lambda s: _bisect_prefix(s["a"], s["b"]))


def _bisect_prefix(a: Column, b: Column) -> Column:
    shorter = F.least(F.octet_length(a), F.octet_length(b))

    def part(c: Column, start: Column, stop: Column) -> Column:
        return F.substring(c, start + 1, stop - start)

    def halve(state, _):
        middle = F.floor((state["low"] + state["high"] + 1) / 2).cast("int")
        equal = part(a, state["low"], middle) == part(b, state["low"], middle)
        return F.struct(
            F.when(equal, middle).otherwise(state["low"]).alias("low"),
            F.when(equal, state["high"]).otherwise(middle - 1).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), shorter.alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(shorter + 1)).cast("int"))
    return F.aggregate(steps, start, halve, lambda s: s["low"])


def sequence_diff(df: DataFrame, expected: str, actual: str, around: int = 8) -> DataFrame:
    """Where two byte strings first differ: position, both bytes, context, equal leading
    bytes and difference in length. The position is NULL if one is a prefix of the other."""
    e, a = F.col(expected), F.col(actual)
    out = df.withColumn("equal_leading", prefix_length(e, a))
    at = F.col("equal_leading")
    differs = at < F.least(F.octet_length(e), F.octet_length(a))
    start = F.greatest(F.lit(0), at - around)

    def near(c: Column) -> Column:
        return F.when(differs, F.hex(F.substring(c, start + 1, at + around - start)))

    return out.withColumns(
        {
            "position": F.when(differs, at),
            "expected_byte": F.when(differs, F.hex(F.substring(e, at + 1, F.lit(1)))),
            "actual_byte": F.when(differs, F.hex(F.substring(a, at + 1, F.lit(1)))),
            "expected_context": near(e),
            "actual_context": near(a),
            "length_difference": F.octet_length(a) - F.octet_length(e),
        }
    )


def prefix_extra(a: Column, b: Column, ends: int = 16) -> Column:
    """Struct: is a a prefix of b, what b has more, first and last items of b."""
    starts = F.startswith(b, a)
    extra = F.when(starts, F.substring(b, F.length(a) + 1, F.length(b)))
    first, last = head_tail(b, ends)
    return F.struct(starts.alias("is_prefix"), extra.alias("extra"), first.alias("first"), last.alias("last"))


def head_tail(text: Column, n: int) -> tuple[Column, Column]:
    """The first and the last n items."""
    return F.substring(text, 1, n), F.substring(text, -n, n)
