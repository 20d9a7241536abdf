"""Vector best-fit packing of token sequences under several capacities.

Items differ in three sizes: tokens, documents (one) and attention cost (tokens squared), all set by
their length. So there are only as many kinds of items as lengths, and the whole packing is found on
the counts per length, whatever the number of documents: at most `capacity` counts reach the driver.
Bins of one state stand for each other and are kept as ranges, with numbers. The result is a small
table of steps (length, ranks from, bins from, offset), and every piece looks up its place by its rank
among the pieces of its length. Ranks are counted by (length, salt), so a frequent length is split.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written
from .common import documents, remembers, small_batches, tidy
from .unitcodes import TextCodes
from .units import UnitCoder, is_word
from .wordbpe import LONGEST, WordMerges

# Codes of units of odd texts that a worker remembers: two generations of each of two tables.
REMEMBERED = 50_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@lru_cache(maxsize=4)
def coder(path: str) -> TextCodes:
    """Ids of the tokenizers library, one coder per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    merges = WordMerges(path)

    def encode(units: list[str]) -> list[bytes]:
        """Words of a few letters by their merges, in step; all else by the library."""
        words, others, out = [], [], [b""] * len(units)
        for i, unit in enumerate(units):
            short = len(unit) <= LONGEST // 2 and is_word(unit[1:] if unit[:1] == " " else unit)
            (words if short else others).append(i)
        for i, code in zip(words, merges.merge([units[i].encode() for i in words]), strict=True):
            out[i] = code
        found = tokenizer.encode_batch_fast([units[i] for i in others], add_special_tokens=False) if others else []
        for i, e in zip(others, found, strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    return TextCodes(merges, encode, UnitCoder(encode, REMEMBERED))


def pieces(df: DataFrame, path: str, capacity: int = 1024, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids of each whole text and the id `end` behind it.

    Only longer documents are cut, into full pieces; the first one takes what is over. A null text
    is empty and is the one id `end`. Rows that repeat are packed each by itself.
    """
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("packing", coder.cache_clear)
        encode = coder(path)
        for batch in small_batches(batches, "text", 8 << 20):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                ids += tail
                total = len(ids) // 4
                first = (total - 1) % capacity + 1
                cuts = [0, *range(first, total + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return documents(df, key, text).mapInArrow(tidy("packing", run), PIECES)


@dataclass
class Bins:
    """A range of bins in the same state."""

    first: int
    count: int
    used: tuple[int, int, int]  # tokens, documents, attention cost


def plan(counts: dict[int, int], capacity: int, documents: int, attention: int, weights=(1.0, 1.0, 1.0), score: str = "norm") -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (length, rank from, first bin, items per bin, offset) and the number of bins.

    counts: items per length. Longest first. Among the bins with room in all three sizes, the best
    one has the least weighted norm of what would be left ("norm"), or the greatest weighted dot
    product of the item and what is left ("dot"); sizes are shares of their capacities. Ties take
    the oldest bins. A bin takes items of one length until it has no more room for one.
    """
    if score not in ("norm", "dot"):
        raise ValueError("score is norm or dot")
    limits = (capacity, documents, attention)
    groups: list[Bins] = []
    steps: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def room(used: tuple[int, int, int], item: tuple[int, int, int]) -> int:
        return min((m - u) // d for m, u, d in zip(limits, used, item, strict=True))

    def value(used: tuple[int, int, int], item: tuple[int, int, int]) -> float:
        left = [(m - u) / m for m, u in zip(limits, used, strict=True)]
        share = [d / m for d, m in zip(item, limits, strict=True)]
        if score == "dot":
            return -sum(w * d * r for w, d, r in zip(weights, share, left, strict=True))
        return sum(w * (r - d) ** 2 for w, d, r in zip(weights, share, left, strict=True))

    for length in sorted(counts, reverse=True):
        item, todo, rank = (length, 1, length * length), counts[length], 0
        if room((0, 0, 0), item) < 1:
            raise ValueError(f"a piece of {length} does not fit into an empty bin")
        order = sorted((value(g.used, item), g.first, g) for g in groups if room(g.used, item) > 0) if todo else []
        for _, _, group in [*order, (0, 0, None)]:
            if not todo:
                break
            if group is None:
                group = Bins(bins, -(-todo // room((0, 0, 0), item)), (0, 0, 0))
                bins += group.count
                groups.append(group)
            per = room(group.used, item)
            # Full bins, then one bin with the rest; the bins after those stay as they are.
            for items, number in ((per, min(group.count, todo // per)), (todo % per, 1)):
                if not items or not number or not todo or not group.count:
                    continue
                steps.append((length, rank, group.first, items, group.used[0]))
                rank, todo = rank + items * number, todo - items * number
                filled = tuple(u + items * d for u, d in zip(group.used, item, strict=True))
                groups.append(Bins(group.first, number, filled))
                group.first, group.count = group.first + number, group.count - number
        groups = [g for g in groups if g.count and g.used[0] < capacity and g.used[1] < documents and g.used[2] < attention]
    return steps, bins


def pack(items: DataFrame, capacity: int = 1024, documents: int | None = None, attention: int | None = None, weights=(1.0, 1.0, 1.0), score: str = "norm") -> DataFrame:
    """items (written before, with doc_id, piece and length from 1 to capacity) with sequence_id and offset.

    documents, attention: capacities of a sequence in documents and in summed squares of lengths;
    by default what `capacity` tokens can hold. Offsets are gapless from 0. Empty tables give none.
    """
    documents = documents or capacity
    attention = attention or capacity * capacity
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths are 1 to capacity")
    steps, _ = plan(counts, capacity, documents, attention, weights, score)
    table = np.array(sorted(steps), np.int64).reshape(-1, 5)

    salts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = items.select("*", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).alias("_salt"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(sizes, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length, rank):
        import pandas as pd

        at = np.searchsorted(table[:, 0] << 44 | table[:, 1], length.to_numpy() << 44 | rank.to_numpy(), side="right") - 1
        step = table[at]
        nth = rank.to_numpy() - step[:, 1]
        return pd.DataFrame({"sequence_id": step[:, 2] + nth // step[:, 3], "offset": step[:, 4] + nth % step[:, 3] * length.to_numpy()})

    placed = ranked.withColumn("_place", place("length", "_rank"))
    return placed.select(*[F.col(c) for c in items.columns], "_place.sequence_id", "_place.offset")


def pack_documents(df: DataFrame, path: str, capacity: int = 1024, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """pieces() and pack() in one: every document of the table, in as few sequences as best-fit finds."""
    return pack(written(pieces(df, path, capacity, key=key, text=text), "pieces"), capacity, **limits)
