"""Benchmark passages in documents, found with an FM-index per shard of the documents.

Documents are cut into shards of about a million words. A shard's words are numbered, its chunks of
text are sorted by suffix, and the word before each suffix goes into a wavelet matrix; that, every
eighth suffix position and the words themselves are one row of a table in the shared folder, which
knows nothing of any benchmark. A benchmark is cut into windows of words, and these are dealt into
blocks of bounded size, one broadcast each. A task that holds a shard searches all windows of a block
at once, backwards, by ranks in the wavelet matrix; it finds the positions of what is left by walking to
the next sampled suffix, and merges them into spans per document.

A chunk is followed by as many words of its document as a window is longer than one, so every window
lies in one chunk whole, and no comparison of suffixes goes beyond a chunk: long copies cost no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .common import documents, small_batches
from .words import kept_bytes, split_words, translated

# Word characters are digits, letters and everything beyond ASCII.
WORDS = kept_bytes({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})
# Words and ends of chunks of a shard: all numbers of a shard have at most 21 bits.
SHARD, CHUNK, SAMPLE, BITS = 1 << 20, 256, 8, np.uint64(21)
MASK = (np.uint64(1) << BITS) - np.uint64(1)
# Bytes of windows and item ids that are broadcast at once.
BLOCK = 32 << 20

INDEX = "shard bigint, docs array<struct<row:bigint,doc_id:bigint,n_words:bigint>>, chunks binary, n bigint, words binary, bits binary, marks binary, samples binary"


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Positions sorted by the suffixes that begin there; code 0 ends a chunk, and of two ends the first is smaller.

    Prefix doubling: numbers of the first two words, then of twice as many, only for what is not told apart.
    """
    n = len(codes)
    ends = codes == 0
    first = np.where(ends, np.cumsum(ends) - 1, codes + np.int64(ends.sum() - 1)).astype(np.uint64)
    after = np.concatenate((first[1:], first[:1]))
    place = np.arange(n, dtype=np.uint64)
    # An end is the only one of its kind, so what follows it does not count.
    keys = np.sort(first << BITS + BITS | np.where(ends, np.uint64(0), after) << BITS | place)
    order = (keys & MASK).astype(np.int64)
    new = np.concatenate(([True], keys[1:] >> BITS != keys[:-1] >> BITS))
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    left = np.flatnonzero(~alone)
    depth = 2
    while len(left):
        held = order[left]
        keys = rank[held].astype(np.uint64) << BITS + BITS | rank[np.minimum(held + depth, n)].astype(np.uint64) << BITS | np.arange(len(left), dtype=np.uint64)
        keys.sort()
        held = held[(keys & MASK).astype(np.int64)]
        order[left] = held
        new = np.concatenate(([True], keys[1:] >> BITS != keys[:-1] >> BITS))
        rank[held] = np.maximum.accumulate(np.where(new, left, 0))
        left = left[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


class Ranks:
    """A sequence of numbers as a wavelet matrix: how often a number occurs before a place, and which one is there."""

    def __init__(self, n: int, bits: np.ndarray):
        """bits: one row of 64-bit words per bit of the numbers, the highest first."""
        self.n, self.bits = n, bits
        counts = np.bitwise_count(bits).astype(np.int32)
        self.before = np.zeros((len(bits), bits.shape[1] + 1), np.int32)
        np.cumsum(counts, axis=1, out=self.before[:, 1:])
        self.zeros = n - self.before[:, -1].astype(np.int64)

    @classmethod
    def of(cls, values: np.ndarray, width: int) -> Ranks:
        rows, n = [], len(values)
        for level in range(width - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            rows.append(np.concatenate((packed, np.zeros(-len(packed) % 8, np.uint8))).view(np.uint64))
            values = np.concatenate((values[~bit], values[bit]))
        return cls(n, np.array(rows))

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before a place."""
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        row = self.bits[level]
        part = row[np.minimum(word, len(row) - 1)] & ((np.uint64(1) << inside) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(part)

    def down(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places in the last row, which is sorted by value, that stand for `at` if one follows `values`."""
        width = len(self.bits)
        for level in range(width):
            ones = self.ones(level, at)
            at = np.where(values >> (width - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at

    def value(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number at a place, and its place in the last row."""
        value = np.zeros(len(at), np.int64)
        for level in range(len(self.bits)):
            ones = self.ones(level, at)
            one = (self.bits[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            value = value << 1 | one
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return value, at


class FMIndex:
    """Suffixes of numbered words (0 ends a chunk) that can be searched without the text."""

    def __init__(self, ranks: Ranks, marks: np.ndarray, samples: np.ndarray, size: int):
        self.ranks, self.samples = ranks, samples
        self.marks = Ranks(ranks.n, marks.reshape(1, -1))
        # Suffixes begin with a word as often as it stands before one; the last row holds them in the order of reversed bits.
        width = len(ranks.bits)
        values = np.arange(size)
        backward = np.zeros(size, np.int64)
        for level in range(width):
            backward |= (values >> level & 1) << (width - 1 - level)
        ordered = np.argsort(backward, kind="stable")
        at = ranks.down(values, np.zeros(size, np.int64))
        stops = np.append(at[ordered][1:], ranks.n)
        counts = np.empty(size, np.int64)
        counts[ordered] = stops - at[ordered]
        self.shift = np.cumsum(counts) - counts - at

    @classmethod
    def of(cls, codes: np.ndarray, offsets: np.ndarray, size: int) -> FMIndex:
        """offsets: of each word within its chunk; every SAMPLE-th suffix is kept, the first of a chunk among them."""
        order = suffix_order(codes)
        ranks = Ranks.of(codes[order - 1], max(1, int(size - 1).bit_length()))
        kept = offsets[order] % SAMPLE == 0
        packed = np.packbits(kept, bitorder="little")
        marks = np.concatenate((packed, np.zeros(-len(packed) % 8, np.uint8))).view(np.uint64)
        return cls(ranks, marks, order[kept].astype(np.int32), size)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """windows: words from the last to the first, one row each, filled up with -1; 0 is a word that is not here.

        (which, low, high): rows that occur, and their suffixes from low to before high.
        """
        which = np.flatnonzero((windows != 0).all(axis=1) & (windows[:, 0] > 0)) if windows.size else np.zeros(0, np.int64)
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.ranks.n)
        for step in range(windows.shape[1]):
            word = windows[which, step]
            more = word > 0
            for bound in (low, high):
                bound[more] = self.ranks.down(word[more], bound[more]) + self.shift[word[more]]
            some = low < high
            which, low, high = which[some], low[some], high[some]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of suffixes."""
        found, steps, left, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows
        while len(left):
            kept = (self.marks.bits[0][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            found[left[kept]] = self.samples[self.marks.ones(0, at[kept])] + steps
            left, at = left[~kept], at[~kept]
            value, at = self.ranks.value(at)
            at = at + self.shift[value]
            steps += 1
        return found


def build_index(df: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: its documents, chunks, words and FM-index. Not written yet; write it before it is searched.

    docs lists every row of the input once, in the shard where it begins; a longer document goes on in the
    next ones. chunks: row of the document, first word, number of words, as three 64-bit integers each.
    """
    overlap = window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, serial, shard = TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        size = 0

        def shards() -> Iterator[pa.RecordBatch]:
            nonlocal serial, shard
            ids = pa.concat_arrays([h[0] for h in held])
            lengths = np.concatenate([h[2] for h in held])
            words = pa.concat_arrays([h[1] for h in held]).dictionary_encode()
            codes, known = words.indices.to_numpy(), words.dictionary
            begins = np.cumsum(lengths) - lengths
            rows = first + serial + np.arange(len(ids))
            serial += len(ids)
            # Chunks of all documents.
            pieces = np.where(lengths > 0, np.maximum(1, -(-(lengths - overlap) // CHUNK)), 0)
            owner = np.repeat(np.arange(len(ids)), pieces)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * CHUNK
            count = np.minimum(lengths[owner] - start, CHUNK + overlap)
            # As many shards as it takes; a document is listed where its first chunk is, one without words in the first shard.
            part = (np.cumsum(count + 1) - 1) // SHARD
            home = np.zeros(len(ids), np.int64)
            home[owner[start == 0]] = part[start == 0]
            for number in range(int(part.max(initial=0)) + 1):
                own = part == number
                o, s, c = owner[own], start[own], count[own]
                total = int(c.sum()) + len(c)
                row = (None, b"", 0, b"", b"", b"", b"")
                if total:
                    ends = np.cumsum(c + 1) - 1
                    offsets = np.arange(total) - np.repeat(ends - c, c + 1)
                    taken = np.repeat(begins[o] + s, c + 1) + offsets
                    taken[ends] = 0
                    there = codes[taken]
                    present = np.zeros(len(known) + 1, bool)
                    present[there] = True
                    dense = np.cumsum(present)
                    numbered = dense[there].astype(np.int64)
                    numbered[ends] = 0
                    listed = np.flatnonzero(present)
                    index = FMIndex.of(numbered, offsets, len(listed) + 1)
                    chunks = np.stack([rows[o], s, c], axis=1).astype("<i8").tobytes()
                    vocabulary = " ".join(known.take(pa.array(listed)).to_pylist()).encode()
                    row = (None, chunks, total, vocabulary, index.ranks.bits.tobytes(), index.marks.bits.tobytes(), index.samples.tobytes())
                here = np.flatnonzero(home == number)
                docs = pa.StructArray.from_arrays([pa.array(rows[here]), ids.take(pa.array(here)), pa.array(lengths[here])], names=["row", "doc_id", "n_words"])
                listed_docs = pa.ListArray.from_arrays(pa.array([0, len(here)], pa.int32()), docs)
                kinds = [pa.binary(), pa.int64(), *[pa.binary()] * 4]
                rest = [pa.array([v], k) for v, k in zip(row[1:], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([first + shard], pa.int64()), listed_docs, *rest], names=["shard", "docs", "chunks", "n", "words", "bits", "marks", "samples"])
                shard += 1

        for batch in small_batches(batches, "text", 4 << 20):
            if not batch.num_rows:
                continue
            words, lengths = split_words(translated(batch.column("text"), WORDS))
            held.append((batch.column("doc_id"), words, lengths))
            size += len(words) + len(lengths)
            if size >= SHARD * 7 // 8:
                yield from shards()
                held, size = [], 0
        if held:
            yield from shards()

    return documents(df, key, text).mapInArrow(run, INDEX)


def item_windows(benchmark: DataFrame, window: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """(words, item_id), each pair once: windows of `window` words joined by one blank; a shorter item is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            words, lengths = split_words(translated(batch.column("text"), WORDS))
            words, ends = words.to_pylist(), np.cumsum(lengths).tolist()
            for item, n, end in zip(batch.column("item_id").to_pylist(), lengths.tolist(), ends, strict=True):
                own = words[end - n : end]
                found = list({" ".join(own[i : i + window]): None for i in range(max(1, n - window + 1))}) if n else []
                for at in range(0, len(found), 10_000):
                    cut = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()), pa.array([item] * len(cut), pa.string())], names=["words", "item_id"])

    items = benchmark.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return items.mapInArrow(run, "words string, item_id string").distinct()


@dataclass
class Block:
    """Windows to look for: numbers of words from the last to the first, and the items of each window."""

    known: dict[str, int]
    windows: np.ndarray
    items: list[str]
    owned: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, pairs: list[tuple[str, str]]) -> Block:
        pairs = sorted(pairs)
        known: dict[str, int] = {}
        rows, owned, edges, items = [], [], [0], {}
        last = None
        for words, item in pairs:
            if words != last:
                rows.append([known.setdefault(w, len(known)) for w in reversed(words.split(" "))])
                edges.append(len(owned))
                last = words
            owned.append(items.setdefault(item, len(items)))
            edges[-1] = len(owned)
        windows = np.full((len(rows), max(map(len, rows), default=1)), -1, np.int64)
        for i, row in enumerate(rows):
            windows[i, : len(row)] = row
        return cls(known, windows, list(items), np.array(owned, np.int64), np.array(edges, np.int64))


def merged_spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of numbered documents in order; those that overlap or touch are one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    base = doc * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + base)
    first = np.flatnonzero(np.concatenate(([True], start[1:] + base[1:] > reach[:-1])))
    last = np.append(first[1:] - 1, len(doc) - 1)
    return doc[first], start[first], (reach - base)[last]


def listed_spans(n: int, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """One list of spans for each of n documents."""
    edges = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], names=["start", "stop"]))


def found_spans(row: dict, block: Block) -> pa.RecordBatch | None:
    """Of one shard: rows of documents with hits, their merged spans, and their items."""
    size = 1
    numbers = np.zeros(len(block.known) + 1, np.int64)
    for word in row["words"].decode().split(" "):
        at = block.known.get(word)
        if at is not None:
            numbers[at] = size
        size += 1
    numbers[-1] = -1  # what windows are filled up with
    width = max(1, int(size - 1).bit_length())
    n = row["n"]
    ranks = Ranks(n, np.frombuffer(row["bits"], np.uint64).reshape(width, -1))
    index = FMIndex(ranks, np.frombuffer(row["marks"], np.uint64), np.frombuffer(row["samples"], np.int32), size)
    which, low, high = index.search(numbers[block.windows])
    if not len(which):
        return None
    # One entry per occurrence.
    times = high - low
    window = np.repeat(which, times)
    rows = np.arange(len(window)) - np.repeat(np.cumsum(times) - times - low, times)
    place = index.locate(rows)
    chunks = np.frombuffer(row["chunks"], "<i8").reshape(-1, 3)
    begins = np.cumsum(chunks[:, 2] + 1) - chunks[:, 2] - 1
    chunk = np.searchsorted(begins, place, "right") - 1
    doc, start = chunks[chunk, 0], chunks[chunk, 1] + place - begins[chunk]
    stop = start + (block.windows[window] >= 0).sum(axis=1)
    docs, of_doc = np.unique(doc, return_inverse=True)
    spans = listed_spans(len(docs), *merged_spans(of_doc, start, stop))
    # Items of each document, once.
    pair = np.unique(of_doc * len(block.windows) + window)
    of, window = pair // len(block.windows), pair % len(block.windows)
    counts = block.edges[window + 1] - block.edges[window]
    owned = block.owned[np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - block.edges[window], counts)]
    pair = np.unique(np.repeat(of, counts) * max(1, len(block.items)) + owned)
    edges = np.searchsorted(pair // len(block.items), np.arange(len(docs) + 1)).astype(np.int32)
    items = pa.ListArray.from_arrays(pa.array(edges), pa.array(block.items, pa.string()).take(pa.array(pair % len(block.items))))
    return pa.RecordBatch.from_arrays([pa.array(docs), spans, items], names=["row", "spans", "items"])


HITS = "row bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"


def search_index(index: DataFrame, windows: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """(row, spans, items) of all documents of an index in which a window occurs; a row for each shard and block.

    windows: as item_windows() gives them. They are dealt into blocks by hash, so that one holds about
    half of block_bytes; each block is broadcast and taken to all shards in a pass of its own.
    """
    size = windows.agg(F.sum(F.octet_length("words") + F.octet_length("item_id") + 80)).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes))
    context = windows.sparkSession.sparkContext
    rows = index.where("n > 0").select("chunks", "n", "words", "bits", "marks", "samples")
    results = []
    for number in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)) == number)
        block = context.broadcast(Block.of([(r["words"], r["item_id"]) for r in own.select("words", "item_id").collect()]))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    found = found_spans({c: batch.column(c)[i].as_py() for c in batch.schema.names}, block.value)
                    if found is not None:
                        yield found

        result = rows.mapInArrow(run, HITS)
        results.append(result if blocks == 1 else written(result, "spans"))
        if blocks > 1:
            block.destroy()
    result = results[0]
    for other in results[1:]:
        result = result.unionByName(other)
    return result


def contamination(df: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row: removal spans in words (start, and stop behind the last one), merged
    and in order, and the distinct items that occur, sorted.

    Null and empty texts have no words; an item without words is no item, a missing item id is the empty string.
    Items of one id count once. Repeated rows are told each; an empty table of documents gives no rows, an empty
    benchmark rows without spans.
    """
    index = written(build_index(df, window, key, text), "fm-index")
    windows = written(item_windows(benchmark, window, item_key, item_text), "windows")
    hits = search_index(index, windows, block_bytes).groupBy("row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            doc = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy())
            start, stop = (x.to_numpy() for x in spans.flatten().flatten())
            yield pa.RecordBatch.from_arrays([batch.column("row"), listed_spans(len(spans), *merged_spans(doc, start, stop)), batch.column("items")], names=["row", "spans", "items"])

    # What several shards or blocks tell of one document.
    hits = hits.mapInArrow(merge, HITS)
    docs = index.select(F.explode("docs").alias("d")).select("d.row", "d.doc_id", "d.n_words")
    return docs.join(hits, "row", "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of what contamination() gives."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["stop"] - s["start"])
    listed = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), listed.alias("items_sha256"), (hit > 0).alias("contaminated"))
