"""Collocations: phrases of two to four words, counted exactly in counting quotient filters.

Documents are dealt into chunks, and a chunk's words are numbered; only words that are frequent in their
language get a number of the whole corpus, and only phrases of frequent shorter phrases are counted, length
by length. A phrase is packed from its word numbers into two halves of up to 64 bits and permuted (a Feistel
network, which can be undone). The permuted number is cut into a segment, a quotient and a remainder, and a
filter holds its entries sorted: quotients in unary, full remainders in whole bytes, and counters. So it is
lossless and a few bytes per phrase. Each chunk sends one filter per segment; sorted filters of a segment are
merged as they stream in, and what is frequent is kept. Each sent filter then gets an answer, one bit per
entry, by which its chunk cuts its text down to runs of frequent phrases before it counts longer ones.

No step holds more than a chunk, or the distinct phrases of a segment; segments grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written
from .common import small_batches
from .words import split_words, translated

# Words of a chunk, words of the corpus per segment, and the most segments (a power of two).
TOGETHER, PER_SEGMENT, MOST_SEGMENTS = 1_500_000, 1 << 20, 1 << 16
# Entries that a merge gathers before it sorts them.
GATHERED = 2_000_000
# A-Z in lower case, ends of pieces as line feeds, tabs as blanks.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
ROUNDS = 4


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    values = (values + np.uint64(salt + 1)) * MIX[0]
    values = (values ^ values >> np.uint64(32)) * MIX[1]
    return values ^ values >> np.uint64(29)


class Phrases:
    """How phrases of n words, whose numbers have `width` bits, become sortable keys and back.

    A key is one 64-bit number if two halves fit, else 16 bytes, the left half first.
    """

    def __init__(self, n: int, width: int, segment_bits: int):
        self.n, self.width = n, width
        self.left = (n + 1) // 2
        self.half = self.left * width
        self.segment_bits = min(segment_bits, self.half)
        self.mask = np.uint64((1 << self.half) - 1)
        self.single = 2 * self.half <= 64

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self.single:
            return left << np.uint64(self.half) | right
        return np.stack([left, right], axis=1).astype(">u8").view("S16").ravel()

    def halves(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.single:
            return keys >> np.uint64(self.half), keys & self.mask
        both = keys.view(">u8").reshape(-1, 2).astype(np.uint64)
        return both[:, 0], both[:, 1]

    def keys(self, words: np.ndarray) -> np.ndarray:
        """words: one row per phrase."""
        words = words.astype(np.uint64)
        left, right = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
        for i in range(self.left):
            left = left << np.uint64(self.width) | words[:, i]
        for i in range(self.left, self.n):
            right = right << np.uint64(self.width) | words[:, i]
        for i in range(ROUNDS):
            left, right = right, left ^ (mixed(right, i) & self.mask)
        return self.joined(left, right)

    def words(self, keys: np.ndarray) -> np.ndarray:
        """The phrases of keys: the permutation undone."""
        left, right = self.halves(keys)
        for i in reversed(range(ROUNDS)):
            left, right = right ^ (mixed(left, i) & self.mask), left
        one = np.uint64((1 << self.width) - 1)
        first = [left >> np.uint64(self.width * (self.left - 1 - i)) & one for i in range(self.left)]
        rest = self.n - self.left
        return np.stack([*first, *[right >> np.uint64(self.width * (rest - 1 - i)) & one for i in range(rest)]], axis=1).astype(np.int64)

    def segments(self, keys: np.ndarray) -> np.ndarray:
        return (self.halves(keys)[0] >> np.uint64(self.half - self.segment_bits)).astype(np.int64) if self.segment_bits else np.zeros(len(keys), np.int64)

    # A filter of one segment: entries, quotient bits, large counts; quotients; remainders; counters.

    def packed(self, keys: np.ndarray, counts: np.ndarray) -> bytes:
        """Distinct sorted keys of one segment, and their counts, as a filter."""
        n, under = len(keys), self.half - self.segment_bits
        whole = -(-max(0, under - max(0, n.bit_length() - 1)) // 8)
        bits = max(0, under - 8 * whole)
        left, right = self.halves(keys)
        left = left & np.uint64((1 << under) - 1)
        quotient = (left >> np.uint64(under - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
        unary = np.zeros(n + (1 << bits), bool)
        unary[np.arange(n) + quotient] = True
        parts = [np.packbits(unary).tobytes()]
        for half, size in ((left, whole), (right, -(-self.half // 8))):
            parts.append(np.ascontiguousarray(half.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes())
        many = counts > 1
        small = np.minimum(counts[many], 255).astype(np.uint8)
        large = counts[many][small == 255].astype("<u8")
        parts += [np.packbits(many).tobytes(), small.tobytes(), large.tobytes()]
        return np.array([n, bits, len(small)], "<u4").tobytes() + b"".join(parts)

    def unpacked(self, segment: int, filter_: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of a filter."""
        n, bits, several = np.frombuffer(filter_, "<u4", 3).tolist()
        at, under = 12, self.half - self.segment_bits

        def take(count: int, kind="u1") -> np.ndarray:
            nonlocal at
            values = np.frombuffer(filter_, kind, count, at)
            at += values.nbytes
            return values

        size = n + (1 << bits)
        quotient = np.flatnonzero(np.unpackbits(take(-(-size // 8)), count=size)) - np.arange(n)
        whole = -(-max(0, under - bits) // 8)
        halves = []
        for width in (whole, -(-self.half // 8)):
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = take(n * width).reshape(n, width)
            halves.append(wide.view("<u8").ravel().astype(np.uint64))
        left, right = halves
        left = left & np.uint64((1 << (under - bits)) - 1) | (quotient.astype(np.uint64) << np.uint64(under - bits) if bits else np.uint64(0))
        if self.segment_bits:
            left = left | np.uint64(segment << under)
        many = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
        counts = np.ones(n, np.int64)
        small = take(several).astype(np.int64)
        small[small == 255] = take(int((small == 255).sum()), "<u8")
        counts[many] = small
        return self.joined(left, right), counts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


def squeezed(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed, behind their length."""
    data = values.astype("<i4").tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), "<i4").astype(np.int64)


def chunked(df: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(chunk, codes, words): numbers of the chunk's words in turn, 0 behind each piece, and (lang, word, n) of number 1, 2, .."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, held, size = TaskContext.get().partitionId() << 32, [], 0

        def chunk() -> pa.RecordBatch:
            words = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
            langs = pa.concat_arrays([h[1] for h in held]).dictionary_encode()
            pieces, lengths = (np.concatenate([h[i] for h in held]) for i in (2, 3))
            tongue = np.repeat(np.repeat(langs.indices.to_numpy(), pieces), lengths).astype(np.int64)
            pair, number, counts = np.unique(tongue * len(words.dictionary) + words.indices.to_numpy(), return_inverse=True, return_counts=True)
            codes = np.zeros(len(number) + len(lengths), np.int64)
            codes[np.arange(len(number)) + np.repeat(np.arange(len(lengths)), lengths)] = number + 1
            of = [langs.dictionary.take(pa.array(pair // max(1, len(words.dictionary)))), words.dictionary.take(pa.array(pair % max(1, len(words.dictionary)))).cast(pa.string()), pa.array(counts)]
            listed = pa.ListArray.from_arrays(pa.array([0, len(pair)], pa.int32()), pa.StructArray.from_arrays(of, names=["lang", "word", "n"]))
            return pa.RecordBatch.from_arrays([pa.array([serial], pa.int64()), pa.array([squeezed(codes)], pa.binary()), listed], names=["chunk", "codes", "words"])

        for batch in small_batches(batches, "text", 4 << 20):
            if not batch.num_rows:
                continue
            lists = pc.split_pattern(translated(batch.column("text"), PIECES), "\n")
            words, lengths = split_words(lists.flatten())
            held.append((words, batch.column("lang"), pc.list_value_length(lists).to_numpy(), lengths))
            size += len(words)
            if size >= TOGETHER:
                yield chunk()
                held, size, serial = [], 0, serial + 1
        if held:
            yield chunk()

    docs = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(run, "chunk bigint, codes binary, words array<struct<lang:string,word:string,n:bigint>>")


def densely_numbered(df: DataFrame, out: str) -> DataFrame:
    """The rows with numbers from 1: places within the written pieces, behind the rows of the pieces before."""
    placed = F.monotonically_increasing_id()
    rows = written(df.withColumn("_piece", F.spark_partition_id()).withColumn("_place", placed - F.shiftleft(F.col("_piece").cast("bigint"), 33)), "numbered")
    starts, total = [], 0
    for row in rows.groupBy("_piece").count().orderBy("_piece").collect():  # one row per piece
        starts.append((row["_piece"], total))
        total += row["count"]
    table = df.sparkSession.createDataFrame(starts, "_piece int, _start bigint")
    return rows.join(F.broadcast(table), "_piece").withColumn(out, F.col("_start") + F.col("_place") + 1).drop("_piece", "_place", "_start")


def runs_of(text: np.ndarray, least: int) -> np.ndarray:
    """The same text without runs of fewer than `least` numbers; one 0 behind each run."""
    there = text > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], there, [False])).astype(np.int8)))
    start, stop = edges[::2], edges[1::2]
    keep = stop - start >= least
    return joined_runs(text, start[keep], stop[keep])


def joined_runs(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Parts of a text, one after the other, with a 0 behind each."""
    length = stop - start + 1
    ends = np.cumsum(length)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - length - start, length)
    result = np.append(text, 0)[at]
    result[ends - 1] = 0
    return result


def phrases_of(text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where n words follow each other, and the words."""
    if len(text) < n:
        return np.zeros(0, np.int64), np.zeros((0, n), np.int64)
    all_ = np.lib.stride_tricks.sliding_window_view(text, n)
    places = np.flatnonzero((all_ > 0).all(axis=1))
    return places, all_[places]


def sent_filters(texts: DataFrame, how: Phrases) -> DataFrame:
    """(segment, chunk, filter): phrases of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("codes"), strict=True):
                _, words = phrases_of(unsqueezed(data.as_py()), how.n)
                if not len(words):
                    continue
                keys, counts = np.unique(how.keys(words), return_counts=True)
                there, start = np.unique(how.segments(keys), return_index=True)
                ends = [*start[1:].tolist(), len(keys)]
                filters = [how.packed(keys[a:z], counts[a:z]) for a, z in zip(start.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array([chunk] * len(there), pa.int64()), pa.array(filters, pa.binary())], names=["segment", "chunk", "filter"])

    return texts.select("chunk", "codes").mapInArrow(run, "segment bigint, chunk bigint, filter binary")


def merged_filters(sent: DataFrame, how: Phrases, least: int) -> DataFrame:
    """(segment, filter): one filter per segment, with all phrases that the chunks have at least `least` times together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, held, size = None, [], 0

        def together() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        def done() -> pa.RecordBatch:
            keys, counts = together()
            kept = counts >= least
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([how.packed(keys[kept], counts[kept])], pa.binary())], names=["segment", "filter"])

        for batch in batches:
            for next_, data in zip(batch.column("segment").to_pylist(), batch.column("filter"), strict=True):
                if next_ != segment and held:
                    yield done()
                    held, size = [], 0
                segment = next_
                held.append(how.unpacked(segment, data.as_py()))
                size += len(held[-1][0])
                if size >= GATHERED + 2 * len(held[0][0]):
                    held = [together()]
                    size = len(held[0][0])
        if held:
            yield done()

    return sent.select("segment", "filter").repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment bigint, filter binary")


def answers(sent: DataFrame, frequent: DataFrame, how: Phrases) -> DataFrame:
    """(chunk, segment, marks): for each sent filter one bit per entry, whether it is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = None
        for batch in batches:
            out: list[list] = [[], [], []]
            for segment, chunk, data in zip(batch.column("segment").to_pylist(), batch.column("chunk").to_pylist(), batch.column("filter"), strict=True):
                own, _ = how.unpacked(segment, data.as_py())
                if chunk < 0:
                    keys = own  # the segment's frequent phrases come first
                    continue
                at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                marks = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                for column, value in zip(out, (chunk, segment, np.packbits(marks).tobytes()), strict=True):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["chunk", "segment", "marks"])

    first = frequent.select("segment", F.lit(-1).cast("bigint").alias("chunk"), "filter")
    rows = first.unionByName(sent.select("segment", "chunk", "filter"))
    return rows.repartition("segment").sortWithinPartitions("segment", "chunk").mapInArrow(run, "chunk bigint, segment bigint, marks binary")


def cut_down(texts: DataFrame, told: DataFrame, how: Phrases) -> DataFrame:
    """(chunk, codes): texts cut down to runs whose phrases are all frequent and that hold a longer phrase."""
    marks = told.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("segment", "marks"))).alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data, parts in zip(batch.column("chunk").to_pylist(), batch.column("codes"), batch.column("told"), strict=True):
                text = unsqueezed(data.as_py())
                places, words = phrases_of(text, how.n)
                keys, which = np.unique(how.keys(words), return_inverse=True)
                _, sizes = np.unique(how.segments(keys), return_counts=True)
                bits = [np.unpackbits(np.frombuffer(p["marks"].as_py(), np.uint8), count=n) for p, n in zip(parts.values, sizes.tolist(), strict=True)]
                good = np.concatenate(bits).astype(bool)[which]
                kept = np.zeros(len(text) + 1, np.int8)
                kept[places[good]] = 1
                edges = np.flatnonzero(np.diff(kept, prepend=0))
                start, stop = edges[::2], edges[1::2] + how.n - 1
                long = stop - start > how.n
                codes = joined_runs(text, start[long], stop[long])
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([squeezed(codes)], pa.binary())], names=["chunk", "codes"])

    return texts.join(marks, "chunk").mapInArrow(run, "chunk bigint, codes binary")


def listed(frequent: DataFrame, how: Phrases) -> DataFrame:
    """(ids, f) of all phrases of filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, data in zip(batch.column("segment").to_pylist(), batch.column("filter"), strict=True):
                keys, counts = how.unpacked(segment, data.as_py())
                words = how.words(keys)
                for at in range(0, len(keys), 10_000):
                    cut = words[at : at + 10_000]
                    ids = pa.ListArray.from_arrays(pa.array(np.arange(0, cut.size + 1, how.n), pa.int32()), pa.array(cut.ravel()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(counts[at : at + 10_000])], names=["ids", "f"])

    return frequent.mapInArrow(run, "ids array<bigint>, f bigint")


def phrase_counts(df: DataFrame, lang: str = "lang", text: str = "text", longest: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts of all phrases that occur at least `least` times in their language.

    (lang, n): all word occurrences; (id, lang, word, n): frequent words; (ids, f): frequent phrases of 2 to `longest` words.
    """
    chunks = written(chunked(df, lang, text), "chunks")
    counts = chunks.select(F.explode("words").alias("w")).groupBy("w.lang", "w.word").agg(F.sum("w.n").alias("n"))
    counts = written(counts, "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words = written(densely_numbered(counts.where(F.col("n") >= least), "id"), "words")
    told = words.agg(F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    width = max(1, int(told[0]).bit_length())
    if width > 32:
        raise ValueError("more than 2^32 frequent words")
    segment_bits = max(4, min(MOST_SEGMENTS.bit_length() - 1, (told[1] // PER_SEGMENT).bit_length()))

    known = chunks.select("chunk", F.posexplode("words").alias("place", "w")).select("chunk", "place", "w.lang", "w.word")
    known = known.join(words.select("lang", "word", "id"), ["lang", "word"])
    known = known.groupBy("chunk").agg(F.collect_list("place").alias("places"), F.collect_list("id").alias("ids"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data, places, ids in zip(batch.column("chunk").to_pylist(), *(batch.column(c) for c in ("codes", "places", "ids")), strict=True):
                codes = unsqueezed(data.as_py())
                table = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
                table[places.values.to_numpy() + 1] = ids.values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([squeezed(runs_of(table[codes], 2))], pa.binary())], names=["chunk", "codes"])

    texts = written(chunks.select("chunk", "codes").join(known, "chunk").mapInArrow(number, "chunk bigint, codes binary"), "texts")
    phrases = None
    for n in range(2, longest + 1):
        how = Phrases(n, width, segment_bits)
        sent = written(sent_filters(texts, how), "sent")
        frequent = written(merged_filters(sent, how, least), "frequent")
        found = listed(frequent, how)
        phrases = found if phrases is None else phrases.unionByName(found)
        if n < longest:
            texts = written(cut_down(texts, answers(sent, frequent, how), how), "texts")
    return totals, words, written(phrases, "phrases")


def collocations(df: DataFrame, top: int = 2000, lang: str = "lang", text: str = "text", longest: int = 4, least: int = 30, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by score, then a, then the phrase.

    Pieces end at .,;:!? and line ends, words at blanks and tabs. Cutting a phrase of a occurrences into parts of l and r
    gives floor(2000000 a / (l + r)), its lowest cut counts (of equal ones the first). A phrase goes if a longer one
    that holds it has `share` percent of its occurrences or more. A missing language is `und`; null and empty texts have
    no words, repeated rows count each, an empty table gives no rows.
    """
    totals, words, phrases = phrase_counts(df, lang, text, longest, least)
    size = F.size("ids")
    parts = words.select(F.array("id").alias("ids"), F.col("n").alias("f")).unionByName(phrases)
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("head"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("tail"))
    cuts = cuts.join(parts.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(parts.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    # 38 digits hold every product.
    score = F.expr("cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))").cast("bigint")
    lowest = cuts.select("ids", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("ids", "a").agg(F.min("cut").alias("cut"))
    # Every shorter phrase within a phrase, with the most that a phrase around it has.
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), i -> slice(ids, i, m))))")
    around = phrases.where(size > 2).select(F.explode(inner).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("more"))
    dropped = F.expr(f"cast(more as decimal(19,0)) * cast(100 as decimal(3,0)) >= cast(a as decimal(19,0)) * cast({share} as decimal(3,0))")
    left = lowest.join(around, "ids", "left").where(~F.coalesce(dropped, F.lit(False))).select("ids", "a", "cut.*")
    # The words of each phrase.
    spelt = left.select("ids", "a", "l", "r", "score", F.posexplode("ids").alias("place", "id")).join(words.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("ids", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"))
    rows = spelt.select("lang", F.array_join("w.word", " ").alias("phrase"), "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The best of each part of a language first, so a large language is not one task.
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(pieces)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
