"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Tokens are words (A-Z in lower case) and one end per document. `learnt` counts word pairs of the training
documents, and takes the words beyond the most frequent ones, each quantised to levels 1, 2, ... of powers of
two: an n-gram of level q is entered as (n-gram, 1) to (n-gram, q), and its level is read by probing until a
probe fails. The filter is cut into segments by hash, each as large as its entries ask for, so none is left
out; one task counts and fills a segment, and the segments are a table in the shared folder.

`scored` probes it for the documents of any table. A filter below a bound in bytes goes to every worker. A
larger one stays where it is: the distinct n-grams of a chunk of documents go to their segments, and only
levels come back. Both ways give the same rows. Probabilities are smoothed with a Dirichlet prior on words:
P(w|h) = (c(h,w) + mu P(w)) / (c(h) + mu). Counts of the most frequent words are exact and held by every
worker.

Beside it stands an exact base score of word counts over all training documents: frequent words from the
workers, all others by a join on the word.
"""

from __future__ import annotations

import secrets
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written
from .common import documents, fold, small_batches, tidy

# The end of a document; no word holds a line feed.
END = b"\n"
PROBES, BITS_PER_ENTRY, MOST_LEVEL = 4, 9, 30
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
# Words whose exact counts every worker holds, at most, and their longest.
FREQUENT, LONGEST = 200_000, 64
# Tokens that a map step counts before it hands them on.
TOGETHER = 1_500_000
# Training tokens, and bytes of text that ask, for each segment at most (on average): what one task holds.
SEGMENT_TOKENS, SEGMENT_TEXT = 2_000_000, 16 << 20
# Bytes of text in a chunk: at least, per segment, and at most.
CHUNK, CHUNK_PER_SEGMENT, MOST_CHUNK = 9_000_000, 2_200, 32_000_000
# What travels of an n-gram to its segment: 48 bits, and a count in one byte or four.
SENT = "segment bigint, spread int, chunk bigint, digest bigint, high binary, low binary, small binary, large binary"


def tokens_of(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    values = (values + np.uint64(salt)) * MIX[0]
    values = (values ^ (values >> np.uint64(31))) * MIX[1]
    return values ^ (values >> np.uint64(29))


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * MIX[1] ^ right, 3)


def levels(counts: np.ndarray) -> np.ndarray:
    """Level of a count: 1 for 1, and one more for each doubling."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], MOST_LEVEL)


def middle(level: np.ndarray) -> np.ndarray:
    """Count that stands for a level; 0 for level 0."""
    return np.where(level > 0, np.exp2(np.maximum(level, 1) - 1) * np.where(level > 1, 1.4142, 1.0), 0.0)


class LogFilter:
    """One segment's bits; their number is a multiple of 8."""

    def __init__(self, segment_bits: int, bits: np.ndarray | None = None):
        self.segment_bits = segment_bits
        self.bits = np.zeros(segment_bits // 8, np.uint8) if bits is None else bits

    @classmethod
    def stored(cls, bits: bytes) -> LogFilter:
        return cls(8 * len(bits), np.frombuffer(bits, np.uint8))

    def places(self, grams: np.ndarray, level: np.ndarray | int) -> np.ndarray:
        """Bit numbers of each entry, one row per probe."""
        first = mixed(grams ^ (np.uint64(0x517CC1B727220A95) * np.asarray(level).astype(np.uint64)), 5)
        second = (first >> np.uint64(32)) | np.uint64(1)
        return np.stack([(first + np.uint64(i) * second) % np.uint64(self.segment_bits) for i in range(PROBES)])

    def filled(self, grams: np.ndarray, counts: np.ndarray) -> bytes:
        """Bits of one segment, with all its n-grams; `sized` says how many bits they need."""
        level = levels(counts)
        marks = np.zeros(self.segment_bits, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            marks[self.places(grams[level >= q], q)] = True
        return np.packbits(marks, bitorder="little").tobytes()

    @classmethod
    def sized(cls, grams: np.ndarray, counts: np.ndarray) -> LogFilter:
        """One segment that gives each of its entries BITS_PER_ENTRY bits."""
        bits = BITS_PER_ENTRY * int(levels(counts).sum())
        one = cls(max(64, -(-bits // 64) * 64))
        one.bits = np.frombuffer(one.filled(grams, counts), np.uint8)
        return one

    def level(self, grams: np.ndarray) -> np.ndarray:
        """Level of each n-gram, by probing upwards until a probe fails."""
        result = np.zeros(len(grams), np.int64)
        left = np.arange(len(grams))
        for q in range(1, MOST_LEVEL + 1):
            at = self.places(grams[left], q).astype(np.int64)
            left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)]
            if not len(left):
                break
            result[left] = q
        return result


def coded(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens of some texts, the number of each token in turn, and tokens per text."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    parts, lengths = [], []
    for text in texts:
        tokens = tokens_of(text)
        lengths.append(len(tokens))
        parts.append(np.fromiter((number(t, len(known)) for t in tokens), np.int64, len(tokens)))
    return list(known), np.concatenate([np.zeros(0, np.int64), *parts]), np.array(lengths, np.int64)


def hashed(tokens: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, tokens), np.uint64, len(tokens))


def histories(codes: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The token before each one; before the first of a text stands an end."""
    before = np.concatenate(([end], codes[:-1]))
    before[(np.cumsum(lengths) - lengths)] = end
    return before


def word_counts(train: DataFrame) -> DataFrame:
    """(word BINARY, n) over whole texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held = Counter(), 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                tokens = tokens_of(text)
                counter.update(tokens)
                held += len(tokens)
                if held >= TOGETHER:
                    yield rows()
                    counter, held = Counter(), 0
        if held:
            yield rows()

    return train.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def packed(batches: list[pa.RecordBatch]) -> bytes:
    """Rows as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        for batch in batches:
            stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


@dataclass(frozen=True)
class LanguageModel:
    """What was learnt: `table` (segment, size, bits) of the filter, exact `counts` (word, n, step) of words,
    of which those from step `least` on are frequent; all tokens and distinct tokens; bytes of the filter."""

    table: DataFrame
    counts: DataFrame
    least: int
    segments: int
    tokens: int
    distinct: int
    size: int

    def frequent(self) -> dict[bytes, int]:
        """Exact counts of at most FREQUENT words of at most LONGEST bytes."""
        rows = self.counts.where((F.col("step") >= self.least) & (F.col("step") >= 0)).select("word", "n").collect()
        return {bytes(r["word"]): r["n"] for r in rows}

    def rare(self) -> DataFrame:
        return self.counts.where((F.col("step") < self.least) | (F.col("step") < 0))


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, list[pa.RecordBatch]]]:
    """Batches of about `size` bytes of text, with a number and a digest that a second reading gives again."""
    first, serial, held, bytes_held = TaskContext.get().partitionId() << 32, 0, [], 0

    def named() -> tuple[int, int, list[pa.RecordBatch]]:
        digest = xxhash.xxh64()
        for batch in held:
            for text in batch.column("text"):
                digest.update(text.as_buffer())
                digest.update(b"\0")
        return first + serial, digest.intdigest() >> 1, held

    for batch in small_batches(batches, "text", 1 << 20):
        if not batch.num_rows:
            continue
        held.append(batch)
        bytes_held += batch.column("text").nbytes
        if bytes_held >= size:
            yield named()
            held, bytes_held, serial = [], 0, serial + 1
    if held:
        yield named()


def texts_of(held: list[pa.RecordBatch]) -> list[str]:
    return [t for batch in held for t in batch.column("text").to_pylist()]


def kept_bits(segments: int) -> np.uint64:
    """The bits of an n-gram's hash that tell it apart: those of its segment, and 48."""
    return ~np.uint64(0) << np.uint64(65 - segments.bit_length()) | np.uint64(2**48 - 1)


def pairs_of(known: list[bytes], codes: np.ndarray, lengths: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens as single words, of the pair at each token, and the token before each."""
    hashes = hashed(known)
    before = histories(codes, lengths, known.index(END))
    return mixed(hashes, 1) & kept_bits(segments), pair_hashes(hashes[before], hashes[codes]) & kept_bits(segments), before


def to_segments(grams: np.ndarray, counts: np.ndarray, segments: int, spread: int = 0, chunk: int = 0, digest: int = 0) -> pa.RecordBatch:
    """Sorted n-grams, one row per segment that has any."""
    owner = (grams >> np.uint64(65 - segments.bit_length())).astype(np.int64)
    there, starts = np.unique(owner, return_index=True)
    ends = [*starts[1:].tolist(), len(grams)]
    high, low, small = (grams >> np.uint64(32)).astype("<u2"), grams.astype("<u4"), np.minimum(counts, 255).astype(np.uint8)
    spans = list(zip(starts.tolist(), ends, strict=True))
    columns = [
        pa.array(there, pa.int64()),
        pa.array(np.full(len(there), spread, np.int32)),
        pa.array(np.full(len(there), chunk, np.int64)),
        pa.array(np.full(len(there), digest, np.int64)),
        pa.array([high[a:b].tobytes() for a, b in spans], pa.binary()),
        pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
        pa.array([small[a:b].tobytes() for a, b in spans], pa.binary()),
        pa.array([counts[a:b][small[a:b] == 255].astype("<u8").tobytes() for a, b in spans], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SENT.split(", ")])


def joined(part: pd.DataFrame, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(part[column]), kind)


def grams_of(part: pd.DataFrame, segment: int, segments: int) -> np.ndarray:
    """The n-grams of rows that `to_segments` has made."""
    rest = joined(part, "high", "<u2").astype(np.uint64) << np.uint64(32) | joined(part, "low", "<u4")
    below = ~np.uint64(0) >> np.uint64(segments.bit_length() - 1)
    return np.uint64(segment) << np.uint64(65 - segments.bit_length()) | rest & below


def chunk_size(segments: int) -> int:
    return min(MOST_CHUNK, max(CHUNK, CHUNK_PER_SEGMENT * segments))


def power_of_two(least: float) -> int:
    return 1 << max(1, int(np.ceil(np.log2(max(2.0, least)))))


def learnt(train: DataFrame, segments: int = 256) -> LanguageModel:
    """The model of whole texts (doc_id, text). segments: of the filter, at least; there are four per shuffle
    partition, and one for each SEGMENT_TOKENS tokens. Everything is counted, nothing left out."""
    counts = written(word_counts(train), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # Counts in steps of 2^(1/64), at most some 4,000 of them, tell from which step on words are frequent.
    counts = counts.withColumn("step", F.when(F.length("word") <= LONGEST, F.floor(F.log2("n") * 64)).otherwise(-1))
    least, held = 0, 0
    for row in sorted(counts.groupBy("step").count().collect(), reverse=True):
        held += row["count"]
        if held > FREQUENT:
            least = row["step"] + 1
            break
    partitions = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = power_of_two(max(segments, 4 * partitions, total["n"] / SEGMENT_TOKENS))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, held in chunks(batches, chunk_size(segments)):
            known, codes, lengths = coded(texts_of(held))
            yield to_segments(*np.unique(pairs_of(known, codes, lengths, segments)[1], return_counts=True), segments)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, times, held = [], [], 0

        def rows() -> pa.RecordBatch:
            every, n = np.concatenate(grams), np.concatenate(times)
            order = np.argsort(every, kind="stable")
            return to_segments(every[order], n[order], segments)

        for batch in batches:
            grams.append(mixed(hashed(batch.column("word").to_pylist()), 1) & kept_bits(segments))
            times.append(batch.column("n").to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= TOGETHER:
                yield rows()
                grams, times, held = [], [], 0
        if held:
            yield rows()

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        segment = int(part["segment"].iloc[0])
        times = joined(part, "small", np.uint8).astype(np.int64)
        times[times == 255] = joined(part, "large", "<u8")
        grams, which = np.unique(grams_of(part, segment, segments), return_inverse=True)
        one = LogFilter.sized(grams, np.bincount(which, times, len(grams)).astype(np.int64))
        return pd.DataFrame({"segment": [segment], "size": [len(one.bits)], "bits": [one.bits.tobytes()]})

    rare = counts.where((F.col("step") < least) | (F.col("step") < 0)).select("word", "n")
    sent = train.select("text").mapInArrow(tidy("lm", pairs), SENT).unionByName(rare.mapInArrow(words, SENT))
    table = written(sent.groupBy("segment").applyInPandas(fill, "segment bigint, size bigint, bits binary"), "filter")
    size = table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()["size"]
    return LanguageModel(table, counts, least, segments, total["n"], total["v"], size)


def asked(known: list[bytes], codes: np.ndarray, lengths: np.ndarray, exact: dict[bytes, int], segments: int) -> tuple[np.ndarray, ...]:
    """The distinct n-grams that a chunk asks the filter for, sorted; then where its pairs and its words
    stand among them, exact counts of its words (-1: rare, asked for) and the token before each."""
    words, pairs, before = pairs_of(known, codes, lengths, segments)
    count = np.fromiter((exact.get(w, -1) for w in known), np.int64, len(known))
    grams, which = np.unique(np.concatenate([pairs, words[count < 0]]), return_inverse=True)
    single = np.zeros(len(known), np.int64)
    single[count < 0] = which[len(pairs) :]
    return grams, which[: len(pairs)], single, count, before


SCORED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, own double, score double, rest array<struct<word:binary,times:bigint>>"


def chunk_scores(rows: pa.Table, exact: dict[bytes, int], segments: int, below: float, prior: float, levels_of: Callable[[np.ndarray], np.ndarray]) -> pd.DataFrame:
    """Scores of a chunk's documents, given the levels of its n-grams."""
    known, codes, lengths = coded(rows.column("text").to_pylist())
    grams, pair_at, word_at, count, before = asked(known, codes, lengths, exact, segments)
    value = middle(levels_of(grams))
    single = np.where(count < 0, value[word_at], count)
    word = (single[codes] + 0.5) / below
    history = single[before]
    logs = np.log10((np.minimum(value[pair_at], history) + prior * word) / (history + prior))
    own = np.log10((np.maximum(count, 0) + 0.5) / below)[codes] * (count[codes] >= 0)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    rest = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        rare = codes[a:b][count[codes[a:b]] < 0]
        rest.append([{"word": known[c], "times": t} for c, t in Counter(rare.tolist()).items()])
    return pd.DataFrame(
        {
            "row": (secrets.randbits(39) << 24) + np.arange(len(lengths)),
            "doc_id": rows.column("doc_id").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get),
            "held_out": rows.column("held_out").to_pandas(),
            "n_tokens": lengths,
            "known": np.add.reduceat((count[codes] > 0).astype(np.int64), starts),
            "own": np.add.reduceat(own, starts),
            "score": np.add.reduceat(logs, starts),
            "rest": rest,
        }
    )


def scored_by_broadcast(spark: SparkSession, docs: DataFrame, model: LanguageModel, exact, below: float, prior: float) -> DataFrame:
    """Every worker holds the whole filter; the caller has checked its size."""
    segments, shift = model.segments, np.uint64(65 - model.segments.bit_length())
    filters = spark.sparkContext.broadcast({r["segment"]: bytes(r["bits"]) for r in model.table.select("segment", "bits").collect()})

    def levels_of(grams: np.ndarray) -> np.ndarray:
        result = np.zeros(len(grams), np.int64)
        there, starts = np.unique((grams >> shift).astype(np.int64), return_index=True)
        for segment, a, b in zip(there.tolist(), starts.tolist(), [*starts[1:].tolist(), len(grams)], strict=True):
            if segment in filters.value:
                result[a:b] = LogFilter.stored(filters.value[segment]).level(grams[a:b])
        return result

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, held in chunks(batches, CHUNK):
            found = chunk_scores(pa.Table.from_batches(held), exact.value, segments, below, prior, levels_of)
            yield pa.RecordBatch.from_pandas(found, schema=SCORED_ARROW, preserve_index=False)

    return docs.mapInArrow(tidy("lm", run), SCORED)


SCORED_ARROW = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("known", pa.int64()),
        ("own", pa.float64()),
        ("score", pa.float64()),
        ("rest", pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))),
    ]
)


def scored_by_shuffle(docs: DataFrame, model: LanguageModel, exact, below: float, prior: float) -> DataFrame:
    """The distinct n-grams of each chunk go to their segments, and levels come back to the chunk.

    The documents are read twice, once to ask and once to score; chunks carry a digest of their texts, and a
    frame that gives other chunks the second time fails. A segment that many documents ask is copied, so that
    what one task holds does not grow with them.
    """
    segments = model.segments
    text = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    copies = max(1, -(-text // (segments * SEGMENT_TEXT)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, digest, held in chunks(batches, chunk_size(segments)):
            grams = asked(*coded(texts_of(held)), exact.value, segments)[0]
            yield to_segments(grams, np.zeros(len(grams), np.int64), segments, digest % copies, chunk, digest).drop_columns(["small", "large"])

    def answer(key: tuple, part: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"chunk": [], "digest": [], "segment": [], "levels": []})
        ends = np.cumsum(part["low"].str.len().to_numpy() // 4).tolist()
        if len(bits):
            level = LogFilter.stored(bits["bits"].iloc[0]).level(grams_of(part, int(key[0]), segments)).astype(np.uint8)
        else:
            level = np.zeros(ends[-1], np.uint8)
        cut = [level[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pd.DataFrame({"chunk": part["chunk"], "digest": part["digest"], "segment": int(key[0]), "levels": cut})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, digest, held in chunks(batches, chunk_size(segments)):
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "digest": [digest], "rows": [packed(held)]})

    def score(key: tuple, levels: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) != 1 or not len(levels):
            raise ValueError("the documents were others when they were read again; write them to a table first")
        table = pa.ipc.open_stream(rows["rows"].iloc[0]).read_all()
        level = joined(levels.sort_values("segment"), "levels", np.uint8).astype(np.int64)
        return chunk_scores(table, exact.value, segments, below, prior, lambda grams: level)

    questions = docs.mapInArrow(tidy("lm", ask), "segment bigint, spread int, chunk bigint, digest bigint, high binary, low binary")
    filters = model.table.select("segment", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("spread"), "bits")
    answers = questions.groupBy("segment", "spread").cogroup(filters.groupBy("segment", "spread")).applyInPandas(answer, "chunk bigint, digest bigint, segment bigint, levels binary")
    texts = docs.mapInArrow(whole, "chunk bigint, digest bigint, rows binary")
    return answers.groupBy("chunk", "digest").cogroup(texts.groupBy("chunk", "digest")).applyInPandas(score, SCORED)


def scored(docs: DataFrame, model: LanguageModel, megabytes: int = 8, prior: float = 30.0) -> DataFrame:
    """Scores of whole texts (doc_id, text, held_out). megabytes: a filter of at most this size goes to every worker."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "held_out", "text")
    exact = spark.sparkContext.broadcast(model.frequent())
    below = float(model.tokens + 0.5 * (model.distinct + 1))
    by_all = model.size <= megabytes << 20
    rows = scored_by_broadcast(spark, docs, model, exact, below, prior) if by_all else scored_by_shuffle(docs, model, exact, below, prior)
    rows = written(rows, "scored")
    # Words beyond the frequent ones: one row per document and word, joined to their counts.
    rare = rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    counted = rare.join(model.rare(), "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    sums = counted.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(below))).alias("others"),
    )
    return rows.drop("rest").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("own") + F.coalesce("others", F.lit(0.0))).alias("base_score"),
        "score",
    )


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text", megabytes: int = 8, segments: int = 256, prior: float = 30.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Learns from documents whose crc32 of the id, modulo 5, is not 1 (a missing id is learnt from).
    A null or empty text is one end. Repeated rows are learnt and scored each. Without training
    documents every count is 0. megabytes: a filter of at most this size goes to every worker, a larger
    one is asked by a shuffle, with the same rows. segments: of the filter, at least.
    """
    docs = documents(df, key, text).select("doc_id", "text", (fold() == 1).alias("held_out"))
    return scored(docs, learnt(docs.where(~F.col("held_out")), segments), megabytes, prior)
