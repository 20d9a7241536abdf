"""Spelling variants: words that differ by one code point, found by pairs of numbered trie nodes.

Words of all documents are counted. Sorted, each word adds the nodes behind the prefix that it shares
with the word before it, so the forward trie is numbered along the sort, and the backward trie along the
sort of the reversed words. A node stands for its whole prefix (or suffix), whatever its length. A word
gives pairs (prefix node, suffix node) that leave one position out, and pairs that leave none out. Two
words that share a pair with a position left out differ by a replacement there; a word whose whole pair
is another one's pair with a position left out lacks that one code point. Pairs are exact, so nothing is
verified, and a pair has one whole word and as many others as there are code points in words at most (90).

The sort is cut into pieces. A piece numbers its nodes by itself; the first and the last word of the
pieces, two per piece, tell which nodes of a piece's first word another one has numbered already.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .common import documents, small_batches
from .words import kept_bytes

# Latin-1 has a byte for each code point of a word: a-z and U+00C0 to U+00FF.
LETTERS = kept_bytes({*range(0x61, 0x7B), *range(0xC0, 0x100)})
# Distinct words that a map step counts before it hands them on.
TOGETHER = 400_000
PIECE = 40


def edited(doc: str, run: bytes, every: int) -> bytes:
    """The run (Latin-1), without one code point if `every` divides the hash of the document and the run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(f"{doc}:".encode()))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 7, every: int = 31) -> DataFrame:
    """(word, n) of all whole texts: runs of letters in lower case, some of them with a code point deleted, of at least `length`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in counter]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counter.values()), pa.int64())], names=["word", "n"])

        for batch in small_batches(batches, "text"):
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                # Other code points become question marks, which end a run.
                runs = Counter(value.encode("latin-1", "replace").translate(LETTERS).split())
                name = "" if doc is None else str(doc)
                for word, n in runs.items():
                    if len(word) >= length and len(word := edited(name, word, every)) >= length:
                        counter[word] += n
            if len(counter) >= TOGETHER:
                yield rows()
                counter = Counter()
        if counter:
            yield rows()

    return documents(df, key, text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def shared_length(a: str, b: str) -> int:
    """Code points that two words begin with alike."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def numbered_trie(words: DataFrame) -> DataFrame:
    """(word, .., piece, rank, nodes): nodes of each of the sorted words, from the root (0) to the word itself.

    Nodes of a piece are numbered from 1, the first word's first; `aliases` tells which of those are another's.
    """
    others = [c for c in words.columns if c != "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, rank, last, path, count = TaskContext.get().partitionId(), 0, "", [0], 0
        base = piece << PIECE
        for batch in batches:
            paths = []
            for word in batch.column("word").to_pylist():
                common = shared_length(last, word)
                new = len(word) - common
                path = [*path[: common + 1], *range(base + count + 1, base + count + new + 1)]
                count, last = count + new, word
                paths.append(path)
            n = batch.num_rows
            columns = [batch.column(c) for c in ["word", *others]]
            columns += [pa.array(np.full(n, piece)), pa.array(base + rank + np.arange(n)), pa.array(paths, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", *others, "piece", "rank", "nodes"])
            rank += n

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.select("word", *others).schema.fields)
    ordered = words.repartitionByRange("word").sortWithinPartitions("word")
    return written(ordered.mapInArrow(run, f"{schema}, piece bigint, rank bigint, nodes array<bigint>"), "trie")


def aliases(trie: DataFrame) -> dict[int, np.ndarray]:
    """Of each piece the numbers, from depth 0, of the nodes that its first word shares with the pieces before it."""
    ends = trie.groupBy("piece").agg(F.min("word").alias("first"), F.max_by(F.struct("word", "nodes"), "word").alias("last")).orderBy("piece").collect()
    result, before, path = {}, "", np.zeros(1, np.int64)
    for row in ends:
        if row["first"] < before:
            raise RuntimeError("pieces are not in the order of their words")
        own = path[: shared_length(before, row["first"]) + 1]
        result[row["piece"]] = own
        path, before = resolved(np.array(row["last"]["nodes"], np.int64), row["piece"], own), row["last"]["word"]
    return result


def resolved(nodes: np.ndarray, piece: int, own: np.ndarray) -> np.ndarray:
    """Nodes of a piece, those that another piece has numbered under that number; own: its aliases."""
    local = nodes - (piece << PIECE)
    foreign = (local > 0) & (local < len(own))
    return np.where(foreign, own[np.where(foreign, local, 0)], nodes)


def node_pairs(words: DataFrame, forward: dict[int, np.ndarray], backward: dict[int, np.ndarray]) -> DataFrame:
    """(p, s, id, n, kind) per word and position: kind 0 leaves none out, 1 and 2 leave the position out.

    2: the code point is the same as the one before it, so the word without it has been told already.
    """
    context = words.sparkSession.sparkContext
    tries = context.broadcast((forward, backward))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for word, id_, n, first, ahead, last, behind in zip(*(batch.column(c).to_pylist() for c in ("word", "id", "n", "first", "ahead", "last", "behind")), strict=True):
                p = resolved(np.array(ahead, np.int64), first, tries.value[0][first])
                s = resolved(np.array(behind, np.int64), last, tries.value[1][last])[::-1]
                length = len(word)
                letters = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
                kind = np.ones(length, np.int8)
                kind[1:] += letters[1:] == letters[:-1]
                for held, part in zip(columns, ((p, p[:-1]), (s, s[1:]), (np.full(2 * length + 1, id_),), (np.full(2 * length + 1, n),), (np.zeros(length + 1, np.int8), kind)), strict=True):
                    held.extend(part)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["p", "s", "id", "n", "kind"])

    return words.mapInArrow(run, "p bigint, s bigint, id bigint, n bigint, kind tinyint")


def nearest(pairs: DataFrame) -> DataFrame:
    """(id, n_near, form): words that are near, and the one of them with the largest n, then the smallest id."""
    member = F.struct((-F.col("n")).alias("less"), "id", "kind")
    met = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list(member)).alias("m")).where("size(m) > 1")
    # Words that lack the position meet no whole word twice: one of several equal code points stands for all.
    near = "filter(m, y -> y.id <> x.id and case x.kind when 0 then y.kind = 1 when 1 then true else y.kind > 0 end)"
    told = met.select(F.expr(f"inline(transform(m, x -> named_struct('id', x.id, 'near', {near})))")).where("size(near) > 0")
    best = F.col("near")[0]
    return told.groupBy("id").agg(F.sum(F.size("near")).alias("n_near"), F.min(F.struct(best["less"].alias("less"), best["id"].alias("id"))).alias("form"))


def roots(edges: DataFrame) -> DataFrame:
    """(id, root): the end of each chain of edges (id, form). Counts grow tenfold at a step, so chains are short."""
    found = written(edges.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = written(found.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = step.select("id", "root")
        if step.where("moved").isEmpty():
            return found


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 7, least: int = 2, ratio: int = 10, every: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all whole texts with at least `length` code points and `least` occurrences.

    form: the near word of largest n (then the smallest in code-point order), if that is at least `ratio` times the
    word's n, else null. root: the last of the forms that follow each other, the word itself if it has none.
    A null text has no words, a row without id counts as one with an empty id; repeated rows count each. An
    empty table gives no rows.
    """
    counts = word_counts(df, key, text, length, every).where(F.col("n") >= least)
    ahead = numbered_trie(counts)
    behind = numbered_trie(ahead.select(F.reverse("word").alias("word"), F.col("rank").alias("id")))
    words = ahead.select("word", "n", F.col("rank").alias("id"), F.col("piece").alias("first"), F.col("nodes").alias("ahead"))
    both = words.join(behind.select("id", F.col("piece").alias("last"), F.col("nodes").alias("behind")), "id")
    near = nearest(node_pairs(both, aliases(ahead), aliases(behind)))
    told = written(words.select("id", "word", "n").join(near, "id", "left"), "near")
    has = F.col("n") * ratio <= -F.col("form.less")
    edges = told.where(has).select("id", F.col("form.id").alias("form"), (-F.col("form.less")).alias("form_n"))
    ends = edges.join(roots(edges), "id")
    names = words.select("id", "word")
    chains = ends.join(names.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form")
    chains = chains.join(names.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    result = told.select("id", "word", "n", "n_near").join(chains.select("id", "form_word", "root_word", "form_n"), "id", "left")
    return result.select(
        "word",
        F.col("form_word").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        "form_n",
    )
