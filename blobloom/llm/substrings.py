"""Removal of passages that repeat across documents, by suffix trees over prefix-partitioned suffixes.

A window is `window` words. It repeats if another document has it too, and its words go from every
document but the one with the smallest id. All of it runs over words, in four steps:

1. Anchors. Of the 5-word grams in each window the one with the least hash is its anchor, so equal
   windows have equal anchors, at the same place; one gram in five is one. Anchors are dealt by hash,
   and only those that occur in two documents go on. A batch of documents sends an anchor once.
2. Suffixes begin at anchors and are `window` words long, with the words before them that a window
   around the anchor can reach. They are dealt by their first words: by one word, or by as many more
   as it takes until a group fits the memory of a task, up to the five of the anchor. A batch sends a
   suffix that repeats in it once, with the smallest document id.
3. Each group is a suffix tree: sorted suffixes with the length of the common prefix of neighbours. An
   internal node of depth r is a run of neighbours that share r words. With the window - r words
   before the anchor, read backwards, the node's suffixes are windows, and equal ones are one repeat.
4. Windows whose smallest document is smaller than their own go back to it, and cover its words.

Nodes compare whole words, so a hash that collides only costs a comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .common import documents, named, small_batches, tidy

GRAM = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
# Suffixes of a group that one task sorts at once, and counters of prefixes per length.
GROUP, COUNTERS = 100_000, 1 << 14
# Words of the documents that one map step looks at together.
TOGETHER = 600_000
# Different suffixes that a task gathers before it sends them.
GATHERED = 300_000
# Words whose hashes a task remembers.
KNOWN = 250_000


def keyed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, packed): a row is known by its id and its text; texts travel compressed."""
    docs = documents(df, key, text).withColumn("digest", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in small_batches(batches, "text"):
            packed = [press(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(packed, pa.binary())], names=["doc_id", "digest", "packed"])

    return docs.mapInArrow(tidy(None, run), "doc_id bigint, digest bigint, packed binary")


def unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(packed)


class Hashes(dict):
    """Hash of every word that was asked for; begins anew beyond KNOWN words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Numbers(dict):
    """A number for every word that was asked for, from 0 on."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value, the leftmost of equal ones, of every `width` neighbours."""
    place, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left = values[:-step] <= values[step:]
        values, place = np.where(left, values[:-step], values[step:]), np.where(left, place[:-step], place[step:])
        span += step
    return place


def anchors(hashes: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place (in the joined words) of the anchors of documents of these lengths, joined one after the other."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for j in range(GRAM):
        grams = grams * MIX + hashes[j : n - GRAM + 1 + j]
        grams ^= grams >> np.uint64(29)
    inside = np.ones(n - window + 1, bool)  # windows that do not reach into the next document
    for end in np.cumsum(lengths)[:-1].tolist():
        inside[max(0, end - window + 1) : end] = False
    least = least_places(grams, window - GRAM + 1)[inside]
    places = least[np.diff(least, prepend=-1) > 0]  # they never go back
    return grams[places], places


def together(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[list, list, list[list[bytes]]]]:
    """Ids, digests and words of so many documents that they have about TOGETHER words."""
    ids, digests, words, held = [], [], [], 0
    for batch in batches:
        for i, d, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", column)), strict=True):
            ids.append(i)
            digests.append(d)
            words.append((text.encode("utf-8", "surrogatepass") if isinstance(text, str) else unpacked(text)).split())
            held += len(words[-1])
            if held >= TOGETHER:
                yield ids, digests, words
                ids, digests, words, held = [], [], [], 0
    if ids:
        yield ids, digests, words


def census(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, digest, places BINARY): places of anchors that occur in two documents, some rows per document."""
    targets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for ids, digests, words in together(batches, "text"):
            lengths = np.array([len(w) for w in words], np.int64)
            grams, places = anchors(hashes.of([w for d in words for w in d]), lengths, window)
            starts = np.cumsum(lengths) - lengths
            slot = np.searchsorted(starts + lengths, places, side="right")
            place = places - starts[slot]
            doc = np.array(ids, np.int64)
            # Anchors in two documents of these need not be looked for elsewhere; one of them tells the others.
            which, first = _which(grams)
            low, high = np.full(len(first), 2**63 - 1), np.full(len(first), -(2**63))
            np.minimum.at(low, which, doc[slot])
            np.maximum.at(high, which, doc[slot])
            twice = (low != high)[which]
            lead = np.zeros(len(grams), bool)
            lead[first] = True
            sent = ~twice | lead
            target = (grams >> np.uint64(33)) % np.uint64(targets)
            rows = []
            dealt = np.argsort(target, kind="stable")
            edges = np.searchsorted(target[dealt], np.arange(targets + 1))
            for t in np.flatnonzero(np.diff(edges)).tolist():
                here = dealt[edges[t] : edges[t + 1]]  # in the order of the documents
                slots, local = np.unique(slot[here], return_inverse=True)
                state = (twice[here].astype(np.uint8) << 1) | sent[here]
                keys = np.stack([doc[slots], np.array(digests, np.int64)[slots]]).astype("<i8").tobytes()
                known = grams[here][sent[here]]
                low, high = known.astype("<u4").tobytes(), (known >> np.uint64(32)).astype("<u2").tobytes()
                step = np.packbits(np.diff(local, prepend=0).astype(bool)).tobytes()  # documents follow each other
                wide = "<u4" if place[here].max() > 65535 else "<u2"
                rows.append((t, len(here), keys, low, high, step, place[here].astype(wide).tobytes(), np.packbits(state[:, None] >> np.arange(2) & 1).tobytes()))
            if rows:
                names = ["target", "n", "keys", "low", "high", "steps", "places", "states"]
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        docs, digests, grams, owners, places, twice, sent = [], [], [], [], [], [], []
        base = 0
        for n, keys, low, high, steps, place, states in zip(*(rows[c] for c in ("n", "keys", "low", "high", "steps", "places", "states")), strict=True):
            table = np.frombuffer(keys, "<i8").reshape(2, -1)
            place = np.frombuffer(place, "<u2" if 2 * n == len(place) else "<u4")
            state = np.unpackbits(np.frombuffer(states, np.uint8), count=2 * n).reshape(n, 2)
            docs.append(table[0])
            digests.append(table[1])
            owners.append(np.cumsum(np.unpackbits(np.frombuffer(steps, np.uint8), count=n)) + base)
            places.append(place)
            sent.append(state[:, 0] == 1)
            twice.append(state[:, 1] == 1)
            grams.append(np.frombuffer(low, "<u4") | np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32))
            base += table.shape[1]
        doc, digest, owner, place = (np.concatenate(x) for x in (docs, digests, owners, places))
        twice, sent, gram = np.concatenate(twice), np.concatenate(sent), np.concatenate(grams)
        which, first = _which(gram)
        low, high, told = np.full(len(first), 2**63 - 1), np.full(len(first), -(2**63)), np.zeros(len(first), bool)
        np.minimum.at(low, which, doc[owner[sent]])
        np.maximum.at(high, which, doc[owner[sent]])
        np.logical_or.at(told, which, twice[sent])
        kept = twice.copy()
        kept[sent] |= (told | (low != high))[which]
        owner, place = owner[kept], place[kept]
        order = np.argsort(owner, kind="stable")
        owner, place = owner[order], place[order]
        edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else np.zeros(1, np.int64)
        out = [(doc[owner[a]], digest[owner[a]], place[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame(out, columns=["doc_id", "digest", "places"])

    schema = "target int, n int, keys binary, low binary, high binary, steps binary, places binary, states binary"
    return docs.mapInArrow(tidy(None, send), schema).groupBy("target").applyInPandas(meet, "doc_id bigint, digest bigint, places binary")


def _which(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each value among the distinct ones, and where each distinct one is first."""
    _, first, which = np.unique(values, return_index=True, return_inverse=True)
    return which, first


@dataclass
class Found:
    """Documents whose anchors came back, joined one after the other."""

    docs: np.ndarray
    digests: np.ndarray
    words: list[bytes]
    starts: np.ndarray  # of each document among the words, and the end
    places: np.ndarray  # of the anchors among the words, in order

    def __post_init__(self) -> None:
        self.slot = np.searchsorted(self.starts, self.places, side="right") - 1

    def sides(self, window: int) -> Iterator[tuple[bytes, bytes]]:
        """Words before each anchor that a window can reach, and words from the anchor on."""
        whole, n = b" ".join(self.words), len(self.words)
        begin = np.zeros(n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, self.words), np.int64, n) + 1, out=begin[1:])
        first = begin[np.maximum(self.places - (window - GRAM), self.starts[self.slot])]
        last = begin[np.minimum(self.places + window, self.starts[self.slot + 1])] - 1
        for low, at, high in zip(first.tolist(), begin[self.places].tolist(), last.tolist(), strict=True):
            yield whole[low : max(at - 1, 0)], whole[at:high]

    def longer(self, rolled: np.ndarray, which: np.ndarray, k: int, hashes: Hashes) -> np.ndarray:
        """Hashes of the prefixes of these anchors, with word k added."""
        added = hashes.of(list(map(self.words.__getitem__, (self.places[which] + k).tolist())))
        rolled = rolled * MIX + added
        return rolled ^ rolled >> np.uint64(29)


def found_again(batches: Iterator[pa.RecordBatch]) -> Iterator[Found]:
    """The documents with their anchors, so many at a time that they have about TOGETHER words."""

    def joined(held: list) -> Found:
        docs, digests, parts, places = zip(*held, strict=True)
        starts = np.cumsum([0, *map(len, parts)])
        places = np.unique(np.concatenate([p + s for p, s in zip(places, starts.tolist(), strict=False)]))
        return Found(np.array(docs, np.int64), np.array(digests, np.int64), [w for part in parts for w in part], starts, places)

    held, size = [], 0
    for batch in batches:
        for doc, digest, packed, blobs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "packed", "places")), strict=True):
            held.append((doc, digest, unpacked(packed).split(), np.frombuffer(b"".join(blobs), "<u4").astype(np.int64)))
            size += len(held[-1][2])
            if size >= TOGETHER:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def prefix_counts(candidates: DataFrame) -> np.ndarray:
    """Suffixes per length of prefix and counter: GRAM rows of COUNTERS, whatever the size of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashes = np.zeros((GRAM, COUNTERS), np.int64), Hashes()
        for found in found_again(batches):
            every = np.arange(len(found.places))
            rolled = np.zeros(len(every), np.uint64)
            for k in range(GRAM):
                rolled = found.longer(rolled, every, k, hashes)
                counts[k] += np.bincount((rolled % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        length, counter = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(length * COUNTERS + counter), pa.array(counts[length, counter])], names=["counter", "n"])

    rows = candidates.mapInArrow(tidy(None, run), "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    table = np.zeros(GRAM * COUNTERS, np.int64)
    for row in rows.collect():
        table[row["counter"]] = row["n"]
    return table.reshape(GRAM, COUNTERS)


def tree_minima(left: list[bytes], right: list[bytes], doc: np.ndarray, window: int) -> np.ndarray:
    """Smallest document of the window that begins j words before each anchor, j from 0 to window - GRAM; no window: 2**63-1.

    The suffix tree of the group as an array: suffixes in order, with the common prefix of neighbours.
    """
    n, before = len(right), window - GRAM
    codes = Numbers()
    after, back = np.full((n, window), -1, np.int64), np.full((n, before), -1, np.int64)
    for sides, table, from_end in ((right, after, False), (left, back[:, ::-1], True)):  # the words before, read backwards
        width = table.shape[1]
        lengths = np.fromiter((side.count(b" ") + 1 if side else 0 for side in sides), np.int64, n)[:, None]
        words = b" ".join(filter(None, sides)).split()
        at = np.arange(width) >= width - lengths if from_end else np.arange(width) < lengths
        table[at] = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    order = np.lexsort(after.T[::-1])
    sorted_after, sorted_back, owner = after[order], back[order], doc[order]
    same = np.logical_and.accumulate(sorted_after[1:] == sorted_after[:-1], axis=1) & (sorted_after[1:] >= 0)
    common = same.sum(axis=1)  # common prefix with the suffix before
    out = np.full((n, before + 1), 2**63 - 1, np.int64)
    reach = (sorted_after >= 0).sum(axis=1)
    path = np.zeros(n, np.int64)  # class of the j words before, read backwards
    has = np.ones(n, bool)
    for j in range(before + 1):
        if j:
            has &= sorted_back[:, j - 1] >= 0
            path = np.unique(path * (len(codes) + 2) + sorted_back[:, j - 1] + 1, return_inverse=True)[1]
        depth = window - j
        node = np.concatenate(([0], np.cumsum(common < depth)))
        whole = np.flatnonzero(has & (reach >= depth))
        if not len(whole):
            continue
        _, window_class = np.unique(node[whole] * (n + 1) + path[whole], return_inverse=True)
        least = np.full(int(window_class.max()) + 1, 2**63 - 1)
        np.minimum.at(least, window_class, owner[whole])
        out[order[whole], j] = least[window_class]
    return out


def repeats(df: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, place, mask): windows that also begin in a document with a smaller id.

    A set bit j of the mask is the window that begins j words before `place`. Only documents that
    have such windows have rows. digest: xxhash64 of the text.
    """
    if window <= GRAM:
        raise ValueError(f"a window has more than {GRAM} words")
    docs = documents(df, key, text).where("doc_id is not null").withColumn("digest", F.xxhash64("text"))
    found = census(docs, window).groupBy("doc_id", "digest").agg(F.collect_list("places").alias("places"))
    candidates = written(keyed(df, key, text).where("doc_id is not null").join(found, ["doc_id", "digest"]), "candidates")
    counts = prefix_counts(candidates)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(seen: dict) -> pa.RecordBatch:
            rows = [(group, left, right, low, high) for (left, right), (group, low, high) in seen.items()]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "left", "right", "low", "high"])

        # Each suffix once, with its group and its smallest and largest document.
        hashes, seen = Hashes(), {}
        for found in found_again(batches):
            which = np.arange(len(found.places))
            part, rolled = np.zeros(len(which), np.uint64), np.zeros(len(which), np.uint64)
            for k in range(GRAM):  # as many words as it takes
                rolled = found.longer(rolled, which, k, hashes)
                fits = (counts[k, (rolled % np.uint64(COUNTERS)).astype(np.int64)] <= GROUP) | (k == GRAM - 1)
                part[which[fits]] = rolled[fits] * MIX + np.uint64(k)
                which, rolled = which[~fits], rolled[~fits]
            owners = found.docs[found.slot].tolist()
            for group, doc, sides in zip(part.view(np.int64).tolist(), owners, found.sides(window), strict=True):
                known = seen.get(sides)
                seen[sides] = (group, min(known[1], doc), max(known[2], doc)) if known else (group, doc, doc)
            if len(seen) >= GATHERED:
                yield sent(seen)
                seen = {}
        if seen:
            yield sent(seen)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trees of the groups of a partition; several small groups are sorted together."""

        def tree(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Each suffix once, with the smallest and the largest document that has it.
            seen: dict[tuple[bytes, bytes], tuple[int, int]] = {}
            for row in rows:
                for left, right, low, high in zip(*(row.column(c).to_pylist() for c in ("left", "right", "low", "high")), strict=True):
                    known = seen.get((left, right), (low, high))
                    seen[left, right] = (min(low, known[0]), max(high, known[1]))
            low, high = np.array(list(seen.values()), np.int64).T
            minima = tree_minima([k[0] for k in seen], [k[1] for k in seen], low, window)
            digest = xxhash.xxh3_128_digest
            useful = (minima < high[:, None]).any(axis=1)  # some document has a window that a smaller one has
            keys = [digest(a + b"\n" + b) for (a, b), x in zip(seen, useful, strict=True) if x]
            flat = minima[useful]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), lists], names=["suffix", "minima"])

        held, size = [], 0
        for batch in batches:
            part = batch.column("part").to_numpy()
            ends = [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else []
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                other = held and held[-1].column("part")[-1].as_py() != part[a]
                if other and size >= GROUP:
                    yield from tree(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += b - a
        if held:
            yield from tree(held)

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for found in found_again(batches):
            keys = [digest(left + b"\n" + right) for left, right in found.sides(window)]
            columns = [found.docs[found.slot], found.digests[found.slot], found.places - found.starts[found.slot]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *map(pa.array, columns)], names=["suffix", "doc_id", "digest", "place"])

    dealt = candidates.mapInArrow(tidy(None, deal), "part bigint, left binary, right binary, low bigint, high bigint")
    trees = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(None, grow), "suffix binary, minima array<bigint>")
    # One row per suffix. A passage that a third of the documents share has as many places: a skewed join, which AQE splits.
    places = candidates.mapInArrow(tidy(None, occur), "suffix binary, doc_id bigint, digest bigint, place bigint").join(trees, "suffix")
    bits = [F.when(F.col("minima")[j] < F.col("doc_id"), 1 << j).otherwise(0) for j in range(window - GRAM + 1)]
    return places.select("doc_id", "digest", "place", sum(bits[1:], bits[0]).alias("mask")).where("mask > 0")


def marked(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, digest, marks): each mark is a place and its mask in one number."""
    mark = F.shiftleft(F.col("place"), window - GRAM + 1).bitwiseOR(F.col("mask").cast("bigint"))
    return found.groupBy("doc_id", "digest").agg(F.collect_list(mark).alias("marks"))


def covered(n_words: int, marks: np.ndarray, window: int) -> np.ndarray:
    """Whether each word lies in a marked window."""
    steps = np.arange(window - GRAM + 1)
    starts = ((marks >> len(steps))[:, None] - steps)[(marks[:, None] >> steps & 1) == 1]
    change = np.bincount(starts, minlength=n_words + 1) - np.bincount(starts + window, minlength=n_words + 1)
    return np.cumsum(change[:-1]) > 0


def kept_words(words: list, marks: np.ndarray | None, window: int) -> list:
    if marks is None or not len(marks):
        return words
    return list(compress(words, (~covered(len(words), marks, window)).tolist()))


def without_repeats(df: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words of each text without those in repeated windows, joined by one blank.

    With digests=True the last column is kept_sha256 instead. Windows are judged on the input, not
    on what is left. Texts with fewer words than a window, empty and null ones lose nothing. Rows of
    one id are one document and do not repeat each other; a row without id neither gives nor takes.
    An empty table gives no rows.
    """
    import hashlib

    marks = marked(repeats(df, window, key, text), window)
    # A row repeated in the table gives each mark as often; marks of one place are the same.
    rows = keyed(df, key, text).join(marks, ["doc_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            marks = batch.column("marks")
            values, edges = marks.flatten().to_numpy(), np.cumsum([0, *(n or 0 for n in marks.value_lengths().to_pylist())]).tolist()
            for i, (doc, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed")), strict=True)):
                words = unpacked(packed).split()
                kept = kept_words(words, values[edges[i] : edges[i + 1]], window)
                line = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest() if digests else line.decode("utf-8", "surrogatepass")))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", last])

    last = "kept_sha256" if digests else "kept"
    return rows.select("doc_id", "packed", "marks").mapInArrow(tidy(None, run), f"doc_id bigint, n_words bigint, n_removed bigint, {last} string")


def cut_repeats(df: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns; texts that lose words are their kept words joined by one blank, all others stay as they are.

    A row without id has a number made of its text, larger than any id below 2^62: it loses what documents with an id
    have, and equal texts without id are one document. Columns may have any names.
    """
    others = [c for c in df.columns if c != text]
    rows = df.select(named(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("id"), F.col(f"`{text}`").cast("string").alias("words"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("rest"))
    found = marked(repeats(rows, window, "id", "words"), window).select(F.col("doc_id").alias("id"), F.col("digest").alias("own"), F.col("marks").alias("places"))
    rows = rows.withColumn("own", F.xxhash64(F.coalesce("words", F.lit("")))).join(found, ["id", "own"], "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for value, found in zip(texts, places, strict=True):
            words = (value or "").encode("utf-8", "surrogatepass").split()
            out.append(b" ".join(kept_words(words, None if found is None else np.asarray(found, np.int64), window)).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype="object")

    some = F.col("places").isNotNull()
    changed = F.when(some, cut(F.when(some, F.col("words")), F.col("places"))).otherwise(F.col("words"))
    return rows.select(*[changed.alias(c) if c == text else F.col("rest")[c].alias(c) for c in df.columns])
