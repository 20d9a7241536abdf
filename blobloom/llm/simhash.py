"""SimHash near-duplicates through an inverted index on the positional bytes of fingerprints.

A fingerprint of B bytes is posted under combinations of (position, byte). Two fingerprints that
differ in at most d bits differ in at most d bytes, so they share B - d positional bytes at least:
the guaranteed minimum. With 8 bytes and 3 bits that is 5, and each of the 56 sets of 5 positions
is one key, so every pair that must be found meets under a key, and a key is as selective as 40
bits. A list of postings is read by one task: it tallies the shared positional bytes of each pair,
keeps pairs that reach the minimum, verifies their bits, and hands on a spanning forest of the
links, not the links themselves. Equal fingerprints are one posting, so a group of copies counts once.

Texts that are alike by the Jaccard likeness of their sets of shingles (`SetPlan`) differ in more bits
than an index of bytes can find. Their fingerprint is a digest of the set, their keys are bands of
least hashes, and every link is decided on the sets themselves.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written
from .common import documents, named, small_batches, tidy
from .graph import components

# Rows of a block when all pairs of a list are compared.
BLOCK = 1024
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """How texts are shingled and which fingerprints link.

    keys: tuples of byte positions; a pair is compared if it agrees on all of one tuple.
    matches: positional bytes that a pair must share before its bits are counted.
    """

    shingle: int
    size: int  # bytes
    distance: int  # bits
    matches: int
    keys: tuple[tuple[int, ...], ...]


def exact_plan(shingle: int = 3, distance: int = 3) -> Plan:
    """64 bits; finds every pair within the distance (up to 7 bits)."""
    if not 0 <= distance < 8:
        raise ValueError("distance must be 0 to 7")
    least = 8 - distance
    return Plan(shingle, 8, distance, least, tuple(itertools.combinations(range(8), least)))


@dataclass(frozen=True)
class SetPlan:
    """How texts are shingled, and from which Jaccard likeness of the sets of shingles they link.

    Texts are compared if they agree on all `rows` least hashes of one of the `bands`.
    """

    shingle: int
    similarity: float
    rows: int
    bands: int


def similar_plan(shingle: int = 5, similarity: float = 0.8) -> SetPlan:
    """Links texts whose sets of shingles have that Jaccard likeness, as counted on the sets.

    With five least hashes to a band, a pair at likeness s is compared unless all bands differ:
    (1 - s^5)^bands. There are as many bands as keep this under 0.0004 at the similarity asked for:
    20 of them at 0.8.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity must be 0.5 to 1")
    rows = 5
    bands = 1 if similarity == 1 else int(np.ceil(np.log(4e-4) / np.log1p(-(similarity**rows))))
    return SetPlan(shingle, similarity, rows, bands)


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `shingle` words, repeats included; of all words if there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    line = b" ".join(words)
    spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((digest(line[a:b], 42) for a, b in spans), np.uint64, len(words) - shingle + 1)


def fingerprint(text: str, shingle: int, size: int) -> bytes:
    """Big-endian fingerprint: a bit is 1 if it is 1 in over half of the shingles; zero without words."""
    hashes = shingle_hashes(text, shingle)
    parts = []
    for k in range(size // 8):
        if k:
            hashes = hashes * MIX + np.uint64(k)
            hashes = hashes ^ (hashes >> np.uint64(29))
        ones = np.zeros(64, np.int64)
        for start in range(0, len(hashes), 1 << 16):  # bounds the memory of very long texts
            part = hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        parts.append(np.packbits(2 * ones > len(hashes)).tobytes())
    return b"".join(parts)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def set_digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.astype("<u8").tobytes(), digest_size=16).digest()


def band_keys(members: np.ndarray, plan: SetPlan) -> np.ndarray:
    """One key per band: a hash of its least hashes; none for the empty set, whose copies share a digest."""
    if not len(members):
        return np.zeros(0, np.int64)
    factors = np.random.default_rng(20_241).integers(0, 2**63, plan.rows * plan.bands, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(factors), 2**64 - 1, np.uint64)
    for start in range(0, len(members), 4096):  # bounds the memory of very long texts
        x = members[start : start + 4096] ^ (members[start : start + 4096] >> np.uint64(31))
        least = np.minimum(least, (x[:, None] * factors).min(axis=0))
    keys = np.arange(plan.bands, dtype=np.uint64)
    for column in least.reshape(plan.bands, plan.rows).T:
        keys = (keys ^ column) * MIX
        keys = keys ^ (keys >> np.uint64(29))
    return keys.view(np.int64)


def fingerprints(docs: DataFrame, plan: Plan | SetPlan) -> DataFrame:
    """(doc_id, fp BINARY) of every whole text, and its keys ARRAY if the plan is one of sets."""
    sets = isinstance(plan, SetPlan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            if sets:
                members = [shingle_set(t, plan.shingle) for t in texts]
                columns = [pa.array([set_digest(m) for m in members], pa.binary()), pa.array([band_keys(m, plan) for m in members], pa.list_(pa.int64()))]
            else:
                columns = [pa.array([fingerprint(t, plan.shingle, plan.size) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "fp", "keys"][: 1 + len(columns)])

    return docs.mapInArrow(tidy(None, run) if sets else run, "doc_id bigint, fp binary" + ", keys array<bigint>" * sets)


def fingerprint_column(text: Column, plan: Plan | SetPlan) -> Column:
    """The fingerprint of each text as a column; a null text is empty."""

    def one(t: str) -> bytes:
        return set_digest(shingle_set(t, plan.shingle)) if isinstance(plan, SetPlan) else fingerprint(t, plan.shingle, plan.size)

    @F.pandas_udf("binary")
    def prints(texts):
        import pandas as pd

        return pd.Series([one(t or "") for t in texts], dtype="object")

    return prints(text)


def list_links(prints: np.ndarray, plan: Plan) -> list[tuple[int, int]]:
    """A spanning forest of the links within one list of postings, as pairs of row numbers.

    prints: rows of uint64 words. All pairs are tallied in blocks. In a long list every row is first
    measured against one pivot: rows within half the distance of it are one group, and by the
    triangle inequality only rows within one and a half times the distance can link to them. So a
    dense cluster of any size takes one pass instead of a square.
    """
    parent = list(range(len(prints)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links: list[tuple[int, int]] = []

    def link(x: int, y: int) -> None:
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((x, y))

    def pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and y that share enough positional bytes and differ in few enough bits."""
        unlike = prints[x][:, None, :] ^ prints[y][None, :, :]
        shared = (unlike.view(np.uint8) == 0).sum(axis=2) if len(x) * len(y) < 4096 else None
        near = np.bitwise_count(unlike).sum(axis=2, dtype=np.int64) <= plan.distance
        if shared is None:  # verify first where that leaves fewer rows to tally
            i, j = np.nonzero(near)
            kept = (unlike[i, j].view(np.uint8) == 0).sum(axis=1) >= plan.matches
            return i[kept], j[kept]
        return np.nonzero(near & (shared >= plan.matches))

    rest = np.arange(len(prints))
    while len(rest) > 4 * BLOCK:
        away = np.bitwise_count(prints[rest] ^ prints[rest[0]]).sum(axis=1, dtype=np.int64)
        core, ring = rest[away <= plan.distance // 2], rest[(away > plan.distance // 2) & (away <= plan.distance + plan.distance // 2)]
        for x in core[1:].tolist():
            link(int(core[0]), x)
        for s in range(0, len(ring), BLOCK):
            y = ring[s : s + BLOCK]
            for t in range(0, len(core), BLOCK):
                i, j = pairs(core[t : t + BLOCK], y)
                j, first = np.unique(j, return_index=True)
                for p, q in zip(core[t : t + BLOCK][i[first]].tolist(), y[j].tolist(), strict=True):
                    link(p, q)
                y = np.delete(y, j)
                if not len(y):
                    break
        rest = rest[away > plan.distance // 2]
    for s in range(0, len(rest), BLOCK):
        for t in range(s, len(rest), BLOCK):
            x, y = rest[s : s + BLOCK], rest[t : t + BLOCK]
            i, j = pairs(x, y)
            kept = x[i] < y[j]
            for p, q in zip(x[i[kept]].tolist(), y[j[kept]].tolist(), strict=True):
                link(p, q)
    return links


def posting_links(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, fp) sorted by key to links (a, b); a list may go on in the next batch."""
    width = plan.size // 8

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, width)
        return batch.column("key").to_numpy(), batch.column("node").to_numpy(), fps

    waiting: list = []

    def links(key, node, fps) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
        fps = np.ascontiguousarray(fps)
        sizes = np.diff(edges)
        a, b = [], []
        # Lists of two are the most frequent by far: all at once.
        two = edges[:-1][sizes == 2]
        unlike = fps[two] ^ fps[two + 1]
        bits = np.bitwise_count(unlike).sum(axis=1, dtype=np.int64)
        shared = (unlike.view(np.uint8) == 0).sum(axis=1)
        two = two[(shared >= plan.matches) & (bits <= plan.distance)]
        a.append(node[two])
        b.append(node[two + 1])
        for start, size in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            found = np.array(list_links(fps[start : start + size], plan), np.int64).reshape(-1, 2) + start
            a.append(node[found[:, 0]])
            b.append(node[found[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def joined(parts: list) -> tuple:
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        part = arrays(batch)
        # Up to the last change of key everything is complete; the rest waits.
        last = waiting[-1][0][-1] if waiting else part[0][0]
        changes = np.flatnonzero(part[0] != np.concatenate(([last], part[0][:-1])))
        if len(changes):
            cut = int(changes[-1])
            yield from links(*joined([*waiting, tuple(x[:cut] for x in part)]))
            part, waiting = tuple(x[cut:].copy() for x in part), []
        waiting.append(part)
    if waiting:
        yield from links(*joined(waiting))


def classes(prints: DataFrame, plan: Plan) -> DataFrame:
    """(fp, node, component): one row per distinct fingerprint; node is its smallest doc_id.

    prints: (doc_id, fp), written before, as it is read twice.
    """
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "prints")

    # Key: number of the tuple of positions and the bytes there, as one integer.
    def key(positions: tuple[int, ...]):
        number = F.concat(*[F.substring("fp", p + 1, 1) for p in positions])
        return F.conv(F.hex(number), 16, 10).cast("bigint")

    keys = [F.lit(i).cast("bigint") * (1 << 8 * len(p)) + key(p) for i, p in enumerate(plan.keys)]
    postings = nodes.where("node is not null").select(F.explode(F.array(*keys)).alias("key"), "node", "fp")
    postings = postings.repartition("key").sortWithinPartitions("key", "node")
    links = postings.mapInArrow(lambda batches: posting_links(batches, plan), "a bigint, b bigint")
    found = components(links)
    return nodes.join(found, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("component"))


def set_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that are alike, as pairs of numbers in the list.

    1 - Jaccard is a metric. All sets are measured against one: those within half the distance that
    links are alike among themselves, and only those within one and a half times of it can be alike
    to one of these. So a dense list takes one pass instead of a square.
    """
    flat, sizes = np.unique(np.concatenate(sets), return_inverse=True)[1], np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    parent = list(range(len(sets)))
    links: list[tuple[int, int]] = []
    mark = np.zeros(len(flat), np.int64)

    def likeness(x: int) -> np.ndarray:
        own = flat[ends[x] - sizes[x] : ends[x]]
        mark[own] = 1
        shared = np.add.reduceat(mark[flat], ends - sizes)
        mark[own] = 0
        return shared / (sizes + sizes[x] - shared)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(x: int, y: int) -> None:
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((x, y))

    far, slack = 1 - similarity, 1e-9
    rest = np.arange(len(sets))
    while len(rest) > 1:
        first = int(rest[0])
        alike = likeness(first)[rest]
        for y in rest[alike >= similarity - slack].tolist():
            link(first, y)
        core = rest[alike >= 1 - far / 2 + slack]
        for y in rest[(alike < similarity - slack) & (alike >= 1 - 1.5 * far - slack)].tolist():
            if len(core) > 1 and root(y) != root(first):
                near = core[likeness(y)[core] >= similarity - slack]
                if len(near):
                    link(int(near[0]), y)
        rest = np.setdiff1d(rest, core, assume_unique=True)
    return links


def set_classes(docs: DataFrame, prints: DataFrame, plan: SetPlan) -> DataFrame:
    """(fp, node, component): one row per distinct set of shingles; node is its smallest doc_id.

    prints: (doc_id, fp, keys), written before. A list of postings of one key is compared as a whole;
    of lists with the same members, only one is. Sets are made again for members of such lists alone.
    """
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "prints")
    postings = nodes.where("node is not null").select(F.explode("keys").alias("key"), "node", "fp")
    members = [F.count("*").alias("c"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("y")]
    lists = postings.groupBy("key").agg(*members).where("c > 1").groupBy("c", "x", "y").agg(F.min("key").alias("key"))
    met = written(postings.join(lists.select("key"), "key"), "met")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [shingle_set(t, plan.shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in found], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], names=["fp", "members"])

    # One document of each set that has met another.
    wanted = met.select("fp", F.col("node").alias("doc_id")).distinct()
    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    known = texts.mapInArrow(tidy(None, sets), "fp binary, members binary").dropDuplicates(["fp"])
    listed = met.join(known, "fp").select("key", "node", "members").repartition("key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "members")), strict=True))
        for _, group in itertools.groupby(rows, lambda row: row[0]):
            _, ids, parts = zip(*group, strict=True)
            links = set_links([np.frombuffer(p, "<u8") for p in parts], plan.similarity)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([ids[x[k]] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    found = components(listed.mapInArrow(tidy(None, run), "a bigint, b bigint"))
    return nodes.join(found, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("component"))


def near_duplicates(df: DataFrame, plan: Plan | SetPlan, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: its fingerprint and the smallest doc_id it reaches over links.

    Null and empty texts have fingerprint zero and link like any other. Rows of one doc_id are one
    document. A row without doc_id has a fingerprint, but takes part in no group (its component is
    null, or the group's that has the same fingerprint). An empty table gives no rows.
    """
    docs = documents(df, key, text)
    prints = written(fingerprints(docs, plan), "fingerprints")
    found = set_classes(docs, prints, plan) if isinstance(plan, SetPlan) else classes(prints, plan)
    return prints.join(found, "fp").select("doc_id", "fp", F.col("component").alias("component_id"))


def survivors(df: DataFrame, plan: Plan | SetPlan, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: that with the smallest id, and of rows with one id the smallest text.

    A row without id has a number made of its text, larger than any id below 2^62, so that it is compared like any
    other and goes before a row with an id does; of equal texts without id one stays. Columns may have any names.
    """
    rows = df.select(named(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("id"), F.col(f"`{text}`").alias("words"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"))
    found = near_duplicates(rows.select("id", "words"), plan, "id", "words")
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    one = W.partitionBy("id").orderBy(F.col("words").asc_nulls_first())
    # The ids grow with the corpus, so they are never broadcast.
    kept = rows.join(first.hint("merge"), "id").withColumn("place", F.row_number().over(one)).where("place = 1")
    return kept.select(*[F.col("whole")[c].alias(c) for c in df.columns])
