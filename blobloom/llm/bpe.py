"""Byte-level BPE encoding with a segment tree over adjacent pairs, and decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import documents, small_batches
from .units import UnitCoder, is_word

NONE = 1 << 62


class SegmentTrees:
    """Merges of many words in step, each word with its own segment tree over the ranks of its adjacent pairs.

    Leaf i of a tree holds (rank, i) of the pair of the living symbol i and its next one, as one
    integer; a node holds the smaller of its children, so the root is the leftmost pair of the
    lowest rank. A merge changes three leaves, each a path of log(n) nodes. A word is done when its
    root holds no pair. Words of similar length share one array, so a step is a few numpy calls for
    all of them; one very long word is an array by itself.
    """

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], bytes_ids: list[int]):
        """merges: pair of ids -> (rank, id of the merged symbol). bytes_ids: id of each byte."""
        self.bytes_ids = np.array(bytes_ids, np.int64)
        pairs = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in merges.items())
        self.pairs, self.ranks, _ = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.made = np.zeros(int(self.ranks.max()) + 1, np.int64)
        self.made[self.ranks] = [new for _, _, new in pairs]

    def _leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.ranks[at] << 32 | place, NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word after all merges, as little-endian 32-bit integers."""
        out = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_width.setdefault(1 << max(0, len(word) - 2).bit_length(), []).append(i)
        for width, rows in by_width.items():
            step = max(1, (1 << 16) // width)
            for s in range(0, len(rows), step):
                part = rows[s : s + step]
                for i, ids in zip(part, self._merge([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], width: int) -> list[bytes]:
        m, n = len(words), width + 1
        lengths = np.fromiter(map(len, words), np.int64, m)
        letters = np.frombuffer(b"".join([word.ljust(n + 1) for word in words]), np.uint8).reshape(m, n + 1)
        ids = np.where(np.arange(n + 1) < lengths[:, None], self.bytes_ids[letters], -1)
        tree = np.full((m, 2 * width), NONE, np.int64)
        places = np.broadcast_to(np.arange(width), (m, width))
        tree[:, width:] = self._leaves(ids[:, :width], ids[:, 1:n], places)
        node = width // 2
        while node:
            tree[:, node : 2 * node] = np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2])
            node //= 2
        after = np.tile(np.minimum(np.arange(1, n + 2), n), (m, 1))
        before = np.tile(np.arange(-1, n), (m, 1))

        def put(rows: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
            at = place + width
            tree[rows, at] = value
            for _ in range(width.bit_length() - 1):
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        rows = np.arange(m)
        while True:
            root = tree[rows, 1]
            rows, root = rows[root != NONE], root[root != NONE]
            if not len(rows):
                break
            i = root & 0xFFFFFFFF
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = self.made[root >> 32]
            ids[rows, j] = -1
            after[rows, i] = k
            before[rows, k] = i
            leaf = j < width
            put(rows[leaf], j[leaf], np.full(int(leaf.sum()), NONE))
            put(rows, i, self._leaves(ids[rows, i], ids[rows, k], i))
            h = before[rows, i]
            left = h >= 0
            put(rows[left], h[left], self._leaves(ids[rows[left], h[left]], ids[rows[left], i[left]], h[left]))
        alive = ids >= 0
        codes, ends = ids[alive].astype("<u4").tobytes(), (4 * alive.sum(axis=1).cumsum()).tolist()
        return [codes[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class ByteBPE:
    """A vocabulary file of the tokenizers library: splits as the library does, merges by the segment tree."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in parts["model"]["merges"]]
        ids: dict[str, int] = parts["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in parts["added_tokens"]}
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        # Byte-level vocabularies write a byte as a character: printable Latin-1 as itself, the rest from 256 on.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in kept}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(kept))}
        pieces = {i: bytes(letters[c] for c in token) for token, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.trees = SegmentTrees(merges, [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])])
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self.coder = UnitCoder(self.units)

    def pieces_of(self, text: str) -> list[bytes | int]:
        """What is merged by itself, as bytes; or the id of a special token."""
        for content, number in self.special.items():
            if content in text:
                parts = [self.pieces_of(part) for part in text.split(content)]
                return [x for i, part in enumerate(parts) for x in ([number, *part] if i else part)]
        if is_word(text[text[:1] == " " :]):
            return [text.encode()]
        return [text[a:b].encode() for _, (a, b) in self.split(text)] if text else []

    def units(self, units: list[str]) -> list[bytes]:
        pieces = [self.pieces_of(unit) for unit in units]
        merged = iter(self.trees.merge([x for unit in pieces for x in unit if isinstance(x, bytes)]))
        return [b"".join([next(merged) if isinstance(x, bytes) else x.to_bytes(4, "little") for x in unit]) for unit in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        return self.coder(texts)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def decimal(self, ids: bytes) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.decimals.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def loaded(path: str) -> ByteBPE:
    """One vocabulary per Python worker, with what it remembers."""
    return ByteBPE(path)


def encode_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids BINARY, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    ids: little-endian 32-bit. A null text is empty: no ids, and the digests of nothing. Any length
    is encoded whole. Repeated rows stay; an empty table gives no rows. path is read by every
    worker, as an installed package is.
    """
    return _encoded(documents(df, key, text), path, True)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same without the ids."""
    return _encoded(documents(df, key, text), path, False)


def _encoded(docs: DataFrame, path: str, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = loaded(path), hashlib.sha256
        for batch in small_batches(batches, "text", 4 << 20):
            rows = []
            for ids in bpe.encode(batch.column("text").to_pylist()):
                back = bpe.decode(ids).encode("utf-8", "surrogatepass")
                rows.append((ids if with_ids else None, len(ids) // 4, sha(bpe.decimal(ids).encode()).hexdigest(), sha(back).hexdigest()))
            ids, n, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary()), "n_tokens": pa.array(n, pa.int64())}
            columns |= {"ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if not with_ids:
                del columns["ids"]
            yield pa.RecordBatch.from_pydict(columns)

    ids = "ids binary, " if with_ids else ""
    return docs.mapInArrow(run, f"doc_id bigint, {ids}n_tokens bigint, ids_sha256 string, decoded_sha256 string")
