"""Merges of many short words in step: one row of symbols per word, a hash table of pairs, no tree.

For words of a few bytes the least rank of a row is found faster by looking at the whole row than by keeping
a tree. Words are dealt by length, a step merges the best pair of every word that still has one, and only
the two pairs next to it are looked up again.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.int32(2**31 - 1)
# Longest word in bytes; longer ones are for others.
LONGEST = 32


class Pairs:
    """Rank and merged symbol of pairs of symbols, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        """Pairs in the order of their ranks."""
        self.bits = max(4, int(4 * len(left)).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        self.made = made.astype(np.int32)
        keys, ranks = left.astype(np.int64) << 32 | right, np.arange(len(left), dtype=np.int32)
        at = self.place(keys)
        while len(keys):
            # Of those that want one free place, the first takes it; the others and all that found it taken go on.
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] == -1]
            self.keys[at[first]], self.ranks[at[first]] = keys[first], ranks[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, at = keys[rest], ranks[rest], (at[rest] + 1) & (size - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE for what is no pair, also where a symbol is -1."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self.place(keys)
        found = self.keys[at]
        result = np.where(found == keys, self.ranks[at], NONE)
        left_ = np.flatnonzero((found != keys) & (found != -1))
        while len(left_):
            at[left_] = (at[left_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[left_]]
            hit = found == keys[left_]
            result[left_[hit]] = self.ranks[at[left_[hit]]]
            left_ = left_[~hit & (found != -1)]
        result[(left < 0) | (right < 0)] = NONE
        return result


class WordMerges:
    """Ids of words under a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Of a pair that is listed twice the last place counts, as in a map that is filled in order.
        last = {pair: rank for rank, pair in enumerate(pairs)}
        pairs = [pair for rank, pair in enumerate(pairs) if last[pair] == rank]
        left, right, made = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs), strict=True))
        self.pairs = Pairs(left, right, made)
        # Byte-level vocabularies write printable Latin-1 as itself, other bytes as characters from 256 on.
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.letters = np.array([ids[chr(b) if b in kept else chr(next(others))] for b in range(256)], np.int32)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of words of 1 to LONGEST bytes."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids, sizes = self.merge_spans(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths)
        codes, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [codes[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_spans(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words data[start:start + length], one after the other, and the number of ids of each."""
        sizes, parts = np.zeros(len(starts), np.int64), []
        left = lengths.copy()
        for width in (4, 8, 12, 16, 24, LONGEST):
            rows = np.flatnonzero((left <= width) & (left > 0))
            left[rows] = -1
            for at in range(0, len(rows), 1 << 14):
                part = rows[at : at + (1 << 14)]
                who, ids, count = self._merge(data, starts[part], lengths[part], width)
                sizes[part[who]] = count
                parts.append((part[who], ids, count))
        flat = np.zeros(int(sizes.sum()), np.int32)
        begins = np.cumsum(sizes) - sizes
        for rows, ids, count in parts:
            put(flat, begins[rows], count, ids)
        return flat, sizes

    def _merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words in the order in which they were done: which, their ids, and how many."""
        places = np.arange(width)
        letters = data[np.minimum(starts[:, None] + places, len(data) - 1)]
        symbols = np.full((len(starts), width + 1), -1, np.int32)
        symbols[:, :width] = np.where(places < lengths[:, None], self.letters[letters], -1)
        ranks = self.pairs.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(-1, width)
        done, ended, order = [], [], np.arange(len(starts))
        while len(order):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(order)), at]
            more = best != NONE
            if not more.all():
                done.append(symbols[~more])
                ended.append(order[~more])
                order, symbols, ranks, at, best = order[more], symbols[more], ranks[more], at[more], best[more]
                if not len(order):
                    break
            row = np.arange(len(order))
            # What stands behind the pair moves up by one.
            behind = places > at[:, None]
            symbols[:, :-1] = np.where(behind, symbols[:, 1:], symbols[:, :-1])
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            symbols[:, -1], ranks[:, -1] = -1, NONE
            symbols[row, at] = self.pairs.made[best]
            ranks[row, at] = self.pairs.rank(symbols[row, at], symbols[row, at + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pairs.rank(symbols[before, at[before] - 1], symbols[before, at[before]])
        all_ = np.concatenate(done)
        alive = all_ >= 0
        return np.concatenate(ended), all_[alive], alive.sum(axis=1)


def put(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
    """Runs of values, one after the other, to their places in flat."""
    flat[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(len(values))] = values
