"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, window against window.

A window is one word in a fixed frame. It is compressed once with the dictionary of each class; what
the toxic one saves over the ordinary one is its margin. A text is as toxic as its c-th best window,
and c and the thresholds are calibrated on the labelled sample. Margins of words repeat, so workers
remember them.

Dictionaries are raw content, in the order of growing frequency: the toxic one holds the words and
beginnings of words that are far more frequent among toxic texts, the ordinary one the frequent words
of the others, and then those of their words that looked toxic so far.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .common import documents, fold, only, remembers

# Before and behind the word: the library looks for no match in the last bytes of its input.
FRAME = bytes(range(1, 9)) + bytes(range(11, 19))
MARKS = b".,!?;:'\"()*#$%&|"
# Labelled rows that are learnt from, at most, toxic and ordinary ones, and the bytes of their texts per class.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_BYTES = 1_200, 2_000, 16 << 20
TOXIC_BYTES, ORDINARY_BYTES = 16_384, 98_304
LEVEL, REMEMBERED = 17, 150_000


@dataclass(frozen=True)
class Model:
    """Both dictionaries and the thresholds: `count` windows of at least `margin` bytes and `share` of their cost."""

    toxic: bytes
    ordinary: bytes
    margin: int = 1
    share: float = 0.0
    count: int = 1


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=100, **plain)
    data.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters)


class Windows:
    """(margin, share) of words: bytes saved by the toxic dictionary, and as a share of what the word costs without."""

    def __init__(self, model: Model):
        self.toxic, self.ordinary = compressor(model.toxic), compressor(model.ordinary)
        self.base = self.lengths(self.ordinary, [b""])[0]
        self.known: dict[bytes, tuple[int, float]] = {}

    @staticmethod
    def lengths(with_one: zstandard.ZstdCompressor, words: list[bytes]) -> list[int]:
        return [len(x) for x in with_one.multi_compress_to_buffer([FRAME + b" " + w + b" " + FRAME for w in words])] if words else []

    def __call__(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, float]]:
        """A table that has at least these words."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [w for w in words if w not in self.known]
        bare = [w.strip(MARKS) for w in new]
        pairs = zip(new, self.lengths(self.ordinary, bare), self.lengths(self.toxic, bare), strict=True)
        self.known.update((w, (o - t, (o - t) / max(1, o - self.base))) for w, o, t in pairs)
        return self.known


def text_value(known: dict[bytes, tuple[int, float]], words: list[bytes], share: float, count: int) -> int:
    """Margin of the count-th best window whose share is enough; -9 without one."""
    best = sorted((known[w][0] for w in words if known[w][0] > 0 and known[w][1] >= share), reverse=True)
    return best[count - 1] if len(best) >= count else -9


def lowered(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def parts(text: str) -> set[bytes]:
    """Words of a text, and the beginnings of 4 to 6 bytes of longer ones."""
    words = {w.strip(MARKS) for w in set(lowered(text))}
    return {b" " + w + b" " for w in words} | {b" " + w[:k] for w in words for k in (4, 5, 6) if len(w) > k}


def train(toxic: list[str], ordinary: list[str]) -> Model | None:
    """A model from texts of both classes; None if one has no text. Texts that repeat count once."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    if not toxic or not ordinary:
        return None
    a, b = Counter(), Counter()
    for counter, texts in ((a, toxic), (b, ordinary)):
        for text in texts:
            counter.update(parts(text))
    n, m = len(toxic), len(ordinary)

    def tells(part: bytes, times: int) -> bool:
        usual = (b[part] + 0.5) / (m + 1)
        return times >= max(3, 0.01 * n) and times / n > 6 * usual and times - n * usual > 6 * math.sqrt(n * usual + 1)

    found = {part: times for part, times in a.items() if tells(part, times)}
    # Of a beginning and a longer part that is nearly as frequent, the longer one says more.
    nearly: dict[bytes, int] = {}
    for part, times in found.items():
        for k in range(5, len(part)):
            nearly[part[:k]] = max(nearly.get(part[:k], 0), times)
    kept = sorted((p for p in found if nearly.get(p, 0) < 0.6 * found[p]), key=lambda p: (found[p], p))
    words = [p for p, times in b.items() if p.endswith(b" ") and times > 0.002 * m]
    usual = b"".join(sorted(words, key=lambda p: (b[p], p)))[-ORDINARY_BYTES // 2 :]
    model = Model(b"".join(kept)[-TOXIC_BYTES:], usual)

    vocabulary = sorted({p[1:-1] for p in b if p.endswith(b" ")})
    looked: list[bytes] = []
    for _ in range(2):
        known = Windows(model)
        table = {}
        for start in range(0, len(vocabulary), 50_000):
            part = vocabulary[start : start + 50_000]
            known.known = {}
            found_now = known(part)
            table.update((w, found_now[w][0]) for w in part)
        looked = sorted((w for w, margin in table.items() if margin >= 2), key=lambda w: (b[b" " + w + b" "], w))
        extra = (b" " + b" ".join(looked) + b" ")[-ORDINARY_BYTES // 4 :]
        model = Model(model.toxic, (extra + model.ordinary)[-ORDINARY_BYTES:])
    return calibrated(model, toxic, ordinary)


def calibrated(model: Model, toxic: list[str], ordinary: list[str]) -> Model:
    """The thresholds that find most toxic texts, each share of ordinary ones taken for toxic counting twenty times."""
    windows, texts = Windows(model), [(t, 1) for t in toxic] + [(t, 0) for t in ordinary]
    grid = [(share, count) for share in (0.85, 0.75, 0.95, 0.65, 0.5, 0.0) for count in (1, 2, 3)]
    values = np.zeros((len(texts), len(grid)), np.int64)
    for row, (text, _) in enumerate(texts):
        words = list(set(lowered(text)))
        known = windows(words)
        saving = [w for w in words if known[w][0] > 0]
        for column, (share, count) in enumerate(grid):
            values[row, column] = text_value(known, saving, share, count)
    label = np.array([x for _, x in texts])
    best, result = -math.inf, model
    for column, (share, count) in enumerate(grid):
        for margin in range(2, 13):
            hit = values[:, column] >= margin
            gain = hit[label == 1].mean() - 20 * hit[label == 0].mean()
            if gain > best:
                best, result = gain, Model(model.toxic, model.ordinary, margin, share, count)
    return result


_windows: dict[Model, Windows] = {}


def scores(texts: Iterable[str | None], model: Model | None) -> list[float]:
    """0 to 1 per whole text; at least 0.5 if its windows reach the thresholds, and 0 without a model."""
    out = []
    only("toxicity")
    remembers("toxicity", _windows.clear)
    if model is not None and model not in _windows:
        _windows.clear()
        _windows[model] = Windows(model)
    for text in texts:
        words = list(set(lowered(text or ""))) if model is not None else []
        value = text_value(_windows[model](words), words, model.share, model.count) if words else -9
        out.append(1 / (1 + math.exp(-(value - model.margin + 0.5))) if model is not None else 0.0)
    return out


def learnt_on(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model from labelled documents that are not held out, by crc32 of the id.

    Labels meet the documents first, and a text counts once per label, so the sample is of texts that exist. Of
    each class at most so many rows are taken, by hash of the id, and of these, in that order, as many as have
    `most_bytes` together; only then texts are read, of any length, and no text is moved but theirs.
    """
    marks = labels.select(F.col(key).cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(~fold().isin(0, -1)).where(F.col("toxic").isin(0, 1)).distinct()
    docs = documents(df, key, text)
    there = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.octet_length("text").alias("bytes")).join(marks, "doc_id")
    once = written(there.groupBy("toxic", "digest").agg(F.min("doc_id").alias("doc_id"), F.max("bytes").alias("bytes")), "labelled")

    chosen = []
    for label, rows in ((1, toxic_rows), (0, ordinary_rows)):
        some, held = once.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(rows).collect(), 0
        for row in some:
            if held + row["bytes"] <= most_bytes:
                held += row["bytes"]
                chosen.append((row["doc_id"], row["digest"], label))
    table = df.sparkSession.createDataFrame(chosen, "doc_id bigint, digest bigint, toxic int")
    found = docs.withColumn("digest", F.xxhash64("text")).join(F.broadcast(table), ["doc_id", "digest"])
    rows = found.select("text", "toxic").distinct().collect()
    return train([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0])


def score_column(text: Column, model: Model | None) -> Column:
    @F.pandas_udf("double")
    def score(column):
        import pandas as pd

        return pd.Series(scores(column, model), dtype="float64")

    return score(text)


def score_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    labels: (key, toxic). A null or empty text has no window and scores low. Labels of missing
    documents, null labels and rows without id teach nothing; without texts of both classes every
    score is 0. Repeated rows are scored each; an empty table gives none.
    """
    model = learnt_on(df, labels, key, text)
    rows = documents(df, key, text).select("doc_id", (fold() == 0).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return rows.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
