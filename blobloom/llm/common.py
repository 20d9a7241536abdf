"""What several operators need: words, Arrow rows, held-out folds and written steps."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sort key of a missing id: before all others.
NO_ID = -(2**63)


def documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two columns, doc_id and text, whatever else the table has; a null text is empty."""
    return df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; bytes.split() cuts at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split()


def fold(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a missing id is in fold -1, so it is never held out nor learnt as one."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5, F.lit(-1))


def named(key: Column, text: Column) -> Column:
    """The id, or for a row without one a number from 2^62 on that is made of its text."""
    made = F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)
    return F.coalesce(key.cast("bigint"), made)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` holds about `most` bytes; a longer single value is a batch by itself."""
    for batch in batches:
        n, values = batch.num_rows, batch.column(column)
        if values.nbytes <= most or n <= 1:
            yield batch
            continue
        size = max(1, n * most // values.nbytes)
        for start in range(0, n, size):
            yield batch.slice(start, size)


_remembered: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """What an operator keeps between tasks of one Python worker, and how it is dropped."""
    _remembered[owner] = forget


def only(owner: str | None) -> None:
    """Drop what other operators keep in this worker; the memory goes back to the system."""
    others = [name for name in _remembered if name != owner]
    for name in others:
        _remembered.pop(name)()
    if others:
        give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not every C library has it


def tidy(owner: str | None, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that keeps nothing of other operators while it runs, and gives free memory back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(owner)
        yield from function(batches)
        give_back()

    return run
