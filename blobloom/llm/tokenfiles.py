"""Token counts of documents in flat token files without an index.

A flat file is one run of 16-bit ids, each document ended by a separator id. It is read in byte
blocks that know nothing of documents: a task searches its block for separators with one vectorised
comparison. What lies between two separators of a block is a document; what goes on from an earlier
block is stitched by a prefix scan over one row per block (separators so far, last separator so far).
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import new_folder, written
from .common import documents, small_batches
from .units import UnitCoder

SEPARATOR = 50256
BLOCK = 4 << 20  # bytes


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of any URI that pyarrow knows, or of a plain path."""
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)


@lru_cache(maxsize=4)
def rank_coder(path: str) -> UnitCoder:
    """Ids of a rank file of tiktoken, one coder per Python worker; every string is ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return UnitCoder(lambda units: [np.array(encode(u), "<u4").tobytes() for u in units])


def write_token_files(df: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write one flat file per task, and return (file, ordinal, doc_id) of what is in them, written as a table.

    Only files that this table names count: a task that is lost and runs again writes another file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, ordinal = rank_coder(path), None, 0
        name = f"{uuid.uuid4().hex}.tokens"
        system, at = opened(folder)
        try:
            for batch in small_batches(batches, "text", 4 << 20):
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(at, recursive=True)
                    out = system.open_output_stream(f"{at}/{name}")
                for ids in encode(batch.column("text").to_pylist()):
                    out.write(np.append(np.frombuffer(ids, "<u4").astype("<u2"), np.uint16(SEPARATOR)).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column("doc_id")], names=["file", "ordinal", "doc_id"])
                ordinal += n
        finally:
            if out is not None:
                out.close()

    return written(documents(df, key, text).mapInArrow(run, "file string, ordinal bigint, doc_id bigint"), "token-files")


def token_counts(spark: SparkSession, folder: str, files: DataFrame, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document in flat files of 16-bit ids.

    files: a table with a column file. start: first token in its file; n_tokens: without the
    separator. Documents may be empty, and may span any number of blocks. Tokens behind the last
    separator are a document with ended = false. A missing file fails; an empty one has no documents.
    """
    if block % 2 or block < 2:
        raise ValueError("a block is a whole number of ids")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = opened(folder)
        for batch in batches:
            names = batch.column("file").to_pylist()
            infos = system.get_file_info([f"{at}/{name}" for name in names])
            for info in infos:
                if info.type == pafs.FileType.NotFound:
                    raise FileNotFoundError(info.path)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([i.size for i in infos], pa.int64())], names=["file", "bytes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one block: number, separators in it, and per separator its place and the one before it (null: in an earlier block)."""
        system, at = opened(folder)
        for batch in batches:
            for name, number, size in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "bytes")), strict=True):
                with system.open_input_file(f"{at}/{name}") as file:
                    ids = np.frombuffer(file.read_at(min(block, size - number * block) // 2 * 2, number * block), "<u2")
                first = number * block // 2
                ends = np.flatnonzero(ids == separator) + first
                # One more row for what follows the last separator.
                place = pa.array([*ends.tolist(), None], pa.int64())
                before = pa.array([None, *ends.tolist()], pa.int64())
                n = len(place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array([number] * n, pa.int64()), pa.array(np.arange(n)), place, before, pa.array([first + len(ids)] * n, pa.int64())],
                    names=["file", "block", "nth", "place", "before", "stop"],
                )

    known = files.select("file").where("file is not null").distinct().mapInArrow(sizes, "file string, bytes bigint")
    blocks = known.where("bytes > 1").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(bytes - 1) div {block}"))).alias("block"))
    blocks = blocks.repartition("file", "block")
    rows = written(blocks.mapInArrow(scan, "file string, block bigint, nth bigint, place bigint, before bigint, stop bigint"), "separators")

    summary = rows.where("place is null").select("file", "block", F.col("nth").alias("_n"), F.col("before").alias("_last"), "stop")
    along = W.partitionBy("file").orderBy("block")
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    summary = summary.select(
        "file",
        "block",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ordinal"),
        F.coalesce(F.last("_last", ignorenulls=True).over(earlier), F.lit(-1)).alias("_before"),
        (F.lead("block").over(along).isNull()).alias("_end"),
    )
    joined = rows.join(summary, ["file", "block"]).withColumn("_from", F.coalesce("before", "_before") + 1)
    ended = F.col("place").isNotNull()
    return joined.where(ended | (F.col("_end") & (F.col("stop") > F.col("_from")))).select(
        "file",
        (F.col("_ordinal") + F.col("nth")).alias("ordinal"),
        F.col("_from").alias("start"),
        (F.coalesce("place", "stop") - F.col("_from")).alias("n_tokens"),
        ended.alias("ended"),
    )


def count_document_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens): writes the texts as flat token files and counts them there.

    A null or empty text has no tokens; repeated rows are counted each.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "tokens")
    names = write_token_files(df, path, folder, key, text)
    counts = token_counts(spark, folder, names).where("ended").drop("ended")
    return names.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
