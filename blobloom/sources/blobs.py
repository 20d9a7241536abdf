"""Blobs and their manifests."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import verify_manifest
from ..shared import written


def read_blobs(spark: SparkSession, path: str, glob: str = "*", min_length: int = 0) -> DataFrame:
    """Whole files as (path, length, content); shorter files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.where(F.col("length") >= min_length).select("path", "length", "content")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, length) of the files under a path, by their hidden metadata; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("length"))


def write_lines(df: DataFrame, key: str, order: Sequence[str], line: Column, path: str) -> None:
    """One text file per key, in a directory of its own, with the key's lines in order."""
    rows = df.select(F.col(key), *[F.col(o).alias(f"_{o}") for o in order], line.alias("line"))
    sorted_ = rows.repartition(key).sortWithinPartitions(key, *[f"_{o}" for o in order])
    sorted_.select(key, "line").write.partitionBy(key).text(path)


def text_blobs(df: DataFrame, text: str, out: str = "content", min_length: int = 0) -> DataFrame:
    """The UTF-8 bytes of a text column as a blob column."""
    return df.where(F.octet_length(text) >= min_length).withColumn(out, F.encode(text, "UTF-8"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """More and smaller partitions for work that makes thousands of rows of each blob.

    Only a scan of fewer splits than two per core is moved; that is little data.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(4 * cores, key)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def listing_rule(name: Column, rule: str, extension: str = "") -> Column:
    """Whether a file name fits a rule.

    `extension`: ends with it. `bare`: has no dot. `bang`: starts with ! and has no dot.
    `contains`: has the extension somewhere behind the first character.
    """
    bare = ~F.contains(name, F.lit("."))
    if rule == "extension":
        return F.endswith(name, F.lit(extension))
    if rule == "bare":
        return bare
    if rule == "bang":
        return F.startswith(name, F.lit("!")) & bare
    if rule == "contains":
        return F.instr(name, extension) > 1
    raise ValueError(f"unknown rule {rule!r}")


def filter_listing(files: DataFrame, path: str, rule: str, extension: str = "") -> DataFrame:
    return files.where(listing_rule(file_name(F.col(path)), rule, extension))


def slice_by_manifest(blobs: DataFrame, blob: str, manifest: Sequence[tuple[str, str, int, int]]) -> DataFrame:
    """Cut the entries (name, folder, start, end) out of every blob.

    Ranges are half-open, may overlap, and are cut to the blob; an empty one gives no bytes.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(folder).alias("folder"),
                F.lit(start).cast("bigint").alias("start"),
                F.lit(end).cast("bigint").alias("end"),
            )
            for name, folder, start, end in manifest
        ]
    )
    keep = [c for c in blobs.columns if c != blob]
    cut = F.expr(f"substring(`{blob}`, int(start) + 1, int(greatest(end - start, 0)))")
    return blobs.select(*keep, blob, F.inline(entries)).select(*keep, "name", "folder", "start", "end", cut.alias("bytes"))


def slice_by_table(blobs: DataFrame, key: str, blob: str, manifest: DataFrame) -> DataFrame:
    """As `slice_by_manifest`, for a manifest table with entries of its own for each blob."""
    cut = F.expr(f"substring(`{blob}`, int(start) + 1, int(greatest(end - start, 0)))")
    return blobs.join(manifest, key).withColumn("bytes", cut).drop(blob)


def snapshot_manifest(blobs: DataFrame, name: str, blob: str) -> DataFrame:
    """(name, crc) of every blob."""
    return blobs.select(name, F.crc32(blob).alias("crc"))


def snapshot_digests(blobs: DataFrame, name: str, blob: str) -> DataFrame:
    """(name, md5) of every blob."""
    return blobs.select(name, F.md5(blob).alias("md5"))


def snapshot_once(manifest: DataFrame, name: str, value: str, path: str) -> DataFrame:
    """(name, expected, actual, status): the first caller's manifest becomes the snapshot, all later ones are compared with it.

    status: `written` for the first caller, else ok, mismatch or missing per row of the snapshot. The manifest is
    written to a folder of its own; the file that names it is created exclusively, so of several callers at once
    one is the first, and a caller that dies before has left no snapshot.
    """
    spark = manifest.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    current = hadoop.Path(f"{path.rstrip('/')}/CURRENT")
    files = current.getFileSystem(spark._jsc.hadoopConfiguration())
    first = False
    if not files.exists(current):
        folder = f"manifest-{uuid.uuid4().hex}"
        manifest.select(name, value).write.parquet(f"{path.rstrip('/')}/{folder}")
        try:
            out = files.create(current, False)
            out.write(bytearray(folder.encode()))
            out.close()
            first = True
        except Py4JJavaError:
            if not files.exists(current):
                raise  # not because another one was first
    held = spark.read.text(current.toString()).first()["value"]
    expected = spark.read.schema(manifest.select(name, value).schema).parquet(f"{path.rstrip('/')}/{held}")
    if first:
        both = F.col(value)
        return expected.select(name, both.alias("expected"), both.alias("actual"), F.lit("written").alias("status"))
    return verify_manifest(manifest.select(name, value), expected, name, value)


def asset_paths(matches: DataFrame, folder: Column, stem: Column, extension: Column, per: Sequence[str], position: str) -> DataFrame:
    """Output path of each match; a name with several matches gets the offset in its name."""
    # Written once, as the search behind it is dear and the matches are read twice.
    matches = written(matches, "matches")
    counts = matches.groupBy(*per).agg(F.count("*").alias("_n"))
    at = F.format_string("_0x%08X", F.col(position))
    name = F.concat(stem, F.when(F.col("_n") > 1, at).otherwise(""), extension)
    return matches.join(counts, list(per)).withColumn("asset_path", F.concat_ws("/", folder, name)).drop("_n")


def flat_name(folder: Column, name: Column) -> Column:
    return F.concat_ws("_", folder, name)


def write_assets(assets: DataFrame, folder: str, path: str) -> None:
    """Asset rows, one directory per folder value."""
    assets.write.partitionBy(folder).mode("overwrite").parquet(path)


def read_assets(spark: SparkSession, schema, folder: str, path: str, only: Sequence[str] | None = None) -> DataFrame:
    """What write_assets has written; of some folders only, no other directory is opened. `schema` is that of the assets."""
    assets = spark.read.schema(schema).parquet(path)
    return assets if only is None else assets.where(F.col(folder).isin(list(only)))
