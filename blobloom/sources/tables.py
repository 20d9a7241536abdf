"""Delimited files, wide tables, nested JSON and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..shared import small_rows

# Columns that a wide table may get from data.
MAX_WIDE = 2_000


def read_csv_positional(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Text columns bound by position; a header line counts as data."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).option("header", False).csv(path)


def titled(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    """Chosen columns under their display titles."""
    return df.select(*[F.col(c).alias(t) for c, t in titles.items()])


def write_csv_titled(df: DataFrame, titles: dict[str, str], path: str) -> None:
    titled(df, titles).write.mode("overwrite").option("header", True).csv(path)


def wide(df: DataFrame, key: Sequence[str], name: str, value: Column, keys: Sequence[str] | None = None) -> DataFrame:
    """One row per key, one column per name in the data, missing cells as empty text."""
    if keys is None:
        rows = small_rows(df.select(name).distinct(), MAX_WIDE)
        if rows is None:
            raise ValueError(f"more than {MAX_WIDE} columns")
        keys = sorted(r[0] for r in rows if r[0] is not None)
    cells = df.groupBy(*key).pivot(name, list(keys)).agg(value)
    return cells.select(*key, *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")).alias(k) for k in keys])


def wide_from_map(df: DataFrame, key: Sequence[str], attributes: str) -> DataFrame:
    """`wide` for a map column; of repeated labels of a key the largest value is kept."""
    long = df.select(*key, F.explode(attributes).alias("_name", "_value"))
    return wide(long, key, "_name", F.max("_value"))


def stack_wide(*frames: DataFrame) -> DataFrame:
    """Union by name of frames with different columns, missing cells as empty text."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.na.fill("")


def write_wide(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def flatten_nested(df: DataFrame, json: str, schema: str, paths: dict[str, str]) -> DataFrame:
    """Dotted paths out of a JSON text as flat columns."""
    keep = [c for c in df.columns if c != json]
    parsed = df.select(*keep, F.from_json(json, schema).alias("_j"))
    return parsed.select(*keep, *[F.col(f"_j.{p}").alias(n) for p, n in paths.items()])


def json_sidecar(df: DataFrame, key: Sequence[str], columns: Sequence) -> DataFrame:
    """One JSON document of metadata per item."""
    return df.select(*key, F.to_json(F.struct(*columns)).alias("document"))


def report_lines(df: DataFrame, group: Sequence[str], order: Sequence[str], header: str, line: Column) -> DataFrame:
    """Lines of a report per group, numbered in order, with the header as line 0."""
    body = numbered(df, group, order, "line_no").select(*group, "line_no", line.alias("line"))
    heads = df.select(*group).distinct().select(*group, F.lit(0).cast("bigint").alias("line_no"), F.lit(header).alias("line"))
    return heads.unionByName(body)
