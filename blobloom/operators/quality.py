"""Data quality: domains, contracts, overlaps, and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Step, scan


def nearest_valid(value: Column, valid: Sequence[float]) -> Column:
    """Allowed value with the smallest distance, the lower one on a tie."""
    table = F.array(*[F.struct(F.abs(value - v).alias("d"), F.lit(v).alias("v")) for v in sorted(valid)])
    return F.array_min(table)["v"]


def member_of(columns: Sequence[Column], valid: Sequence) -> Column:
    """Whether all the columns are in the allowed set."""
    inside = F.lit(True)
    for c in columns:
        inside = inside & c.isin(list(valid))
    return inside


def validate_domain(df: DataFrame, value: str, valid: Sequence[float]) -> DataFrame:
    """Rows whose value is not allowed, with the nearest allowed one."""
    bad = df.where(~F.col(value).isin(list(valid)))
    return bad.withColumn("suggested", nearest_valid(F.col(value), valid))


def adjustment_report(df: DataFrame, group: Sequence[str], notes: str) -> DataFrame:
    """Distinct adjustments per group, with the number of rows that had one."""
    return (
        df.where(F.size(notes) > 0)
        .select(*group, F.explode(notes).alias("note"))
        .groupBy(*group, "note")
        .agg(F.count("*").alias("rows"))
    )


def expect(df: DataFrame, rules: dict[str, Column], abort: bool = False) -> DataFrame:
    """Add the first broken rule of each row; with `abort`, a broken rule fails the job."""
    broken = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    out = df.withColumn("broken", broken)
    if abort:
        out = out.where(F.assert_true(broken.isNull(), F.concat(F.lit("broken rule: "), broken)).isNull())
    return out


def layout_checks(df: DataFrame, keys: Sequence[str], start: str, stop: str) -> DataFrame:
    """Sections that begin before the one in front of them has ended."""
    follow = scan(df, keys, [start, stop], Step(before={"_until": F.col(stop)}))
    return follow.where(F.col(start) < F.col("_until")).withColumn(
        "overlap", F.col("_until") - F.col(start)
    ).drop("_until")


def minimum_offset(headers: DataFrame, offset: str, count: str, header: int = 10, size: int = 32) -> DataFrame:
    """Headers whose section starts inside the records before it, with the safe offset."""
    safe = F.col(count) * size + header
    return headers.where(F.col(offset) < safe).withColumn("safe_offset", safe)


def size_contract(df: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """Rows whose produced size is not the computed one."""
    return df.withColumns({"expected": expected, "actual": actual}).where(
        ~F.col("expected").eqNullSafe(F.col("actual"))
    )


def expected_count(spark, declared: int, table: DataFrame, index: str, first: int = 0) -> DataFrame:
    """Declared numbers that the table does not have."""
    numbers = spark.range(first, first + declared).withColumnRenamed("id", index)
    return numbers.join(table, index, "left_anti")


def fill_unmapped(universe: DataFrame, mapped: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Mapped rows, and the keys of the universe without one at their default."""
    rest = universe.select(key).join(mapped, key, "left_anti").withColumns(defaults)
    return mapped.unionByName(rest)


def concat_tracks(*tracks: DataFrame) -> DataFrame:
    """All tracks as one, each row with the number of its track."""
    out = None
    for i, track in enumerate(tracks):
        numbered = track.withColumn("track", F.lit(i))
        out = numbered if out is None else out.unionByName(numbered, allowMissingColumns=True)
    return out
