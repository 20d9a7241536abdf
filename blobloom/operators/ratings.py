"""Ratings: code tables, imputation from ranks, renaming and contributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .ordered import Step, scan

# Rating code -> rating.
RATING_SCALE = {0: 25, 1: 40, 2: 50, 3: 65, 4: 75, 5: 90, 6: 100}


def translate_rating(code: Column) -> Column:
    """Rating of a code 0..6; NULL for other codes."""
    return F.when(code.between(0, 6), F.get(F.lit(list(RATING_SCALE.values())), code.cast("int")))


def percent_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Share of the other rows whose value is lower, over the whole table.

    Counted on the distinct values, whose running total is built in pieces, so that no task
    sees the whole table. A row without a value has no rank.
    """
    # Written once, as it is read for the cuts, the totals and the numbers.
    counts = written(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")))
    below = scan(counts, [], [value], Step(sums={"_upto": F.col("_n")}))
    rows = counts.agg(F.sum("_n")).scalar()
    rank = (F.col("_upto") - F.col("_n")) / F.greatest(rows - 1, F.lit(1))
    return df.join(below.select(value, rank.alias(out)), value, "left")


def impute_rating(df: DataFrame, rating: str, inputs: Sequence[str], offset: int = 0, out: str | None = None) -> DataFrame:
    """Given rating, or 99 times the mean percent rank of the inputs plus an offset, cut to
    0..99 and rounded. The formula is this library's own; only the inputs are prescribed."""
    ranked = df
    for c in inputs:
        ranked = percent_rank(ranked, c, f"_r_{c}")
    mean = sum((F.col(f"_r_{c}") for c in inputs), F.lit(0.0)) / len(inputs)
    derived = F.greatest(F.lit(0), F.least(F.lit(99), F.floor(mean * 99 + offset + 0.5)))
    return ranked.withColumn(out or rating, F.coalesce(F.col(rating), derived.cast("int"))).drop(
        *[f"_r_{c}" for c in inputs]
    )


def rename_ratings(df: DataFrame, mapping: Sequence[tuple[str, str]], keep: Sequence[str]) -> DataFrame:
    """(old, new) pairs; one old column may feed several new ones."""
    return df.select(*keep, *[F.col(old).alias(new) for old, new in mapping])


def contributions(df: DataFrame, keys: Sequence[str], stats: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """One row per key and contributing stat, with its weight and weighted value."""
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    long = df.unpivot(list(keys), list(stats), "stat", "amount")
    return (
        long.withColumn("weight", weight[F.col("stat")])
        .where(F.col("weight").isNotNull())
        .withColumn("weighted", F.col("amount") * F.col("weight"))
    )
