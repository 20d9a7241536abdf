"""Histograms, profiles, imbalance measures and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import small_rows, written
from . import inplace
from .ordered import numbered


def histogram(df: DataFrame, group: Sequence[str], key: Sequence[str], count: str = "cnt") -> DataFrame:
    """Count per distinct key in each group."""
    return df.groupBy(*group, *key).agg(F.count("*").alias(count))


def top_k(hist: DataFrame, group: Sequence[str], key: Sequence[str], k: int, count: str = "cnt") -> DataFrame:
    """The k largest counts per group, smallest key first on a tie, with their rank.

    Spark cuts each partition to k rows per group before it moves any of them.
    """
    ranking = W.partitionBy(*group).orderBy(F.col(count).desc(), *key)
    return hist.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)


def bytes_of(df: DataFrame, ids: Sequence[str], blob: str) -> DataFrame:
    """Histogram of the byte values of each blob: ids, byte, cnt. Blobs with the same ids count together."""
    return inplace.value_counts(df, ids, blob).groupBy(*ids, "byte").agg(F.sum("cnt").alias("cnt"))


def byte_profile(df: DataFrame, ids: Sequence[str], blob: str) -> DataFrame:
    """Length, distinct values, extremes, mean and population deviation of each blob's bytes.

    Bytes are counted where the blob is read; one row of sums per blob is all that moves.
    """
    marks = [f"marks{i}" for i in range(4)]
    sums = inplace.totals(df, ids, blob).groupBy(*ids).agg(
        F.sum("length").alias("length"),
        sum(F.bit_count(F.bit_or(m)) for m in marks).cast("bigint").alias("distinct_values"),
        F.min("low").alias("min_value"),
        F.max("high").alias("max_value"),
        F.sum("s").alias("_s"),
        F.sum("q").alias("_q"),
    )
    mean = F.col("_s") / F.col("length")
    # n * sum of squares - square of the sum is exact in integers.
    spread = F.sqrt(
        (F.col("length").cast("decimal(38,0)") * F.col("_q") - F.col("_s").cast("decimal(38,0)") * F.col("_s")).cast("double")
    )
    return sums.select(
        *ids, "length", "distinct_values", "min_value", "max_value",
        mean.alias("mean"), (spread / F.col("length")).alias("std_dev"),
    )


def top_bytes(df: DataFrame, ids: Sequence[str], blob: str, k: int = 10) -> DataFrame:
    """The k most frequent bytes of each blob with their percentage to one decimal."""
    hist = bytes_of(df, ids, blob)
    share = F.col("cnt") / F.sum("cnt").over(W.partitionBy(*ids)) * 100
    return top_k(hist.withColumn("percent", F.round(share, 1)), ids, ["byte"], k)


def adjacent_repeats(df: DataFrame, blob: str, shortest: int = 2, longest: int = 8) -> DataFrame:
    """How often each piece of 2..8 bytes is directly followed by itself, by content: (pattern, repeats)."""
    return inplace.adjacent_repeats(df, blob, shortest, longest)


def range_counts(df: DataFrame, group: Sequence[str], value: str, bands: dict[str, tuple]) -> DataFrame:
    """Total, extremes, mean, and per half-open band its count and percentage."""
    v = F.col(value)
    aggs = [F.count(v).alias("total"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean")]
    aggs += [F.count(F.when((v >= lo) & (v < hi), 1)).alias(f"{n}_count") for n, (lo, hi) in bands.items()]
    out = df.groupBy(*group).agg(*aggs)
    return out.withColumns({f"{n}_percent": F.col(f"{n}_count") / F.col("total") * 100 for n in bands})


def primary_key_of(df: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Most frequent key of each group, the smallest on a tie."""
    counts = histogram(df, group, [key])
    return counts.groupBy(*group).agg(
        F.min_by(key, F.struct(-F.col("cnt"), F.col(key))).alias("primary"), F.max("cnt").alias("uses")
    )


def bounding_box(df: DataFrame, group: Sequence[str], x: Column, y: Column, width: Column, height: Column, unit: int = 8) -> DataFrame:
    """Box around sprites of width x height units, and its size; zeros for no sprites."""
    box = df.groupBy(*group).agg(
        F.coalesce(F.min(x), F.lit(0)).alias("min_x"),
        F.coalesce(F.max(x + width * unit), F.lit(0)).alias("max_x"),
        F.coalesce(F.min(y), F.lit(0)).alias("min_y"),
        F.coalesce(F.max(y + height * unit), F.lit(0)).alias("max_y"),
    )
    return box.withColumn("width", F.col("max_x") - F.col("min_x")).withColumn(
        "height", F.col("max_y") - F.col("min_y")
    )


def moved_to_origin(df: DataFrame, group: Sequence[str], x: str, y: str, box: DataFrame) -> DataFrame:
    """The rows with x and y counted from the corner of their group's box; groups may be null."""
    corner = box.select(*[F.col(g).alias(f"_{g}") for g in group], "min_x", "min_y")
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    moved = df.join(corner, same, "left").withColumns({x: F.col(x) - F.col("min_x"), y: F.col(y) - F.col("min_y")})
    return moved.select(*df.columns)


def extents(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest, largest and range of each column, one row per column, with hex limits."""
    both = df.agg(*[f(c).cast("bigint").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("low"), F.col(f"hi_{c}").alias("high")) for c in columns])
    )
    return both.select(rows.alias("e")).select("e.*").select(
        "*",
        (F.col("high") - F.col("low")).alias("range"),
        F.hex("low").alias("low_hex"),
        F.hex("high").alias("high_hex"),
    )


def usage_stats(df: DataFrame, group: Sequence[str], key: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent keys per group, and the group's rounded share of all rows."""
    # Written once, as it is read for the keys, the groups and the total.
    hist = written(histogram(df, group, key), "histogram")
    sizes = hist.groupBy(*group).agg(F.sum("cnt").alias("group_rows"))
    everything = sizes.agg(F.sum("group_rows")).scalar()
    shares = sizes.withColumn("percent", F.floor(F.col("group_rows") * 100 / everything + 0.5).cast("bigint"))
    return top_k(hist, group, key, k).join(shares.drop("group_rows"), list(group))


def merge_histograms(hist: DataFrame, part: Sequence[str], key: Sequence[str], per_part: int = 64, k: int = 16) -> DataFrame:
    """The k largest keys of the merged lists of each part's `per_part` largest keys."""
    merged = top_k(hist, part, key, per_part).groupBy(*key).agg(F.sum("cnt").alias("cnt"))
    return merged.orderBy(F.col("cnt").desc(), *key).limit(k)


def shared_keys(hist: DataFrame, group: str, key: Sequence[str]) -> DataFrame:
    """Keys of more than one group, with their groups and total count."""
    return (
        hist.groupBy(*key)
        .agg(F.count_distinct(group).alias("groups"), F.sum("cnt").alias("total"))
        .where(F.col("groups") > 1)
    )


def key_count(hist: DataFrame, group: Sequence[str]) -> DataFrame:
    return hist.groupBy(*group).agg(F.count("*").cast("double").alias("score"))


def entropy(hist: DataFrame, group: Sequence[str]) -> DataFrame:
    """Shannon entropy in bits of each group's histogram.

    Uses H = log2(n) - sum(c * log2(c)) / n, so one pass over the counts is enough.
    """
    c = F.col("cnt")
    score = F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c)
    return hist.groupBy(*group).agg(score.alias("score"))


def importance(hist: DataFrame, group: Sequence[str]) -> DataFrame:
    """Square root weight of each group; up to three keys count as one."""
    many = F.sum(F.sqrt("cnt"))
    score = F.when(F.count("*") <= 3, F.sqrt(F.sum("cnt"))).otherwise(many)
    return hist.groupBy(*group).agg(score.alias("score"))


SCORES = {"count": key_count, "entropy": entropy, "importance": importance}


def spread_of(measure: str, score: str = "score", groups: int | None = None) -> Column:
    """Aggregate: how far apart the scores of the groups are.

    With `groups` a missing group is an empty one, whose score is 0.
    """
    s = F.col(score)
    if measure == "importance":
        positive = F.when(s > 0, s)
        return F.log1p(F.max(s)) - F.log1p(F.min(positive))
    lowest = F.min(s)
    if groups is not None:
        lowest = F.when(F.count("*") < groups, F.lit(0.0)).otherwise(lowest)
    return F.max(s) - lowest


def imbalance(hist: DataFrame, group: Sequence[str], measure: str) -> DataFrame:
    """One number: spread of the groups' key counts, entropies or importances."""
    return SCORES[measure](hist, group).agg(spread_of(measure).alias("imbalance"))


def imbalance_area(rectangles: DataFrame) -> DataFrame:
    """Largest minus smallest area of rectangles (x0, y0, x1, y1)."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return rectangles.agg((F.max(area) - F.min(area)).alias("imbalance"))


def invert_index(df: DataFrame, value: Sequence[str], index: str, low: int = 128, high: int = 255, groups: int | None = 64) -> DataFrame:
    """Value -> sorted indices, for the indices low..high that are in use.

    An index set has at most high - low + 1 members; duplicates go before the grouping.
    """
    used = df.where(F.col(index).between(low, high)).select(*value, index).distinct()
    out = used.groupBy(*value).agg(F.sort_array(F.collect_list(index)).alias("indices"))
    return out if groups is None else out.orderBy(F.element_at("indices", 1), *value).limit(groups)


def density(hist: DataFrame, group: Sequence[str], area: DataFrame, size: str) -> DataFrame:
    """Distinct keys per unit of size of each group."""
    keys = hist.groupBy(*group).agg(F.count("*").alias("keys"))
    return keys.join(area, list(group)).withColumn("density", F.col("keys") / F.col(size))


def distinct_keys(df: DataFrame, map_column: str) -> DataFrame:
    """Union of the map keys of all rows."""
    return df.select(F.explode(F.map_keys(map_column)).alias("key")).distinct()


def run_summary(df: DataFrame, group: Sequence[str], folder: str, size: Column) -> DataFrame:
    """Items, distinct folders, total size and size per item."""
    return df.groupBy(*group).agg(
        F.count("*").alias("items"),
        F.count_distinct(folder).alias("folders"),
        F.sum(size).alias("total"),
        (F.sum(size) / F.count("*")).alias("per_item"),
    )


def transform_extremes(df: DataFrame, group: Sequence[str], value: Column) -> DataFrame:
    """Smallest and largest transformed value."""
    return df.groupBy(*group).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def first_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """The first n rows in a total order."""
    return df.orderBy(*order).limit(n)


def sort_by_luminance(palette: DataFrame, group: Sequence[str], index: str, luminance: Column) -> DataFrame:
    """New place of each entry: entry 0 stays, the others follow by ascending luminance."""
    pinned = F.when(F.col(index) == 0, F.lit(-1.0)).otherwise(luminance)
    placed = numbered(palette.withColumn("_lum", pinned), group, ["_lum", index], "place")
    return placed.withColumn("place", F.col("place") - 1).drop("_lum")


def unique_sorted_limited(df: DataFrame, columns: Sequence[str], most: int = 59) -> DataFrame:
    """Distinct rows in order; fails if there are more than `most`."""
    unique = df.select(*columns).distinct()
    rows = small_rows(unique, most)
    if rows is None:
        raise ValueError(f"more than {most} distinct values")
    # The rows are here, so they are not computed again.
    return df.sparkSession.createDataFrame(rows, unique.schema).orderBy(*columns)
