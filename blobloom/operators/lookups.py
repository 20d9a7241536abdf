"""Lookups: manifests, codes, overrides, ranges, rectangles, merges.

The joins carry no hints: Spark broadcasts a side whose size it knows, or measures at run
time, to be below its threshold, and splits skewed partitions of the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import small_rows

# Up to this many ranges are tested in the row itself.
LITERAL_RANGES = 64

# Size code 0..15 -> tiles, width, height (in tiles).
SIZE_CODES = tuple(
    (4 * (w - 1) + h - 1, w * h, w, h) for w in range(1, 5) for h in range(1, 5)
)


def verify_manifest(actual: DataFrame, expected: DataFrame, name: str, value: str) -> DataFrame:
    """Status ok, mismatch or missing for each expected row; extra actual rows are silent."""
    found = actual.select(name, F.col(value).alias("actual"), F.lit(True).alias("_found"))
    joined = expected.withColumnRenamed(value, "expected").join(found, name, "left")
    status = (
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("expected").eqNullSafe(F.col("actual")), "ok")
        .otherwise("mismatch")
    )
    return joined.select(name, "expected", "actual", status.alias("status"))


def identify_signature(blobs: DataFrame, signatures: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Name of the signature with the same size and checksum; NULL where nothing fits."""
    known = signatures.groupBy(*keys).agg(F.min(name).alias(name))
    return blobs.join(known, list(keys), "left")


def unidentified(blobs: DataFrame, signatures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blobs without a signature."""
    return blobs.join(signatures.select(*keys).distinct(), list(keys), "left_anti")


def decode_size(code: Column) -> Column:
    """Struct (tiles, width, height) of a size code; NULL outside 0..15."""
    table = F.array(
        *[
            F.struct(F.lit(t).alias("tiles"), F.lit(w).alias("width"), F.lit(h).alias("height"))
            for _, t, w, h in SIZE_CODES
        ]
    )
    return F.when(code.between(0, 15), F.get(table, code.cast("int")))


def decode_by_dimension(records: DataFrame, dimension: DataFrame, code: str) -> DataFrame:
    return records.join(dimension, code, "left")


def palette_lookup(pixels: DataFrame, palette: DataFrame, index: str, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Channels of each pixel's palette entry; black where the entry is missing."""
    return pixels.join(palette, index, "left").na.fill(0, list(channels))


def remap_two_hop(
    df: DataFrame, remap: DataFrame, palette: DataFrame, index: str, target: str, low: int | None = None, default=0
) -> DataFrame:
    """palette[remap[index]]; indices below `low` or outside the map get the default."""
    if low is not None:
        remap = remap.where(F.col(index) >= low)
    hops = remap.join(palette, target, "left")
    values = [c for c in palette.columns if c != target]
    mapped = df.join(hops.select(index, *values), index, "left")
    return mapped.na.fill(default, values)


def resolve_override(
    df: DataFrame, specific: DataFrame, general: DataFrame, specific_keys: Sequence[str], name: str, value: str
) -> DataFrame:
    """Value of the specific table, else of the general one, else the name itself if it is a
    literal (holds a blank); `source` says which, and is "error" if nothing resolves."""
    near = specific.select(*specific_keys, F.col(value).alias("_near"))
    far = general.select(name, F.col(value).alias("_far"))
    joined = df.join(near, list(specific_keys), "left").join(far, name, "left")
    literal = F.when(F.instr(F.col(name), " ") > 0, F.col(name))
    source = (
        F.when(F.coalesce("_near", F.lit("")) != "", "specific")
        .when(F.coalesce("_far", F.lit("")) != "", "general")
        .when(literal.isNotNull(), "literal")
        .otherwise("error")
    )
    resolved = F.coalesce(F.nullif("_near", F.lit("")), F.nullif("_far", F.lit("")), literal)
    return joined.select(*df.columns, resolved.alias(value), source.alias("source"))


def tuned_default(custom: Column, default: Column, otherwise: float = 1.0) -> Column:
    """Custom value if there is one (0 counts); else the default, where 0 or NULL mean none."""
    return F.coalesce(custom, F.nullif(default, F.lit(0)), F.lit(otherwise))


def range_lookup(
    df: DataFrame, value: str, ranges: DataFrame, key: str, low: str, high: str, default=0, width: float | None = None
) -> DataFrame:
    """Smallest range key with low <= value <= high, else the default.

    A small range table is searched in the row itself. A large one is cut into buckets of
    `width`, and each distinct value meets only the ranges of its own bucket. Without a width,
    buckets are as wide as the mean range or the mean distance of ranges, whichever is more, so
    ranges have few pieces on average and none has more than there are ranges.
    """
    rows = small_rows(ranges.select(key, low, high), LITERAL_RANGES)
    if rows is not None:
        hit = F.lit(default)
        for k, lo, hi in sorted(rows, reverse=True):
            hit = F.when(F.col(value).between(lo, hi), F.lit(k)).otherwise(hit)
        return df.withColumn(key, hit)
    if width is None:
        span = ranges.agg(F.max(high) - F.min(low), F.avg(F.col(high) - F.col(low)), F.count("*")).first()
        width = max(float(span[0] or 0) / span[2], float(span[1] or 0)) or 1.0

    def bucket(c) -> Column:
        return F.floor(F.col(c) / width)

    pieces = ranges.select(key, low, high, F.explode(F.sequence(bucket(low), bucket(high))).alias("_b"))
    values = df.select(value).distinct().withColumn("_b", bucket(value))
    hits = (
        values.join(pieces, "_b")
        .where(F.col(value).between(F.col(low), F.col(high)))
        .groupBy(value)
        .agg(F.min(key).alias(key))
    )
    return df.join(hits, value, "left").withColumn(key, F.coalesce(key, F.lit(default)))


def assign_region(x: Column, y: Column, rectangles: Sequence[Sequence[float]], default: int | None = 0) -> Column:
    """Index of the first half-open rectangle (x0, y0, x1, y1) that holds the point."""
    hit = F.lit(default).cast("int")
    for i, (x0, y0, x1, y1) in reversed(list(enumerate(rectangles))):
        inside = (x >= x0) & (x < x1) & (y >= y0) & (y < y1)
        hit = F.when(inside, F.lit(i)).otherwise(hit)
    return hit


def interval_catalog(
    df: DataFrame, value: str, catalog: DataFrame, category: str, low: str, high: str, other_low: str | None = None, width: float | None = None
) -> DataFrame:
    """Category of the closed interval that holds the value, and the value's counterpart in
    another version of the catalog (value - low + other_low)."""
    found = range_lookup(df, value, catalog, low, low, high, default=None, width=width)
    extra = [category] + ([other_low] if other_low else [])
    named = found.join(catalog.select(low, *extra).dropDuplicates([low]), low, "left")
    if other_low:
        named = named.withColumn("other", F.col(value) - F.col(low) + F.col(other_low)).drop(other_low)
    return named.drop(low)


def merge_by_index(a: DataFrame, b: DataFrame, index: str, value: str, first: int, tail_from: int | None = None) -> DataFrame:
    """Entries below `first` (and from `tail_from` on) from a, the rest from b."""
    from_a = F.col(index) < first
    if tail_from is not None:
        from_a = from_a | (F.col(index) >= tail_from)
    return a.where(from_a).select(index, value).unionByName(b.where(~from_a).select(index, value))


def catalog_fill(spark, start: int, stop: int, known: DataFrame, code: str, default: dict) -> DataFrame:
    """Every code of start..stop with its known columns, or the defaults."""
    codes = spark.range(start, stop + 1).withColumnRenamed("id", code)
    return codes.join(known, code, "left").na.fill(default)


def parameter_sweep(items: Sequence, factors: Sequence[float], named: Sequence[tuple] = ()) -> list[tuple]:
    """(name, item, factor): a baseline, every item with every factor, and named extras."""
    grid = [("baseline", None, None)]
    grid += [
        (f"item{item}_factor{factor:g}".replace(".", "_"), item, float(factor))
        for item in items
        for factor in factors
    ]
    return grid + [(name, item, float(factor)) for name, item, factor in named]


def apply_sweep(df: DataFrame, item: str, amount: str, scenarios: Sequence[tuple], out: str = "total") -> DataFrame:
    """Total amount under each scenario, where the scenario's item is scaled by its factor.

    The rows are summed once per item; only those sums meet the scenarios.
    """
    sums = df.groupBy(item).agg(F.sum(amount).alias("_sum"))
    types = (("scenario", "string"), ("item", dict(df.dtypes)[item]), ("factor", "double"))
    table = F.array(
        *[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(s, types)]) for s in scenarios]
    )
    scaled = sums.select(item, "_sum", F.explode(table).alias("_s"))
    factor = F.when(F.col(f"_s.item").eqNullSafe(F.col(item)), F.col("_s.factor")).otherwise(1.0)
    return scaled.groupBy(F.col("_s.scenario").alias("scenario")).agg(F.sum(F.col("_sum") * factor).alias(out))


def recode(df: DataFrame, code: str, table: DataFrame, new: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their new code, unmapped codes with their row counts)."""
    joined = df.join(table.withColumn("_known", F.lit(True)), code, "left")
    mapped = joined.where(F.col("_known")).drop("_known")
    missing = joined.where(F.col("_known").isNull()).groupBy(code).agg(F.count("*").alias("skipped"))
    return mapped, missing


def enrich(base: DataFrame, key: str, *details: DataFrame) -> DataFrame:
    """Left joins on one key; a later source overrides columns of the same name, and a row
    without details stays."""
    out = base
    for detail in details:
        common = [c for c in detail.columns if c != key and c in out.columns]
        renamed = detail.withColumnsRenamed({c: f"_new_{c}" for c in common}).withColumn("_got", F.lit(True))
        out = out.join(renamed, key, "left")
        overrides = {c: F.when(F.col("_got"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in common}
        out = out.withColumns(overrides).drop("_got", *[f"_new_{c}" for c in common])
    return out


def unnest(parent: DataFrame, path: str, out: str = "item", keep_empty: bool = False) -> DataFrame:
    """One row per element of a nested array."""
    top = path.split(".")[0]
    keep = [c for c in parent.columns if c != top]
    blow = F.explode_outer if keep_empty else F.explode
    return parent.select(*keep, blow(path).alias(out))


def keep_failed(base: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """All keys of base; where the lookup failed, the row has only its key."""
    return base.select(key).join(detail, key, "left")
