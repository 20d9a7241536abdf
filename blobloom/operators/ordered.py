"""Running values over ordered rows, without a task that holds all rows of a hot key.

A window puts all rows of a key into one task. That is right for all keys but the hot ones.
The rows of hot keys are cut at quantiles of their order column. Each (key, piece) is one
window group, its totals are carried to the later pieces of its key through a table of one
row per (key, piece), and the carried value is joined back. Without keys, all rows are cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written

# A key with more rows than this is cut, and a piece has about as many.
HOT_ROWS = 4_000_000
# At most this many hot keys and pieces. A key that is not among the 10,000 largest holds
# less than a ten-thousandth of all rows.
MOST = 10_000
# Up to this many cuts are simply compared one by one.
FEW = 64


@dataclass
class Step:
    """Running columns that one pass over the ordered rows adds.

    sums: running total up to and including the row.
    lasts: last value that is not NULL, up to and including the row.
    before, after: value in the previous or next row, NULL at the ends of a key.
    """

    sums: dict[str, Column] = field(default_factory=dict)
    lasts: dict[str, Column] = field(default_factory=dict)
    before: dict[str, Column] = field(default_factory=dict)
    after: dict[str, Column] = field(default_factory=dict)


def cut_points(df: DataFrame, order: str, pieces: int) -> list:
    """At most pieces - 1 values that cut a numeric column into about equal parts."""
    if pieces < 2:
        return []
    shares = [i / pieces for i in range(1, pieces)]
    found = df.select(F.percentile_approx(order, shares, max(10_000, 10 * pieces)).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> list[Row]:
    """The at most MOST largest keys of more than `hot_rows` rows, with their counts."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    return counts.orderBy(F.col("_n").desc()).limit(MOST).collect()


def part_of(df: DataFrame, keys: Sequence[str], hot: list[Row], how: str) -> DataFrame:
    """Rows of the hot keys (left_semi) or all others (left_anti); hot keys are at most MOST."""
    schema = df.select(*keys).schema
    table = df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in hot], schema)
    table = table.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(table[f"_hot_{k}"])
    return df.join(F.broadcast(table), same, how)


def piece_of(order: str, cuts: list) -> Column:
    """Number of cut points at or below the value, by bisection if they are many; 0 for NULL."""
    value = F.col(order)
    if len(cuts) <= FEW:
        return sum((F.when(value >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    table = F.lit(cuts)

    def halve(state, _):
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        right = F.get(table, middle) <= value
        return F.when(
            state["low"] < state["high"],
            F.struct(
                F.when(right, middle + 1).otherwise(state["low"]).alias("low"),
                F.when(right, state["high"]).otherwise(middle).alias("high"),
            ),
        ).otherwise(state)

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return F.coalesce(F.aggregate(steps, start, halve, lambda s: s["low"]), F.lit(0))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], *steps: Step, hot_rows: int | None = None) -> DataFrame:
    """Add the running columns of each step per key, in the given order.

    A later step may use the columns of an earlier one. The first order column must be
    numeric; the order columns must be unique per key. Rows of hot keys are written once,
    as they are read for the cuts, the totals and the result.
    """
    keys, order = list(keys), list(order)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not keys:
        return _scan_pieces(df, keys, order, steps, cut_points(df, order[0], min(MOST, least)))
    hot_rows = hot_rows or HOT_ROWS
    hot = hot_keys(df, keys, hot_rows)
    if not hot:
        return _scan_whole(df, keys, order, steps)
    rows = written(part_of(df, keys, hot, "left_semi"), "hot")
    pieces = min(MOST, max(least, -(-sum(r["_n"] for r in hot) // hot_rows)))
    result = _scan_pieces(rows, keys, order, steps, cut_points(rows, order[0], pieces))
    return _scan_whole(part_of(df, keys, hot, "left_anti"), keys, order, steps).unionByName(result)


def _scan_whole(df: DataFrame, keys: list, order: list, steps: Sequence[Step]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    up_to = w.rowsBetween(W.unboundedPreceding, 0)
    for step in steps:
        new = {n: F.coalesce(F.sum(e).over(up_to), F.lit(0)) for n, e in step.sums.items()}
        new |= {n: F.last(e, ignorenulls=True).over(up_to) for n, e in step.lasts.items()}
        new |= {n: F.lag(e).over(w) for n, e in step.before.items()}
        new |= {n: F.lead(e).over(w) for n, e in step.after.items()}
        df = df.select("*", *[e.alias(n) for n, e in new.items()])
    return df


def _scan_pieces(df: DataFrame, keys: list, order: list, steps: Sequence[Step], cuts: list) -> DataFrame:
    # One struct for the keys, as two structs with NULL inside are equal; so the joins keep
    # the partitioning of the windows.
    df = df.select("*", F.struct(F.lit(0), *keys).alias("_key"), piece_of(order[0], cuts).alias("_piece"))
    for i, step in enumerate(steps):
        df = _step_pieces(written(df, "step") if i else df, order, step)
    return df.drop("_key", "_piece")


def _step_pieces(df: DataFrame, order: list, step: Step) -> DataFrame:
    sums, lasts, before, after = step.sums, step.lasts, step.before, step.after
    part = ["_key", "_piece"]
    position = F.struct(*order)  # in a struct a null is the smallest value, as in the window

    # What a piece hands to its neighbours.
    totals = [F.coalesce(F.sum(e), F.lit(0)).alias(f"_t_{n}") for n, e in sums.items()]
    totals += [F.max_by(e, F.when(e.isNotNull(), position)).alias(f"_t_{n}") for n, e in lasts.items()]
    totals += [F.max_by(e, position).alias(f"_t_{n}") for n, e in before.items()]
    totals += [F.min_by(e, position).alias(f"_t_{n}") for n, e in after.items()]
    table = df.groupBy(*part).agg(*totals)

    along = W.partitionBy("_key").orderBy("_piece")
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    carry = {n: F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)) for n in sums}
    carry |= {n: F.last(f"_t_{n}", ignorenulls=True).over(earlier) for n in lasts}
    carry |= {n: F.lag(f"_t_{n}").over(along) for n in before}
    carry |= {n: F.lead(f"_t_{n}").over(along) for n in after}
    table = table.select(*part, *[e.alias(f"_c_{n}") for n, e in carry.items()])

    local = W.partitionBy(*part).orderBy(*order)
    up_to = local.rowsBetween(W.unboundedPreceding, 0)
    here = {n: F.coalesce(F.sum(e).over(up_to), F.lit(0)) for n, e in sums.items()}
    here |= {n: F.last(e, ignorenulls=True).over(up_to) for n, e in lasts.items()}
    here |= {n: F.lag(F.struct(e.alias("v"))).over(local) for n, e in before.items()}
    here |= {n: F.lead(F.struct(e.alias("v"))).over(local) for n, e in after.items()}
    rows = df.select("*", *[e.alias(f"_h_{n}") for n, e in here.items()]).join(table, part)

    result = {n: F.col(f"_h_{n}") + F.col(f"_c_{n}") for n in sums}
    result |= {n: F.coalesce(F.col(f"_h_{n}"), F.col(f"_c_{n}")) for n in lasts}
    result |= {
        n: F.when(F.col(f"_h_{n}").isNotNull(), F.col(f"_h_{n}")["v"]).otherwise(F.col(f"_c_{n}"))
        for n in [*before, *after]
    }
    return rows.select(*df.columns, *[e.alias(n) for n, e in result.items()])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn", hot_rows: int | None = None) -> DataFrame:
    """Row numbers from 1 per key (or over all rows if there is no key)."""
    return scan(df, keys, order, Step(sums={out: F.lit(1).cast("bigint")}), hot_rows=hot_rows)
