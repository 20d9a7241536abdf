"""Ordered sequences: spans, gaps, separators, sentinels, sticky values, layers, records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binary import each_position
from ..shared import written
from .ordered import Step, numbered, scan

BLOCK = 1024


def record_spans(df: DataFrame, keys: Sequence[str], offset: str, size: int = 1, hot_rows: int | None = None) -> DataFrame:
    """(start, next, count) for each table entry and its successor; the last one drops out."""
    spans = scan(df, keys, [offset], Step(after={"next": F.col(offset)}), hot_rows=hot_rows)
    return spans.where(F.col("next").isNotNull()).withColumn(
        "count", F.floor((F.col("next") - F.col(offset)) / size).cast("bigint")
    )


def gap_groups(
    df: DataFrame, keys: Sequence[str], position: str, gap: int, length=0, tie: Sequence[str] = (), hot_rows: int | None = None
) -> DataFrame:
    """Group hits that are less than `gap` after the hit before them.

    Per group: start, end (last hit and its length), members, and the end of a preview that
    is at most `gap` long.
    """
    order = [position, *tie]
    # A fixed length needs no look at the last hit; sums and extremes stay in a hash table.
    if isinstance(length, Column):
        end = F.max_by(F.col(position) + length, F.struct(*order))
    else:
        end = F.max(position) + length
    opens = F.col("_previous").isNull() | (F.col(position) - F.col("_previous") >= gap)
    look = Step(before={"_previous": F.col(position)})
    hits = scan(df, keys, order, look, Step(sums={"group": opens.cast("bigint")}), hot_rows=hot_rows)
    return (
        hits.groupBy(*keys, "group")
        .agg(
            F.min(position).alias("start"),
            end.alias("end"),
            F.count("*").alias("members"),
        )
        .withColumn("preview_end", F.least("end", F.col("start") + gap))
    )


def segment_by_separator(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], is_separator: Column, run: int, keep_tail: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Sections between runs of at least `run` separators, as (first, last+1) row numbers.

    The whole run is swallowed. The section behind the last run is only kept with
    `keep_tail`, if it has rows. Row numbers start at 0; other sections may be empty.
    """
    keys = list(keys)
    data = (~is_separator).cast("bigint")
    rows = scan(df, keys, order, Step(sums={"_pos": F.lit(1).cast("bigint"), "_data": data}), hot_rows=hot_rows)
    # Separators of one run share the number of data rows before them.
    runs = (
        rows.where(is_separator)
        .groupBy(*keys, "_data")
        .agg((F.min("_pos") - 1).alias("_from"), F.max("_pos").alias("_to"))
        .where(F.col("_to") - F.col("_from") >= run)
    )
    if keep_tail:
        ends = rows.groupBy(*keys).agg(F.max("_pos").alias("_from"), F.max("_data").alias("_data"))
        tail = ends.select(*keys, (F.col("_data") + 1).alias("_data"), "_from", F.col("_from").alias("_to"))
        runs = runs.withColumn("_tail", F.lit(False)).unionByName(tail.withColumn("_tail", F.lit(True)))
    sections = scan(runs, keys, ["_from", "_to"], Step(before={"_start": F.col("_to")}), hot_rows=hot_rows)
    sections = sections.withColumn("_start", F.coalesce("_start", F.lit(0)).cast("bigint"))
    if keep_tail:
        sections = sections.where(~F.col("_tail") | (F.col("_start") < F.col("_from")))
    return sections.select(*keys, F.col("_start").alias("first"), F.col("_from").alias("stop"))


def take_until_sentinel(df: DataFrame, keys: Sequence[str], position: str, is_sentinel: Column) -> DataFrame:
    """Rows before the first sentinel of their key; all rows if it has none."""
    keys = list(keys)
    stops = df.where(is_sentinel).groupBy(*keys).agg(F.min(position).alias("_stop"))
    return (
        df.join(stops, keys, "left")
        .where(F.col("_stop").isNull() | (F.col(position) < F.col("_stop")))
        .drop("_stop")
    )


def sticky_state(df: DataFrame, keys: Sequence[str], order: Sequence[str], setter: Column, default, out: str = "state", hot_rows: int | None = None) -> DataFrame:
    """Value of the last setter so far; `setter` is NULL in rows that set nothing."""
    rows = scan(df, keys, order, Step(lasts={out: setter}), hot_rows=hot_rows)
    return rows.withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def _then(first: Column, second: Column) -> Column:
    """Two clamped steps x -> min(high, max(low, x + add)) as one."""
    low = F.least(second["high"], F.greatest(second["low"], first["low"] + second["add"]))
    high = F.least(second["high"], F.greatest(second["low"], first["high"] + second["add"]))
    return F.struct((first["add"] + second["add"]).alias("add"), low.alias("low"), high.alias("high"))


def _composed(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each BLOCK steps (keys, _at, step) in a row one: as many steps as there are blocks."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "step"))), lambda s: s["step"])
    blocks = steps.groupBy(*keys, F.floor(F.col("_at") / BLOCK).cast("bigint").alias("_block")).agg(ordered.alias("_steps"))
    whole = F.aggregate(F.expr("slice(_steps, 2, size(_steps))"), F.col("_steps")[0], _then)
    return blocks.select(*keys, F.col("_block").alias("_at"), whole.alias("step"))


def _levels(blocks: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """Steps of blocks, of blocks of blocks and so on, until one is left per key; all but the first are written."""
    levels = [blocks]
    most = blocks.agg(F.max("_at")).first()[0] or 0
    while most:
        levels.append(written(_composed(levels[-1], keys), "steps"))
        most //= BLOCK
    return levels


def bounded_accumulate(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], delta: Column, low: int, high: int, start: int, out: str = "total",
    hot_rows: int | None = None,
) -> DataFrame:
    """Sum per key that is cut to [low, high] after every step.

    Clamped steps are composable, so each block of 1024 rows becomes one step, each 1024
    blocks become one step again, until one is left per key. A missing delta is 0.
    """
    keys = list(keys)
    bound = [F.lit(v).cast("bigint").alias(n) for v, n in ((low, "low"), (high, "high"))]
    delta = F.coalesce(delta.cast("bigint"), F.lit(0).cast("bigint"))
    steps = numbered(df, keys, order, "_rn", hot_rows=hot_rows).select(
        *keys, (F.col("_rn") - 1).alias("_at"), F.struct(delta.alias("add"), *bound).alias("step")
    )
    step = F.col("step")
    return _levels(written(_composed(steps, keys), "steps"), keys)[-1].select(
        *keys, F.least(step["high"], F.greatest(step["low"], F.lit(start) + step["add"])).alias(out)
    )


def _clamped(value: Column, step: Column) -> Column:
    return F.least(step["high"], F.greatest(step["low"], value + step["add"]))


def _replayed(items: Column, start: Column, step, after: bool) -> Column:
    """The running value of each item of an array, behind its step (or in front of it)."""

    def add(state, item):
        value = _clamped(state["value"], step(item))
        return F.struct(value.alias("value"), F.array_append(state["told"], value if after else state["value"]).alias("told"))

    begin = F.struct(start.alias("value"), F.array().cast("array<bigint>").alias("told"))
    return F.aggregate(items, begin, add, lambda state: state["told"])


def bounded_running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], delta: Column, low: int, high: int, start: int, out: str = "total",
    is_end: Column | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """The rows with their key's sum so far, cut to [low, high] after every step; a missing delta is 0.

    With `is_end` a key stops in front of its first such row: that row and those behind it drop out. Rows go into
    blocks of 1024, and a block's steps make one step. The steps of blocks are composed level by level up to
    one per key; down again, each level's starts follow from those above; in the end every block is replayed
    from its start. So a key of any length is spread over its blocks.
    """
    keys = list(keys)
    columns = df.columns
    sums = {"_rn": F.lit(1).cast("bigint")}
    if is_end is not None:
        sums["_ends"] = F.coalesce(is_end, F.lit(False)).cast("bigint")
    rows = scan(df, keys, order, Step(sums=sums), hot_rows=hot_rows)
    if is_end is not None:
        rows = rows.where(F.col("_ends") == 0)
    bound = [F.lit(v).cast("bigint").alias(n) for v, n in ((low, "low"), (high, "high"))]
    step = F.struct(F.coalesce(delta.cast("bigint"), F.lit(0).cast("bigint")).alias("add"), *bound)
    # One struct for the keys, as structs with NULL inside are equal.
    rows = rows.select(F.struct(F.lit(0), *keys).alias("_key"), (F.col("_rn") - 1).alias("_at"), step.alias("step"), F.struct(*columns).alias("row"))
    held = F.array_sort(F.collect_list(F.struct("_at", "step", "row")))
    blocks = rows.groupBy("_key", F.floor(F.col("_at") / BLOCK).cast("bigint").alias("_block")).agg(held.alias("_rows"))
    own = F.transform("_rows", lambda r: r["step"])
    whole = F.aggregate(F.slice(own, F.lit(2), F.size("_rows")), F.col("_rows")[0]["step"], _then)
    blocks = written(blocks.select("_key", F.col("_block").alias("_at"), "_rows", whole.alias("step")), "blocks")

    levels = _levels(blocks.select("_key", "_at", "step"), ["_key"])
    starts = levels[-1].select("_key", "_at", F.lit(start).cast("bigint").alias("start"))
    for level in reversed(levels[:-1]):
        group = level.groupBy("_key", F.floor(F.col("_at") / BLOCK).cast("bigint").alias("_above")).agg(F.array_sort(F.collect_list(F.struct("_at", "step"))).alias("_steps"))
        above = starts.select("_key", F.col("_at").alias("_above"), "start")
        told = _replayed(F.col("_steps"), F.col("start"), lambda s: s["step"], after=False)
        pairs = F.arrays_zip(F.transform("_steps", lambda s: s["_at"]).alias("_at"), told.alias("start"))
        starts = written(group.join(above, ["_key", "_above"]).select("_key", F.explode(pairs).alias("p")).select("_key", "p._at", "p.start"), "starts")

    told = _replayed(F.col("_rows"), F.col("start"), lambda r: r["step"], after=True)
    pairs = F.arrays_zip(F.transform("_rows", lambda r: r["row"]).alias("row"), told.alias("value"))
    done = blocks.join(starts, ["_key", "_at"]).select(F.explode(pairs).alias("p"))
    return done.select(*[F.col("p.row")[c].alias(c) for c in columns], F.col("p.value").alias(out))


def dictionary_encode(df: DataFrame, key: Sequence[str], order: str, out: str = "code") -> DataFrame:
    """Distinct keys with dense codes from 0 in the order of their first appearance."""
    # Written once, because both the cut points and the numbering read it.
    firsts = written(
        df.groupBy(*key).agg(F.min(order).alias("first_at"), F.count("*").alias("uses"))
    )
    coded = numbered(firsts, [], ["first_at", *key], out)
    return coded.withColumn(out, F.col(out) - 1)


def composite_layers(records: DataFrame, cells: Sequence[str], layer: Sequence[str], value: str, palette: Column | None = None) -> DataFrame:
    """Visible value of each cell: that of the last layer which is not zero, else 0.

    With a palette number, a visible value becomes value + 16 * palette.
    """
    shown = F.col(value) if palette is None else F.col(value) + palette * 16
    order = F.col(layer[0]) if len(layer) == 1 else F.struct(*layer)
    top = F.max_by(shown, F.when(F.col(value) != 0, order))
    visible = F.max((F.col(value) != 0).cast("int")) == 1
    return records.groupBy(*cells).agg(F.when(visible, top).otherwise(F.lit(0)).alias("shown"))


def context_window(df: DataFrame, text: str, position: str, length: Column, around: int) -> DataFrame:
    """The text of a hit with `around` characters on both sides, cut at the ends."""
    start = F.greatest(F.lit(1), F.col(position) - around)
    stop = F.least(F.length(text), F.col(position) + length - 1 + around)
    return df.withColumn("context", F.substring(F.col(text), start, stop - start + 1))


def run_expand(runs, length: Column | None = None) -> Column:
    """Flat array of an array of (value, count) runs; stops at a zero count or at `length`."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    stop = F.array_position(F.transform(runs, lambda r: r["count"] <= 0), True)
    kept = F.when(stop > 0, F.slice(runs, F.lit(1), (stop - 1).cast("int"))).otherwise(runs)
    flat = F.flatten(F.transform(kept, lambda r: F.array_repeat(r["value"], r["count"].cast("int"))))
    return flat if length is None else F.slice(flat, F.lit(1), length.cast("int"))


def stride_records(df: DataFrame, blob: str, size: int, offset: int = 0, every: int | None = None) -> DataFrame:
    """Fixed-size records of a blob, one row each; a short tail is dropped."""
    keep = [c for c in df.columns if c != blob]
    step = every or size
    rows = each_position(df, "at", F.lit(offset), F.octet_length(blob) - size, step)
    record = F.floor((F.col("at") - offset) / step).cast("int")
    return rows.select(*keep, record.alias("record"), "at", F.expr(f"substring(`{blob}`, at + 1, {size})").alias("bytes"))


def scan_nonoverlapping(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Positions (from 0) of the greedy left-to-right matches, one row each."""
    keep = [c for c in df.columns if c != text]
    parts = F.split(F.col(text), r"\Q" + pattern + r"\E", -1)
    # The n-th match starts behind the first n parts and the n - 1 matches between them.
    width = len(pattern)
    lengths = F.transform(parts, lambda p: F.length(p))
    return (
        df.select(*keep, F.posexplode(lengths).alias("match", "_length"), (F.size(parts) - 1).alias("_n"))
        .where(F.col("match") < F.col("_n"))
        .withColumn("_upto", F.sum("_length").over(W.partitionBy(*keep).orderBy("match")))
        .select(*keep, "match", (F.col("_upto") + F.col("match") * width).cast("bigint").alias("position"))
    )


def offset_from_end(df: DataFrame, position: str, length: Column) -> DataFrame:
    return df.withColumn("from_end", length - F.col(position))
