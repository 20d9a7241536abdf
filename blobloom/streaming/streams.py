"""Gap groups, manifest checks and band counts on event streams.

Times without a zone are taken as UTC, so no result depends on the session's zone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.sequence import gap_groups
from ..shared import new_folder, written

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Awaited names that share one state.
GROUP_NAMES = 1_024


def read_stream(spark: SparkSession, folder: str, file_name: str, schema) -> DataFrame:
    """Files of one name that appear in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_name).parquet(folder)


def instant(df: DataFrame, time: str) -> Column:
    """The column as a time with zone, which watermarks and windows need; one without zone is UTC."""
    t = F.col(time)
    if not isinstance(df.schema[time].dataType, T.TimestampNTZType):
        return t.cast("timestamp")
    minutes = (F.unix_date(t.cast("date")).cast("bigint") * 24 + F.hour(t)) * 60 + F.minute(t)
    return F.timestamp_micros(minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("bigint"))


def gap_sessions(events: DataFrame, keys: Sequence[str], time: str, gap: str, delay: str) -> DataFrame:
    """Sessions of events less than `gap` apart: start, end (last event), members.

    A session window also joins events exactly `gap` apart, so the gap is made one
    microsecond shorter.
    """
    zoned = events.withColumn(time, instant(events, time)).withWatermark(time, delay)
    window = F.session_window(time, f"{gap} -1 microseconds")
    return (
        zoned.groupBy(*keys, window.alias("_w"))
        .agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("members"))
        .drop("_w")
    )


def all_sessions(events: DataFrame, keys: Sequence[str], time: str, gap: str, delay: str, label: str = "sessions") -> DataFrame:
    """Closed and open sessions of all that has arrived: keys, start, end, members, open.

    The stream appends sessions that its watermark has closed. Those still open are read from the state
    that it leaves behind, so no event is read again. Events that come later than `delay` are in neither.
    """
    sessions = gap_sessions(events, keys, time, gap, delay)
    folder, ran = _append(sessions, label)
    if not ran:
        return events.sparkSession.createDataFrame([], sessions.schema).withColumn("open", F.lit(False))
    closed = events.sparkSession.read.schema(sessions.schema).parquet(f"{folder}/rows").withColumn("open", F.lit(False))
    # The state's value has the keys, the window, and the aggregates in the order in which they were asked for.
    state = events.sparkSession.read.format("statestore").load(f"{folder}/state")
    held = [f.name for f in state.schema["value"].dataType.fields][-3:]
    still = state.select("value.*").select(*keys, *[F.col(h).alias(n) for h, n in zip(held, ("start", "end", "members"), strict=True)])
    return closed.unionByName(still.withColumn("open", F.lit(True)))


def with_open_sessions(closed: DataFrame, events: DataFrame, keys: Sequence[str], time: str, gap: int, tie: Sequence[str] = ()) -> DataFrame:
    """Closed sessions (keys, start, end, members), and those still open: of the events behind each key's last closed one.

    Times are numbers here. An event without a time is in no session, as in a stream.
    """
    last = closed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("end").alias("_last"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    behind = events.join(last, same, "left").where(F.col(time).isNotNull() & (F.col("_last").isNull() | (F.col(time) > F.col("_last"))))
    still = gap_groups(behind.select(*events.columns), keys, time, gap, tie=tie)
    return closed.unionByName(still.select(*closed.columns))


def band_counts(events: DataFrame, keys: Sequence[str], time: str, value: str, width: str, delay: str, bands: dict[str, tuple]) -> DataFrame:
    """Per time window and key: total, and count of the values in each half-open band. Days begin at midnight UTC."""
    zoned = events.withColumn(time, instant(events, time)).withWatermark(time, delay)
    v = F.col(value)
    counts = [F.count(F.when((v >= lo) & (v < hi), 1)).alias(n) for n, (lo, hi) in bands.items()]
    return (
        zoned.groupBy(F.window(time, width).alias("_w"), *keys)
        .agg(F.count("*").alias("total"), *counts)
        .select(F.col("_w.start").alias("window_start"), *keys, "total", *bands)
    )


def _append(stream: DataFrame, label: str) -> tuple[str, bool]:
    """Append all that is available to a new table; its folder, and whether there was anything."""
    folder = new_folder(stream.sparkSession, label)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return folder, has_read(query)


def has_read(query) -> bool:
    """Whether an ended query has run a batch."""
    return any("addBatch" in progress["durationMs"] for progress in query.recentProgress)


def run_to_end(stream: DataFrame, label: str) -> DataFrame:
    """Append all that is available to a table in the shared folder, and read it back. No file gives no rows."""
    spark = stream.sparkSession
    folder, ran = _append(stream, label)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows") if ran else spark.createDataFrame([], stream.schema)


def run_updates(stream: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Write each batch of updates, and read back the last version of every key. No file gives no rows."""
    spark = stream.sparkSession
    folder = new_folder(spark, label)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not has_read(query):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(*keys, "_v.*")


class ManifestCheck(StatefulProcessor):
    """State per group of names: what is expected of each, until its status is told once.

    The expected rows of a group come as one initial state. The first arrival of a name in time is compared with
    it; a name whose deadline the watermark has reached before is missing. Either takes the name out of the state, so
    whatever comes later is silent. The group's one timer stands at the earliest deadline that is left. What a call
    tells is one row of arrays.
    """

    def __init__(self, name: T.DataType, value: T.DataType):
        self.name, self.value = name, value

    def init(self, handle) -> None:
        self.handle = handle
        kinds = {"names": T.ArrayType(self.name), "expected": T.ArrayType(self.value), "deadlines": T.ArrayType(T.LongType()), "timer": T.LongType()}
        self.awaited = handle.getValueState("awaited", T.StructType([T.StructField(n, kind) for n, kind in kinds.items()]))

    def held(self) -> tuple[dict, int | None]:
        """(expected, deadline) by name, and the time of the timer."""
        if not self.awaited.exists():
            return {}, None
        names, expected, deadlines, timer = self.awaited.get()
        return dict(zip(names, zip(expected, deadlines, strict=True), strict=True)), timer

    def keep(self, held: dict, timer: int | None) -> None:
        """Store what is still awaited, and move the timer."""
        soonest = min((deadline for _, deadline in held.values() if deadline is not None), default=None)
        if timer is not None and timer != soonest:
            self.handle.deleteTimer(timer)
        if soonest is not None and timer != soonest:
            self.handle.registerTimer(soonest)
        if held:
            self.awaited.update((list(held), [e for e, _ in held.values()], [d for _, d in held.values()], soonest))
        else:
            self.awaited.clear()

    def told(self, rows: list[tuple]) -> Iterator[Row]:
        return iter([Row("name", "expected", "actual", "status")(*[list(c) for c in zip(*rows, strict=True)])] if rows else [])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.keep({h["name"]: (h["expected"], h["deadline"]) for h in initialState["held"]}, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, timer = self.held()
        first = {}
        for r in rows:
            _, name, _, actual, at = r  # by place, as a row's columns are slow to find by name
            if name in held:
                arrival = (at is None, at, actual is not None, actual)
                if name not in first or arrival < first[name]:
                    first[name] = arrival
        told = []
        for name, (_, at, _, actual) in first.items():
            expected, deadline = held[name]
            if at is not None and deadline is not None and at > deadline:
                continue  # as late as if the timer had been first
            del held[name]
            told.append((name, expected, actual, "ok" if expected == actual else "mismatch"))
        if told:
            self.keep(held, timer)
        return self.told(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, _ = self.held()
        mark = timerValues.getCurrentWatermarkInMs()
        late = [name for name, (_, deadline) in held.items() if deadline is not None and deadline <= mark]
        told = [(name, held.pop(name)[0], None, "missing") for name in late]
        self.keep(held, None)  # the timer that fired goes by itself
        return self.told(told)

    def close(self) -> None:
        pass


def check_arrivals(
    arrivals: DataFrame, expected: DataFrame, name: str, value: str, time: str, deadline: str, delay: str, label: str, group: int = GROUP_NAMES
) -> DataFrame:
    """One status for each expected row, whatever the number of batches: (name, expected, actual, status).

    arrivals: stream of (name, value, time). expected: (name, value, deadline), one row per name, the
    deadline in milliseconds since 1970. The first arrival of a name that is not behind its deadline gives ok or
    mismatch (the earliest of a batch, then the least value). A name is missing when the watermark, the latest time
    less `delay`, reaches its deadline; later and repeated arrivals, those older than the watermark and unexpected
    ones are silent. An arrival without time is never late, a name without deadline never missing.
    What the watermark has not reached is pending; without any file that is all.

    Names share their state by hash, about `group` of them: a call into the state costs as much for one name as for
    many. A batch writes the state of each group again in which it tells something.
    """
    spark = arrivals.sparkSession
    awaited = written(expected.select(F.col(name).alias("name"), F.col(value).alias("expected"), F.col(deadline).cast("bigint").alias("deadline")), label)
    groups = F.lit(awaited.count() // group + 1)
    of = F.pmod(F.xxhash64("name"), groups).alias("_group")
    rows = arrivals.select(F.col(name).alias("name"), instant(arrivals, time).alias("time"), F.col(value).alias("actual")).withWatermark("time", delay)
    rows = rows.select(of, "name", "time", "actual", F.unix_millis("time").alias("at"))
    states = awaited.groupBy(of).agg(F.collect_list(F.struct("name", "expected", "deadline")).alias("held"))
    kinds = {"name": awaited.schema["name"].dataType, "expected": awaited.schema["expected"].dataType, "actual": rows.schema["actual"].dataType, "status": T.StringType()}
    schema = T.StructType([T.StructField(n, T.ArrayType(kind)) for n, kind in kinds.items()])
    told = rows.groupBy("_group").transformWithState(ManifestCheck(kinds["name"], kinds["expected"]), schema, "append", "eventTime", states.groupBy("_group"))
    told = told.select(F.inline(F.arrays_zip(*kinds)))
    # User-defined state with timers needs this store.
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKS)
    try:
        told = run_to_end(told, label)
    finally:
        spark.conf.set(setting, before)
    pending = awaited.join(told.select(F.col("name").alias("_told")), F.col("name").eqNullSafe(F.col("_told")), "left_anti")
    pending = pending.select("name", "expected", F.lit(None).cast(kinds["actual"]).alias("actual"), F.lit("pending").alias("status"))
    return told.unionByName(pending).withColumnRenamed("name", name)
