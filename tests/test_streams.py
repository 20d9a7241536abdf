"""Streams over several batches: state kept between them, late rows, no file at all, other zones."""

import datetime
import os
import pathlib
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import check  # noqa: E402
from blobloom.streaming import streams  # noqa: E402

START = datetime.datetime(2024, 3, 10, 1, 0)  # the night in which American clocks leave an hour out
SCHEMA = "name string, value bigint, ts timestamp_ntz"


def arriving(spark, folder, batches):
    """A stream with one file, and so one batch, per list of (name, value, minute)."""
    folder.mkdir()
    for i, rows in enumerate(batches):
        columns = list(zip(*rows, strict=True))
        times = [None if m is None else START + datetime.timedelta(minutes=m) for m in columns[2]]
        pq.write_table(pa.table({"name": pa.array(columns[0]), "value": pa.array(columns[1], pa.int64()), "ts": pa.array(times, pa.timestamp("us"))}), folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1000 + i, 1000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def millis(minute):
    return int((START + datetime.timedelta(minutes=minute) - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)


def manifest(spark, rows):
    return spark.createDataFrame([(n, v, millis(m)) for n, v, m in rows], "name string, value bigint, deadline bigint")


EXPECTED = [("once", 1, 900), ("twice", 2, 900), ("wrong", 3, 900), ("late", 4, 30), ("never", 5, 60), ("far", 6, 9000), ("after", 7, 50), ("null", None, 900)]
BATCHES = [
    [("once", 1, 0), ("twice", 2, 5), ("other", 9, 6), ("null", None, 7)],
    [("twice", 99, 20), ("wrong", 30, 21), ("wrong", 3, 25), ("clock", 0, 200)],
    [("after", 7, 190), ("clock", 0, 210)],
    [("late", 4, 10), ("clock", 0, 220)],
]


def test_one_status_per_name_over_all_batches(spark, tmp_path):
    told = streams.check_arrivals(arriving(spark, tmp_path / "in", BATCHES), manifest(spark, EXPECTED), "name", "value", "ts", "deadline", "10 minutes", "told")
    assert sorted((tuple(r) for r in told.collect()), key=str) == sorted(
        [
            ("once", 1, 1, "ok"),
            ("twice", 2, 2, "ok"),  # the second arrival, in another batch, is silent
            ("wrong", 3, 30, "mismatch"),  # the earlier of one batch counts
            ("late", 4, None, "missing"),  # it came behind the watermark
            ("never", 5, None, "missing"),
            ("after", 7, None, "missing"),  # it came after its deadline
            ("far", 6, None, "pending"),
            ("null", None, None, "ok"),
        ],
        key=str,
    )


def statuses(spark, folder, batches, rows, delay="10 minutes", **options):
    expected = spark.createDataFrame([(n, v, None if m is None else millis(m)) for n, v, m in rows], "name string, value bigint, deadline bigint")
    told = streams.check_arrivals(arriving(spark, folder, batches), expected, "name", "value", "ts", "deadline", delay, "told", **options)
    return sorted((tuple(r) for r in told.collect()), key=str)


def test_names_share_state_and_timers(spark, tmp_path, monkeypatch):
    """A call into the state and a timer for each name took a millisecond of a core a name."""
    ended = []
    has_read = streams.has_read
    monkeypatch.setattr(streams, "has_read", lambda query: ended.append(query) or has_read(query))
    rows = [(f"n{i}", i, 100 + i % 700) for i in range(3000)]
    batches = [[(f"n{i}", i + i % 2, i % 90) for i in range(1500)], [("clock", 0, 310)]]
    found = statuses(spark, tmp_path / "in", batches, rows)
    expected = [(n, i, i + i % 2, "mismatch" if i % 2 else "ok") for i, (n, *_) in enumerate(rows[:1500])]
    expected += [(n, i, None, "missing" if m <= 300 else "pending") for n, i, m in rows[1500:]]
    assert found == sorted(expected, key=str)
    metrics = [p["stateOperators"][0]["customMetrics"] for p in ended[0].recentProgress if p["stateOperators"]]
    assert 0 < sum(m["numRegisteredTimers"] for m in metrics) < 30


@pytest.mark.parametrize("group", [1, 3, 1024])
def test_names_of_one_group(spark, tmp_path, group):
    """The timer moves on as names are told; a deadline that the watermark just reaches is over; repeated, late and unknown names are silent."""
    rows = [("a", 1, 10), ("b", 2, 20), ("c", 3, 30), ("d", 4, 40), ("e", 5, 60), ("f", 6, 61)]
    batches = [
        [("a", 1, 5), ("c", 0, 9), ("x", 1, 9)],
        [("a", 7, 8), ("clock", 0, 45)],  # the watermark comes to 35
        [("b", 2, 21), ("c", 3, 44), ("d", 4, 50)],
        [("d", 4, 40), ("b", 2, 20), ("clock", 0, 70)],  # and to 60
    ]
    assert statuses(spark, tmp_path / "in", batches, rows, group=group) == [
        ("a", 1, 1, "ok"),
        ("b", 2, None, "missing"),
        ("c", 3, 0, "mismatch"),
        ("d", 4, 4, "ok"),  # the arrival behind its deadline is silent, the one in time comes a batch later
        ("e", 5, None, "missing"),
        ("f", 6, None, "pending"),
    ]


def test_missing_values_of_a_manifest(spark, tmp_path):
    """Without deadline a name is never missing, without time an arrival is never late; a name that is null has one status."""
    rows = [("open", 1, None), ("timeless", 2, 5), ("both", 3, None), (None, 4, 20), ("gone", 5, 20)]
    batches = [[("timeless", 2, None), ("timeless", 9, None), ("both", 0, None), ("clock", 0, 90)]]
    assert statuses(spark, tmp_path / "in", batches, rows) == sorted(
        [("open", 1, None, "pending"), ("timeless", 2, 2, "ok"), ("both", 3, 0, "mismatch"), (None, 4, None, "missing"), ("gone", 5, None, "missing")], key=str
    )


def test_arrivals_without_a_file(spark, tmp_path):
    told = streams.check_arrivals(arriving(spark, tmp_path / "in", []), manifest(spark, EXPECTED), "name", "value", "ts", "deadline", "10 minutes", "told")
    assert sorted((r["name"], r["status"]) for r in told.collect()) == sorted((n, "pending") for n, *_ in EXPECTED)


def sessions(spark, folder, batches):
    found = streams.all_sessions(arriving(spark, folder, batches), ["name"], "ts", "20 minutes", "1 hour")
    first = millis(0) * 1000
    rows = found.select("name", ((F.unix_micros("start") - first) / 60e6).alias("a"), ((F.unix_micros("end") - first) / 60e6).alias("z"), "members", "open")
    return sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_sessions_over_batches(spark, tmp_path, zone):
    """A session that goes on in the next batch, gaps just below and at the limit, a late event, a missing time."""
    batches = [
        [("a", 1, 0), ("a", 1, 10), ("b", 1, 5), ("b", 1, None)],
        [("a", 1, 25), ("a", 1, 45), ("b", 1, 70)],
        [("a", 1, 160), ("b", 1, 12), ("b", 1, 75)],
        [("a", 1, 170), ("b", 1, 20)],
        [("a", 1, 175), ("b", 1, 30)],
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = sessions(spark, tmp_path / "in", batches)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == [
        ("a", 0.0, 25.0, 3, False),
        ("a", 45.0, 45.0, 1, False),
        ("a", 160.0, 175.0, 3, True),
        ("b", 5.0, 20.0, 3, False),  # lateness is judged by the batch before the last one, so only 30 is late
        ("b", 70.0, 75.0, 2, False),
    ]


def test_sessions_and_bands_without_a_file(spark, tmp_path):
    assert sessions(spark, tmp_path / "in", []) == []
    events = arriving(spark, tmp_path / "more", [])
    counts = streams.band_counts(events, ["name"], "ts", "value", "1 day", "1 day", {"low": (0, 5)})
    assert streams.run_updates(counts, "bands", ["window_start", "name"]).collect() == []


@pytest.mark.parametrize("name", ["ss01_gap_sessions", "ss01_open_sessions", "ss01_gap_sessions_all", "ss02_manifest_on_arrival", "ss03_band_counts"])
def test_other_zone(spark, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        told = check.compare(spark, check.connection("/root/testdata/sf0.001"), "/root/testdata/sf0.001", name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert told.split()[0] == "ok", told
