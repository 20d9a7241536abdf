"""Byte kernels, command streams and bounded running values against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from blobloom.operators import inplace, profile, sequence

RNG = random.Random(11)
BLOBS = [RNG.randbytes(RNG.choice((0, 1, 2, 3, 7, 16, 300, 2000))) for _ in range(40)]
BLOBS += [bytes(50), b"ab" * 40, b"aaaaa", b"xaaaay" * 9, bytes([0]), bytes([200]), bytes([5]), b"\x80" + bytes(128), None, b""]


@pytest.fixture(scope="module")
def blobs(spark):
    """Several partitions, ids that repeat and are null, and a column with a clashing name."""
    rows = [(i if i % 9 else None, None if b is None else bytearray(b), 1) for i, b in enumerate(BLOBS)]
    return spark.createDataFrame(rows, "id int, content binary, byte int").repartition(3)


@pytest.fixture(params=[None, 64], autouse=True)
def part(request, monkeypatch):
    """Also with parts of a few bytes, so that blobs are cut into many of them."""
    if request.param:
        monkeypatch.setattr(inplace, "PART_BYTES", request.param)
        monkeypatch.setattr(inplace, "PART_BLOBS", 3)


def test_value_counts(blobs):
    want = collections.Counter((i if i % 9 else None, x) for i, b in enumerate(BLOBS) for x in b or b"")
    got = {(r["id"], r["byte"]): r["cnt"] for r in profile.bytes_of(blobs, ["id"], "content").collect()}
    assert got == dict(want)


def test_byte_profile_of_repeated_ids(blobs):
    of = collections.defaultdict(list)
    for i, b in enumerate(BLOBS):
        of[i if i % 9 else None] += b or b""
    got = {r["id"]: r for r in profile.byte_profile(blobs, ["id"], "content").collect()}
    assert set(got) == {k for k, v in of.items() if v}
    for k, r in got.items():
        v = of[k]
        mean = sum(v) / len(v)
        assert (r["length"], r["distinct_values"], r["min_value"], r["max_value"]) == (len(v), len(set(v)), min(v), max(v))
        assert r["mean"] == pytest.approx(mean) and r["std_dev"] == pytest.approx((sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5)


def test_adjacent_repeats(blobs):
    want = collections.Counter()
    for b in BLOBS:
        for n in range(2, 9):
            for i in range(len(b or b"") - 2 * n + 1):
                if b[i : i + n] == b[i + n : i + 2 * n]:
                    want[b[i : i + n].hex().upper()] += 1
    got = {r["pattern"]: r["repeats"] for r in profile.adjacent_repeats(blobs, "content").collect()}
    assert got == dict(want)


@pytest.mark.parametrize("pattern", [b"a", b"aa", b"ab", b"\x00\x00\x00", b"aaaay"])
def test_scan_nonoverlapping(blobs, pattern):
    want = []
    for i, b in enumerate(BLOBS):
        at, match = (b or b"").find(pattern), 0
        while at >= 0:
            want.append((i if i % 9 else None, match, at))
            at, match = b.find(pattern, at + len(pattern)), match + 1
    got = [tuple(r) for r in inplace.scan_nonoverlapping(blobs, ["id"], "content", pattern).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def expanded(blob, length):
    """Commands one after the other."""
    out, at, blob = b"", 0, blob or b""
    while len(out) < length:
        if at == len(blob):
            return out, at, "end"
        code = blob[at]
        if code == 0:
            return out, at + 1, "stop"
        size = 256 - code if code >= 128 else 1
        data = blob[at + 1 : at + 1 + size]
        out += data if code >= 128 else data * code
        at += 1 + size
        if len(data) < size:
            return (out[:length], len(blob), "length") if len(out) >= length else (out, len(blob), "cut")
    return out[:length], at, "length"


@pytest.mark.parametrize("length", [0, 1, 40, 100_000])
def test_expand_commands(blobs, length):
    want = [(i if i % 9 else None, *expanded(b, length)) for i, b in enumerate(BLOBS)]
    got = [(r["id"], bytes(r["data"]), r["used"], r["status"]) for r in inplace.expand_commands(blobs, ["id"], "content", length).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {x[3] for x in got} >= ({"length"} if not length else {"length", "stop", "cut", "end"} if length == 40 else {"stop", "cut", "end"} if length > 100 else set())


def commands(data, stop):
    """An encoder: runs of equal bytes, everything else as literals."""
    out, at = b"", 0
    while at < len(data):
        run = 1
        while run < 127 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 2:
            out += bytes([run, data[at]])
            at += run
        else:
            n = min(128, len(data) - at)
            out += bytes([256 - n]) + data[at : at + n]
            at += n
    return out + b"\x00" * stop


def test_round_trip_of_commands(spark):
    texts = [bytes(RNG.choice(b"aaaaaaaab") for _ in range(n)) for n in (0, 1, 5, 500, 5000)] + [RNG.randbytes(3000), bytes(4000)]
    df = spark.createDataFrame([(i, bytearray(commands(t, i % 2))) for i, t in enumerate(texts)], "id int, c binary")
    got = {r["id"]: (bytes(r["data"]), r["status"]) for r in inplace.expand_commands(df, ["id"], "c", 1 << 20).collect()}
    assert got == {i: (t, "stop" if i % 2 else "end") for i, t in enumerate(texts)}


def test_no_row_per_byte_and_no_shuffle_of_blobs(spark, blobs):
    for df in (profile.bytes_of(blobs, ["id"], "content"), profile.byte_profile(blobs, ["id"], "content"), profile.adjacent_repeats(blobs, "content")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan
        assert plan.index("Exchange") < plan.index("MapInArrow")  # what moves has been counted


# --- bounded running values -------------------------------------------------------------------------


def ran(data, low, high, start):
    rows = []
    for key in {d[0] for d in data}:
        x = start
        for k, p, d, end in sorted((r for r in data if r[0] == key), key=lambda r: r[1]):
            if end:
                break
            x = max(low, min(high, x + (d or 0)))
            rows.append((k, p, x))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("hot_rows", [None, 40])
@pytest.mark.parametrize("block", [4, 1024])
def test_bounded_running(spark, monkeypatch, hot_rows, block):
    """With blocks of 4 rows there are five levels; keys may be null, deltas too, and every second key has an end."""
    if inplace.PART_BYTES == 64:
        pytest.skip("has no blobs")
    monkeypatch.setattr(sequence, "BLOCK", block)
    rng = random.Random(2)
    data = [(rng.choice([0, 0, 0, 1, None]), p, rng.choice([None, *range(-300, 301, 7)]), False) for p in range(900)]
    data += [(7, 2000, 5, True), (7, 2001, 5, False), (8, 0, -1, False), (8, 1, 100_000, False), (8, 2, -1, None), (8, 3, 1, True), (8, 4, 1, True)]
    df = spark.createDataFrame(data, "k int, p int, step int, e boolean")
    got = sequence.bounded_running(df, ["k"], ["p"], F.col("step"), -500, 499, 500, is_end=F.col("e"), hot_rows=hot_rows)
    assert got.columns == ["k", "p", "step", "e", "total"]
    assert sorted((tuple(r) for r in got.select("k", "p", "total").collect()), key=repr) == ran(data, -500, 499, 500)
    last = {}
    for k, p, x in ran([(k, p, d, False) for k, p, d, _ in data], -500, 499, 500):
        last[k] = (p, x) if k not in last or p > last[k][0] else last[k]
    totals = sequence.bounded_accumulate(df, ["k"], ["p"], F.col("step"), -500, 499, 500, hot_rows=hot_rows).collect()
    assert {r["k"]: r["total"] for r in totals} == {k: x for k, (_, x) in last.items()}


def test_bounded_running_of_nothing(spark):
    df = spark.createDataFrame([], "k int, p int, d int")
    assert sequence.bounded_running(df, ["k"], ["p"], F.col("d"), 0, 9, 5).collect() == []
    assert sequence.bounded_accumulate(df, ["k"], ["p"], F.col("d"), 0, 9, 5).collect() == []


def test_moved_to_origin(spark):
    df = spark.createDataFrame([("a", 5, -3), ("a", 9, 4), (None, -2, 7), (None, 0, 0)], "g string, x int, y int")
    box = profile.bounding_box(df, ["g"], F.col("x"), F.col("y"), F.lit(1), F.lit(1))
    got = profile.moved_to_origin(df, ["g"], "x", "y", box)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([("a", 0, 0), ("a", 4, 7), (None, 0, 7), (None, 2, 0)], key=repr)
