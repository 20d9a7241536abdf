"""Operators against brute force and on edge cases."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from blobloom.operators import lookups as lk
from blobloom.operators import ordered, probes, similar
from blobloom.operators import profile as pr
from blobloom.operators import quality as qu
from blobloom.operators import ratings as rt
from blobloom.operators import search as se
from blobloom.operators import sequence as sq
from blobloom.sources import blobs as bl
from blobloom.sources import tables as tb


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def skewed(seed=1, n=600):
    """(key, position, value): one key, here NULL, has two thirds of all rows."""
    rng = random.Random(seed)
    places = rng.sample(range(n * 3), n)
    return [(None if rng.random() < 0.66 else rng.randrange(6), p, None if rng.random() < 0.3 else rng.randrange(9)) for p in places]


def by_key(data):
    groups = defaultdict(list)
    for r in sorted(data, key=lambda r: r[1]):
        groups[r[0]].append(r)
    return groups


# --- ordered scans ----------------------------------------------------------------------------


@pytest.mark.parametrize("hot_rows", [None, 10, 100])
def test_scan(spark, hot_rows):
    data = skewed()
    df = spark.createDataFrame(data, "k int, p int, v int")
    v = F.col("v")
    step = ordered.Step(sums={"s": v}, lasts={"l": v}, before={"b": v}, after={"a": v})
    out = ordered.scan(df, ["k"], ["p"], step, hot_rows=hot_rows)
    want = []
    for key, group in by_key(data).items():
        total, last = 0, None
        for i, (_, p, v) in enumerate(group):
            total += v or 0
            last = v if v is not None else last
            before = group[i - 1][2] if i else None
            after = group[i + 1][2] if i + 1 < len(group) else None
            want.append((key, p, v, total, last, before, after))
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_hot_keys_are_found(spark):
    df = spark.createDataFrame(skewed(), "k int, p int, v int")
    assert [r["k"] for r in ordered.hot_keys(df, ["k"], 100)] == [None]
    assert ordered.hot_keys(df, ["k"], ordered.HOT_ROWS) == []


def test_pieces_are_even(spark):
    df = spark.range(10_000).withColumnRenamed("id", "p")
    for pieces in (8, 100):
        cuts = ordered.cut_points(df, "p", pieces)
        sizes = Counter(r[0] for r in df.select(ordered.piece_of("p", cuts)).collect())
        assert set(sizes) == set(range(pieces)) and max(sizes.values()) < 1.2 * 10_000 / pieces


def test_numbered_without_key(spark):
    df = spark.createDataFrame([(p,) for p in random.Random(2).sample(range(5000), 700)], "p int")
    got = rows(ordered.numbered(df, [], ["p"]), "p", "rn")
    assert [r[1] for r in got] == list(range(1, 701))


# --- sequences --------------------------------------------------------------------------------


@pytest.mark.parametrize("hot_rows", [None, 50])
def test_gap_groups(spark, hot_rows):
    data = [(r[0], r[1]) for r in skewed()]
    df = spark.createDataFrame(data, "k int, p int")
    got = sq.gap_groups(df, ["k"], "p", 20, 4, hot_rows=hot_rows).select("k", "start", "end", "members", "preview_end").collect()
    want = []
    for key, group in by_key(data).items():
        places = [p for _, p in group]
        groups = [[places[0]]]
        for a, b in zip(places, places[1:]):
            groups[-1].append(b) if b - a < 20 else groups.append([b])
        want += [(key, g[0], g[-1] + 4, len(g), min(g[-1] + 4, g[0] + 20)) for g in groups]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_gap_of_exactly_the_limit_splits(spark):
    df = spark.createDataFrame([("a", 0), ("a", 19), ("a", 39)], "k string, p int")
    assert rows(sq.gap_groups(df, ["k"], "p", 20), "start", "members") == [(0, 2), (39, 1)]
    # The end is that of the last hit, even if one before it reaches further.
    sized = sq.gap_groups(df.withColumn("n", 25 - F.col("p")), ["k"], "p", 20, F.col("n"))
    assert rows(sized, "start", "end") == [(0, 25), (39, 25)]


def sections_by_hand(flags, run, keep_tail):
    out, start, i = [], 0, 0
    while i < len(flags):
        j = i
        while j < len(flags) and flags[j]:
            j += 1
        if j - i >= run:
            out.append((start, i))
            start = j
        i = max(j, i + 1)
    if keep_tail and start < len(flags):
        out.append((start, len(flags)))
    return out


@pytest.mark.parametrize("keep_tail", [False, True])
@pytest.mark.parametrize("hot_rows", [None, 50])
def test_segments(spark, keep_tail, hot_rows):
    rng = random.Random(5)
    data = [(k, p, rng.random() < 0.6) for k in range(3) for p in range(200)]
    data += [(8, p, False) for p in range(5)] + [(9, p, True) for p in range(5)]
    df = spark.createDataFrame(data, "k int, p int, z boolean")
    got = rows(sq.segment_by_separator(df, ["k"], ["p"], F.col("z"), 4, keep_tail, hot_rows), "k", "first", "stop")
    want = [(k, *s) for k in (0, 1, 2, 8, 9) for s in sections_by_hand([z for q, _, z in data if q == k], 4, keep_tail)]
    assert got == sorted(want)


def test_take_until_sentinel(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 255), ("a", 2, 1), ("b", 0, 7)], "k string, p int, v int")
    assert rows(sq.take_until_sentinel(df, ["k"], "p", F.col("v") == 255), "k", "p") == [("a", 0), ("b", 0)]


@pytest.mark.parametrize("hot_rows", [None, 50])
def test_bounded_accumulate(spark, hot_rows):
    rng = random.Random(7)
    data = [(rng.choice([0, 0, 0, 1]), p, rng.randrange(-900, 900)) for p in range(4000)]
    df = spark.createDataFrame(data, "k int, p int, d int")
    got = dict(rows(sq.bounded_accumulate(df, ["k"], ["p"], F.col("d"), -8192, 8191, 8192, hot_rows=hot_rows), "k", "total"))
    for key, group in by_key(data).items():
        x = 8192
        for _, _, d in group:
            x = max(-8192, min(8191, x + d))
        assert got[key] == x


def test_dictionary_encode(spark):
    data = [(random.Random(9 + i).choice("abcdef"), i) for i in range(60)]
    df = spark.createDataFrame(data, "v string, p int")
    order = list(dict.fromkeys(v for v, _ in data))
    assert rows(sq.dictionary_encode(df, ["v"], "p"), "code", "v") == list(enumerate(order))


def test_layers(spark):
    data = [(0, 0, 1, 5), (0, 0, 2, 0), (0, 0, 3, 7), (0, 0, 4, 0), (1, 0, 1, 0)]
    df = spark.createDataFrame(data, "x int, y int, layer int, v int")
    assert rows(sq.composite_layers(df, ["x", "y"], ["layer"], "v", F.col("layer")), "x", "shown") == [(0, 7 + 48), (1, 0)]


def test_run_expand(spark):
    df = spark.createDataFrame([([(1, 3), (2, 2)], 9), ([(4, 2), (5, 0), (6, 9)], 9), ([(7, 5)], 3), ([], 3)], "r array<struct<value:int,count:int>>, n int")
    got = [r[0] for r in df.select(sq.run_expand("r", F.col("n"))).collect()]
    assert got == [[1, 1, 1, 2, 2], [4, 4], [7, 7, 7], []]


def test_stride_and_nonoverlapping(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcdefghij")), (2, bytearray(b"ab"))], "id int, b binary")
    got = [(r["record"], bytes(r["bytes"])) for r in sq.stride_records(df, "b", 4, 1).collect()]
    assert got == [(0, b"bcde"), (1, b"fghi")]
    text = spark.createDataFrame([(1, "aaaaa"), (2, "a.a"), (3, "")], "id int, t string")
    assert rows(sq.scan_nonoverlapping(text, "t", "aa"), "id", "position") == [(1, 0), (1, 2)]
    assert rows(sq.scan_nonoverlapping(text, "t", "."), "id", "position") == [(2, 1)]


def test_context_is_cut(spark):
    df = spark.createDataFrame([("0123456789", 1), ("0123456789", 9), ("0123456789", 5)], "t string, p int")
    got = [r["context"] for r in sq.context_window(df, "t", "p", F.lit(2), 2).collect()]
    assert got == ["0123", "6789", "234567"]


# --- search -----------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes, few", [((16, 20), True), ((40, 90), True), ((3, 5), True), ((16, 60), False)])
def test_search_patterns(spark, monkeypatch, sizes, few):
    if not few:
        # As with many patterns and many candidates: nothing is broadcast by hint.
        monkeypatch.setattr(se, "MOST_PATTERN_BYTES", 0)
        monkeypatch.setattr(se, "MOST_SEEDS", 0)
        monkeypatch.setattr(se, "MOST_CANDIDATES", 0)
    rng = random.Random(sum(sizes))
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 400))) for _ in range(30)]
    texts.append(b"a" * 300)
    patterns = [t[i : i + rng.randint(*sizes)] for t in texts[:20] for i in [rng.randrange(0, 50)]]
    patterns += [b"a" * sizes[0], patterns[0], b"", b"zz" * sizes[1]]
    shortest = 16 if sizes[0] >= 16 else 3
    blobs = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "id int, b binary")
    known = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(patterns)], "pid int, p binary")
    got = rows(se.search_patterns(blobs, known, "id", "b", "pid", "p", shortest), "id", "pid", "position")
    want = [
        (i, j, at)
        for i, t in enumerate(texts)
        for j, p in enumerate(patterns)
        if len(p) >= shortest
        for at in range(len(t) - len(p) + 1)
        if t[at : at + len(p)] == p
    ]
    assert got == sorted(want) and want


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_search_with_padding(spark, monkeypatch, most):
    """Patterns that begin with padding, in blobs full of it: what lies around each hit, and no blob is shuffled."""
    monkeypatch.setattr(se, "MOST_PATTERN_BYTES", most)
    pad = bytes(300)
    patterns = [pad + b"first mark of all", pad + b"second mark", b"\x01" * 20]
    texts = [bytes(100_000), pad + patterns[0] + b"end", b"x" + patterns[1] + bytes(50_000), b"", None, b"\x01" * 22]
    blobs = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in enumerate(texts)], "id int, b binary")
    known = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(patterns)], "pid int, p binary")
    found = se.search_patterns(blobs, known, "id", "b", "pid", "p", around=5)
    want = []
    for i, t in enumerate(texts):
        for j, p in enumerate(patterns):
            for at in range(len(t or b"") - len(p) + 1):
                if t.startswith(p, at):
                    want.append((i, j, at, t[max(0, at - 5) : at + len(p) + 5], min(at, 5), len(t)))
    got = sorted((r["id"], r["pid"], r["position"], bytes(r["near"]), r["near_at"], r["blob_size"]) for r in found.collect())
    assert got == want and len(want) == 5
    if most:
        # Grams of padding are never what is looked up, as they are sampled often.
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "_content" not in plan


def test_search_without_patterns(spark):
    blobs = spark.createDataFrame([(1, bytearray(b"abc"))], "id int, b binary")
    known = spark.createDataFrame([(1, bytearray(b"abc"))], "pid int, p binary")
    assert se.search_patterns(blobs, known, "id", "b", "pid", "p").count() == 0


def test_sequence_diff(spark):
    rng = random.Random(11)
    pairs = [(b"abc", b"abc"), (b"", b"x"), (b"abc", b"abcd"), (b"xbc", b"abc")]
    for _ in range(60):
        a = bytearray(rng.randbytes(rng.randrange(1, 60)))
        b = bytearray(a)
        if rng.random() < 0.8:
            b[rng.randrange(len(b))] ^= 1
        pairs.append((a, b + rng.randbytes(rng.randrange(3))))
    df = spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(pairs)], "id int, a binary, b binary")
    for r in se.sequence_diff(df, "a", "b").collect():
        a, b = map(bytes, pairs[r["id"]])
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert r["equal_leading"] == same and r["length_difference"] == len(b) - len(a)
        if same < min(len(a), len(b)):
            assert r["position"] == same and r["actual_byte"] == b[same : same + 1].hex().upper()
            assert r["expected_context"] == a[max(0, same - 8) : same + 8].hex().upper()
        else:
            assert r["position"] is None and r["expected_byte"] is None


# --- probes -----------------------------------------------------------------------------------


def map_file(tiles, width, height, marker, packed_gap=0):
    body = b"\x07" * (tiles * 32 - packed_gap)
    palette = 10 + len(body)
    head = palette.to_bytes(4, "big") + (palette + 32).to_bytes(4, "big") + tiles.to_bytes(2, "big")
    grid = width.to_bytes(2, "big") + height.to_bytes(2, "big") + b"\x00\x01" * (width * height)
    return head + body + b"\x11" * 32 + grid + (b"\xff" * 4 if marker else b"")


def test_find_map_layouts(spark):
    noise = bytes(random.Random(4).randrange(1, 255) for _ in range(50))
    plain, packed = map_file(3, 4, 2, False), map_file(3, 4, 2, True, packed_gap=20)
    blob = noise + plain + noise + packed + noise
    df = spark.createDataFrame([(1, bytearray(blob))], "id int, b binary")
    got = rows(probes.find_map_layouts(df, "b"), "at", "kind", "width", "height", "end")
    second = 100 + len(plain)
    assert got == [(50, "plain", 4, 2, 50 + len(plain)), (second, "packed", 4, 2, second + len(packed))]


def test_probe_map_header_reasons(spark):
    # In a header the palette size is the high byte of the 16-bit tile count.
    good = bytearray(map_file(2, 4, 2, True))
    good[8] = 0x20
    cases = [(bytes(good), None), (b"abc", "no header"), (bytes(good[:-8]), "end beyond file")]
    bad = bytearray(good)
    bad[8] = 0x21
    cases.append((bytes(bad), "invalid palette size"))
    bad = bytearray(good)
    bad[9] = 99
    cases.append((bytes(bad), "tile bytes do not fit"))
    bad = bytearray(good)
    bad[4:8] = b"\x00\x00\x00\x01"
    cases.append((bytes(bad), "map not behind palette"))
    bad = bytearray(good)
    bad[8] = 0x40
    cases.append((bytes(bad), "palette overlaps map"))
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(cases)], "id int, b binary")
    for r in probes.probe_map_header(df, "b", F.lit(0)).collect():
        assert r["reason"] == cases[r["id"]][1], r["id"]
        if r["reason"] is None:
            assert r["file_size"] == len(good) and r["has_end_marker"]


def test_detect_encoding(spark):
    def blob(at, end):
        b = bytearray(b"\x70" * 400)
        if at is not None:
            b[at] = 0x85
        if end is not None:
            b[end] = 0xFF
        return b

    cases = [(blob(16, 215), (True, 16)), (blob(16, 216), (False, 0)), (blob(None, 50), (False, 0)), (blob(10, 11), (True, 10)), (bytearray(b"x"), (False, 0))]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "id int, b binary")
    got = df.select("id", probes.detect_encoding(F.col("b"), "[\\x00-\\x3F\\x80-\\x9F\\xFF]", "ÿ").alias("e")).collect()
    assert {r["id"]: tuple(r["e"]) for r in got} == {i: w for i, (_, w) in enumerate(cases)}


def test_content_valid(spark):
    def grid(*words):
        return bytearray(b"".join(w.to_bytes(2, "big") for w in words))

    blobs = [(1, grid(0xF805, 3, 9), 10), (2, grid(1, 10), 10), (3, grid(4, 2047, 4), 10), (4, grid(), 1), (5, grid(0, 0, 7), 7)]
    df = spark.createDataFrame(blobs, "id int, b binary, tiles int")
    assert rows(probes.probe_content_valid(df, "id", "b", F.col("tiles")), "id") == [(1,), (4,)]
    assert rows(probes.probe_content_valid(df, "id", "b", F.col("tiles"), words=F.lit(1)), "id") == [(1,), (2,), (3,), (5,)]
    assert rows(probes.probe_content_valid(df, "id", "b", F.col("tiles"), offset=2), "id") == [(1,), (4,)]


def test_checksum_gate(spark):
    df = spark.createDataFrame([(1, bytearray(b"123456789")), (2, bytearray(b"x"))], "id int, b binary")
    crc = zlib.crc32(b"123456789")
    assert rows(probes.checksum_gate(df, "b", crc), "id") == [(1,)]
    assert rows(probes.checksum_gate(df, "b", crc, soft=True), "id", "checksum_ok") == [(1, True), (2, False)]


# --- lookups ----------------------------------------------------------------------------------


def test_verify_manifest_with_nulls(spark):
    expected = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", None)], "name string, crc int")
    actual = spark.createDataFrame([("a", 1), ("b", 9), ("d", None), ("x", 1)], "name string, crc int")
    got = dict(rows(lk.verify_manifest(actual, expected, "name", "crc"), "name", "status"))
    assert got == {"a": "ok", "b": "mismatch", "c": "missing", "d": "ok"}


def test_range_lookup_both_ways(spark):
    rng = random.Random(8)
    ranges = [(k, lo, lo + rng.randrange(0, 40)) for k in range(70) for lo in [rng.randrange(0, 500)]]
    values = [(v,) for v in range(-5, 560)]
    df = spark.createDataFrame(values, "v int")

    def want(some):
        return [(v, min((k for k, lo, hi in some if lo <= v <= hi), default=0)) for (v,) in values]

    for some in (ranges, ranges[:20]):
        table = spark.createDataFrame(some, "k int, lo int, hi int")
        assert rows(lk.range_lookup(df, "v", table, "k", "lo", "hi", width=16), "v", "k") == want(some)


def test_override_and_default(spark):
    df = spark.createDataFrame([(1, "red"), (2, "red"), (1, "blue"), (1, "1 2 3"), (1, "none")], "team int, name string")
    near = spark.createDataFrame([(1, "red", "9 9 9")], "team int, name string, colour string")
    far = spark.createDataFrame([("red", "8 8 8"), ("blue", "0 0 7")], "name string, colour string")
    got = rows(lk.resolve_override(df, near, far, ["team", "name"], "name", "colour").na.fill(""), "team", "name", "colour", "source")
    assert got == sorted(
        [(1, "red", "9 9 9", "specific"), (2, "red", "8 8 8", "general"), (1, "blue", "0 0 7", "general"), (1, "1 2 3", "1 2 3", "literal"), (1, "none", "", "error")]
    )
    tuned = spark.createDataFrame([(0.0, 2.0), (None, 2.0), (None, 0.0), (None, None)], "c double, d double")
    assert [r[0] for r in tuned.select(lk.tuned_default(F.col("c"), F.col("d"))).collect()] == [0.0, 2.0, 1.0, 1.0]


def test_regions_first_wins(spark):
    df = spark.createDataFrame([(0, 0), (5, 5), (9, 9), (10, 0)], "x int, y int")
    rects = [(0, 0, 5, 5), (0, 0, 10, 10), (5, 5, 10, 10)]
    got = [tuple(r) for r in df.select(lk.assign_region(F.col("x"), F.col("y"), rects), lk.assign_region(F.col("x"), F.col("y"), rects, None)).collect()]
    assert got == [(0, 0), (1, 1), (1, 1), (0, None)]


def test_enrich_keeps_and_overrides(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    stats = spark.createDataFrame([(1, "A", 5)], "id int, name string, goals int")
    got = {r["id"]: (r["name"], r["goals"]) for r in lk.enrich(base, "id", stats).collect()}
    assert got == {1: ("A", 5), 2: ("b", None)}


def test_unnest_nested(spark):
    df = spark.createDataFrame([(1, ([10, 20],)), (2, ([],))], "id int, team struct<roster: array<int>>")
    assert rows(lk.unnest(df, "team.roster"), "id", "item") == [(1, 10), (1, 20)]
    assert lk.unnest(df, "team.roster", keep_empty=True).count() == 3


def test_sweep_names():
    grid = lk.parameter_sweep([0, 1, 2, 3, 6, 7], [0.25, 0.5, 0.75, 1.0, 1.5, 2.0], [("half", 1, 0.5)])
    assert len(grid) == 38 and grid[1][0] == "item0_factor0_25" and grid[4][0] == "item0_factor1"


# --- profiles ---------------------------------------------------------------------------------


def test_byte_profile(spark):
    blob = random.Random(6).randbytes(500)
    df = spark.createDataFrame([(1, bytearray(blob)), (2, bytearray())], "id int, b binary")
    (got,) = pr.byte_profile(df, ["id"], "b").collect()
    mean = sum(blob) / 500
    assert (got["length"], got["distinct_values"]) == (500, len(set(blob)))
    assert math.isclose(got["mean"], mean)
    assert math.isclose(got["std_dev"], math.sqrt(sum((x - mean) ** 2 for x in blob) / 500))


def test_repeats(spark):
    blob = b"abababab--xyzxyz" + bytes(10)
    df = spark.createDataFrame([(bytearray(blob),)], "b binary")
    want = Counter()
    for n in range(2, 9):
        for i in range(len(blob) - 2 * n + 1):
            if blob[i : i + n] == blob[i + n : i + 2 * n]:
                want[blob[i : i + n].hex().upper()] += 1
    assert dict(rows(pr.adjacent_repeats(df, "b"), "pattern", "repeats")) == dict(want)


def test_ties(spark):
    df = spark.createDataFrame([("g", 3), ("g", 1), ("g", 2)], "g string, k int")
    assert pr.primary_key_of(df, ["g"], "k").first()["primary"] == 1
    assert rows(pr.top_k(pr.histogram(df, ["g"], ["k"]), ["g"], ["k"], 2), "rank", "k") == [(1, 1), (2, 2)]


def imbalance_by_hand(groups, measure):
    def score(c):
        if not c:
            return 0.0
        n = sum(c.values())
        if measure == "count":
            return len(c)
        if measure == "entropy":
            return -sum(v / n * math.log2(v / n) for v in c.values())
        return math.sqrt(n) if len(c) <= 3 else sum(math.sqrt(v) for v in c.values())

    scores = [score(c) for c in groups]
    if measure == "importance":
        return math.log1p(max(scores)) - math.log1p(min(s for s in scores if s > 0))
    return max(scores) - min(scores)


def picture(seed=3, width=40, height=30, colours=7):
    rng = random.Random(seed)
    return [(x, y, min(colours - 1, rng.randrange(1 + x // 6)) if y < 12 else rng.randrange(colours)) for x in range(width) for y in range(height)]


@pytest.mark.parametrize("measure", ["count", "entropy", "importance"])
def test_splits(spark, measure):
    data = picture()
    df = spark.createDataFrame(data, "x int, y int, k int")
    cuts = similar.split_points(40)
    assert cuts == [12, 20, 28]
    got = rows(similar.split_scores(df, F.col("x"), ["k"], cuts + [0], measure), "cut", "imbalance")
    for cut, imbalance in got:
        sides = [Counter(k for x, _, k in data if (x >= cut) == side) for side in (False, True)]
        assert math.isclose(imbalance, imbalance_by_hand(sides, measure), abs_tol=1e-9)


@pytest.mark.parametrize("measure", ["count", "entropy", "importance", "area"])
def test_quadrants(spark, measure):
    data = picture()
    df = spark.createDataFrame(data, "x int, y int, k int")
    xs, ys = similar.split_points(40), similar.split_points(30)
    got = similar.quadrant_scores(df, F.col("x"), F.col("y"), ["k"], xs, ys, measure, width=40, height=30).collect()
    assert len(got) == len(xs) * len(ys)
    best = None
    for r in sorted(got, key=lambda r: (r["h"], r["v"])):
        if measure == "area":
            areas = [w * t for w in (r["v"], 40 - r["v"]) for t in (r["h"], 30 - r["h"])]
            want = max(areas) - min(areas)
        else:
            parts = [Counter(k for x, y, k in data if (x >= r["v"]) == a and (y >= r["h"]) == b) for b in (False, True) for a in (False, True)]
            want = imbalance_by_hand(parts, measure)
        assert math.isclose(r["imbalance"], want, abs_tol=1e-9)
        if best is None or want < best[0] - 1e-12:
            best = (want, r["h"], r["v"])
    chosen = similar.best_quadrants(df, F.col("x"), F.col("y"), ["k"], xs, ys, measure, width=40, height=30).first()
    assert (chosen["h"], chosen["v"]) == best[1:]


def test_arrangements(spark):
    data = picture()
    df = spark.createDataFrame(data, "x int, y int, k int")
    x, y = F.col("x"), F.col("y")
    layouts = similar.three_way_layouts(df, x, y, ["k"], 40, 30, "entropy") + similar.two_way_layouts(40, 30, 10, 20) + [[(0, 0, 40, 30), (40, 0, 50, 30)]]

    def best_cut(inside, position, cuts):
        def score(c):
            return imbalance_by_hand([Counter(r[2] for r in inside if (r[position] >= c) == side) for side in (False, True)], "entropy")

        return min(cuts, key=lambda c: (round(score(c), 9), c))

    h = best_cut(data, 1, similar.split_points(30))
    top = best_cut([r for r in data if r[1] < h], 0, similar.split_points(40))
    assert layouts[0] == [(0, 0, top, h), (top, 0, 40, h), (0, h, 40, 30)]
    for r in similar.arrangement_scores(df, x, y, ["k"], layouts, "entropy").collect():
        parts = [Counter(k for a, b, k in data if x0 <= a < x1 and y0 <= b < y1) for x0, y0, x1, y1 in layouts[r["layout"]]]
        assert math.isclose(r["imbalance"], imbalance_by_hand(parts, "entropy"), abs_tol=1e-9)


def test_nine_sections_and_checkerboard(spark):
    rects = similar.nine_sections(9, 6, 2, 5, 1, 4)
    assert len(rects) == 9 and rects[0] == (0, 0, 2, 1) and rects[8] == (5, 4, 9, 6)
    got = [r[0] for r in spark.range(9).orderBy("id").select(similar.checkerboard(F.col("id"))).collect()]
    assert got == [0, 1, 0, 1, 0, 1, 0, 1, 0]


# --- similarity -------------------------------------------------------------------------------


def section_counts(seed=13):
    rng = random.Random(seed)
    return {s: Counter(rng.randrange(4 + s) for _ in range(60)) for s in range(9)}


def jaccard_by_hand(a, b):
    shared = sum(min(a[k], b[k]) for k in a)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def test_jaccard_both_ways(spark, monkeypatch):
    counts = section_counts()
    hist = spark.createDataFrame([(s, k, n) for s, c in counts.items() for k, n in c.items()], "s int, k int, cnt long")
    want = {(a, b): jaccard_by_hand(counts[a], counts[b]) for a, b in itertools.combinations(range(9), 2)}
    for limit in (1000, 2):
        monkeypatch.setattr(similar, "MATRIX_GROUPS", limit)
        got = {(a, b): v for a, b, v in rows(similar.weighted_jaccard(hist, "s", ["k"]), "a", "b", "similarity")}
        assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in want)


def matrix_by_hand(counts):
    return [[1.0 if a == b else jaccard_by_hand(counts[a], counts[b]) for b in range(9)] for a in range(9)]


def test_groupings(spark):
    counts = section_counts()
    hist = spark.createDataFrame([(s, k, n) for s, c in counts.items() for k, n in c.items()], "s int, k int, cnt long")
    pairs = similar.weighted_jaccard(hist, "s", ["k"])
    m = matrix_by_hand(counts)

    def join(groups, section):
        means = [sum(m[section][i] for i in g) / len(g) for g in groups]
        groups[means.index(max(means))].append(section)

    order = sorted(range(9), key=lambda i: -sum(m[i]))
    groups = [[i] for i in order[:4]]
    for s in range(9):
        if s not in order[:4]:
            join(groups, s)
    assert dict(rows(similar.greedy_groups4(pairs), "section", "palette")) == {s: g for g, group in enumerate(groups) for s in group}

    corners = sorted([0, 2, 6, 8], key=lambda c: m[4][c])
    groups = [[4], corners[:2], corners[2:]]
    for s in (1, 3, 5, 7):
        join(groups, s)
    assert dict(rows(similar.anchor_groups3(pairs), "section", "palette")) == {s: g for g, group in enumerate(groups) for s in group}


def test_cohesion(spark):
    pairs = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.1), (1, 2, 0.3)], "a int, b int, similarity double")
    same = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "s int, c string")
    apart = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "s int, c string")
    assert similar.cohesion(pairs, same, "s", "c").first()[0] == 0.5
    assert similar.cohesion(pairs, apart, "s", "c").first()[0] == 0.0


def test_nearest_rules(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [4.0, 0.0]), (3, [9.0, 9.0])], "id int, v array<double>")
    palette = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [6.0, 0.0])], "idx int, centre array<double>")
    assert rows(similar.nearest(points, "v", palette), "id", "nearest") == [(1, 0), (2, 1), (3, 2)]
    assert rows(similar.nearest(points, "v", palette, skip_first=True), "id", "nearest") == [(1, 1), (2, 1), (3, 2)]
    assert rows(similar.nearest(points, "v", palette.limit(2)), "id", "nearest") == [(1, 0), (2, 0), (3, 0)]


def test_two_nearest_and_usage(spark):
    points = spark.createDataFrame([(0, 0, [2.4]), (1, 0, [0.0]), (2, 2, [5.0])], "x int, y int, v array<double>")
    palette = spark.createDataFrame([(0, [0.0]), (1, [5.0]), (2, [50.0])], "idx int, centre array<double>")
    low = similar.two_nearest(points, "v", palette, F.lit(0.3))
    assert rows(low, "x", "best", "second", "chosen") == [(0, 0, 1, 1), (1, 0, 1, 0), (2, 1, 0, 1)]
    assert rows(similar.two_nearest(points, "v", palette, F.lit(0.6)), "x", "chosen") == [(0, 0), (1, 0), (2, 1)]
    assert rows(similar.usage_within(points, "v", palette, 3), "idx", "usage") == [(0, 2), (1, 2), (2, 0)]
    assert rows(similar.usage_within(points, "v", palette, 3, 2, "x", "y"), "idx", "usage") == [(0, 1), (1, 2), (2, 0)]


def test_lloyd_keeps_empty_cluster(spark):
    points = spark.createDataFrame([([0.0],), ([2.0],)], "v array<double>")
    start = spark.createDataFrame([(0, [0.5]), (1, [99.0])], "idx int, centre array<double>")
    assert rows(similar.lloyd_step(points, "v", start), "idx", "centre", "points") == [(0, [1.0], 2), (1, [99.0], 0)]


def test_kmeans_separates(spark):
    points = spark.createDataFrame([(i, [float(i % 2) * 100 + i * 0.01]) for i in range(40)], "id int, v array<double>")
    clusters = {r["id"]: r["cluster"] for r in similar.kmeans(points, "v", 2, seed=1).collect()}
    assert len({clusters[i] for i in range(0, 40, 2)}) == 1 and clusters[0] != clusters[1]
    hist = points.withColumn("cnt", F.lit(3))
    assert similar.kmeans_weighted(hist, "v", 2, seed=1).select("cluster").distinct().count() == 2


def test_diverse_topk(spark):
    rng = random.Random(21)
    data = [(g, i, float(rng.randrange(200)), rng.randrange(1, 9)) for g in "ab" for i in range(60)] + [("c", i, 0.0, 1) for i in range(12)] + [("d", 1, 0.0, 1)]
    df = spark.createDataFrame(data, "g string, i int, v double, cnt long")
    got = similar.diverse_topk(df, ["g"], "i", "v", 15, 4, 9).orderBy("g", "place").collect()
    for g in "abcd":
        pool = sorted((-n, i, v) for h, i, v, n in data if h == g)
        chosen = pool[:4]
        for c in pool:
            if len(chosen) < 9 and all(abs(c[2] - k[2]) >= 15 for k in chosen):
                chosen.append(c)
        chosen += [c for c in pool if c not in chosen][: 9 - len(chosen)]
        assert [r["i"] for r in got if r["g"] == g] == [c[1] for c in chosen], g
        assert [r["place"] for r in got if r["g"] == g] == list(range(len(chosen)))


# --- quality, ratings, tables -----------------------------------------------------------------


def test_domain_and_contracts(spark):
    df = spark.createDataFrame([(18,), (36,), (300,), (-5,)], "v int")
    assert rows(qu.validate_domain(df, "v", [0, 36, 72]), "v", "suggested") == [(-5, 0), (18, 0), (300, 72)]
    ruled = qu.expect(df, {"small": F.col("v") < 100, "positive": F.col("v") > 0})
    assert dict(rows(ruled.na.fill("fine"), "v", "broken")) == {18: "fine", 36: "fine", 300: "small", -5: "positive"}
    with pytest.raises(Exception, match="broken rule"):
        qu.expect(df, {"small": F.col("v") < 100}, abort=True).collect()


def test_unique_limit(spark):
    df = spark.range(100).select((F.col("id") % 60).alias("v"))
    with pytest.raises(ValueError):
        pr.unique_sorted_limited(df, ["v"])
    assert pr.unique_sorted_limited(df, ["v"], 60).count() == 60


def test_ratings(spark):
    df = spark.createDataFrame([(i,) for i in range(-1, 8)], "c int")
    assert [r[0] for r in df.select(rt.translate_rating(F.col("c"))).collect()] == [None, 25, 40, 50, 65, 75, 90, 100, None]
    stats = spark.createDataFrame([(1, None, 1, 5), (2, 70, 2, 5), (3, None, 2, 7), (4, None, None, 9)], "id int, r int, a int, b int")
    got = dict(rows(rt.percent_rank(stats.where("a IS NOT NULL"), "a", "p"), "id", "p"))
    assert got == {1: 0.0, 2: 0.5, 3: 0.5}
    imputed = {r["id"]: r["out"] for r in rt.impute_rating(stats, "r", ["a", "b"], out="out").collect()}
    assert imputed[2] == 70 and imputed[1] == 0


def test_listing_rules(spark):
    names = [("A.PPV",), ("BARE",), ("!pal",), ("!pal.x",), (".IFF",), ("X.IFF2",)]
    df = spark.createDataFrame([(f"/d/{n}",) for (n,) in names], "path string")
    kept = lambda *rule: {r[0].split("/")[-1] for r in bl.filter_listing(df, "path", *rule).collect()}
    assert kept("extension", ".PPV") == {"A.PPV"}
    assert kept("bare") == {"BARE", "!pal"}
    assert kept("bang") == {"!pal"}
    assert kept("contains", ".IFF") == {"X.IFF2"}


def test_blobs_from_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(10)))
    (tmp_path / "b.bin").write_bytes(b"xy")
    (tmp_path / "c.txt").write_bytes(b"longer than six")
    blobs = bl.read_blobs(spark, str(tmp_path), "*.bin", 6)
    cut = bl.slice_by_manifest(blobs, "content", [("one", "f", 2, 5), ("two", "f", 4, 99), ("none", "f", 7, 7), ("past", "f", 50, 60)])
    assert {r["name"]: bytes(r["bytes"]) for r in cut.collect()} == {"one": b"\x02\x03\x04", "two": bytes(range(4, 10)), "none": b"", "past": b""}


def test_csv_header_is_data(spark, tmp_path):
    df = spark.createDataFrame([(1, "x, y")], "id int, name string")
    tb.write_csv_titled(df.coalesce(1), {"id": "ID", "name": "Name"}, str(tmp_path / "t"))
    assert rows(tb.read_csv_positional(spark, str(tmp_path / "t"), ["p", "q"]), "p", "q") == [("1", "x, y"), ("ID", "Name")]


def test_wide(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": "x", "b": "y"}), (2, {"c": 'z"'})], "id int, m map<string,string>")
    wide = tb.wide_from_map(df, ["id"], "m")
    assert rows(wide, "id", "a", "b", "c") == [(1, "x", "y", ""), (2, "", "", 'z"')]
    tb.write_wide(wide, str(tmp_path / "w"))
    assert spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "w")).count() == 2
    one, two = spark.createDataFrame([("1", "x")], "id string, a string"), spark.createDataFrame([("2", "y")], "id string, b string")
    assert rows(tb.stack_wide(one, two), "id", "a", "b") == [("1", "x", ""), ("2", "", "y")]


def test_overlaps_both_ways_with_nulls_and_repeats(spark, monkeypatch):
    """Null keys count nowhere and repeated rows are added up, in the matrix and in the join."""
    from blobloom.operators import similar

    rows = [("a", "x", 2), ("a", "x", 1), ("b", "x", 5), ("a", None, 4), ("b", None, 4), ("b", "y", 1), ("c", "y", 3), ("c", "y", 3), (None, "x", 9)]
    hist = spark.createDataFrame(rows, "g string, k string, cnt bigint")
    want = {("a", "b", 3, 1, 3, 6), ("b", "c", 1, 1, 6, 6)}
    assert set(map(tuple, similar.pair_overlaps(hist, "g", ["k"]).collect())) == want
    monkeypatch.setattr(similar, "MATRIX_GROUPS", 1)
    assert set(map(tuple, similar.pair_overlaps(hist, "g", ["k"]).collect())) == want


def test_overlaps_of_blocks(spark, monkeypatch):
    """More groups than a block takes, a key that all of them have, and pairs that are added up in several turns."""
    from blobloom.operators import similar

    monkeypatch.setattr(similar, "MATRIX_GROUPS", 10)
    monkeypatch.setattr(similar, "BLOCK_GROUPS", 7)
    draw = random.Random(5)
    counts = {f"g{g}": {0: draw.randint(1, 9), **{draw.randint(1, 40): draw.randint(1, 9) for _ in range(6)}} for g in range(60)}
    counts["alone"] = {99: 3}
    hist = spark.createDataFrame([(g, k, n) for g, c in counts.items() for k, n in c.items()], "g string, k int, cnt int")
    want = set()
    for a, b in itertools.combinations(sorted(counts), 2):
        common = counts[a].keys() & counts[b].keys()
        if common:
            want.add((a, b, sum(min(counts[a][k], counts[b][k]) for k in common), len(common), sum(counts[a].values()), sum(counts[b].values())))
    found = list(map(tuple, similar.pair_overlaps(hist, "g", ["k"]).collect()))
    assert set(found) == want and len(found) == len(want) == 60 * 59 // 2


def test_add_pairs_in_turns(monkeypatch):
    import pyarrow as pa

    from blobloom.operators import similar

    monkeypatch.setattr(similar, "PAIRS_TOGETHER", 3)
    cells = [[{"g": 1, "c": 2}, {"g": 2, "c": 5}], [], [{"g": 1, "c": 4}, {"g": 2, "c": 1}, {"g": 3, "c": 1}]]
    kind = pa.list_(pa.struct([("g", pa.int64()), ("c", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([None, *cells][1:], kind)] * 2, names=["left", "right"])
    got = [tuple(r.values()) for out in similar._add_pairs([batch.slice(0, 1), batch.slice(1)]) for r in out.to_pylist()]
    assert sorted(got) == [(1, 2, 1, 1), (1, 2, 2, 1), (1, 3, 1, 1), (2, 3, 1, 1)]


def test_sticky_state_with_null_positions_hot_or_not(spark):
    from pyspark.sql import functions as F

    from blobloom.operators.ordered import Step, scan

    rows = [(1, None if i == 0 else i, 7 if i == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    step = Step(lasts={"state": F.col("v")})
    for hot in (None, 20):
        assert {r["state"] for r in scan(df, ["k"], ["t"], step, hot_rows=hot).collect()} == {7}


def test_many_ranges_need_no_width(spark):
    from blobloom.operators.lookups import range_lookup

    ranges = spark.createDataFrame([(i, 10 * i, 10 * i + (500 if i == 3 else 4)) for i in range(80)], "id int, lo int, hi int")
    values = spark.createDataFrame([(v,) for v in range(-5, 850, 3)], "v int")
    want = {v: min((i for i in range(80) if 10 * i <= v <= 10 * i + (500 if i == 3 else 4)), default=0) for v in range(-5, 850, 3)}
    assert {r["v"]: r["id"] for r in range_lookup(values, "v", ranges, "id", "lo", "hi").collect()} == want


def test_open_sessions_are_kept(spark):
    from blobloom.streaming.streams import with_open_sessions

    events = spark.createDataFrame([(1, 0, 1), (1, 5, 2), (1, 50, 3), (1, 55, 4), (1, 90, 5), (2, 99, 6), (None, 98, 7), (2, None, 8)], "k int, t bigint, id int")
    closed = spark.createDataFrame([(1, 0, 5, 2)], "k int, start bigint, end bigint, members bigint")
    found = with_open_sessions(closed, events, ["k"], "t", 20, tie=["id"]).collect()
    assert {tuple(r) for r in found} == {(1, 0, 5, 2), (1, 50, 55, 2), (1, 90, 90, 1), (2, 99, 99, 1), (None, 98, 98, 1)} and len(found) == 5


def test_queries_that_keep_short_blobs(spark, tmp_path):
    from __spark_entry__ import queries

    texts = [(1, ""), (2, None), (3, "a"), (4, "short"), (5, "long enough to have a header")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    told = {r["reason"]: r["docs"] for r in queries()["flt03_probe_map_header_all"](spark, str(tmp_path)).collect()}
    assert told["no header"] == 4 and sum(told.values()) == 5
    assert {1, 2, 3} <= {r["doc_id"] for r in queries()["flt04_probe_content_valid_all"](spark, str(tmp_path)).collect()}
