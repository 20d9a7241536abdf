"""Column functions on small hand-made rows."""

import math
import random

from pyspark.sql import functions as F

from blobloom.functions import binary as bi
from blobloom.functions import colour as co
from blobloom.functions import signal as sg
from blobloom.functions import text as tx


def one(df, *columns):
    return df.select(*columns).first()


def row(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_integers(spark):
    df = row(spark, b=bytearray([0x00, 0x01, 0x80, 0xFF, 0xFE, 0x10]))
    got = one(
        df, bi.u8("b", 2), bi.u16be("b", 2), bi.u32be("b", 1), bi.u16le("b", 3), bi.i16be("b", 2), bi.i16le("b", 3),
        bi.u32le("b", 0), bi.u16be("b", 5), bi.u8("b", -1), bi.u32be("b", 3),
    )
    assert list(got) == [0x80, 0x80FF, 0x0180FFFE, 0xFEFF, 0x80FF - 65536, 0xFEFF - 65536, 0xFF800100, None, None, None]


def test_word_round_trip(spark):
    words = spark.range(65536).select(F.col("id").cast("int").alias("w"))
    fields = {n: bi.unpack_word("w")[n] for n, _, _ in bi.WORD_FIELDS}
    assert words.where(bi.pack_word(**fields) != F.col("w")).count() == 0


def test_pack_masks(spark):
    assert one(row(spark, x=1), bi.pack_word(tile=F.lit(4096 + 5), palette=F.lit(7)))[0] == 5 | 3 << 13


def test_nibbles_round_trip(spark):
    data = bytes(range(256))
    got = one(row(spark, b=bytearray(data)), bi.unpack_nibbles("b"), bi.pack_nibbles(bi.unpack_nibbles("b")))
    assert got[0][:4] == [0, 0, 0, 1] and got[0][-2:] == [15, 15] and bytes(got[1]) == data
    assert one(row(spark, b=bytearray()), bi.unpack_nibbles("b"))[0] == []


def test_nibble_swap_and_flip(spark):
    df = row(spark, v=0x2F, x=1, y=2, h=1, u=0)
    got = one(df, bi.nibble_swap("v"), bi.flip_xy("x", "y", 8, 8, "h", "u"))
    assert got[0] == 0xF2 and tuple(got[1]) == (6, 2)


def test_wide_index(spark):
    df = row(spark, high=0xF0A3, low=0x0FFF)
    got = one(df, *[bi.wide_index("high", "low", v) for v in ("word", "plain", "nibble")])
    assert list(got) == [0x7800 | 0x7FF, 0x0FFF, (0xA << 11) | 0x7FF]


def test_align_and_hex(spark):
    df = row(spark, n=5, m=8, s=" 0a fF", odd="abc", bad="zz")
    got = one(df, bi.align_up("n"), bi.align_up("m"), bi.hex_offset("n"), bi.parse_hex("s"), bi.parse_hex("odd"), bi.parse_hex("bad"))
    assert list(got) == [8, 8, "0x00000005", bytearray([0x0A, 0xFF]), None, None]


def test_hex_dump(spark):
    rows = bi.hex_dump(row(spark, id=1, b=bytearray(range(18))), "b").collect()
    assert [(r["offset"], r["hex"]) for r in rows] == [(0, bytes(range(16)).hex().upper()), (16, "1011")]


def test_positions_of_long_blobs(spark):
    df = spark.createDataFrame([(1, 0, 200_000), (2, 5, 4), (3, 7, 7)], "id int, a int, z int")
    got = bi.each_position(df, "at", F.col("a"), F.col("z"), 3).groupBy("id").agg(F.count("*"), F.min("at"), F.max("at"), F.count_distinct("at"))
    assert sorted(map(tuple, got.collect())) == [(1, 66667, 0, 199998, 66667), (3, 1, 7, 7, 1)]


def test_colour9(spark):
    df = row(spark, w=0b0000_1110_0110_0010)
    got = one(df, *[co.colour9_to_rgb("w", s) for s in (32, 252, 255)])
    assert [tuple(c) for c in got] == [(32, 96, 224), (36, 108, 252), (36, 109, 255)]


def test_rgb_to_colour9_inverts(spark):
    levels = spark.createDataFrame([(r, g, b) for r in co.LEVELS for g in co.LEVELS for b in co.LEVELS], "r int, g int, b int")
    back = levels.withColumn("c", co.colour9_to_rgb(co.rgb_to_colour9("r", "g", "b"), 252))
    assert back.where("c.r <> r OR c.g <> g OR c.b <> b").count() == 0


def test_quantise_matches_formula(spark):
    rows = spark.range(256).select("id", co.quantise("id", 4), co.roundtrip3("id"), co.expand(F.col("id") % 16, 4)).collect()
    half_up = lambda x: math.floor(x + 0.5)
    for c, q, r, e in rows:
        assert q == half_up(c / 255 * 15)
        assert r == min(7, half_up(c / 36)) * 36
        assert e == half_up((c % 16) / 15 * 255)


def shade_by_hand(rgb, mode):
    step = {"light": 36, "medium": 0, "dark": -36}[mode]
    out, cut_notes, snap_notes = [], [], []
    for name, c in zip("RGB", rgb):
        moved = c + step if (c or rgb == (0, 0, 0)) else c
        cut = max(0, min(252, moved))
        snap = min(co.LEVELS, key=lambda v: (abs(v - cut), v))
        if cut != moved and step:
            cut_notes.append(f"{name} cut to {cut}")
        if snap != cut:
            snap_notes.append(f"{name} snapped to {snap}")
        out.append(snap)
    return tuple(out), cut_notes + snap_notes


def test_shade(spark):
    rng = random.Random(3)
    colours = [(0, 0, 0), (252, 0, 36), (18, 0, 0), (0, 10, 250), (36, 36, 36)]
    colours += [tuple(rng.randrange(256) for _ in range(3)) for _ in range(200)]
    df = spark.createDataFrame(colours, "r int, g int, b int")
    for mode in ("light", "medium", "dark"):
        for r, g, b, s in df.select("r", "g", "b", co.shade("r", "g", "b", mode)).collect():
            want, notes = shade_by_hand((r, g, b), mode)
            assert (s["r"], s["g"], s["b"]) == want, (mode, r, g, b)
            assert s["adjustments"] == notes, (mode, r, g, b)


def test_dither(spark):
    df = spark.createDataFrame([(100, 0, 0), (100, 1, 1), (255, 3, 3), (0, 0, 0), (100, 7, 8)], "v int, x int, y int")
    got = [r[0] for r in df.select(co.ordered_dither("v", 255, "x", "y")).collect()]
    want = []
    for v, x, y in [(100, 0, 0), (100, 1, 1), (255, 3, 3), (0, 0, 0), (100, 7, 8)]:
        scaled = v / 255 * 7
        low = math.floor(scaled)
        want.append(min(7, low + 1) if scaled - low > co.BAYER_8X8[y % 8][x % 8] / 64 else low)
    assert got == want


def test_lab_of_white_and_black(spark):
    df = spark.createDataFrame([(255, 255, 255), (0, 0, 0)], "r int, g int, b int")
    white, black = (r[0] for r in df.select(co.rgb_to_lab("r", "g", "b")).collect())
    assert abs(white["l"] - 100) < 1e-6 and abs(white["a"]) < 0.1 and abs(white["b"]) < 0.1
    assert abs(black["l"]) < 1e-9


def test_noise_stays_near(spark):
    rows = spark.range(1000).select("id", co.noise_quantise(F.col("id") % 256, 255, 0.5, 1, "id").alias("q")).collect()
    assert all(abs(q - (i % 256) / 255 * 7) <= 1.0 and 0 <= q <= 7 for i, q in rows)


def test_signal(spark):
    df = row(spark, s=0, p=61, z=0, d=1000.0, f=0.0)
    got = one(df, sg.compand("s"), sg.pitch_name("p"), sg.pitch_name("z"), sg.cap_scale("d", "f"), sg.scale_delta("d", F.lit(0.5)))
    assert list(got) == [-128 * 127, "C#4", "None", 255, 500]


def test_freq_to_note(spark):
    # 440 Hz is pitch 69.
    fnum = round(440 / (7670454 / 144 / 32) * 2 ** (21 - 12))
    assert one(row(spark, f=fnum, b=12), sg.freq_to_note("f", "b"))[0] == 69
    assert one(row(spark, f=0, b=0), sg.freq_to_note("f", "b"))[0] == 0
    assert one(row(spark, f=2047, b=20), sg.freq_to_note("f", "b"))[0] == 127


def test_classify_in_order(spark):
    cases = [(0, 0, 0, "empty"), (71, 29, 0, "low"), (45, 30, 25, "likely low"), (41, 41, 18, "mixed"), (10, 80, 10, "middle"), (0, 20, 80, "high"), (40, 30, 30, "mixed")]
    df = spark.createDataFrame(cases, "l int, m int, h int, want string")
    assert df.where(sg.classify("l", "m", "h") != F.col("want")).count() == 0


def test_text(spark):
    df = row(spark, s="  a \n b\t", n="St. Louis", d="", t="36 72", m="xx--yy", w="f")
    got = one(
        df, tx.collapse_space("s"), tx.abbreviate("n"), tx.abbreviate("n", "d"), tx.abbreviate("n", F.lit("BLU")), tx.parse_triplet("t"),
        tx.slice_after("m", "--"), tx.slice_after("m", "**"), tx.slice_between("m", "x", "y"), tx.weight_pounds("w"), tx.grid_slot(F.lit(7)), tx.grid_slot(F.lit(20)),
    )
    assert list(got[:4]) == ["a b", "STL", "STL", "BLU"]
    assert tuple(got[4]) == (36, 72, None)
    assert list(got[5:]) == ["yy", None, "x--", 260, 210, None]


PAGE = """<!-- Start --><ul>
  <li id='one'>
    <span lang='x'>12</span> Apples
  </li><li><span>7</span> Sour  Plums</li><li><span>31</span> Apples</li></ul><!-- End -->
<h4 id='k'>Ripe</h4><h4>Hand  Picked</h4><h4>Ripe</h4>"""


def test_page(spark):
    df = row(spark, html=PAGE)
    pattern = r"<li[^>]*>\s*<span[^>]*>([^<]*)</span>\s([^<]*)</li>"
    inner = tx.slice_between("html", "<!-- Start -->", "<!-- End -->")
    got = one(df, tx.extract_pairs(inner, pattern, 2, 1), tx.ability_flags("html", "h4"))
    assert got[0] == {"Apples": "31", "Sour Plums": "7"}
    assert got[1] == {"Ripe": True, "Hand Picked": True}
