"""Column functions, ratings."""

from pyspark.sql import functions as F

from ..functions import binary as bi
from ..functions import colour as co
from ..functions import signal as sg
from ..functions import text as tx
from ..operators import ratings as rt
from .registry import cents, query, rounded, sql_round
from .sources import document_blobs

LINE = ["l_orderkey", "l_partkey", "l_suppkey"]
LINE_SQL = "l_orderkey, l_partkey, l_suppkey"
WORD_SQL = "((l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 31) % 65536)"
# 8-bit channels of a line, for colour queries.
R_SQL, G_SQL, B_SQL = "((l_partkey * 7 + l_linenumber) % 256)", "((l_suppkey * 11) % 256)", "((l_quantity::BIGINT * 5) % 256)"


def lines(t, **columns):
    return t.lineitem.select(*LINE, *[c.alias(n) for n, c in columns.items()])


def word():
    return (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + F.col("l_linenumber") * 31) % 65536


def rgb(t, *more):
    return t.lineitem.select(
        *LINE,
        ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 256).alias("r"),
        ((F.col("l_suppkey") * 11) % 256).alias("g"),
        ((F.col("l_quantity").cast("bigint") * 5) % 256).alias("b"),
        *more,
    )


def _hex_sql(start: str, n: int) -> str:
    return f"CASE WHEN {start} >= 0 AND {start} + {n} <= octet_length(b) THEN ('0x' || hex(b[{start} + 1:{start} + {n}]))::BIGINT END"


def _little_sql(start: str) -> str:
    return f"CASE WHEN {start} + 2 <= octet_length(b) THEN ('0x' || hex(b[{start} + 2:{start} + 2]) || hex(b[{start} + 1:{start} + 1]))::BIGINT END"


@query(
    "fn01_read_integers",
    f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
             v AS (SELECT doc_id, {_hex_sql('0', 1)} AS u8, {_hex_sql('5', 2)} AS u16be, {_hex_sql('50', 4)} AS u32be, {_little_sql('7')} AS u16le,
                          {_hex_sql('octet_length(b) - 2', 2)} AS tail, {_hex_sql('octet_length(b) - 1', 2)} AS past FROM d)
        SELECT *, CASE WHEN tail >= 32768 THEN tail - 65536 ELSE tail END AS i16be, CASE WHEN u16le >= 32768 THEN u16le - 65536 ELSE u16le END AS i16le FROM v""",
)
def read_integers(t):
    size = F.octet_length("content")
    return document_blobs(t).select(
        "doc_id",
        bi.u8("content", 0).alias("u8"),
        bi.u16be("content", 5).alias("u16be"),
        bi.u32be("content", 50).alias("u32be"),
        bi.u16le("content", 7).alias("u16le"),
        bi.u16be("content", size - 2).alias("tail"),
        bi.u16be("content", size - 1).alias("past"),
        bi.i16be("content", size - 2).alias("i16be"),
        bi.i16le("content", 7).alias("i16le"),
    )


@query(
    "fn02_unpack_word",
    f"""SELECT {LINE_SQL}, w & 2047 AS tile, (w >> 11) & 1 AS hflip, (w >> 12) & 1 AS vflip, (w >> 13) & 3 AS palette, (w >> 15) & 1 AS priority
        FROM (SELECT *, {WORD_SQL} AS w FROM lineitem)""",
)
def unpack_word(t):
    return lines(t, f=bi.unpack_word(word())).select(*LINE, "f.*")


@query(
    "fn03_pack_word",
    f"""SELECT {LINE_SQL}, ((l_partkey & 2047) | ((l_linenumber & 1) << 11) | ((l_suppkey & 1) << 12)
               | ((l_quantity::BIGINT & 3) << 13) | ((l_linenumber::BIGINT >> 1 & 1) << 15))::BIGINT AS word, true AS round_trip FROM lineitem""",
)
def pack_word(t):
    packed = bi.pack_word(
        tile=F.col("l_partkey"),
        hflip=F.col("l_linenumber"),
        vflip=F.col("l_suppkey"),
        palette=F.col("l_quantity"),
        priority=F.shiftright("l_linenumber", 1),
    )
    rows = lines(t, word=packed)
    fields = {n: bi.unpack_word("word")[n] for n, _, _ in bi.WORD_FIELDS}
    return rows.withColumn("round_trip", bi.pack_word(**fields) == F.col("word"))


@query(
    "fn04_wide_index",
    f"""SELECT {LINE_SQL}, ((w & 61440) >> 1) | (x & 2047) AS word, x AS plain, (x & 2047) | (((w >> 4) & 15) << 11) AS nibble
        FROM (SELECT *, {WORD_SQL} AS w, (l_orderkey * 13 + l_partkey) % 65536 AS x FROM lineitem)""",
)
def wide_index(t):
    low = (F.col("l_orderkey") * 13 + F.col("l_partkey")) % 65536
    return lines(t, **{v: bi.wide_index(word(), low, v) for v in ("word", "plain", "nibble")})


@query(
    "fn05_nibbles",
    """WITH d AS (SELECT page_id, encode(url) AS b FROM pages)
       SELECT page_id, array_to_string(list_transform(range(1, 2 * octet_length(b) + 1), lambda i: ('0x' || substr(hex(b), i, 1))::INT), ' ') AS nibbles,
              hex(b) AS packed FROM d""",
)
def nibbles(t):
    values = bi.unpack_nibbles(F.encode("url", "UTF-8"))
    rows = t.pages.select("page_id", values.alias("v"))
    return rows.select("page_id", F.array_join("v", " ").alias("nibbles"), F.hex(bi.pack_nibbles("v")).alias("packed"))


@query("fn06_nibble_swap", f"SELECT {LINE_SQL}, ((x & 15) << 4) | (x >> 4) AS swapped FROM (SELECT *, l_partkey % 256 AS x FROM lineitem)")
def nibble_swap(t):
    return lines(t, swapped=bi.nibble_swap(F.col("l_partkey") % 256))


@query(
    "fn07_flip_xy",
    f"""SELECT {LINE_SQL}, CASE WHEN l_returnflag = 'R' THEN 49 - l_quantity::BIGINT ELSE l_quantity::BIGINT END AS x,
               CASE WHEN l_linestatus = 'F' THEN 7 - l_linenumber ELSE l_linenumber END::BIGINT AS y FROM lineitem""",
)
def flip_xy(t):
    flipped = bi.flip_xy(
        F.col("l_quantity").cast("bigint"), "l_linenumber", 50, 8, F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    )
    return lines(t, p=flipped).select(*LINE, "p.*")


def _colour9_sql() -> str:
    parts = []
    for scale in (32, 252, 255):
        for name, low in (("r", 1), ("g", 5), ("b", 9)):
            level = f"((w >> {low}) & 7)"
            value = f"{level} * 32" if scale == 32 else f"floor({level} * {scale}::DOUBLE / 7 + 0.5)::BIGINT"
            parts.append(f"{value} AS {name}{scale}")
    return f"SELECT {LINE_SQL}, {', '.join(parts)} FROM (SELECT *, {WORD_SQL} AS w FROM lineitem)"


@query("fn08_colour9_to_rgb", _colour9_sql())
def colour9_to_rgb(t):
    rows = lines(t, **{f"c{s}": co.colour9_to_rgb(word(), s) for s in (32, 252, 255)})
    return rows.select(*LINE, *[F.col(f"c{s}.{c}").alias(f"{c}{s}") for s in (32, 252, 255) for c in "rgb"])


def _level_sql(c: str, wrap: bool) -> str:
    level = f"floor({c} / 36.0::DOUBLE + 0.5)::BIGINT"
    return f"({level} & 7)" if wrap else f"least(7, {level})"


def _packed_sql(wrap: bool) -> str:
    return f"(({_level_sql(R_SQL, wrap)} << 1) | ({_level_sql(G_SQL, wrap)} << 5) | ({_level_sql(B_SQL, wrap)} << 9))"


@query("fn09_rgb_to_colour9", f"SELECT {LINE_SQL}, {_packed_sql(False)}::BIGINT AS cut, {_packed_sql(True)}::BIGINT AS wrapped FROM lineitem")
def rgb_to_colour9(t):
    return rgb(t).select(
        *LINE, co.rgb_to_colour9("r", "g", "b").alias("cut"), co.rgb_to_colour9("r", "g", "b", wrap=True).alias("wrapped")
    )


@query(
    "fn10_quantise",
    f"""SELECT {LINE_SQL}, floor(r / 255::DOUBLE * 31 + 0.5)::BIGINT AS five, floor(floor(r / 255::DOUBLE * 31 + 0.5) / 31 * 255 + 0.5)::BIGINT AS back, r AS eight
        FROM (SELECT *, {R_SQL} AS r FROM lineitem)""",
)
def quantise(t):
    rows = rgb(t).withColumn("five", co.quantise("r", 5))
    return rows.select(*LINE, "five", co.expand("five", 5).alias("back"), co.quantise("r", 8).alias("eight"))


@query("fn11_roundtrip3", f"SELECT {LINE_SQL}, least(7, floor({R_SQL} / 36::DOUBLE + 0.5)::BIGINT) * 36 AS r FROM lineitem")
def roundtrip3(t):
    return rgb(t).select(*LINE, co.roundtrip3("r").alias("r"))


@query("fn12_scale6", f"SELECT {LINE_SQL}, (l_partkey % 64) * 4 AS channel FROM lineitem")
def scale6(t):
    return lines(t, channel=co.scale6(F.col("l_partkey") % 64))


def _snap_sql(c: str) -> str:
    return f"greatest(0, least(252, ceil({c} / 36.0::DOUBLE - 0.5) * 36))::BIGINT"


def shade_sql(step: int) -> str:
    """Moved, cut and snapped channels with their notes, from (r, g, b)."""
    black = "(r = 0 AND g = 0 AND b = 0)"
    moved = ", ".join(f"CASE WHEN {black} OR {c} <> 0 THEN {c} + ({step}) ELSE {c} END AS m{c}" for c in "rgb")
    cut = ", ".join(f"greatest(0, least(252, m{c})) AS c{c}" for c in "rgb")
    final = ", ".join(f"{_snap_sql(f'c{c}')} AS s{c}" for c in "rgb")
    notes = [f"CASE WHEN m{c} <> c{c} AND m{c} <> {c} THEN '{c.upper()} cut to ' || c{c} END" for c in "rgb"]
    notes += [f"CASE WHEN s{c} <> c{c} THEN '{c.upper()} snapped to ' || s{c} END" for c in "rgb"]
    return f"""base AS (SELECT *, {R_SQL} AS r, {G_SQL} AS g, {B_SQL} AS b FROM lineitem), moved AS (SELECT *, {moved} FROM base),
               cut AS (SELECT *, {cut} FROM moved), final AS (SELECT *, {final} FROM cut),
               shaded AS (SELECT *, [x FOR x IN [{', '.join(notes)}] IF x IS NOT NULL] AS notes FROM final)"""


def _shade_query(mode: str, step: int) -> None:
    sql = f"""WITH {shade_sql(step)} SELECT {LINE_SQL}, sr AS r, sg AS g, sb AS b, array_to_string(notes, '; ') AS adjustments FROM shaded"""

    @query(f"fn13_shade_{mode}", sql)
    def shade(t):
        rows = rgb(t).select(*LINE, co.shade("r", "g", "b", mode).alias("s"))
        return rows.select(*LINE, "s.r", "s.g", "s.b", F.array_join("s.adjustments", "; ").alias("adjustments"))


for _mode, _step in (("light", 36), ("medium", 0), ("dark", -36)):
    _shade_query(_mode, _step)


@query(
    "fn14_ordered_dither",
    f"""WITH m AS (SELECT [{', '.join(str(v) for row in co.BAYER_8X8 for v in row)}] AS m),
             s AS (SELECT {LINE_SQL}, {R_SQL} / 255::DOUBLE * 7 AS s, m[(l_linenumber % 8) * 8 + l_suppkey % 8 + 1] / 64::DOUBLE AS threshold FROM lineitem, m)
        SELECT {LINE_SQL}, CASE WHEN s - floor(s) > threshold THEN least(7, floor(s) + 1) ELSE floor(s) END::BIGINT AS level FROM s""",
)
def ordered_dither(t):
    rows = rgb(t, "l_linenumber")
    return rows.select(*LINE, co.ordered_dither("r", 255, "l_suppkey", "l_linenumber").alias("level"))


@query(
    "fn15_noise_quantise",
    f"""WITH s AS (SELECT {LINE_SQL}, {R_SQL} / 255::DOUBLE * 7 AS s,
                   ('0x' || md5('42:' || l_orderkey || ':' || l_linenumber)[1:8])::BIGINT / 4294967296::DOUBLE AS share FROM lineitem)
        SELECT {LINE_SQL}, greatest(0, least(7, floor(s + (share - 0.5) + 0.5)))::BIGINT AS level FROM s""",
)
def noise_quantise(t):
    rows = rgb(t, "l_linenumber")
    return rows.select(*LINE, co.noise_quantise("r", 255, 0.5, 42, "l_orderkey", "l_linenumber").alias("level"))


def lab_sql(r: str, g: str, b: str) -> str:
    """Lab struct of three 8-bit channels."""

    def linear(c: str) -> str:
        return f"(CASE WHEN {c} / 255::DOUBLE > 0.04045 THEN pow(({c} / 255::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255::DOUBLE / 12.92 END)"

    def curve(weights, white: float) -> str:
        total = " + ".join(f"{linear(c)} * {w}::DOUBLE" for c, w in zip((r, g, b), weights))
        t = f"(({total}) / {white}::DOUBLE)"
        return f"(CASE WHEN {t} > 0.008856 THEN pow({t}, 1::DOUBLE / 3) ELSE {t} * 7.787 + 16::DOUBLE / 116 END)"

    x, y, z = (curve(w, white) for w, white in zip(co.RGB_TO_XYZ, co.WHITE_D65))
    return f"{{'l': {y} * 116 - 16, 'a': ({x} - {y}) * 500, 'b': ({y} - {z}) * 200}}"


@query(
    "fn16_rgb_to_lab",
    f"""SELECT {LINE_SQL}, {sql_round('lab.l')} AS l, {sql_round('lab.a')} AS a, {sql_round('lab.b')} AS b
        FROM (SELECT *, {lab_sql(R_SQL, G_SQL, B_SQL)} AS lab FROM lineitem)""",
)
def rgb_to_lab(t):
    rows = rgb(t).select(*LINE, co.rgb_to_lab("r", "g", "b").alias("lab"))
    return rows.select(*LINE, *[rounded(f"lab.{c}").alias(c) for c in "lab"])


@query(
    "fn17_delta_e",
    f"""SELECT {LINE_SQL}, {sql_round('sqrt((p.l - q.l) ** 2 + (p.a - q.a) ** 2 + (p.b - q.b) ** 2)')} AS distance
        FROM (SELECT *, {lab_sql(R_SQL, G_SQL, B_SQL)} AS p, {lab_sql('128', '64', '200')} AS q FROM lineitem)""",
)
def delta_e(t):
    rows = rgb(t).select(
        *LINE, co.rgb_to_lab("r", "g", "b").alias("p"), co.rgb_to_lab(F.lit(128), F.lit(64), F.lit(200)).alias("q")
    )
    return rows.select(*LINE, rounded(co.delta_e("p", "q")).alias("distance"))


@query(
    "fn18_luminance",
    f"""SELECT {LINE_SQL}, {sql_round(f'0.299::DOUBLE * {R_SQL} + 0.587::DOUBLE * {G_SQL} + 0.114::DOUBLE * {B_SQL}')} AS luminance FROM lineitem""",
)
def luminance(t):
    return rgb(t).select(*LINE, rounded(co.luminance("r", "g", "b")).alias("luminance"))


@query("fn19_compand", f"SELECT {LINE_SQL}, ({R_SQL} - 128) * abs({R_SQL} - 127) AS sample FROM lineitem")
def compand(t):
    return rgb(t).select(*LINE, sg.compand("r").alias("sample"))


@query(
    "fn20_cap_scale",
    """SELECT event_id, least(255, floor(value * (1.0::DOUBLE / CASE WHEN user_id % 4 = 0 THEN 1.0 ELSE (user_id % 4) * 0.5 END) + 0.5)::BIGINT) AS capped,
              floor(value * ((user_id % 4) * 0.5) + 0.5)::BIGINT AS scaled FROM events""",
)
def cap_scale(t):
    factor = (F.col("user_id") % 4) * 0.5
    return t.events.select(
        "event_id", sg.cap_scale("value", factor).alias("capped"), sg.scale_delta("value", factor).alias("scaled")
    )


@query(
    "fn21_pitch_name",
    f"""SELECT {LINE_SQL}, CASE WHEN p = 0 THEN 'None' ELSE ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][p % 12 + 1] || (p // 12 - 1) END AS pitch
        FROM (SELECT *, l_partkey % 128 AS p FROM lineitem)""",
)
def pitch_name(t):
    return lines(t, pitch=sg.pitch_name(F.col("l_partkey") % 128))


@query(
    "fn22_freq_to_note",
    f"""WITH f AS (SELECT *, l_partkey % 2048 AS fnum, l_linenumber % 8 AS block, l_quantity::BIGINT % 3 AS bend FROM lineitem)
        SELECT {LINE_SQL}, CASE WHEN fnum = 0 THEN 0 ELSE greatest(0, least(127, floor(log2(fnum * (7670454::DOUBLE / 144 / 32) / pow(2.0, 21 - block) / 440) * 12 + 69.5)
               + floor(bend / 8::DOUBLE + 0.5) * 500)) END::BIGINT AS note FROM f""",
)
def freq_to_note(t):
    bend = F.col("l_quantity").cast("bigint") % 3
    return lines(t, note=sg.freq_to_note(F.col("l_partkey") % 2048, F.col("l_linenumber") % 8, bend))


@query("fn23_align_up", "SELECT doc_id, ceil(n_chars / 4.0)::BIGINT * 4 AS four, ceil(n_chars / 100.0)::BIGINT * 100 AS hundred FROM documents")
def align_up(t):
    return t.documents.select("doc_id", bi.align_up("n_chars").alias("four"), bi.align_up("n_chars", 100).alias("hundred"))


@query(
    "fn24_hex_text",
    """SELECT doc_id, printf('0x%08X', n_chars) AS address, CASE WHEN n_chars % 2 = 0 THEN md5(text) END AS parsed FROM documents""",
)
def hex_text(t):
    digits = F.hex(F.encode("text", "UTF-8"))
    spaced = F.regexp_replace(digits, "(..)", "$1 ")
    # An odd number of digits is no byte string.
    cut = F.when(F.col("n_chars") % 2 == 0, spaced).otherwise(F.concat(spaced, F.lit("7")))
    return t.documents.select("doc_id", bi.hex_offset("n_chars").alias("address"), F.md5(bi.parse_hex(cut)).alias("parsed"))


@query(
    "fn25_hex_dump",
    """WITH d AS (SELECT doc_id, encode(text) AS b FROM documents),
            o AS (SELECT doc_id, b, unnest(range(0, octet_length(b), 16)) AS i FROM d)
       SELECT doc_id, i AS "offset", hex(b[i + 1:i + 16]) AS hex FROM o""",
)
def hex_dump(t):
    return bi.hex_dump(document_blobs(t), "content")


@query(
    "fn26_abbreviate",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE upper(substr(regexp_replace(p_name || '-' || p_type, '[^a-zA-Z0-9]', '', 'g'), 1, 3)) END AS short FROM part""",
)
def abbreviate(t):
    declared = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")
    return t.part.select("p_partkey", tx.abbreviate(F.concat_ws("-", "p_name", "p_type"), declared).alias("short"))


@query(
    "fn27_parse_triplet",
    f"""SELECT {LINE_SQL}, l_quantity::BIGINT AS r, l_linenumber::BIGINT AS g, CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS b FROM lineitem""",
)
def parse_triplet(t):
    third = F.when(F.col("l_returnflag") != "N", F.col("l_suppkey").cast("string"))
    text = F.concat_ws(" ", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"), third)
    return lines(t, c=tx.parse_triplet(text)).select(*LINE, "c.*")


LINK = '<a href="([^"]*)">([^<]*)</a>'


@query(
    "fn28_extract_pairs",
    f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 2)) AS label, unnest(regexp_extract_all(html, '{LINK}', 1)) AS value,
                          unnest(range(0, len(regexp_extract_all(html, '{LINK}')))) AS i FROM pages)
        SELECT page_id, trim(regexp_replace(label, '\\s+', ' ', 'g')) AS label, arg_max(trim(value), i) AS value FROM l GROUP BY 1, 2""",
)
def extract_pairs(t):
    pairs = tx.extract_pairs("html", LINK, 2, 1)
    return t.pages.select("page_id", F.explode(pairs).alias("label", "value"))


@query(
    "fn29_ability_flags",
    """SELECT DISTINCT page_id, trim(regexp_replace(unnest(regexp_extract_all(html, '<li[^>]*><a href="[^"]*">([^<]*)</a>', 1)), '\\s+', ' ', 'g')) AS ability, true AS flag FROM pages""",
)
def ability_flags(t):
    plain = F.regexp_replace("html", "<li><a [^>]*>([^<]*)</a></li>", "<li>$1</li>")
    return t.pages.select("page_id", F.explode(tx.ability_flags(plain, "li")).alias("ability", "flag"))


@query("fn30_collapse_space", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def collapse_space(t):
    return t.documents.select("doc_id", F.md5(F.encode(tx.collapse_space("text"), "UTF-8")).alias("digest"))


CLASS_SQL = """CASE WHEN low + middle + high = 0 THEN 'empty' WHEN 100 * low / (low + middle + high) > 70 THEN 'low'
    WHEN 100 * low / (low + middle + high) > 40 AND low > middle AND low > high THEN 'likely low'
    WHEN 100 * middle / (low + middle + high) > 70 THEN 'middle' WHEN 100 * high / (low + middle + high) > 70 THEN 'high' ELSE 'mixed' END"""
TRACKS_SQL = """k AS (SELECT o_custkey, count(*) FILTER (o_totalprice < 150000) AS low, count(*) FILTER (o_totalprice >= 150000 AND o_totalprice < 300000) AS middle,
                             count(*) FILTER (o_totalprice >= 300000) AS high FROM orders GROUP BY 1),
                c AS (SELECT c_custkey, coalesce(low, 0) AS low, coalesce(middle, 0) AS middle, coalesce(high, 0) AS high FROM customer LEFT JOIN k ON o_custkey = c_custkey)"""


def tracks(t):
    p = F.col("o_totalprice")
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(p < 150000).alias("low"), F.count_if((p >= 150000) & (p < 300000)).alias("middle"), F.count_if(p >= 300000).alias("high")
    )
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").na.fill(0)


@query("fn31_classify", f"WITH {TRACKS_SQL} SELECT c_custkey, {CLASS_SQL} AS class FROM c")
def classify(t):
    return tracks(t).select("c_custkey", sg.classify("low", "middle", "high").alias("class"))


@query(
    "fn32_recommend",
    f"""WITH {TRACKS_SQL}, x AS (SELECT c_custkey, {CLASS_SQL} AS class FROM c)
        SELECT c_custkey, class, CASE WHEN class = 'empty' THEN NULL WHEN class IN ('low', 'likely low') THEN 0.5 ELSE 1.0 END::DOUBLE AS factor,
               CASE WHEN class = 'empty' THEN NULL WHEN class IN ('low', 'likely low') THEN 1.0 ELSE 2.0 END::DOUBLE AS alternative FROM x""",
)
def recommend(t):
    told = tracks(t).select("c_custkey", sg.classify("low", "middle", "high").alias("class"))
    return told.select("c_custkey", "class", sg.recommend("class").alias("r")).select("c_custkey", "class", "r.*")


@query(
    "fn33_crest_slot",
    f"""SELECT {LINE_SQL}, 192 + 16 * (l_linenumber % 4) + l_partkey % 5 AS slot, CASE WHEN q < 20 THEN 192 + 16 * (q // 5) + q % 5 END AS listed
        FROM (SELECT *, l_quantity::BIGINT AS q FROM lineitem)""",
)
def crest_slot(t):
    return lines(
        t,
        slot=tx.slot(F.col("l_linenumber") % 4, F.col("l_partkey") % 5),
        listed=tx.grid_slot(F.col("l_quantity").cast("bigint")),
    )


# --- ratings --------------------------------------------------------------------------------


@query(
    "rt01_translate_rating",
    """SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 40 WHEN '2' THEN 50 WHEN '3' THEN 65 WHEN '4' THEN 75 WHEN '5' THEN 90 END::BIGINT AS rating FROM orders""",
)
def translate_rating(t):
    return t.orders.select("o_orderkey", rt.translate_rating(F.substring("o_orderpriority", 1, 1).cast("int")).alias("rating"))


@query("rt02_translate_weight", "SELECT p_partkey, (140 + 8 * (p_size % 16))::BIGINT AS pounds FROM part")
def translate_weight(t):
    return t.part.select("p_partkey", tx.weight_pounds(F.hex(F.col("p_size") % 16)).alias("pounds"))


CUSTOMER_STATS = """s AS (SELECT c_custkey, count(o_orderkey) AS orders, coalesce(sum(round(o_totalprice * 100)::BIGINT), 0)::BIGINT AS cents,
                               max(round(o_totalprice * 100)::BIGINT) AS biggest, CASE WHEN any_value(c_acctbal) < 0 THEN 30 END AS given
                          FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"""


def customer_stats(t):
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("orders"), F.sum(cents("o_totalprice")).alias("cents"), F.max(cents("o_totalprice")).alias("biggest")
    )
    given = F.when(F.col("c_acctbal") < 0, 30).alias("given")
    return t.customer.select("c_custkey", given).join(orders, "c_custkey", "left").na.fill(0, ["orders", "cents"])


@query(
    "rt03_impute_rating",
    f"""WITH {CUSTOMER_STATS}, r AS (SELECT *, (percent_rank() OVER (ORDER BY orders) + percent_rank() OVER (ORDER BY cents)) / 2 AS mean FROM s)
        SELECT c_custkey, coalesce(given, greatest(0, least(99, floor(mean * 99 + 5 + 0.5))))::BIGINT AS rating FROM r""",
)
def impute_rating(t):
    out = rt.impute_rating(customer_stats(t), "given", ["orders", "cents"], offset=5, out="rating")
    return out.select("c_custkey", "rating")


@query("rt04_rename_ratings", f"WITH {CUSTOMER_STATS} SELECT c_custkey, orders AS agility, orders AS speed, cents AS power FROM s")
def rename_ratings(t):
    return rt.rename_ratings(customer_stats(t), [("orders", "agility"), ("orders", "speed"), ("cents", "power")], ["c_custkey"])


@query(
    "rt05_contributions",
    f"""WITH {CUSTOMER_STATS} SELECT c_custkey, 'orders' AS stat, orders AS amount, 2.0::DOUBLE AS weight, orders * 2.0::DOUBLE AS weighted FROM s
        UNION ALL SELECT c_custkey, 'cents', cents, 0.5::DOUBLE, cents * 0.5::DOUBLE FROM s""",
)
def contributions(t):
    return rt.contributions(customer_stats(t), ["c_custkey"], ["orders", "cents", "biggest"], {"orders": 2.0, "cents": 0.5})
