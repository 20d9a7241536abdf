"""Testing blobs for known layouts, at one or at every offset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import each_position, u8, u16be, u32be

# Limits of a tile-and-map header.
MAX_PALETTE_OFFSET = 0x10000
MAX_MAP_OFFSET = 0x20000
HEADER = 10
TILE_BYTES = 32
PALETTE_SIZES = (0x20, 0x40, 0x60, 0x80)
END_MARKER = 0xFFFFFFFF

READERS = {"u8": u8, "u16be": u16be, "u32be": u32be}


def checksum_gate(blobs: DataFrame, blob: str, expected: int | Column, soft: bool = False) -> DataFrame:
    """Blobs with the expected CRC-32; the soft form keeps all and adds a flag."""
    good = F.crc32(blob) == expected
    return blobs.withColumn("checksum_ok", good) if soft else blobs.where(good)


def digest_gate(blobs: DataFrame, blob: str, expected: str | Column, soft: bool = False) -> DataFrame:
    """As `checksum_gate`, with an MD5 digest."""
    good = F.md5(blob) == expected
    return blobs.withColumn("checksum_ok", good) if soft else blobs.where(good)


def every_offset(blobs: DataFrame, blob: str, header: int, near: tuple[Column, int] | None = None) -> DataFrame:
    """One row per offset `at` with `header` bytes left, or only those around a target."""
    first, last = F.lit(0), F.octet_length(blob) - header
    if near is not None:
        target, radius = near
        first, last = F.greatest(first, target - radius), F.least(last, target + radius)
    return each_position(blobs, "at", first, last)


def probe_layout(
    blobs: DataFrame, blob: str, fields: dict[str, tuple[int, str]], rules: Sequence[Column], first: Column | None = None, header: int = 12
) -> DataFrame:
    """Offsets where all rules hold on header fields read there.

    `first` is a cheap test on the bytes at `at` that goes before any field is read.
    """
    keep = [c for c in blobs.columns if c != blob]
    rows = every_offset(blobs, blob, header)
    if first is not None:
        rows = rows.where(first)
    read = {n: READERS[kind](blob, F.col("at") + off) for n, (off, kind) in fields.items()}
    rows = rows.select(*keep, "at", *[e.alias(n) for n, e in read.items()])
    for rule in rules:
        rows = rows.where(rule)
    return rows


def find_map_layouts(blobs: DataFrame, blob: str) -> DataFrame:
    """Offsets that look like a tile, palette and map file, with kind, map size and end.

    `packed` needs an end marker behind the map; `plain` needs the palette to follow exactly
    behind its tiles. Where both fit, the kind is `packed`.
    """
    keep = [c for c in blobs.columns if c != blob]
    at, size = F.col("at"), F.octet_length(blob)
    # The map offset is below 2^24, so both numbers start with a zero byte.
    likely = F.expr(f"substring(`{blob}`, at + 1, 1) = X'00' AND substring(`{blob}`, at + 5, 1) = X'00'")
    rows = every_offset(blobs, blob, 13).where(likely)
    rows = rows.withColumns({"palette_at": u32be(blob, at), "map_at": u32be(blob, at + 4)})
    pal, mp = F.col("palette_at"), F.col("map_at")
    rows = rows.where(
        (at + pal < size) & (at + mp < size) & (pal < mp) & (pal >= HEADER)
        & (pal <= MAX_PALETTE_OFFSET) & (mp <= MAX_MAP_OFFSET) & (mp - pal >= 4)
    )
    rows = rows.withColumns(
        {
            "tiles": u16be(blob, at + 8),
            "packed_tiles": u8(blob, at + 9),
            "width": u16be(blob, at + mp),
            "height": u16be(blob, at + mp + 2),
        }
    ).where(F.col("width").between(1, 999) & F.col("height").between(1, 999))
    end = at + mp + 4 + F.col("width") * F.col("height") * 2
    plain = (pal == F.col("tiles") * TILE_BYTES + HEADER) & F.col("tiles").between(1, 999) & (end <= size)
    packed = F.col("packed_tiles").between(1, 254) & (pal > HEADER) & (end + 4 <= size) & (u32be(blob, end) == END_MARKER)
    kind = F.when(packed, "packed").when(plain, "plain")
    stop = F.when(packed, end + 4).when(plain, end)
    return rows.select(*keep, "at", kind.alias("kind"), "palette_at", "map_at", "width", "height", stop.alias("end")).where(
        F.col("kind").isNotNull()
    )


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Text of the first rule that fails, in order; NULL if all hold."""
    reason = F
    for text, ok in rules:
        reason = reason.when(~F.coalesce(ok, F.lit(False)), F.lit(text))
    return reason


def probe_map_header(blobs: DataFrame, blob: str, at: Column) -> DataFrame:
    """Why the bytes at an offset are no packed map file (`reason`), or its fields."""
    size = F.octet_length(blob)
    rows = blobs.withColumns(
        {
            "palette_at": u32be(blob, at),
            "map_at": u32be(blob, at + 4),
            "palette_size": u8(blob, at + 8),
            "tiles": u8(blob, at + 9),
        }
    )
    pal, mp, tiles = F.col("palette_at"), F.col("map_at"), F.col("tiles")
    rows = rows.withColumns({"width": u16be(blob, at + mp), "height": u16be(blob, at + mp + 2)})
    width, height = F.col("width"), F.col("height")
    length = mp + 4 + width * height * 2 + 4
    actual, full = pal - HEADER, tiles * TILE_BYTES
    reason = first_reason(
        [
            ("no header", pal.isNotNull() & tiles.isNotNull()),
            ("map not behind palette", mp > pal),
            ("invalid palette size", F.col("palette_size").isin(*PALETTE_SIZES)),
            ("tile bytes do not fit", (actual >= full * 0.1) & (actual <= full)),
            ("map beyond file", at + mp + 4 <= size),
            ("invalid map size", width.between(1, 1024) & height.between(1, 1024)),
            ("end beyond file", at + length <= size),
            ("palette overlaps map", pal + F.col("palette_size") <= mp),
        ]
    )
    return rows.withColumns(
        {
            "reason": reason,
            "file_size": F.when(reason.isNull(), length),
            "has_end_marker": F.when(reason.isNull(), u32be(blob, at + length - 4) == END_MARKER),
        }
    )


def probe_with_reason(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add the first failed rule's text; rules are tried in order."""
    return df.withColumn("reason", first_reason(rules))


def probe_content_valid(blobs: DataFrame, key: str, blob: str, bound: Column | int, offset: int = 0, words: Column | None = None) -> DataFrame:
    """Blobs whose 16-bit words all have a tile index (bits 0-10) below the bound.

    The words are tested where the blob is read; only keys of blobs with a bad word move.
    Without a number of words, all that the blob holds behind the offset are tested; a word
    that is asked for but not there is bad.
    """
    keep = [c for c in blobs.columns if c != blob]
    if words is None:
        words = F.floor((F.octet_length(blob) - offset) / 2)
    rows = each_position(blobs, "at", F.lit(offset), (words - 1) * 2 + offset, 2)
    good = u16be(blob, F.col("at")).bitwiseAND(F.lit(2047)) < bound
    bad = rows.where(~F.coalesce(good, F.lit(False))).select(key).distinct()
    return blobs.select(*keep).join(bad, key, "left_anti")


def probe_near(blobs: DataFrame, blob: str, target: Column, radius: int, test: Column, header: int = 1) -> DataFrame:
    """Offsets around a target, cut to the blob, where the test holds."""
    keep = [c for c in blobs.columns if c != blob]
    return every_offset(blobs, blob, header, (target, radius)).where(test).select(*keep, "at")


def detect_encoding(
    blob: Column, command_class: str, end: str, offsets: Sequence[int] = (10, 12, 16, 20, 24, 32), reach: int = 200
) -> Column:
    """Struct (found, offset): the first probe offset whose byte is in a class (a regular
    expression over Latin-1) and is followed by an end byte within `reach` bytes."""
    found = None
    for at in reversed(offsets):
        head = F.decode(F.substring(blob, at + 1, reach), "ISO-8859-1")
        hit = F.substring(head, 1, 1).rlike(command_class) & (F.instr(F.substring(head, 2, reach), end) > 0)
        found = F.when(hit, F.lit(at)) if found is None else F.when(hit, F.lit(at)).otherwise(found)
    return F.struct(found.isNotNull().alias("found"), F.coalesce(found, F.lit(0)).alias("offset"))


def first_offset_or_header(text: Column, pattern: str, start: int, header: Column) -> Column:
    """Smallest position (from 0) at or behind `start` where the pattern matches, else the
    declared one."""
    at = F.regexp_instr(F.substring(text, F.lit(start + 1), F.length(text)), F.lit(pattern))
    return F.when(at > 0, at + start - 1).otherwise(header)


def filter_events(events: DataFrame, kind: str, kinds: Sequence, value: Column | None = None) -> DataFrame:
    """Events of some kinds, with a positive value where one is asked for."""
    wanted = F.col(kind).isin(list(kinds))
    return events.where(wanted if value is None else wanted & (value > 0))


def skip_short_patterns(patterns: DataFrame, pattern: str, min_length: int = 16) -> DataFrame:
    return patterns.where(F.octet_length(pattern) >= min_length)
