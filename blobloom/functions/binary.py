"""Reading and writing packed bytes with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Longest array of positions that is made at once.
BLOCK = 65_536


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _bytes(blob, start, n: int) -> Column:
    return F.substring(blob, _lit(start) + 1, F.lit(n))


def read_uint(blob, offset, n: int, little: bool = False) -> Column:
    """n-byte unsigned integer at a byte offset; NULL where the blob is too short."""
    blob, offset = _column(blob), _lit(offset)
    if little:
        part = F.concat(*[_bytes(blob, offset + i, 1) for i in reversed(range(n))])
    else:
        part = _bytes(blob, offset, n)
    inside = (offset >= 0) & (offset + n <= F.octet_length(blob))
    value = F.conv(F.hex(part), 16, 10).cast("bigint")
    return F.when(inside, value if n > 2 else value.cast("int"))


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), with the value computed once.

    A higher-order function evaluates what its lambda takes from outside for every element;
    a lambda's own argument is ready.
    """
    return F.transform(F.array(value), use)[0]


def u8(blob, offset) -> Column:
    return read_uint(blob, offset, 1)


def u16be(blob, offset) -> Column:
    return read_uint(blob, offset, 2)


def u32be(blob, offset) -> Column:
    return read_uint(blob, offset, 4)


def u16le(blob, offset) -> Column:
    return read_uint(blob, offset, 2, little=True)


def u32le(blob, offset) -> Column:
    return read_uint(blob, offset, 4, little=True)


def signed16(value) -> Column:
    """Two's complement reading of an unsigned 16-bit value."""
    value = _column(value)
    return F.when(value >= 32768, value - 65536).otherwise(value)


def i16be(blob, offset) -> Column:
    return signed16(u16be(blob, offset))


def i16le(blob, offset) -> Column:
    return signed16(u16le(blob, offset))


def bits(word, low: int, width: int) -> Column:
    """`width` bits of an integer column, the lowest of them being bit `low`."""
    return F.shiftright(_column(word), low).bitwiseAND(F.lit((1 << width) - 1))


# Fixed layout of a map word: name, lowest bit, width.
WORD_FIELDS = (
    ("tile", 0, 11),
    ("hflip", 11, 1),
    ("vflip", 12, 1),
    ("palette", 13, 2),
    ("priority", 15, 1),
)


def unpack_word(word) -> Column:
    """Struct of the five fields of a 16-bit map word."""
    return F.struct(*[bits(word, low, width).alias(name) for name, low, width in WORD_FIELDS])


def pack_word(**fields) -> Column:
    """Map word from its fields; what does not fit a field is masked away."""
    word = F.lit(0)
    for name, low, width in WORD_FIELDS:
        if name in fields:
            field = _lit(fields[name]).cast("int").bitwiseAND(F.lit((1 << width) - 1))
            word = word.bitwiseOR(F.shiftleft(field, low))
    return word


def wide_index(high, low, variant: str) -> Column:
    """Tile index spread over two fields, in one of three layouts.

    `word`: bits 12-15 of the high word, moved down by one, over bits 0-10 of the low word.
    `plain`: the low word alone.
    `nibble`: bits 4-7 of the high byte, as bits 11-14, over bits 0-10 of the low word.
    """
    high, low = _column(high), _column(low)
    if variant == "plain":
        return low
    base = bits(low, 0, 11)
    if variant == "word":
        return F.shiftright(high.bitwiseAND(F.lit(0xF000)), 1).bitwiseOR(base)
    if variant == "nibble":
        return F.shiftleft(bits(high, 4, 4), 11).bitwiseOR(base)
    raise ValueError(f"unknown layout {variant!r}")


def unpack_nibbles(blob) -> Column:
    """Array of 4-bit values, high nibble of each byte first."""
    digits = F.regexp_extract_all(F.hex(_column(blob)), F.lit("."), F.lit(0))
    return F.transform(digits, lambda d: F.conv(d, 16, 10).cast("int"))


def pack_nibbles(values) -> Column:
    """Inverse of `unpack_nibbles`; values are masked to four bits."""
    return F.unhex(
        F.array_join(F.transform(_column(values), lambda v: F.hex(v.bitwiseAND(F.lit(15)))), "")
    )


def nibble_swap(byte) -> Column:
    return F.shiftleft(bits(byte, 0, 4), 4).bitwiseOR(bits(byte, 4, 4))


def flip_xy(x, y, width, height, hflip, vflip) -> Column:
    """Struct (x, y) mirrored inside a width x height box where a flip flag is set."""
    x, y = _column(x), _column(y)
    return F.struct(
        F.when(_column(hflip).cast("boolean"), _lit(width) - 1 - x).otherwise(x).alias("x"),
        F.when(_column(vflip).cast("boolean"), _lit(height) - 1 - y).otherwise(y).alias("y"),
    )


def align_up(n, multiple: int = 4) -> Column:
    n = _column(n)
    return n + F.pmod(-n, F.lit(multiple))


def hex_offset(n) -> Column:
    return F.format_string("0x%08X", _column(n))


def parse_hex(text) -> Column:
    """Bytes from spaced hex digits; NULL for an odd number of digits or a bad one."""
    digits = F.regexp_replace(_column(text), r"\s", "")
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(digits))


def each_position(df: DataFrame, name: str, first: Column, last: Column, step: int = 1) -> DataFrame:
    """One row per position first, first + step, ... up to last.

    In two stages, so that no array is longer than BLOCK, however long the blob is.
    """
    start = F.explode(F.sequence(first.cast("int"), last.cast("int"), F.lit(BLOCK * step)))
    stop = F.least(F.col("_from") + (BLOCK - 1) * step, last.cast("int"))
    blocks = df.where(first <= last).select("*", start.alias("_from"))
    return blocks.select(*df.columns, F.explode(F.sequence("_from", stop, F.lit(step))).alias(name))


def hex_dump(df: DataFrame, blob: str, width: int = 16) -> DataFrame:
    """One row per `width` bytes: offset, the bytes in hex."""
    keep = [c for c in df.columns if c != blob]
    rows = each_position(df, "offset", F.lit(0), F.octet_length(blob) - 1, width)
    return rows.select(*keep, "offset", F.hex(_bytes(F.col(blob), F.col("offset"), width)).alias("hex"))
