"""Colour arithmetic: packed 9-bit colours, quantising, shading, dithering and Lab."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import _column, bits

# The channel levels of a 3-bit colour.
LEVELS = (0, 36, 72, 108, 144, 180, 216, 252)
STEP = 36

# 8x8 ordered dither thresholds, row by row, in 64ths.
BAYER_8X8 = (
    (0, 32, 8, 40, 2, 34, 10, 42),
    (48, 16, 56, 24, 50, 18, 58, 26),
    (12, 44, 4, 36, 14, 46, 6, 38),
    (60, 28, 52, 20, 62, 30, 54, 22),
    (3, 35, 11, 43, 1, 33, 9, 41),
    (51, 19, 59, 27, 49, 17, 57, 25),
    (15, 47, 7, 39, 13, 45, 5, 37),
    (63, 31, 55, 23, 61, 29, 53, 21),
)

# Linear sRGB to XYZ, and the D65 white point.
RGB_TO_XYZ = (
    (0.4124, 0.3576, 0.1805),
    (0.2126, 0.7152, 0.0722),
    (0.0193, 0.1192, 0.9505),
)
WHITE_D65 = (0.95047, 1.0, 1.08883)


def round_half_up(x) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(_column(x) + 0.5).cast("bigint")


def clamp(x, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _column(x)))


def colour9_to_rgb(word, scale: int = 252) -> Column:
    """Struct (r, g, b) of a packed colour with 3-bit channels at bits 1, 5 and 9.

    scale 32 multiplies a channel by 32; 252 and 255 stretch 0..7 to 0..scale.
    """

    def channel(low: int) -> Column:
        level = bits(word, low, 3)
        if scale == 32:
            return level.cast("bigint") * 32
        return round_half_up(level * F.lit(float(scale)) / 7)

    return F.struct(channel(1).alias("r"), channel(5).alias("g"), channel(9).alias("b"))


def rgb_to_colour9(r, g, b, wrap: bool = False) -> Column:
    """Packed colour of 8-bit channels; too large levels are cut to 7, or wrap modulo 8."""

    def level(c) -> Column:
        nearest = round_half_up(_column(c) / STEP).cast("int")
        return nearest.bitwiseAND(F.lit(7)) if wrap else F.least(F.lit(7), nearest)

    packed = F.shiftleft(level(r), 1)
    packed = packed.bitwiseOR(F.shiftleft(level(g), 5))
    return packed.bitwiseOR(F.shiftleft(level(b), 9))


def quantise(c, n_bits: int) -> Column:
    """8-bit channel in an n-bit space; 8 bits change nothing."""
    if n_bits == 8:
        return _column(c).cast("bigint")
    return round_half_up(_column(c) / 255 * ((1 << n_bits) - 1))


def expand(c, n_bits: int) -> Column:
    """n-bit channel back to 8 bits."""
    return round_half_up(_column(c) / ((1 << n_bits) - 1) * 255)


def roundtrip3(c) -> Column:
    """8-bit channel through 3 bits and back, in steps of 36."""
    return F.least(F.lit(7), round_half_up(_column(c) / STEP)) * STEP


def scale6(c) -> Column:
    """6-bit palette channel as 8 bits."""
    return _column(c) * 4


def nearest_level(c) -> Column:
    """Closest valid channel level, the lower one on a tie."""
    return clamp(F.ceil(_column(c) / STEP - 0.5) * STEP, 0, 252).cast("bigint")


def shade(r, g, b, mode: str) -> Column:
    """Struct (r, g, b, adjustments) of a colour made lighter or darker by one step.

    A zero channel stays zero unless all three are zero. The result is cut to 0..252 and
    snapped to a valid level; every cut and snap is named in `adjustments`.
    """
    step = {"light": STEP, "medium": 0, "dark": -STEP}[mode]
    channels = {"R": _column(r), "G": _column(g), "B": _column(b)}
    black = F.lit(True)
    for c in channels.values():
        black = black & (c == 0)

    final, notes = [], []
    for name, c in channels.items():
        moved = F.when(black | (c != 0), c + step).otherwise(c)
        cut = clamp(moved, 0, 252)
        snapped = nearest_level(cut)
        final.append(snapped.alias(name.lower()))
        out = F.when((moved != cut) & (moved != c), F.concat(F.lit(f"{name} cut to "), cut))
        off = F.when(snapped != cut, F.concat(F.lit(f"{name} snapped to "), snapped))
        notes.append((out, off))
    adjustments = F.array_compact(F.array(*[o for o, _ in notes], *[s for _, s in notes]))
    return F.struct(*final, adjustments.alias("adjustments"))


def bayer_threshold(x, y) -> Column:
    """Threshold in [0, 1) of the dither cell that (x, y) falls in."""
    flat = F.lit([v / 64 for row in BAYER_8X8 for v in row])
    cell = F.pmod(_column(y), F.lit(8)) * 8 + F.pmod(_column(x), F.lit(8))
    return F.element_at(flat, (cell + 1).cast("int"))


def ordered_dither(value, top: int, x, y) -> Column:
    """Value of 0..top as a 3-bit level, rounded up where it beats the cell's threshold."""
    scaled = _column(value) / top * 7
    low = F.floor(scaled)
    up = F.least(F.lit(7), low + 1)
    return F.when(scaled - low > bayer_threshold(x, y), up).otherwise(low).cast("bigint")


def noise_quantise(value, top: int, amount: float, seed: int, *key) -> Column:
    """3-bit level of value with uniform noise in (-amount, amount) added first.

    The noise is the first 32 bits of md5 of the seed and the row's key, so it does not hang on
    partitions and repeats itself.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[_column(k).cast("string") for k in key])
    share = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    noise = (share - 0.5) * amount * 2
    return clamp(round_half_up(_column(value) / top * 7 + noise), 0, 7).cast("bigint")


def rgb_to_lab(r, g, b) -> Column:
    """Struct (l, a, b) in CIE Lab of 8-bit sRGB channels."""

    def linear(c) -> Column:
        c = _column(c) / 255
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)

    def curve(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787 + 16 / 116)

    rgb = [linear(c) for c in (r, g, b)]
    x, y, z = (
        curve((rgb[0] * m[0] + rgb[1] * m[1] + rgb[2] * m[2]) / white)
        for m, white in zip(RGB_TO_XYZ, WHITE_D65)
    )
    return F.struct(
        (y * 116 - 16).alias("l"), ((x - y) * 500).alias("a"), ((y - z) * 200).alias("b")
    )


def delta_e(one, two) -> Column:
    """Euclidean distance of two Lab structs."""
    one, two = _column(one), _column(two)
    return F.sqrt(sum(F.pow(one[k] - two[k], F.lit(2)) for k in ("l", "a", "b")))


def luminance(r, g, b) -> Column:
    return _column(r) * 0.299 + _column(g) * 0.587 + _column(b) * 0.114
