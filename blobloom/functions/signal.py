"""Sample values, note timing and pitch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import _column
from .colour import clamp, round_half_up

# Note names of one octave, and the tone generator's clock.
NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
TONE_CLOCK = 7670454


def compand(sample) -> Column:
    """Unsigned 8-bit sample on a square curve around the middle."""
    sample = _column(sample)
    return (sample - 128) * F.abs(sample - 127)


def scale_delta(delta, factor) -> Column:
    """Time step multiplied by a factor, rounded."""
    return round_half_up(_column(delta) * _column(factor))


def cap_scale(delta, factor) -> Column:
    """Time step divided by a factor (0 counts as 1), rounded and cut to one byte."""
    factor = _column(factor)
    usable = F.when(factor == 0, F.lit(1.0)).otherwise(factor)
    return F.least(F.lit(255), round_half_up(_column(delta) * (F.lit(1.0) / usable)))


def pitch_name(pitch) -> Column:
    """Name and octave of a pitch number; pitch 0 has none."""
    pitch = _column(pitch)
    name = F.element_at(F.lit(list(NOTE_NAMES)), (F.pmod(pitch, F.lit(12)) + 1).cast("int"))
    octave = (F.floor(pitch / 12) - 1).cast("string")
    return F.when(pitch == 0, "None").otherwise(F.concat(name, octave))


def freq_to_note(fnum, block, bend=None) -> Column:
    """Nearest pitch number of a tone generator frequency, in 0..127."""
    bend = F.lit(0) if bend is None else _column(bend)
    hertz = _column(fnum) * (TONE_CLOCK / 144 / 32) / F.pow(F.lit(2.0), 21 - _column(block))
    note = round_half_up(F.log2(hertz / 440) * 12 + 69) + round_half_up(bend / 8) * 500
    return F.when(_column(fnum) == 0, F.lit(0)).otherwise(clamp(note, 0, 127)).cast("bigint")


def classify(low, middle, high) -> Column:
    """Class of a track from its three counts; the first rule that holds wins."""
    low, middle, high = _column(low), _column(middle), _column(high)
    total = low + middle + high
    return classify_shares(total, low / total * 100, middle / total * 100, high / total * 100)


def classify_shares(total, low, middle, high) -> Column:
    """As `classify`, from a total and three percentages of it."""
    total, low, middle, high = (_column(c) for c in (total, low, middle, high))
    return (
        F.when(total == 0, "empty")
        .when(low > 70, "low")
        .when((low > 40) & (low > middle) & (low > high), "likely low")
        .when(middle > 70, "middle")
        .when(high > 70, "high")
        .otherwise("mixed")
    )


def recommend(track_class) -> Column:
    """Struct of two timing factors: slow the low tracks, or speed up the others."""
    low = _column(track_class).isin("low", "likely low")
    counted = _column(track_class) != "empty"
    return F.struct(
        F.when(counted, F.when(low, 0.5).otherwise(1.0)).alias("factor"),
        F.when(counted, F.when(low, 1.0).otherwise(2.0)).alias("alternative"),
    )
