"""Small text rules: names, triplets, page fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import _column, let


def collapse_space(text) -> Column:
    """Trimmed text with every run of white space as one blank."""
    return F.trim(F.regexp_replace(_column(text), r"\s+", " "))


def abbreviate(name, declared=None) -> Column:
    """Declared abbreviation, else the first three letters or digits in upper case."""
    letters = F.regexp_replace(_column(name), "[^a-zA-Z0-9]", "")
    short = F.upper(F.substring(letters, 1, 3))
    return short if declared is None else F.coalesce(F.nullif(_column(declared), F.lit("")), short)


def parse_triplet(text) -> Column:
    """Struct (r, g, b) of a text such as "36 72 0"; a missing number is NULL."""
    parts = F.split(_column(text), " ")
    return F.struct(
        *[F.get(parts, F.lit(i)).try_cast("int").alias(c) for i, c in enumerate("rgb")]
    )


def slice_after(text, marker: str) -> Column:
    """What follows the first marker; NULL without a marker."""
    text = _column(text)
    at = F.instr(text, marker)
    return F.when(at > 0, F.substring(text, at + len(marker), F.length(text)))


def slice_between(text, first: str, last: str) -> Column:
    """What lies between the first `first` and the next `last`; NULL if one is missing."""
    rest = slice_after(text, first)
    at = F.instr(rest, last)
    return F.when(at > 0, F.substring(rest, F.lit(1), at - 1))


def extract_pairs(html, pattern: str, label_group: int, value_group: int) -> Column:
    """Map label -> value over all matches of a pattern; the last value of a label wins.

    Labels have their white space collapsed.
    """
    found = F.struct(
        F.reverse(F.regexp_extract_all(_column(html), F.lit(pattern), F.lit(label_group))).alias("labels"),
        F.reverse(F.regexp_extract_all(_column(html), F.lit(pattern), F.lit(value_group))).alias("values"),
    )

    def clean(s):
        return F.struct(
            F.transform(s["labels"], collapse_space).alias("labels"),
            F.transform(s["values"], lambda v: F.trim(v)).alias("values"),
        )

    def last_of_each(s):
        names = F.array_distinct(s["labels"])
        value = lambda n: F.element_at(s["values"], F.array_position(s["labels"], n).cast("int"))
        return F.map_from_arrays(names, F.transform(names, value))

    return let(let(found, clean), last_of_each)


def ability_flags(html, tag: str) -> Column:
    """Map heading text -> true for every heading of one tag."""
    pattern = F.lit(f"<{tag}[^>]*>([^<]*)</{tag}>")
    names = F.array_distinct(
        F.transform(F.regexp_extract_all(_column(html), pattern, F.lit(1)), collapse_space)
    )
    return F.map_from_arrays(names, F.transform(names, lambda _: F.lit(True)))


def slot(row, col, start: int = 192, row_step: int = 16) -> Column:
    """Palette slot of a cell in a grid whose rows are `row_step` slots apart."""
    return _column(row) * row_step + _column(col) + start


def grid_slot(position, columns: int = 5, rows: int = 4, start: int = 192, row_step: int = 16) -> Column:
    """Slot of the n-th entry of a row-major list; NULL past the last row."""
    position = _column(position)
    row = F.floor(position / columns)
    inside = (position >= 0) & (position < columns * rows)
    return F.when(inside, slot(row, F.pmod(position, F.lit(columns)), start, row_step))


def weight_pounds(code) -> Column:
    """Weight of a hex digit: 140 pounds, and 8 for each step."""
    digit = F.when(_column(code).rlike("^[0-9A-Fa-f]$"), F.conv(_column(code), 16, 10))
    return digit.cast("int") * 8 + 140
