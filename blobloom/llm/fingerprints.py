"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are words, and words of over 64 characters in parts of 64. Every k-gram of tokens has a
polynomial hash modulo a prime, rolled up by doubling (the hash of 2n tokens from two of n). In each
window of w neighbouring grams the least hash is chosen, the rightmost one of equal ones. So any run
of w + k - 1 tokens that two texts share has a chosen gram in common. Hash and position are one
integer, hash first and positions counted downwards, so a plain minimum makes both choices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import cut_points, piece_of
from .common import NO_ID

PRIME = 2**31 - 1
BASE = 1_000_003
TOKEN = r"[^\x20\x09-\x0D]{1,64}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def doubled(a: Column, wanted: int, join: Callable[[Column, Column, int], Column]) -> Column:
    """Per position the join of the `wanted` neighbours from there on, from joins of 1, 2, 4, ...; shorter by wanted - 1.

    join(left, right, n): right is the join of n neighbours. Neighbours are joined from left to right.
    """

    def trimmed(x: Column, y: Column, n: int) -> Column:
        joined = F.zip_with(x, y, lambda p, q: join(p, q, n))  # beyond the shorter one it joins nothing
        return let(y, lambda z: F.slice(joined, 1, F.size(z)))

    def grow(done: Column, have: int, power: Column, size: int, left: int) -> Column:
        """done: joins of `have` neighbours, power: joins of `size`, left: bits of wanted still to use."""
        take = left & 1
        rest = left >> 1
        if take and have:
            done = trimmed(done, shifted(power, have), size)
        elif take:
            done = power
        have += size * take
        if not rest:
            return done
        twice = let(power, lambda p: trimmed(p, shifted(p, size), size))
        if have:
            return let(done, lambda d: let(twice, lambda p: grow(d, have, p, 2 * size, rest)))
        return let(twice, lambda p: grow(p, 0, p, 2 * size, rest))

    return let(a, lambda x: grow(x, 0, x, 1, wanted))


def chosen(text: Column, k: int = 5, w: int = 8) -> Column:
    """The chosen grams of a text as ARRAY<BIGINT>, in order of position; see hash_of and position_of.

    A text with fewer than k tokens is one gram; fewer than w grams are one window; without tokens
    (null, empty or white) nothing is chosen.
    """

    def gram(left: Column, right: Column, n: int) -> Column:
        return (left * pow(BASE, n, PRIME) + right) % PRIME

    def all_in_one(x: Column) -> Column:
        return F.array(F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: (s * BASE + v) % PRIME))

    def windows(g: Column) -> Column:
        placed = F.transform(g, lambda h, i: h * 2**32 + (2**32 - 1 - i))
        return let(
            placed,
            lambda p: F.when(F.size(p) > w, F.array_distinct(doubled(p, w, lambda a, b, n: F.least(a, b)))).otherwise(F.array(F.array_min(p))),
        )

    values = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME)))
    none = F.array().cast("array<bigint>")
    return let(
        values,
        lambda x: F.when(F.size(x) < 1, none).otherwise(
            let(F.when(F.size(x) >= k, doubled(x, k, gram)).otherwise(all_in_one(x)), windows),
        ),
    )


def hash_of(gram: Column) -> Column:
    return F.shiftright(gram, 32)


def position_of(gram: Column) -> Column:
    """Token number of the gram's first token, from 0."""
    return F.lit(2**32 - 1) - gram.bitwiseAND(F.lit(2**32 - 1))


def as_text(grams: Column) -> Column:
    """`hash@position` of each chosen gram, the hash in hex."""
    return F.array_join(F.transform(grams, lambda g: F.concat(F.lower(F.hex(hash_of(g))), F.lit("@"), position_of(g).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of chosen hashes; 1 if both are empty."""

    def share(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y)).cast("double")
        return let(both, lambda n: F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(n / (F.size(x) + F.size(y) - n)))

    def hashes(grams: Column) -> Column:
        return F.array_distinct(F.transform(grams, hash_of))

    return let(hashes(a), lambda x: let(hashes(b), lambda y: share(x, y)))


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add next_<column>: values of the next row by key, after the last one the first's.

    Rows are cut into pieces at quantiles of the key, some per shuffle partition, and each piece is
    one window; the first row of a piece is also lent to the piece before. So one shuffle moves every
    row once, and no task holds more than a few pieces. A missing key comes first; rows of one key
    are in the order of their values.
    """
    spark = df.sparkSession
    rows = df.withColumn("_key", F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)))
    many = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = cut_points(rows, "_key", many)
    rows = rows.withColumn("_piece", piece_of("_key", cuts).cast("int"))
    # At most one row per piece.
    firsts = sorted((r["_piece"], r["first"]) for r in rows.groupBy("_piece").agg(F.min("_key").alias("first")).collect())
    lent = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    lent = spark.createDataFrame(lent, "_key bigint, _to int")
    rows = rows.join(F.broadcast(lent), "_key", "left")
    own = F.struct(F.col("_piece"), F.lit(False).alias("lent"))
    copy = F.struct(F.col("_to").alias("_piece"), F.lit(True).alias("lent"))
    rows = rows.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    order = W.partitionBy("_at._piece").orderBy("_at.lent", "_key", *columns)
    following = F.lead(F.struct(*columns)).over(order)
    rows = rows.withColumn("_next", following).where(~F.col("_at.lent"))
    return rows.select(*df.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def fingerprint_documents(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, w: int = 8) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likeness.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all) of
    the next document's, by ascending id, after the last one the first's. A null text is empty; an
    empty fingerprint is like another empty one (1) and unlike all others (0). Repeated rows follow
    each other. An empty table gives no rows.
    """
    docs = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("grams", chosen(F.col("text"), k, w)), "doc_id", ["text", "grams"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "grams", "next_grams", edited.alias("edited"))
    rows = rows.select("*", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), chosen(F.col("edited"), k, w).alias("edited_grams"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("grams")).alias("fingerprint"),
        as_text(F.col("edited_grams")).alias("edited_fingerprint"),
        likeness(F.col("grams"), F.col("edited_grams")).alias("near_edited"),
        likeness(F.col("grams"), F.col("next_grams")).alias("near_next"),
    )
