"""Queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _plain(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and floats as DOUBLE, so that results compare across engines."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("bigint").alias(f.name)
            if isinstance(f.dataType, small)
            else F.col(f"`{f.name}`").cast("double").alias(f.name)
            if isinstance(f.dataType, T.FloatType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None):
    """Register a function of the tables under a name, with the SQL of the same result."""

    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: _plain(function(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    c = F.col(column)
    minutes = (F.unix_date(c.cast("date")).cast("bigint") * 24 + F.hour(c)) * 60 + F.minute(c)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def days(column: str) -> Column:
    """Days since 1995-01-01 of a timestamp without zone."""
    return F.expr(f"datediff(cast(`{column}` AS DATE), DATE'1995-01-01')")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def rounded(column, digits: int = 6):
    """Rounded, and without a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def sql_round(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0::DOUBLE"
