"""What every operator may need from the session: shared storage and size checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows of a lookup side that may be turned into a literal or a broadcast table.
SMALL_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from `spark.checkpoint.dir` or the context's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder name under the shared folder that nobody used before."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "rows") -> DataFrame:
    """The same rows, written once to the shared folder.

    For what is read several times: it is not computed again, it survives the loss of any
    executor, and Spark knows its size for the joins that follow.
    """
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def is_small(df: DataFrame, limit: int = SMALL_ROWS) -> bool:
    """Whether df has at most `limit` rows; reads no more than it needs to tell."""
    return df.limit(limit + 1).count() <= limit


def small_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list | None:
    """The rows of a lookup table if there are at most `limit` of them, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
