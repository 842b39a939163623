"""Rows dealt by key to tasks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task gets at most, about, where the number of rows is known.
ROWS = 1_000_000


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df dealt by keys to so many tasks that none has many more than ROWS of its `rows`; as it is if the session's cores have no more than that each, or rows is not known.

    Spark cuts shuffles by their compressed bytes, and rows that compress well fill a task's memory with
    some twenty times as much.  A number of parts of its own is not joined to fewer by Spark.
    """
    spark = df.sparkSession
    parts = -(-(rows or 0) // ROWS)
    if parts <= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
