"""Indicator observations: the as-of upsert and its filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OBS_KEY = ["code", "period_start", "period_end", "dims"]


def upsert_observations(existing: DataFrame, new: DataFrame, pinned: DataFrame) -> DataFrame:
    """One row per key: the newest as_of wins and, at equal as_of, the later writer (new over existing, then greater seq).

    existing, new: the key, as_of, value, availability, run_id, seq.  pinned: keys with run_id that a frozen
    snapshot refers to: their value is updated, their run id stays.
    """
    both = existing.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    # a greatest struct: tasks combine before they send
    rest = [c for c in both.columns if c not in (*OBS_KEY, "as_of", "turn", "seq")]
    won = both.groupBy(*OBS_KEY).agg(F.max_by(F.struct(*rest, "as_of", "seq"), F.struct("as_of", "turn", "seq")).alias("w")).select(*OBS_KEY, "w.*")
    held = existing.join(pinned.select(*OBS_KEY, "run_id"), [*OBS_KEY, "run_id"], "left_semi").select(*OBS_KEY, F.col("run_id").alias("kept"))
    return won.join(held, OBS_KEY, "left").withColumn("run_id", F.coalesce("kept", "run_id")).drop("kept")


def list_observations(observations: DataFrame, code: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    if code:
        observations = observations.where(F.col("code") == code)
    if start:
        observations = observations.where(F.col("period_start") >= F.lit(start).cast("date"))
    if end:
        observations = observations.where(F.col("period_end") <= F.lit(end).cast("date"))
    return observations


def list_runs(runs: DataFrame, start: str, end: str) -> DataFrame:
    """Completed runs whose window overlaps [start, end]."""
    return runs.where((F.col("state") == "COMPLETED") & (F.col("window_end") >= F.lit(start).cast("date")) & (F.col("window_start") <= F.lit(end).cast("date")))


def latest_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
