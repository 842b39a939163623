"""Quarantine: queries, pages, transitions and their log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_quarantine(items: DataFrame, files: DataFrame, records: DataFrame, state: str | None = None, cause: str | None = None, family: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Items with the row number and family they came from (null where unknown), filtered."""
    x = items.join(records.select("record_id", "row_number"), "record_id", "left").join(files.select("file_id", "family"), "file_id", "left")
    wanted = [F.col(c) == v for c, v in (("state", state), ("cause", cause), ("family", family)) if v is not None]
    wanted += [F.col("created_at") >= F.lit(start).cast("timestamp")] if start else []
    wanted += [F.col("created_at") < F.lit(end).cast("timestamp")] if end else []
    return x.where(reduce(lambda a, b: a & b, wanted)) if wanted else x


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, limit: int, descending: bool = False) -> DataFrame:
    """The next limit + 1 rows behind a cursor, in key order; the extra row tells that there is more."""
    if after is not None:
        step: Column = F.lit(False)
        for k, v in reversed(list(zip(keys, after))):
            past = F.col(k) < v if descending else F.col(k) > v
            step = past | ((F.col(k) == v) & step)
        df = df.where(step)
    return df.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in keys]).limit(limit + 1)


def apply_transitions(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Items after at most one action each.

    actions: item_id, action (REINJECT or DISCARD), conforming, new_cause, candidate, reason.  Only a
    pending item moves; a valid reinjection ends it, an invalid one keeps it with the new cause and
    candidate; a discard needs a reason.  `outcome` tells what happened.
    """
    x = items.join(actions, "item_id", "left")
    pending = F.col("state") == "Pendiente"
    again, drop = F.col("action") == "REINJECT", (F.col("action") == "DISCARD")
    reason = F.coalesce(F.length(F.trim("reason")) > 0, F.lit(False))
    outcome = F.when(F.col("action").isNull(), "NONE").when(~pending, "REFUSED").when(again & F.col("conforming"), "Reinyectado").when(again, "RETRY").when(drop & reason, "Descartado").otherwise("REFUSED")
    x = x.withColumn("outcome", outcome)
    state = F.when(F.col("outcome").isin("Reinyectado", "Descartado"), F.col("outcome")).otherwise(F.col("state"))
    retry = F.col("outcome") == "RETRY"
    return x.select("item_id", state.alias("state"), F.when(retry, F.col("new_cause")).otherwise(F.col("cause")).alias("cause"), F.when(retry, F.col("candidate")).alias("candidate"), "outcome")


def transition_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per action that was carried out: from, to, outcome."""
    moved = after.where(F.col("outcome").isin("Reinyectado", "RETRY", "Descartado"))
    return moved.join(before.select("item_id", F.col("state").alias("from_state")), "item_id").select("item_id", "from_state", F.col("state").alias("to_state"), "outcome")
