"""Audit events, ledgers and data-quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.ids import uuid5
from casemill.operators.parts import dealt

EVENTS = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def audit_events(events: DataFrame, actor=None, actions: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events of an actor (all without one), of the given actions and time range."""
    if actor is not None:
        events = events.where(F.col("actor") == actor)
    if actions:
        events = events.where(F.col("action").isin(actions))
    if start:
        events = events.where(F.col("occurred_at") >= F.lit(start).cast("timestamp"))
    if end:
        events = events.where(F.col("occurred_at") < F.lit(end).cast("timestamp"))
    return events


def with_resources(events: DataFrame, resources: DataFrame) -> DataFrame:
    """Events with their resources (event_id, position, resource), ordered."""
    rows = F.array_sort(F.collect_list(F.struct("position", "resource")))
    own = resources.groupBy("event_id").agg(F.array_join(F.transform(rows, lambda r: r["resource"]), ",").alias("resources"))
    return events.join(own, "event_id", "left").withColumn("resources", F.coalesce("resources", F.lit("")))


def process_events(df: DataFrame, existing: DataFrame, fields: list[str]) -> DataFrame:
    """New events with an id from their fields; equal ones are one, and those that exist are left out."""
    x = df.withColumn("event_id", uuid5(EVENTS, F.concat_ws(":", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])))
    return x.dropDuplicates(["event_id"]).join(existing.select("event_id"), "event_id", "left_anti")


def check_resources(events: DataFrame, fragments: DataFrame) -> DataFrame:
    """(event_id, resource, side) that only the audit or only the operation has."""
    a, b = events.select("event_id", "resource"), fragments.select("event_id", "resource")
    return a.exceptAll(b).withColumn("side", F.lit("audit")).unionByName(b.exceptAll(a).withColumn("side", F.lit("operation")))


def stale_runs(dispatch: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Work in progress whose heartbeat is older than so many seconds."""
    return dispatch.where((F.col("state") == "IN_PROGRESS") & (F.col("heartbeat").cast("long") < now.cast("long") - seconds))


def job_ledger(entries: DataFrame) -> DataFrame:
    """Jobs as they stand, from appended entries (job_id, seq, state, at …): the last entry's columns, when the job was created, and when it ended, if it has."""
    ended = F.col("state").isin("COMPLETED", "FAILED", "NO_RELEVANT_WORK")
    rest = [c for c in entries.columns if c not in ("job_id", "seq", "at")]
    x = entries.groupBy("job_id").agg(F.max_by(F.struct(*rest, "at"), F.struct("seq", "at")).alias("last"), F.min("at").alias("created_at"), F.count("*").alias("entries"))
    x = x.select("job_id", *[F.col(f"last.{c}").alias(c) for c in rest], "created_at", F.col("last.at").alias("at"), "entries")
    return x.withColumn("completed_at", F.when(ended, F.col("at"))).drop("at")


def check_run_binding(jobs: DataFrame, snapshots: DataFrame, runs: DataFrame, rows: int | None = None) -> DataFrame:
    """(job_id, problem): jobs whose frozen rows point to no run, to several, or to one of another parent.

    Repeated pairs of job and run are one.  With the number of snapshots' rows, a task gets a bounded part of them.
    """
    pairs = dealt(snapshots.select("job_id", "run_id"), rows, "run_id").distinct()
    each = runs.groupBy("run_id").agg(F.min("parent").alias("run_parent"))
    known = pairs.join(each, "run_id").select("job_id", "run_parent")
    own = dealt(known, rows, "job_id").groupBy("job_id").agg(F.count("*").alias("n"), F.min("run_parent").alias("p"))
    x = jobs.join(own, "job_id", "left")
    return x.select("job_id", F.when(F.col("n").isNull(), "NO_RUN").when(F.col("n") > 1, "SEVERAL_RUNS").when(~F.col("p").eqNullSafe(F.col("parent")), "OTHER_PARENT").alias("problem")).where("problem is not null")
