"""Structured Streaming forms: landing ingest, monthly counts, quarantine items, stale timers, event log."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from casemill.functions.calendar import month_index, month_of
from casemill.operators.audit import process_events
from casemill.operators.proactive import RULES, TWO_MONTHS, reevaluate_touched
from casemill.sources.landing import classify_files, read_landing
from casemill.sources.tables import partitions_of, write_table


def use_rocksdb(spark: SparkSession) -> None:
    """State variables and timers need the store that keeps them on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _kept(spark: SparkSession, out: str, df: DataFrame, part: str) -> DataFrame | None:
    """What the output holds of the batch's partitions, None before anything was written; other partitions are not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    names = [r[0] for r in df.select(part).distinct().collect()]  # a batch's, 256 at most
    return spark.read.schema(df.schema).parquet(out).where(F.col(part).isin(names))


def ingest_landing(spark: SparkSession, root: str, out: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None):
    """New files of the landing folders, classified, appended to `out` once each; ends when all are read.

    A file whose locator and content are in `out` already is left out, within a batch too.  The output is
    partitioned by the first byte of the content's digest; a batch reads the partitions that it writes.
    """

    def batch(df: DataFrame, number: int) -> None:
        x = classify_files(df).drop("content").dropDuplicates(["locator", "content_sha256"]).withColumn("part", F.concat(F.lit("p"), F.substring("content_sha256", 1, 2)))
        if (old := _kept(spark, out, x, "part")) is not None:
            x = x.join(old.select("locator", "content_sha256"), ["locator", "content_sha256"], "left_anti")
        x.write.mode("append").partitionBy("part").parquet(out)
        if each:
            each(df, number)

    return read_landing(spark, root, stream=True).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_counts(stream: DataFrame, day: str, *groups: str) -> DataFrame:
    """Running counts by month and group, for update mode.  There is no watermark: a late row changes its own month, whenever it comes; the state is one small row a month and group."""
    return stream.groupBy(F.trunc(day, "month").alias("month"), *groups).agg(F.count("*").alias("n"))


class _Item(StatefulProcessor):
    """One quarantine item: where it stands and how often it moved."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", "state string, moves int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = self.item.get() or ("Pendiente", 0)
        now, moves = was
        for r in sorted(rows, key=lambda r: r.turn) if now == "Pendiente" else ():
            if r.action == "REINJECT":
                moves += 1
                now = "Reinyectado" if r.conforming else now
            elif r.action == "DISCARD" and (r.reason or "").strip():
                moves += 1
                now = "Descartado"
            if now != "Pendiente":
                break
        if (now, moves) != tuple(was):
            self.item.update((now, moves))
        yield Row(item_id=key[0], state=now, moves=moves)

    def close(self) -> None:
        pass


def quarantine_items(actions: DataFrame) -> DataFrame:
    """(item_id, state, moves) after every batch of actions (item_id, turn, action, conforming, reason): a pending item ends by a valid reinjection or a discard with a reason, and stays ended."""
    use_rocksdb(actions.sparkSession)
    return actions.groupBy("item_id").transformWithState(_Item(), "item_id long, state string, moves int", "Update", "None")


class _Beats(StatefulProcessor):
    """One run's last heartbeat, and a timer that goes off when it is too old."""

    def __init__(self, minutes: int):
        self.wait = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "us long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = max(((r.us, r.ended) for r in rows if r.us is not None), default=None)
        old = self.last.get()
        if new is None or old is not None and new <= tuple(old):
            return
        if old is not None and not old[1]:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
        self.last.update(new)
        if not new[1]:
            # a timer goes off when the watermark reaches it; a heartbeat just so old is not yet too old
            due = new[0] // 1000 + self.wait + 1
            if due <= timerValues.getCurrentWatermarkInMs():
                yield Row(run_id=key[0], us=new[0])
            else:
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(run_id=key[0], us=self.last.get()[0])

    def close(self) -> None:
        pass


def _with_clock(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heartbeats without a clock, and after each batch a row with nothing but its newest time as clock: Spark leaves out late rows by their clock, so no heartbeat is late."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, b.column("at").type)], [*b.schema.names, "clock"])
            at = pc.max(b.column("at"))
            tick = [b.column(c).take(pa.array([0])) if c == "run_id" else pa.nulls(1, b.column(c).type) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*tick, pa.array([at.as_py()], b.column("at").type)], [*b.schema.names, "clock"])


def stale_timers(beats: DataFrame, minutes: int) -> DataFrame:
    """(run_id, last) of runs without a heartbeat (run_id, state, at) for so many minutes, by the clock of the heartbeats themselves, to the millisecond: the newest `at` of the batches before.

    A run that ends, in any state other than IN_PROGRESS, is watched no more; at the same time as a
    heartbeat the end counts.  Heartbeats come in any order: a late one counts unless its run has a newer
    one, which is therefore kept for each run, with one timer for each that goes on.
    """
    use_rocksdb(beats.sparkSession)
    x = beats.select("run_id", F.coalesce(F.col("state") != "IN_PROGRESS", F.lit(True)).alias("ended"), F.unix_micros("at").alias("us"), "at")
    x = x.mapInArrow(_with_clock, "run_id long, ended boolean, us long, at timestamp, clock timestamp").drop("at").withWatermark("clock", "0 seconds")
    out = x.groupBy("run_id").transformWithState(_Beats(minutes), "run_id long, us long", "Update", "EventTime")
    return out.select("run_id", F.timestamp_micros("us").alias("last"))


class _Series(StatefulProcessor):
    """The last months of one series, of which every batch's months become part, late ones too."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.months = handle.getListState("months", "m int, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        code, dims = key
        have = {m: v for m, v in self.months.get()} if self.months.exists() else {}
        for r in pd.concat(list(rows)).itertuples():
            have[r.m] = r.value
        top, depth = max(have), 5 if code in TWO_MONTHS else 6
        have = {m: v for m, v in have.items() if m > top - depth}
        self.months.put(sorted(have.items()))
        yield pd.DataFrame([(code, dims, *judge(code, have))], columns=["code", "dims", "m", "outcome", "signal", "trend", "recurrence"])

    def close(self) -> None:
        pass


def judge(code: str, months: dict[int, str | None]) -> tuple[int, str, bool, str | None, int | None]:
    """(month, outcome, signal, trend, recurrence) of a series at its newest month; values are decimal texts, None where there is none."""
    top = max(months)
    at = lambda m: None if months.get(m) is None else Decimal(months[m])
    two = code in TWO_MONTHS

    def signal(m: int) -> bool:
        v, p, e = at(m), at(m - 1), at(m - 2)
        return v is not None and p is not None and v > p and (two or e is not None and p > e)

    v, p, e = at(top), at(top - 1), at(top - 2)
    enough = v is not None and p is not None and (two or e is not None)
    trend = None if not enough or e is None else "INCREASING" if v > p > e else "DECREASING" if v < p < e else None
    return top, "EVALUATED" if enough else "INSUFFICIENT_HISTORY", enough and signal(top), trend, sum(signal(m) for m in range(top - 3, top + 1) if m in months) if enough else None


def judged_series(observations: DataFrame) -> DataFrame:
    """(code, dims, month, outcome, signal, trend, recurrence) of every judged series that a batch of observations (code, dims, period_start, availability, value) touched, after the batch.

    Five or six months of a series are its state; the history is never read again.  A late month takes its
    place among them, or is left out if it is older than all; a month that comes again replaces itself.
    """
    use_rocksdb(observations.sparkSession)
    x = observations.where(F.col("code").isin(list(RULES)))
    value = F.when(F.col("availability") == "DISPONIBLE", F.col("value").cast("string"))
    x = x.select("code", "dims", month_index(F.col("period_start")).cast("int").alias("m"), value.alias("value"))
    out = x.groupBy("code", "dims").transformWithStateInPandas(_Series(), "code string, dims string, m int, outcome string, signal boolean, trend string, recurrence int", "Update", "None")
    return out.withColumn("month", month_of(F.col("m"))).select("code", "dims", "month", "outcome", "signal", "trend", "recurrence")


def reevaluate_series(observations: DataFrame, history: str, out: str, run_id: str, checkpoint: str):
    """New observations are upserted into `history`; the series that a batch touched are evaluated again, the newest evaluation of each in `out`; ends when all are read.

    Both tables are laid out by series, so a batch reads and rewrites the partitions of its own series alone.
    """
    spark = observations.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        new = df.dropDuplicates(["code", "dims", "period_start"])
        write_table(spark, new.withColumn("seq", F.lit(number)), history, ["code", "dims", "period_start"], "update", "seq", by=["code", "dims"])
        x = reevaluate_touched(partitions_of(spark, history, new, ["code", "dims"]), new, run_id).withColumn("seq", F.lit(number))
        write_table(spark, x, out, ["code", "dims"], "update", "seq")

    return observations.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_log(events: DataFrame, out: str, checkpoint: str, fields: list[str], day: str):
    """Appends events with ids from their fields; redelivered ones have the same id and are left out.  The log is partitioned by the day of the column `day`, one of the fields, so a batch reads the days that it brings."""
    spark = events.sparkSession

    def batch(df: DataFrame, _: int) -> None:
        x = df.withColumn("part", F.date_format(day, "yyyy-MM-dd"))
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            span = x.agg(F.min("part"), F.max("part")).first()
            old = spark.read.schema("event_id string, part string").parquet(out).where(F.col("part").between(*span) | F.col("part").isNull()) if span[0] else spark.read.schema("event_id string").parquet(out)
        else:
            old = x.select(F.lit("").alias("event_id")).where("1 = 0")
        process_events(x, old, fields).write.mode("append").partitionBy("part").parquet(out)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
