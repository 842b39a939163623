"""Streaming forms: each query runs a stream over the driver's tables to its end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.plans.fixtures import table, view, with_views, work_dir
from casemill.plans.kpi_queries import _CLOSURE, _LAGS, RUN
from casemill.plans.landing_queries import _FOLDERS
from casemill.plans.registry import query
from casemill.streaming import jobs


def _stream(spark, df, name, parts=3):
    """df as a stream of a few files."""
    at = work_dir(spark, name)
    df.repartition(parts).write.parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


_LANDED = f"SELECT upper(f) AS family, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes FROM (SELECT {_FOLDERS} AS f, l_orderkey || ',' || l_linenumber || ',' || l_returnflag AS line FROM lineitem) WHERE f <> 'otra' GROUP BY f"


@query("ST1_incremental_ingest", _LANDED)
def _ingest(spark, d):
    root, out = _landed(spark, d), work_dir(spark, "files")
    jobs.ingest_landing(spark, root, out, work_dir(spark, "mark")).awaitTermination()
    return spark.read.parquet(out).groupBy("family").agg(F.sum("length").alias("bytes"))


def _run_in_order(spark, df, column, name, job, parts=3):
    """Runs a stream over df in the order of a column: the rows of a part, in however many files, are one batch, and a part comes when those before are through.  job takes the stream's table and gives what is to be started."""
    at, mark = work_dir(spark, name), work_dir(spark, "mark")
    cuts = df.approxQuantile(column, [k / parts for k in range(1, parts)], 0.01)
    for k in range(parts):
        part = df if not k else df.where(F.col(column) > cuts[k - 1])
        (part if k == parts - 1 else part.where(F.col(column) <= cuts[k])).write.mode("append").parquet(at)
        job(spark.readStream.schema(df.schema).parquet(at)).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()


def _landed(spark, d):
    root = work_dir(spark, "landing")
    x = table(spark, d, "lineitem").select(F.expr(_FOLDERS).alias("f"), F.concat_ws(",", "l_orderkey", "l_linenumber", "l_returnflag").alias("value"))
    for folder in ("contratos_documentos", "litigios", "cumplimiento", "auditoria_interna", "otra"):
        x.where(F.col("f") == folder).select("value").write.text(f"{root}/{folder}")
    return root


@query("ST2_replay_removal", _LANDED)
def _replayed(spark, d):
    root, out = _landed(spark, d), work_dir(spark, "files")
    for _ in range(2):  # the second stream has forgotten what the first one read
        jobs.ingest_landing(spark, root, out, work_dir(spark, "mark")).awaitTermination()
    return spark.read.parquet(out).groupBy("family").agg(F.sum("length").alias("bytes"))


def _counted(spark, stream, *groups):
    out = work_dir(spark, "months")

    def batch(df, _):
        df.write.mode("overwrite").parquet(out)

    jobs.monthly_counts(stream, "day", *groups).writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", work_dir(spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("ST4_monthly_counts", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _months(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus")
    return _counted(spark, _stream(spark, x, "orders"), "o_orderstatus")


@query("ST3_late_rows", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY ALL")
def _late(spark, d):
    # the newest days come first, so that nearly every later row is late; all of them count
    x = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    at = work_dir(spark, "late")
    x.repartitionByRange(3, F.desc("day")).write.parquet(at)
    return _counted(spark, spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(at))


@query("ST5_sliding_months", with_views("WITH " + _CLOSURE.strip() + "," + _LAGS + " SELECT code, dims, month, outcome, signal, trend, recurrence FROM ids", "observations"))
def _sliding(spark, d):
    x = view(spark, d, "observations").select("code", "dims", "period_start", "period_end", "availability", "value")
    history, out = work_dir(spark, "history"), work_dir(spark, "evaluations")
    jobs.reevaluate_series(_stream(spark, x, "observations", 2), history, out, RUN, work_dir(spark, "mark")).awaitTermination()
    return spark.read.parquet(out).select("code", "dims", "month", "outcome", "signal", "trend", "recurrence")


@query("ST5_series_state", with_views("WITH " + _CLOSURE.strip() + "," + _LAGS + " SELECT code, dims, month, outcome, signal, trend, recurrence FROM ids", "observations"))
def _series(spark, d):
    # the newest months come first, so that the older ones are late and have to take their places
    x = view(spark, d, "observations").select("code", "dims", "period_start", "availability", "value")
    at, out = work_dir(spark, "late"), work_dir(spark, "series")
    x.repartitionByRange(3, F.desc("period_start")).write.parquet(at)

    def batch(df, n):
        df.withColumn("seq", F.lit(n)).write.mode("append").parquet(out)

    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(at)
    jobs.judged_series(stream).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", work_dir(spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("code", "dims").agg(F.max_by(F.struct("month", "outcome", "signal", "trend", "recurrence"), "seq").alias("s"))
    return last.select("code", "dims", "s.*")


_TURNS = "SELECT o_custkey AS item_id, o_orderkey AS turn, CASE WHEN o_orderkey % 3 = 0 THEN 'DISCARD' ELSE 'REINJECT' END AS action, o_orderkey % 5 = 1 AS conforming, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'duplicado' END AS reason FROM {orders}"


@query("ST6_quarantine_items", f"""
WITH a AS (SELECT *, CASE WHEN action = 'REINJECT' AND conforming THEN 'Reinyectado' WHEN action = 'DISCARD' AND trim(reason) <> '' THEN 'Descartado' END AS ends, action = 'REINJECT' OR trim(reason) <> '' AS moves FROM ({_TURNS.format(orders='orders')})),
f AS (SELECT item_id, min(turn) FILTER (ends IS NOT NULL) AS stop FROM a GROUP BY item_id)
SELECT a.item_id, coalesce(max(ends) FILTER (turn = stop), 'Pendiente') AS state, CAST(count(*) FILTER (moves AND (stop IS NULL OR turn <= stop)) AS INT) AS moves FROM a JOIN f ON f.item_id = a.item_id GROUP BY a.item_id""")
def _items(spark, d):
    x = spark.sql(_TURNS, orders=table(spark, d, "orders"))
    out = work_dir(spark, "items")

    def batch(df, n):
        df.withColumn("seq", F.lit(n)).write.mode("append").parquet(out)

    _run_in_order(spark, x, "turn", "turns", lambda stream: jobs.quarantine_items(stream).writeStream.outputMode("update").foreachBatch(batch))
    last = spark.read.parquet(out).groupBy("item_id").agg(F.max_by(F.struct("state", "moves"), "seq").alias("s"))
    return last.select("item_id", "s.*")


@query("ST7_stale_timers", """
WITH l AS (SELECT user_id AS run_id, max(ts) AS last FROM events GROUP BY user_id), s AS (SELECT run_id, last, coalesce((SELECT bool_or(event_type = 'click') FROM events e WHERE e.user_id = run_id AND e.ts = last), false) AS ended FROM l)
SELECT run_id, epoch_us(last) AS last_us FROM s WHERE NOT ended AND last + INTERVAL 720 MINUTE < (SELECT max(ts) FROM events)""")
def _stale(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "click", "DONE").otherwise("IN_PROGRESS").alias("state"), F.col("ts").cast("timestamp").alias("at"))
    out = work_dir(spark, "stale")

    def batch(df, n):
        df.withColumn("seq", F.lit(n)).write.mode("append").parquet(out)

    _run_in_order(spark, x.withColumn("us", F.unix_micros("at")), "us", "beats", lambda stream: jobs.stale_timers(stream.drop("us"), 720).writeStream.outputMode("update").foreachBatch(batch))
    # a run that was heard of again after its timer is no longer stale
    newest = x.groupBy("run_id").agg(F.max("at").alias("newest"))
    told = spark.read.schema("run_id long, last timestamp, seq int").parquet(out).groupBy("run_id").agg(F.max("last").alias("last"))
    return told.join(newest, "run_id").where("last = newest").select("run_id", F.unix_micros("last").alias("last_us"))


@query("ST8_event_log", "SELECT event_type, user_id, count(DISTINCT ts) AS n FROM events GROUP BY ALL")
def _log(spark, d):
    x = table(spark, d, "events").select("event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = work_dir(spark, "log")
    for _ in range(2):  # delivered twice
        jobs.event_log(_stream(spark, x, "events"), out, work_dir(spark, "mark"), ["event_type", "user_id", "ts"], "ts").awaitTermination()
    return spark.read.parquet(out).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
