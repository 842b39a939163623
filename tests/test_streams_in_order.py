"""Streams over tables of many files, and heartbeats that come late."""

from datetime import datetime

from pyspark.sql import functions as F

from casemill.plans import streaming_queries
from casemill.streaming import jobs


def test_parts_are_batches_however_many_files(spark):
    """Files of one part come together, and parts one after another."""
    seen = []

    def batch(df, n):
        if (r := df.agg(F.count("*"), F.min("turn"), F.max("turn")).first())[0]:
            seen.append(tuple(r))

    x = spark.range(3000).select(((F.col("id") * 7) % 3000).alias("turn")).repartition(11)
    streaming_queries._run_in_order(spark, x, "turn", "ordered", lambda stream: stream.writeStream.foreachBatch(batch))
    assert len(seen) == 3 and sum(n for n, _, _ in seen) == 3000
    assert seen[0][2] < seen[1][1] and seen[1][2] < seen[2][1]


def test_late_heartbeats_count(spark, tmp_path):
    """The second file is older than the first one's newest time: its runs are watched all the same, and an old end stops no newer heartbeat."""
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = lambda h: datetime(2024, 1, 1, h)
    for rows in ([(1, "IN_PROGRESS", t(20)), (5, "IN_PROGRESS", t(10)), (6, "DONE", t(9))], [(2, "IN_PROGRESS", t(2)), (3, "IN_PROGRESS", t(19)), (4, "DONE", t(3)), (5, "DONE", t(4)), (6, "IN_PROGRESS", t(8)), (7, "IN_PROGRESS", t(5)), (7, "DONE", t(5))]):
        spark.createDataFrame(rows, "run_id long, state string, at timestamp").coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema("run_id long, state string, at timestamp").option("maxFilesPerTrigger", 1).parquet(at)
    each = lambda df, _: df.write.mode("append").parquet(out)
    jobs.stale_timers(stream, 180).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.run_id, r.last.hour) for r in spark.read.schema("run_id long, last timestamp").parquet(out).collect()) == [(2, 2), (5, 10)]


def test_landed_files_stay_under_the_limits(spark, monkeypatch):
    """The daily run's files are cut before a table is refused for its size, and many files give the rows of few."""
    from casemill.plans import landing_queries, registry
    from tests.oracle import duck_rows, spark_rows

    monkeypatch.setattr(landing_queries, "FILE_ROWS", 200)
    at = "/root/testdata/sf0.001"
    root = landing_queries._two_days(spark, at)
    n = [r[0] for r in spark.read.text(f"{root}/*/", wholetext=False).groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(n) > 10 and max(n) <= 201
    assert spark_rows(spark, registry.QUERIES["R32_daily_run"], at) == duck_rows(registry.SQL["R32_daily_run"], at)
