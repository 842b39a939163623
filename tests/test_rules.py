"""Rules that the tables' queries do not reach: empty sides, indented headings, broken quotes, interrupted updates."""

import datetime

import pytest

from casemill.functions import scalars
from casemill.operators import audit, corpus, proactive, projection, retrieval
from casemill.sources import landing
from casemill.streaming import jobs


def test_no_last_run_means_a_run(spark):
    one = spark.createDataFrame([("h",)], "fingerprint string")
    last = spark.createDataFrame([("h",)], "last string")
    decide = lambda a, b: [r.decision for r in proactive.needs_run(a, b).collect()]
    assert decide(one, last.where("1 = 0")) == ["RUN"]
    assert decide(one, last) == ["NO_RELEVANT_WORK"]
    assert decide(one.where("1 = 0").selectExpr("max(fingerprint) as fingerprint"), last) == ["NO_RELEVANT_WORK"]


def test_indented_headings_end_chunks():
    text = " ".join(f"w{i}" for i in range(60)) + "\n   Sección uno " + " ".join(f"v{i}" for i in range(60))
    assert corpus.structural_bounds(text, corpus.token_offsets(text), 100, 10)[0] == (0, 60)
    flat = text.replace("\n   Sección", " Sección")
    assert corpus.structural_bounds(flat, corpus.token_offsets(flat), 100, 10)[0] == (0, 100)
    plural = text.replace("Sección", "Secciones")
    assert corpus.structural_bounds(plural, corpus.token_offsets(plural), 100, 10)[0] == (0, 100)


def test_causes_have_texts(spark):
    rows = spark.createDataFrame([(c,) for c in [*scalars.CAUSES, "UNKNOWN"]], "cause string")
    got = {r.cause: r.d for r in rows.select("cause", scalars.cause_description(rows.cause).alias("d")).collect()}
    assert len(scalars.CAUSES) == 25 and got.pop("UNKNOWN") == scalars.CAUSES["OTHER_CAUSE"] and got == scalars.CAUSES


def test_broken_quotes_are_refused(spark):
    files = [("a", b'x,y\n1,"2\n3,4\n'), ("b", b'x,y\n1,"2"\n'), ("c", b"x,y\n" + b"1,2\n" * 30_000 + b'3,"4\n')]
    df = spark.createDataFrame(files, "file_id string, content binary")
    got = {r.file_id: (r.delimiter, r.cause) for r in landing.infer_delimiter(df).collect()}
    assert got == {"a": (None, "UNDETERMINABLE_STRUCTURE"), "b": (",", None), "c": (None, "UNDETERMINABLE_STRUCTURE")}
    assert landing.read_delimited(df.join(landing.infer_delimiter(df).where("delimiter is not null"), "file_id")).count() == 2


def test_first_writer(spark):
    rows = [(1, "E", "x", "p"), (2, "E", "x", "q"), (3, "E", "x", "p"), (1, "E", "x", "p"), (4, "E", "y", "p")]
    t = spark.createDataFrame(rows, "record_id int, entity_type string, business_id string, payload_sha256 string").selectExpr("*", "record_id as turn")
    none = t.select("entity_type", "business_id", "payload_sha256").where("1 = 0")
    got = projection.apply_targets(t, none, t.selectExpr("record_id", "entity_type", "business_id", "payload_sha256", "'' as result").where("1 = 0"))
    assert sorted((r.record_id, r.result) for r in got.collect()) == [(1, "IDEMPOTENTE"), (1, "INCORPORADO"), (2, "CONFLICTO"), (3, "IDEMPOTENTE"), (4, "INCORPORADO")]


def test_ledger(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [(1, 1, "STARTED", "a", day(1)), (1, 2, "COMPLETED", "b", day(3)), (2, 1, "STARTED", None, day(2))]
    got = sorted(tuple(r) for r in audit.job_ledger(spark.createDataFrame(rows, "job_id int, seq int, state string, refs string, at timestamp")).select("job_id", "state", "refs", "created_at", "completed_at", "entries").collect())
    assert got == [(1, "COMPLETED", "b", day(1), day(3), 2), (2, "STARTED", None, day(2), None, 1)]


def test_vectors_that_cannot_be_compared(spark):
    rows = [(1, [1.0, 0.0], ["a"]), (2, [0.0, 0.0], ["a"]), (3, None, ["a"]), (4, [1.0, 1.0, 1.0], ["a"]), (5, [1.0, None], ["a"]), (6, [0.0, 2.0], ["a", "b"]), (7, [float("nan"), 1.0], ["b"])]
    df = spark.createDataFrame(rows, "fragment_id long, embedding array<double>, scopes array<string>")
    q = spark.createDataFrame([(1, [2.0, 0.0], "a"), (2, [1.0, 1.0], "b"), (3, None, "a"), (4, [0.0, 0.0], "a"), (5, [1.0, 0.0], "c")], "query_id long, embedding array<double>, scope string")
    got = sorted((r.query_id, r.fragment_id, r["rank"]) for r in retrieval.vector_topk(q, df).collect())
    assert got == [(1, 1, 1), (1, 6, 2), (2, 6, 1)]
    plain = sorted((r.query_id, r.fragment_id, r["rank"]) for r in retrieval.vector_topk(q.drop("scope"), df.drop("scopes"), 1).collect())
    assert plain == [(1, 1, 1), (2, 1, 1), (5, 1, 1)]


@pytest.mark.parametrize("minutes", [30])
def test_timers(spark, tmp_path, minutes):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    layout = "run_id long, state string, at timestamp"
    for rows in ([(1, "IN_PROGRESS", t(1)), (2, "IN_PROGRESS", t(1)), (3, "IN_PROGRESS", t(1))], [(1, "IN_PROGRESS", t(1, 20)), (2, "DONE", t(1, 10))], [(4, "IN_PROGRESS", t(1, 45))], [(4, "IN_PROGRESS", t(1, 50))]):
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(at)
    each = lambda df, _: df.write.mode("append").parquet(out)
    jobs.stale_timers(stream, minutes).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.read.schema("run_id long, last timestamp").parquet(out).collect())) == [(3, t(1))]
