"""Composed reports: analysis pages, operation outcomes, active chunks, OCR operations, audit pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.operators.audit import EVENTS, audit_events, with_resources
from casemill.operators.documents import latest_ocr
from casemill.operators.observations import latest_per_key
from casemill.operators.quarantine import keyset_page
from casemill.functions.ids import uuid5


def citation_complete(doc_id: Column, name: Column, kind: Column, date: Column, fragment: Column) -> Column:
    return doc_id.isNotNull() & name.isNotNull() & kind.isNotNull() & date.isNotNull() & fragment.isNotNull()


def repeated_series(observations: DataFrame) -> DataFrame:
    """(code, dims, period_start, n) of months with more than one observation of a series; none may be."""
    return observations.groupBy("code", "dims", "period_start").agg(F.count("*").alias("n")).where("n > 1")


def valid_rules_reference(reference: Column, rules: list[str]) -> Column:
    """A run's reference is of the contract: its tag, a 64-digit digest, two UUIDs, and the sorted rules."""
    uuid = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    at = lambda k: F.get_json_object(reference, f"$.{k}")
    listed = F.from_json(at("signal_rules"), "array<string>")
    ok = (at("contract") == "PROACTIVE_ANALYSIS_V1") & at("input_fingerprint_sha256").rlike("^[0-9a-f]{64}$") & at("parent_job_run_id").rlike(uuid) & at("parent_operation_id").rlike(uuid) & (listed == F.array(*[F.lit(r) for r in sorted(rules)]))
    return F.coalesce(ok, F.lit(False))


def latest_run(runs: DataFrame) -> DataFrame:
    """The completed run that ended last."""
    return runs.where("state = 'COMPLETED'").orderBy(F.desc("completed_at"), F.desc("run_id")).limit(1)


def analysis_page(runs: DataFrame, findings: DataFrame, start: str, end: str, code: str | None = None) -> DataFrame:
    """Findings (run_id …) of completed runs that overlap the range, with an indicator filter."""
    own = runs.where((F.col("state") == "COMPLETED") & (F.col("window_end") >= F.lit(start).cast("date")) & (F.col("window_start") <= F.lit(end).cast("date"))).select("run_id")
    x = findings.join(own, "run_id", "left_semi")
    return x.where(F.col("code") == code) if code else x


def technical_kpi(observations: DataFrame, code: str, start: str, end: str) -> DataFrame:
    """One row: the indicator's newest observation of the range, or NO_DISPONIBLE without any."""
    x = observations.where((F.col("code") == code) & F.col("period_start").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    one = latest_per_key(x, ["code"], F.desc("period_start"), F.desc("observation_id")).select("code", "period_start", "value", "availability")
    base = observations.sparkSession.createDataFrame([(code,)], "code string")
    return base.join(one, "code", "left").withColumn("availability", F.coalesce("availability", F.lit("NO_DISPONIBLE")))


def exposure_traces(rows: DataFrame) -> DataFrame:
    """(context, ambiguous): contexts (a column) that have several partitions in one month."""
    n = rows.groupBy("context", "period_start").agg(F.count("*").alias("n"))
    return n.groupBy("context").agg(F.max(F.col("n") > 1).alias("ambiguous"))


def operation_outcome(df: DataFrame) -> DataFrame:
    """df (evidence, authorized, failure) with operation, generation and action: denied before all else, then failures, then what the evidence allows."""
    denied, failed, unknown, enough = ~F.col("authorized"), F.col("failure").isNotNull(), F.col("evidence").isNull(), F.col("evidence") == "EVIDENCIA_SUFICIENTE"
    return (
        df.withColumn("operation", F.when(denied, "COMPLETED").when(unknown | failed, "FAILED").otherwise("COMPLETED"))
        .withColumn("generation", F.when(denied | unknown, "NOT_REQUESTED").when(failed, "FAILED").when(enough, "SUCCEEDED").otherwise("NOT_REQUESTED"))
        .withColumn("action", F.when(denied, "AUTHORIZATION_DENIED").otherwise("RAG_QUERY"))
        .withColumn("audit", F.when(denied, "DENIED").when(unknown | failed, "FAILURE").otherwise("SUCCESS"))
    )


def rag_audit_events(operations: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, violations): one event per operation, its id from the operation's, with the fragments as resources; violations are actions that do not fit their result."""
    own = fragments.groupBy("operation_id").agg(F.array_join(F.array_sort(F.collect_list("fragment_id")), ",").alias("resources"))
    ev = operations.join(own, "operation_id", "left").select(uuid5(EVENTS, F.col("operation_id").cast("string")).alias("event_id"), "operation_id", "action", "audit", F.coalesce("resources", F.lit("")).alias("resources"))
    bad = ev.where((F.col("action") == "AUTHORIZATION_DENIED") != (F.col("audit") == "DENIED"))
    return ev, bad


def active_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks (doc_id, version …) of the active version of ready, valid documents."""
    live = docs.where("state = 'LISTA' and not invalidated").select("doc_id", F.col("active").alias("version"))
    return chunks.join(live, ["doc_id", "version"])


def active_chunk_count(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return active_chunks(chunks, docs).groupBy("doc_id").agg(F.count("*").alias("chunks"))


def ocr_operations(docs: DataFrame, versions: DataFrame, runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Versions with their document's family, latest run and state, and whether any page needs OCR."""
    flags = pages.groupBy("doc_id").agg(F.max("requires_ocr").alias("needs_ocr"))
    return latest_ocr(versions, runs).join(docs.select("doc_id", "family"), "doc_id", "left").join(flags, "doc_id", "left").withColumn("needs_ocr", F.coalesce("needs_ocr", F.lit(False)))


def audit_page(events: DataFrame, resources: DataFrame, after: tuple | None, limit: int, **filters) -> DataFrame:
    """A page of filtered events, newest first, with their resources; resources are joined to the page alone."""
    return with_resources(keyset_page(audit_events(events, **filters), ["occurred_at", "event_id"], after, limit, descending=True), resources)


def load_records(source: DataFrame) -> DataFrame:
    """Records of files (file_id, sheet, row_number, payload) with their width and their place in the file's order, by sheet and row."""
    by = Window.partitionBy("file_id").orderBy("sheet", "row_number")
    return source.withColumn("width", F.size(F.map_keys("payload"))).withColumn("place", F.row_number().over(by))
