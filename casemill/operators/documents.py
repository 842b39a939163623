"""Document tables: versions, OCR results, consolidated text, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions.scalars import LOW_CONFIDENCE, is_absent, ocr_state
from casemill.operators.observations import latest_per_key


def candidates_from_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, state, text): the pages' native text joined by blank lines; PENDING_OCR if any page is blank. pages: doc_id, page, native_text."""
    rows = F.array_sort(F.collect_list(F.struct("page", F.coalesce("native_text", F.lit("")).alias("t"))))
    x = pages.groupBy("doc_id").agg(F.max(is_absent(F.col("native_text"))).alias("ocr"), F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("text"))
    return x.select("doc_id", F.when(F.col("ocr"), "PENDING_OCR").otherwise("READY").alias("state"), "text")


def consolidate(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc_id, text, pages): native and sufficiently sure OCR text in page order, with each kept page's span.

    pages: doc_id, page, native_text, requires_ocr.  ocr: doc_id, page, ocr_text, confidence.  A page that
    needs OCR counts only with a confidence of 0.80 or more; empty pages do not count.
    """
    x = pages.join(ocr, ["doc_id", "page"], "left")
    text = F.when(~F.col("requires_ocr"), F.col("native_text")).when(F.col("confidence") >= LOW_CONFIDENCE, F.col("ocr_text"))
    x = x.select("doc_id", "page", text.alias("t")).where(F.length("t") > 0)
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("start", F.coalesce(F.sum(F.length("t") + 2).over(before), F.lit(0)))
    rows = F.array_sort(F.collect_list(F.struct("page", "start", (F.col("start") + F.length("t")).alias("end"), "t")))
    out = x.groupBy("doc_id").agg(rows.alias("r"))
    return out.select("doc_id", F.array_join(F.transform("r", lambda r: r["t"]), "\n\n").alias("text"), F.transform("r", lambda r: F.named_struct(F.lit("page"), r["page"], F.lit("start"), r["start"], F.lit("end"), r["end"])).alias("pages"))


def assign_versions(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """new documents' versions, counted on from the highest known one of each document."""
    top = existing.groupBy("doc_id").agg(F.max("version").alias("top"))
    by = Window.partitionBy("doc_id").orderBy(order)
    return new.join(top, "doc_id", "left").withColumn("version", F.coalesce("top", F.lit(0)) + F.row_number().over(by)).drop("top")


def latest_ocr(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Versions with their latest run's confidence and state; without a run the state is pending."""
    last = latest_per_key(runs, ["version_id"], F.desc("attempt"), F.desc("run_id")).select("version_id", "run_id", "confidence")
    return versions.join(last, "version_id", "left").withColumn("state", ocr_state(F.col("confidence")))


def load_candidates(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates (doc_id, state, text) with their pages (page, native_text, requires_ocr) in order; an empty list without any."""
    own = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "native_text", "requires_ocr"))).alias("pages"))
    none = F.array().cast("array<struct<page:int,native_text:string,requires_ocr:boolean>>")
    return candidates.join(own, "doc_id", "left").withColumn("pages", F.coalesce("pages", none))


def ocr_results(versions: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Versions (version_id, operation_id …) with their latest run's state, pending without one, and the recalculation jobs (job_id, state) of the same operation."""
    last = latest_per_key(runs, ["version_id"], F.desc("processed_at"), F.desc("run_id")).select("version_id", ocr_state(F.col("confidence")).alias("ocr_state"))
    own = jobs.where("case_type = 'KPI_RECALCULATION'").select("operation_id", F.col("job_id").alias("kpi_job_id"), F.col("state").alias("kpi_job_state"))
    return versions.join(last, "version_id", "left").join(own, "operation_id", "left").withColumn("ocr_state", F.coalesce("ocr_state", F.lit("Pendiente")))


def ocr_confidence(samples: DataFrame) -> DataFrame:
    """(run_id, confidence): the mean of the samples between 0 and 1; null without any."""
    return samples.groupBy("run_id").agg(F.avg(F.when(F.col("sample").between(0, 1), F.col("sample"))).alias("confidence"))


def reprocess_eligible(rows: DataFrame) -> DataFrame:
    """Rows that may be read again: verified, valid, completed, accepted, not quarantined, in need of OCR, not failed, and not yet successful."""
    ok = F.col("verified") & ~F.col("invalidated") & F.col("completed") & F.col("accepted") & ~F.col("quarantined") & F.col("needs_ocr") & (F.col("state") != "FALLIDA") & F.coalesce(F.col("ocr_state") != "Exitoso", F.lit(True))
    return rows.where(ok)


def document_outcome(rows: DataFrame) -> DataFrame:
    """rows (confidence, text, certified) with outcome: refused, in process, or ready."""
    low = F.coalesce(F.col("confidence") < LOW_CONFIDENCE, F.lit(False)) | is_absent(F.col("text"))
    return rows.withColumn("outcome", F.when(low, "RECHAZADA").when(F.col("certified"), "LISTA").otherwise("PROCESANDO"))


def activate_versions(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """docs (doc_id, active) with the candidate's version where it is ready and the active one is still the one it saw. candidates: doc_id, version, seen, ready."""
    x = docs.join(candidates.select("doc_id", "version", "seen", "ready"), "doc_id", "left")
    ok = F.coalesce(F.col("ready") & F.col("active").eqNullSafe(F.col("seen")), F.lit(False))
    return x.select("doc_id", F.when(ok, F.col("version")).otherwise(F.col("active")).alias("active"), F.when(F.col("version").isNull(), "NONE").when(ok, "ACTIVATED").otherwise("REFUSED").alias("outcome"))


def register_documents(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new (doc_id, name, type, family, date) with outcome: NEW, SAME, or INCOMPATIBLE with what is registered."""
    old = existing.select("doc_id", *[F.col(c).alias(f"old_{c}") for c in ("name", "type", "family", "date")], F.lit(True).alias("there"))
    x = new.join(old, "doc_id", "left")
    same = F.lit(True)
    for c in ("name", "type", "family", "date"):
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return x.select(*new.columns, F.when(F.col("there").isNull(), "NEW").when(same, "SAME").otherwise("INCOMPATIBLE").alias("outcome"))


def match_operations(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new (operation_id, user, session, query_hash, reference) with outcome NEW, REPLAY or CONFLICT."""
    cols = ["user", "session", "query_hash", "reference"]
    old = existing.select("operation_id", *[F.col(c).alias(f"old_{c}") for c in cols], F.lit(True).alias("there"))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return new.join(old, "operation_id", "left").select(*new.columns, F.when(F.col("there").isNull(), "NEW").when(same, "REPLAY").otherwise("CONFLICT").alias("outcome"))
