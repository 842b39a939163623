"""Scalar rules and small reports: queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import calendar, ids, scalars
from casemill.operators import access, documents, indicators, observations
from casemill.plans.fixtures import table, view, with_views
from casemill.plans.registry import query
from casemill.sources import landing

def _k():
    return F.col("o_orderkey")


def _orders(spark, d):
    return table(spark, d, "orders")


_BLANKS = "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(9) || chr(10) WHEN 2 THEN ' x ' ELSE CAST(o_custkey AS VARCHAR(20)) END"


@query("P01_absent_values", f"SELECT o_orderkey, v IS NULL OR regexp_full_match(v, '\\s*') AS absent FROM (SELECT o_orderkey, {_BLANKS} AS v FROM orders)")
def _absent(spark, d):
    return _orders(spark, d).select("o_orderkey", scalars.is_absent(F.expr(_BLANKS)).alias("absent"))


_LEVELS = "CASE o_orderkey % 4 WHEN 0 THEN ' alto' || chr(9) WHEN 1 THEN 'ALTO' WHEN 2 THEN lower(substr(o_orderpriority, 3)) ELSE 'medio' END"


@query("F03_catalog_membership", f"SELECT o_orderkey, regexp_replace({_LEVELS}, '^\\s+|\\s+$', '', 'g') IN ('alto', 'medio', 'bajo') AS inside FROM orders")
def _catalog(spark, d):
    return _orders(spark, d).select("o_orderkey", scalars.in_catalog(F.expr(_LEVELS), scalars.SEVERITIES).alias("inside"))


@query("F04_month_arithmetic", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS a, last_day(CAST(o_orderdate AS DATE)) AS b, CAST(date_trunc('month', o_orderdate) - INTERVAL 5 MONTH AS DATE) AS c FROM orders")
def _months(spark, d):
    day = F.to_date("o_orderdate")
    return _orders(spark, d).select("o_orderkey", calendar.month_start(day).alias("a"), calendar.month_end(day).alias("b"), calendar.shift_month(day, -5).alias("c"))


@query("F05_utc_days", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def _days(spark, d):
    return table(spark, d, "events").select("event_id", calendar.utc_date(F.col("ts")).alias("day"))


@query("F06_period_bounds", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN DATE '2024-01-10' WHEN 1 THEN DATE '2024-06-01' WHEN 2 THEN CAST(date_trunc('month', o_orderdate) - INTERVAL 2 MONTH AS DATE) WHEN 3 THEN CAST(date_trunc('month', o_orderdate) - INTERVAL 5 MONTH AS DATE) ELSE CAST(date_trunc('month', o_orderdate) - INTERVAL 11 MONTH AS DATE) END AS a,
 CASE o_orderkey % 5 WHEN 0 THEN DATE '2024-02-20' WHEN 1 THEN DATE '2024-06-30' ELSE last_day(CAST(o_orderdate AS DATE)) END AS b FROM orders""")
def _bounds(spark, d):
    names = ["custom", "current_month", "last_3_months", "last_6_months", "last_12_months"]
    x = _orders(spark, d).select("o_orderkey", F.element_at(F.array(*[F.lit(n) for n in names]), (_k() % 5 + 1).cast("int")).alias("period"), F.lit("2024-01-10").cast("date").alias("period_start"), F.lit("2024-02-20").cast("date").alias("period_end"), F.to_date("o_orderdate").alias("reference"), F.lit("2024-06-17").cast("date").alias("today"))
    return calendar.period_bounds(x).select("o_orderkey", "a", "b")


@query("F08_canonical_json", "SELECT o_orderkey, '{\"area\":\"' || o_orderstatus || '\",\"nivel\":\"é\",\"tipo\":\"' || o_custkey || '\"}' AS dims FROM orders")
def _json(spark, d):
    m = F.create_map(F.lit("tipo"), F.col("o_custkey").cast("string"), F.lit("area"), F.col("o_orderstatus"), F.lit("nivel"), F.lit("é"))
    return _orders(spark, d).select("o_orderkey", ids.canonical_json(m).alias("dims"))


@query("F09_payload_hash", """SELECT o_orderkey, sha256('{"amount":["' || rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') || '"],"day":["' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '"],"note":[null]}') AS h FROM orders""")
def _payload(spark, d):
    amount = ids.canonical_decimal(F.col("o_totalprice").cast("decimal(18,2)"))
    return _orders(spark, d).select("o_orderkey", ids.payload_hash(note=F.lit(None).cast("string"), amount=amount, day=F.to_date("o_orderdate")).alias("h"))


@query("F12_text_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def _text(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.text_sha256(F.col("text")).alias("h"))


@query("F18_reciprocal_rank", "SELECT l_orderkey, l_linenumber, l_partkey, round(1.0 / (60 + l_linenumber) + CASE WHEN l_quantity > 10 THEN 0 ELSE 1.0 / (60 + l_quantity) END, 9) AS rrf FROM lineitem")
def _rrf(spark, d):
    second = F.when(F.col("l_quantity") <= 10, F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(scalars.reciprocal_rank(F.col("l_linenumber"), second), 9).alias("rrf"))


@query("F20_variation", "SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN round((o_orderkey - o_custkey % 10) / CAST(o_custkey % 10 AS DOUBLE) * 100, 6) END AS percent FROM orders")
def _variation(spark, d):
    return _orders(spark, d).select("o_orderkey", F.round(scalars.variation_percent(_k(), F.col("o_custkey") % 10), 6).alias("percent"))


@query("F25_severity", with_views("SELECT observation_id, CASE WHEN dims LIKE '%alto%' THEN 'alto' WHEN dims LIKE '%medio%' THEN 'medio' WHEN dims LIKE '%bajo%' THEN 'bajo' END AS severity FROM observations", "observations"))
def _severity(spark, d):
    return view(spark, d, "observations").select("observation_id", scalars.severity(F.col("dims")).alias("severity"))


_ACTORS = "SELECT event_id, CASE WHEN event_type = 'click' THEN user_id END AS account, CASE event_id % 3 WHEN 0 THEN 'nightly' WHEN 1 THEN ' ' END AS process FROM {events}"


@query("F33_actor_types", f"SELECT event_id, CASE WHEN account IS NOT NULL THEN 'HUMAN' WHEN trim(coalesce(process, '')) <> '' THEN 'PROCESS' ELSE 'ANONYMOUS' END AS actor FROM ({_ACTORS.format(events='events')})")
def _actors(spark, d):
    return spark.sql(_ACTORS, events=table(spark, d, "events")).select("event_id", scalars.actor_type(F.col("account"), F.col("process")).alias("actor"))


@query("A14_ocr_states", with_views("SELECT run_id, CASE WHEN confidence IS NULL THEN 'Pendiente' WHEN confidence >= 0.8 THEN 'Exitoso' ELSE 'Baja_confianza' END AS state FROM ocr_runs", "ocr_runs"))
def _states(spark, d):
    return view(spark, d, "ocr_runs").select("run_id", scalars.ocr_state(F.col("confidence")).alias("state"))


@query("P17_reprocess_eligible", with_views("SELECT run_id FROM ocr_runs WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 AND (confidence IS NULL OR confidence < 0.8)", "ocr_runs"))
def _eligible(spark, d):
    yes, no = F.lit(True), F.lit(False)
    x = view(spark, d, "ocr_runs").select("run_id", (F.col("doc_id") % 2 == 0).alias("verified"), no.alias("invalidated"), yes.alias("completed"), yes.alias("accepted"), (F.col("doc_id") % 3 == 0).alias("quarantined"), yes.alias("needs_ocr"), F.lit("LISTA").alias("state"), scalars.ocr_state(F.col("confidence")).alias("ocr_state"))
    return documents.reprocess_eligible(x).select("run_id")


@query("P20_valid_requests", with_views("SELECT period_start, month(period_start) % 3 = 0 AS valid FROM requests", "requests"))
def _requests(spark, d):
    m = F.month("period_start") % 3
    x = view(spark, d, "requests").withColumn("codes", F.when(m == 1, F.array(F.lit("KPI-XX-99"))).otherwise(F.array(F.lit("KPI-LI-05")))).withColumn("as_of", F.when(m == 2, F.date_add("period_end", 1)).otherwise(F.col("period_start")))
    return indicators.valid_request(x).select("period_start", "valid")


@query("P11_overlapping_runs", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) + 30 >= DATE '1997-03-01' AND CAST(o_orderdate AS DATE) <= DATE '1997-04-30'")
def _runs(spark, d):
    x = _orders(spark, d).select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED").alias("state"), F.to_date("o_orderdate").alias("window_start"), F.date_add(F.to_date("o_orderdate"), 30).alias("window_end"))
    return observations.list_runs(x, "1997-03-01", "1997-04-30").select("o_orderkey")


@query("J18_effective_permissions", "SELECT DISTINCT o_custkey AS principal, 'p' || (l_linenumber % 3) AS permission FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def _permissions(spark, d):
    o = _orders(spark, d)
    users = o.select(F.col("o_custkey").alias("principal"), _k().alias("role"))
    perms = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("role"), F.concat(F.lit("p"), F.col("l_linenumber") % 3).alias("permission"))
    return access.effective_permissions(users, o.select(_k().alias("role"), (F.col("o_orderstatus") != "P").alias("active")), perms)


def _receipts(spark, d):
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("in/"), F.col("user_id")).alias("locator"), F.sha2(F.concat_ws("/", "user_id", "event_type"), 256).alias("content_sha256"), F.col("event_type").alias("actor"), F.lit(None).cast("string").alias("idempotency_key"), F.col("event_id").alias("turn"))


@query("S07_receipts", "SELECT event_id AS turn, CASE WHEN event_type = 'error' OR row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 THEN 'REPLAYED' ELSE 'NEW' END AS outcome FROM events")
def _dedupe(spark, d):
    x = _receipts(spark, d)
    return landing.dedupe_receipts(x, x.where("actor = 'error'")).select("turn", "outcome")


@query("S08_revisions", "SELECT event_id AS turn, user_id % 7 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision FROM events")
def _revisions(spark, d):
    x = _receipts(spark, d)
    old = table(spark, d, "events").select(F.concat(F.lit("in/"), F.col("user_id")).alias("locator"), (F.col("user_id") % 7).alias("revision")).distinct()
    return landing.next_revision(x, old).select("turn", "revision")


_ARRIVED = "SELECT event_id, CASE WHEN event_type = 'error' THEN 'CUARENTENA' ELSE 'COMPLETADO' END AS state, CASE user_id % 5 WHEN 0 THEN 'CSV' WHEN 1 THEN 'PDF' WHEN 2 THEN 'XLSX' WHEN 3 THEN 'DOCX' END AS detected_format FROM {events}"


@query("S09_routing", f"SELECT event_id, CASE WHEN state = 'COMPLETADO' AND detected_format IN ('CSV', 'XLSX') THEN 'VALIDATION' WHEN state = 'COMPLETADO' AND detected_format IN ('PDF', 'DOCX') THEN 'DOCUMENT' ELSE 'NONE' END AS target FROM ({_ARRIVED.format(events='events')})")
def _route(spark, d):
    return landing.route_receipts(spark.sql(_ARRIVED, events=table(spark, d, "events"))).select("event_id", "target")


@query("W10_renumber", "SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_linenumber END NULLS LAST, l_orderkey, l_partkey, l_quantity, l_extendedprice) AS position FROM lineitem")
def _renumber(spark, d):
    row = F.when(F.col("l_linenumber") % 2 != 0, F.col("l_linenumber"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_suppkey").alias("file_id"), F.col("l_returnflag").alias("sheet"), row.alias("row"), F.struct("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").alias("record_id"))
    return landing.renumber(x).select("l_orderkey", "l_partkey", "l_suppkey", "position")
