"""Dashboards, document tables, audit and ledgers: queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions.ids import text_sha256
from casemill.operators import audit, dashboard, documents, quarantine, rules
from casemill.operators.parts import dealt
from casemill.plans.fixtures import table, view, with_views
from casemill.plans.registry import query

_r = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
_OBS = lambda sql: with_views(sql, "observations")
_SEV = "regexp_extract(dims, '\"nivel_severidad\":\"(\\w+)\"', 1)"


def _obs(spark, d):
    return view(spark, d, "observations")


@query("P12_dashboard_filter", _OBS("SELECT observation_id FROM observations WHERE code IN ('KPI-RC-01', 'KPI-EO-01') OR code LIKE 'KPI-LI-%'"))
def _filter(spark, d):
    return dashboard.filter_dashboard(_obs(spark, d), "litigation", "x").select("observation_id")


@query("F07_reference_month", _OBS("SELECT max(period_start) AS reference FROM observations WHERE availability = 'DISPONIBLE' AND period_end < DATE '2000-06-15'"))
def _reference(spark, d):
    return dashboard.period_reference(_obs(spark, d), "2000-06-15")


@query("R11_kpi_page", _OBS("SELECT code, dims, period_start, round(CAST(value AS DOUBLE), 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY code, availability ORDER BY period_start DESC, observation_id DESC) AS n FROM observations WHERE period_start BETWEEN DATE '1998-01-01' AND DATE '1998-12-31') WHERE code <> 'KPI-RC-03' OR availability = 'DISPONIBLE' AND n = 1"))
def _page(spark, d):
    return dashboard.kpi_page(_obs(spark, d), "1998-01-01", "1998-12-31").select("code", "dims", "period_start", _r("value"))


@query("W13_latest_series", _OBS("SELECT code, dims, period_start, round(CAST(value AS DOUBLE), 6) AS value FROM observations QUALIFY row_number() OVER (PARTITION BY code, dims ORDER BY period_start DESC, observation_id DESC) = 1"))
def _latest(spark, d):
    return dashboard.latest_series(_obs(spark, d)).select("code", "dims", "period_start", _r("value"))


@query("A25_severity_composition", _OBS(f"WITH x AS (SELECT *, {_SEV} AS severity FROM observations WHERE code = 'KPI-CN-03' AND availability = 'DISPONIBLE'), t AS (SELECT severity, sum(value) AS total FROM x WHERE period_start = (SELECT max(period_start) FROM x) GROUP BY severity) SELECT severity, round(CAST(total AS DOUBLE), 6) AS total, round(CAST(total AS DOUBLE) / (SELECT CAST(sum(total) AS DOUBLE) FROM t) * 100, 6) AS percent FROM t"))
def _composition(spark, d):
    return dashboard.severity_composition(_obs(spark, d), "KPI-CN-03").select("severity", _r("total"), "percent")


@query("A26_exposure_by_month", _OBS(f"SELECT period_start, " + ", ".join(f"round(CAST(max(value) FILTER ({_SEV} = '{s}') AS DOUBLE), 6) AS {s}" for s in ("alto", "medio", "bajo")) + " FROM observations WHERE code = 'KPI-LI-01' GROUP BY period_start"))
def _evolution(spark, d):
    return dashboard.exposure_evolution(_obs(spark, d)).select("period_start", _r("alto"), _r("medio"), _r("bajo"))


@query("A27_exposure_total", _OBS(f"SELECT period_start, round(CAST(CASE WHEN count(*) = 3 AND count(DISTINCT {_SEV}) = 3 AND count(value) = 3 THEN sum(value) END AS DOUBLE), 4) AS total FROM observations WHERE code = 'KPI-LI-01' GROUP BY period_start"))
def _total(spark, d):
    return dashboard.litigation_exposure(_obs(spark, d)).select("period_start", F.round(F.col("total").cast("double"), 4).alias("total"))


@query("A28_executive_tiles", _OBS(f"""
WITH x AS (SELECT *, {_SEV} AS severity FROM observations o WHERE period_start = (SELECT max(period_start) FROM observations i WHERE i.code = o.code)),
g AS (SELECT code, count(*) AS n, count(value) AS v, count(DISTINCT nullif(severity, '')) AS d, sum(value) AS total FROM x GROUP BY code),
s AS (SELECT k.code, total, CASE WHEN n IS NULL THEN 'NO_OBSERVATION' WHEN v = 0 THEN 'NO_DISPONIBLE' WHEN k.code = 'KPI-CN-03' OR k.code = 'KPI-LI-01' AND NOT (n = 3 AND d = 3 AND v = 3) OR k.code <> 'KPI-LI-01' AND n <> 1 THEN 'DIMENSIONAL' WHEN total = 0 THEN 'ZERO' ELSE 'VALUE' END AS state
 FROM (VALUES ('KPI-RC-01'), ('KPI-RC-03'), ('KPI-LI-01'), ('KPI-LI-05'), ('KPI-CN-02'), ('KPI-CN-03'), ('KPI-EO-01')) k(code) LEFT JOIN g ON g.code = k.code)
SELECT code, state, round(CAST(CASE WHEN state IN ('ZERO', 'VALUE') THEN total END AS DOUBLE), 4) AS value FROM s"""))
def _tiles(spark, d):
    return dashboard.executive_tiles(_obs(spark, d)).select("code", "state", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("R14_chart_series", _OBS("SELECT dims, string_agg(strftime(period_start, '%Y-%m') || '=' || coalesce(CAST(CAST(value AS DECIMAL(20,2)) AS VARCHAR), ''), ';' ORDER BY period_start) AS points FROM observations WHERE code = 'KPI-CN-03' GROUP BY dims"))
def _series(spark, d):
    return dashboard.chart_series(_obs(spark, d), "KPI-CN-03")


_PAGES = "SELECT doc_id, CAST(k + 1 AS INT) AS page, CASE WHEN (doc_id + k) % 5 = 0 THEN ' ' ELSE substr(text, k * 1000 + 1, 1000) END AS native_text, (doc_id + k) % 5 = 0 AS requires_ocr, 'ocr ' || substr(text, k * 1000 + 1, 1000) AS ocr_text, CAST((doc_id * 7 + k * 13) % 101 AS DOUBLE) / 100 AS confidence FROM (SELECT doc_id, coalesce(text, '') AS text, {each} AS k FROM {documents}) x"
#: Every page of every text; one, without text, of an empty one.
_EACH_SPARK, _EACH_SQL = "explode(sequence(0, greatest(CAST(ceil(length(coalesce(text, '')) / 1000) AS INT) - 1, 0)))", "unnest(generate_series(0, greatest(CAST(ceil(length(coalesce(text, '')) / 1000.0) AS INT) - 1, 0)))"


def _pages(spark, d):
    return spark.sql(_PAGES.replace("{each}", _EACH_SPARK), documents=table(spark, d, "documents"))


_P = f"p AS ({_PAGES.format(documents='documents', each=_EACH_SQL)})"


@query("S12_page_candidates", f"WITH {_P} SELECT doc_id, CASE WHEN bool_or(trim(native_text) = '') THEN 'PENDING_OCR' ELSE 'READY' END AS state, sha256(string_agg(native_text, chr(10) || chr(10) ORDER BY page)) AS digest FROM p GROUP BY doc_id")
def _candidates(spark, d):
    return documents.candidates_from_pages(_pages(spark, d)).select("doc_id", "state", text_sha256(F.col("text")).alias("digest"))


@query("S13_load_candidates", f"WITH {_P}, c AS (SELECT doc_id, CASE WHEN bool_or(trim(native_text) = '') THEN 'PENDING_OCR' ELSE 'READY' END AS state FROM p GROUP BY doc_id) SELECT doc_id, state, count(*) AS n, sha256(string_agg(page || ':' || requires_ocr || ':' || native_text, chr(10) ORDER BY page)) AS digest FROM c JOIN p USING (doc_id) GROUP BY ALL")
def _loaded(spark, d):
    p = _pages(spark, d).select("doc_id", "page", "native_text", "requires_ocr")
    x = documents.load_candidates(documents.candidates_from_pages(p), p)
    shown = F.array_join(F.transform("pages", lambda r: F.concat(r["page"].cast("string"), F.lit(":"), r["requires_ocr"].cast("string"), F.lit(":"), r["native_text"])), "\n")
    return x.select("doc_id", "state", F.size("pages").cast("long").alias("n"), text_sha256(shown).alias("digest"))


@query("J19_ocr_results", with_views("""
SELECT v.version_id, CASE WHEN confidence IS NULL THEN 'Pendiente' WHEN confidence >= 0.8 THEN 'Exitoso' ELSE 'Baja_confianza' END AS ocr_state, j.event_id AS kpi_job_id, j.event_type AS kpi_job_state FROM versions v LEFT JOIN (SELECT * FROM ocr_runs QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY processed_at DESC, run_id DESC) = 1) r USING (version_id)
LEFT JOIN (SELECT * FROM events WHERE user_id % 2 = 0) j ON 'V-' || j.event_id || '-1' = v.version_id""", "versions", "ocr_runs"))
def _ocr_results(spark, d):
    jobs = table(spark, d, "events").select(F.concat(F.lit("V-"), F.col("event_id"), F.lit("-1")).alias("operation_id"), F.col("event_id").alias("job_id"), F.col("event_type").alias("state"), F.when(F.col("user_id") % 2 == 0, "KPI_RECALCULATION").otherwise("OCR").alias("case_type"))
    x = documents.ocr_results(view(spark, d, "versions").withColumn("operation_id", F.col("version_id")), view(spark, d, "ocr_runs"), jobs)
    return x.select("version_id", "ocr_state", "kpi_job_id", "kpi_job_state")


@query("R31_job_ledger", """
WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'STARTED' ELSE 'COMPLETED' END AS state, props AS refs, ts FROM events),
l AS (SELECT *, min(ts) OVER (PARTITION BY job_id) AS created, count(*) OVER (PARTITION BY job_id) AS entries FROM e QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1)
SELECT job_id, state, refs, epoch_us(created) AS created_us, CASE WHEN state <> 'STARTED' THEN epoch_us(ts) END AS completed_us, entries FROM l""")
def _ledger(spark, d):
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "STARTED").otherwise("COMPLETED")
    x = audit.job_ledger(e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), state.alias("state"), F.col("props").alias("refs"), F.col("ts").cast("timestamp").alias("at")))
    return x.select("job_id", "state", "refs", F.unix_micros("created_at").alias("created_us"), F.unix_micros("completed_at").alias("completed_us"), "entries")


@query("R16_consolidated_text", f"WITH {_P}, k AS (SELECT doc_id, page, CASE WHEN NOT requires_ocr THEN native_text WHEN confidence >= 0.8 THEN ocr_text END AS t FROM p), f AS (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM k WHERE length(t) > 0) SELECT doc_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY page)) AS digest, string_agg(page || ':' || CAST(a AS BIGINT) || ':' || CAST(a + length(t) AS BIGINT), ',' ORDER BY page) AS spans FROM f GROUP BY doc_id")
def _consolidated(spark, d):
    p = _pages(spark, d)
    x = documents.consolidate(p.select("doc_id", "page", "native_text", "requires_ocr"), p.select("doc_id", "page", "ocr_text", "confidence"))
    return x.select("doc_id", text_sha256(F.col("text")).alias("digest"), F.array_join(F.transform("pages", lambda s: F.concat_ws(":", s["page"].cast("string"), s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


@query("J06_latest_ocr", with_views("SELECT v.version_id, r.run_id, confidence, CASE WHEN confidence IS NULL THEN 'Pendiente' WHEN confidence >= 0.8 THEN 'Exitoso' ELSE 'Baja_confianza' END AS state FROM versions v LEFT JOIN (SELECT * FROM ocr_runs QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY attempt DESC, run_id DESC) = 1) r USING (version_id)", "versions", "ocr_runs"))
def _latest_ocr(spark, d):
    return documents.latest_ocr(view(spark, d, "versions"), view(spark, d, "ocr_runs")).select("version_id", "run_id", "confidence", "state")


@query("A13_ocr_confidence", "SELECT user_id AS run_id, round(avg(CASE WHEN value / 20 BETWEEN 0 AND 1 THEN value / 20 END), 6) AS confidence FROM events GROUP BY user_id")
def _confidence(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.col("value") / 20).alias("sample"))
    return documents.ocr_confidence(x).select("run_id", F.round("confidence", 6).alias("confidence"))


@query("W09_version_numbers", with_views("SELECT o_custkey AS doc_id, o_orderkey, coalesce(top, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders LEFT JOIN (SELECT doc_id, max(version) AS top FROM versions GROUP BY 1) t ON t.doc_id = o_custkey", "versions"))
def _numbers(spark, d):
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    return documents.assign_versions(new, view(spark, d, "versions"), "o_orderkey").select("doc_id", "o_orderkey", F.col("version").cast("long").alias("version"))


@query("R17_document_outcome", with_views("""
SELECT r.run_id, CASE WHEN coalesce(confidence < 0.8, false) OR trim(substr(text, 1, CAST(length(text) % 5 AS INT)), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'RECHAZADA' WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang IN ('en', 'es')) THEN 'LISTA' ELSE 'PROCESANDO' END AS outcome
FROM ocr_runs r JOIN versions v ON v.version_id = r.version_id""", "ocr_runs", "versions"))
def _outcome(spark, d):
    # a version is certified if a certificate has its text's digest; what was read of it is the text's first few letters
    sure = table(spark, d, "documents").where("lang in ('en', 'es')").select(text_sha256(F.col("text")).alias("h")).distinct().withColumn("certified", F.lit(True))
    x = view(spark, d, "ocr_runs").join(view(spark, d, "versions").select("version_id", text_sha256(F.col("text")).alias("h"), F.expr("substr(text, 1, length(text) % 5)").alias("text")), "version_id")
    x = x.join(sure, "h", "left").withColumn("certified", F.coalesce("certified", F.lit(False)))
    return documents.document_outcome(x).select("run_id", "outcome")


@query("R21_activate_versions", with_views("""
WITH seen AS (SELECT doc_id, count(*) AS seen FROM ocr_runs WHERE version = 1 GROUP BY doc_id), c AS (SELECT doc_id, coalesce(bool_or(is_final AND confidence >= 0.8), false) AS ready FROM ocr_runs WHERE version = 2 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN ready AND seen = 1 THEN 2 ELSE 1 END AS active, CASE WHEN ready IS NULL THEN 'NONE' WHEN ready AND seen = 1 THEN 'ACTIVATED' ELSE 'REFUSED' END AS outcome FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN seen USING (doc_id)""", "ocr_runs"))
def _activate(spark, d):
    # a second version is ready if a final run of it is sure; it saw as many versions as the first one had runs
    runs = view(spark, d, "ocr_runs")
    seen = runs.where("version = 1").groupBy("doc_id").agg(F.count("*").cast("int").alias("seen"))
    ready = runs.where("version = 2").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("is_final") & (F.col("confidence") >= 0.8)), F.lit(False)).alias("ready"))
    docs = table(spark, d, "documents").select("doc_id", F.lit(1).alias("active"))
    return documents.activate_versions(docs, ready.join(seen, "doc_id").withColumn("version", F.lit(2)))


_REGISTERED = "SELECT doc_id, substr(text, 1, 20) AS name, CASE WHEN toxic = 1 THEN 'otro' ELSE source END AS type, lang AS family FROM documents JOIN labels USING (doc_id) WHERE quality = 1 OR toxic = 1"


@query("R36_document_registry", f"""
SELECT d.doc_id, CASE WHEN o.doc_id IS NULL THEN 'NEW' WHEN substr(d.text, 1, 20) IS NOT DISTINCT FROM o.name AND d.source IS NOT DISTINCT FROM o.type AND d.lang IS NOT DISTINCT FROM o.family THEN 'SAME' ELSE 'INCOMPATIBLE' END AS outcome FROM documents d LEFT JOIN ({_REGISTERED}) o ON o.doc_id = d.doc_id""")
def _registry(spark, d):
    docs, day = table(spark, d, "documents"), F.lit(None).cast("date").alias("date")
    x = docs.select("doc_id", F.substring("text", 1, 20).alias("name"), F.col("source").alias("type"), F.col("lang").alias("family"), day)
    old = docs.join(table(spark, d, "labels"), "doc_id").where("quality = 1 or toxic = 1").select("doc_id", F.substring("text", 1, 20).alias("name"), F.when(F.col("toxic") == 1, "otro").otherwise(F.col("source")).alias("type"), F.col("lang").alias("family"), day)
    return documents.register_documents(x, old).select("doc_id", "outcome")


@query("R37_operation_replay", """
WITH x AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, arg_min(event_type, (ts, event_id)) AS first, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id AS operation_id, CASE WHEN n % 3 = 0 THEN 'NEW' WHEN last = first THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome FROM x""")
def _replay(spark, d):
    # a user's first event is on record, their last one comes again
    turn = F.struct("ts", "event_id")
    x = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", turn).alias("last"), F.min_by("event_type", turn).alias("first"), F.count("*").alias("n"))
    of = lambda c: x.select(F.col("user_id").alias("operation_id"), F.col("user_id").alias("user"), F.lit("s").alias("session"), text_sha256(F.col(c)).alias("query_hash"), F.lit(None).cast("string").alias("reference"), "n")
    return documents.match_operations(of("last").drop("n"), of("first").where("n % 3 <> 0").drop("n")).select("operation_id", "outcome")


def _events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("occurred_at"))


@query("P18_audit_scope", "SELECT event_id FROM events WHERE user_id = 7 AND event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05'")
def _scope(spark, d):
    return audit.audit_events(_events(spark, d), 7, ["click", "view"], "2024-01-05").select("event_id")


@query("T06_audit_page", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 31")
def _audit_page(spark, d):
    return quarantine.keyset_page(_events(spark, d), ["occurred_at", "event_id"], (F.lit("2024-01-20").cast("timestamp"), F.lit(-1)), 30, descending=True).select("event_id")


@query("J14_event_resources", "SELECT o_orderkey AS event_id, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS resources FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) l ON l_orderkey = o_orderkey GROUP BY o_orderkey".replace("ORDER BY l_linenumber, l_partkey", "ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)"))
def _resources(spark, d):
    ev = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    rs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").cast("string").alias("resource")).distinct()
    return audit.with_resources(ev, rs)


@query("R27_process_events", "SELECT event_type AS action, CAST(user_id AS VARCHAR) AS actor, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY ALL")
def _process(spark, d):
    ev = _events(spark, d).select("action", F.col("actor").cast("string").alias("actor"))
    return audit.process_events(ev, ev.where("1 = 0").select(F.lit("").alias("event_id")), ["action", "actor"]).groupBy("action", "actor").agg(F.count("*").alias("n"))


@query("O04_resource_equality", """
WITH a AS (SELECT l_orderkey AS event_id, l_partkey AS resource FROM lineitem WHERE l_returnflag <> 'R'), o AS (SELECT l_orderkey AS event_id, l_partkey AS resource FROM lineitem WHERE l_quantity < 40)
SELECT *, 'audit' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM o) UNION ALL SELECT *, 'operation' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM a)""")
def _equality(spark, d):
    x = table(spark, d, "lineitem")
    of = lambda df: df.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("resource"))
    return audit.check_resources(of(x.where("l_returnflag <> 'R'")), of(x.where("l_quantity < 40")))


@query("R30_stale_runs", "SELECT event_id FROM events WHERE event_type = 'view' AND epoch(ts) < epoch(TIMESTAMP '2024-01-31') - 864000")
def _stale(spark, d):
    x = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "IN_PROGRESS").otherwise("DONE").alias("state"), F.col("ts").cast("timestamp").alias("heartbeat"))
    return audit.stale_runs(x, F.lit("2024-01-31").cast("timestamp"), 864_000).select("event_id")


@query("R34_run_binding", """
WITH s AS (SELECT l_orderkey AS job_id, l_orderkey || l_returnflag AS run_id, max(l_linestatus) AS parent FROM lineitem GROUP BY l_orderkey, l_returnflag), j AS (SELECT o_orderkey AS job_id, o_orderstatus AS parent FROM orders), n AS (SELECT job_id, count(DISTINCT run_id) AS n, min(parent) AS p FROM s GROUP BY job_id)
SELECT j.job_id, CASE WHEN n IS NULL THEN 'NO_RUN' WHEN n > 1 THEN 'SEVERAL_RUNS' ELSE 'OTHER_PARENT' END AS problem FROM j LEFT JOIN n USING (job_id) WHERE n IS NULL OR n > 1 OR p IS DISTINCT FROM parent""")
def _binding(spark, d):
    # an order's lines were frozen for the run of their flag, whose parent is the lines' status
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.col("l_orderkey").cast("string"), "l_returnflag").alias("run_id"), "l_linestatus")
    rows = lines.count()
    runs = dealt(lines.select("run_id", "l_linestatus"), rows, "run_id").groupBy("run_id").agg(F.max("l_linestatus").alias("parent"))
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("parent"))
    return audit.check_run_binding(jobs, lines.select("job_id", "run_id"), runs, rows)


def _broken(name, rows):
    """What DuckDB finds of a table's rules: one branch a rule, with a check's unknown as held."""
    r, parts = rules.CATALOGUE[name], []
    tell = lambda rule, where, of=rows: parts.append(f"SELECT '{name}' AS \"table\", CAST({r.key} AS VARCHAR) AS key, '{rule}' AS rule FROM ({of}) WHERE {where}")
    for c in r.required:
        tell(f"REQUIRED_{c}", f"{c} IS NULL")
    for rule, condition in r.checks.items():
        tell(rule, f"NOT ({condition})")
    for u in r.unique:
        tell("UNIQUE_" + "_".join(u), "n > 1 AND " + " AND ".join(f"{c} IS NOT NULL" for c in u), f"SELECT *, count(*) OVER (PARTITION BY {', '.join(u)}) AS n FROM ({rows})")
    return " UNION ALL ".join(parts)


#: The entities with what breaks their rules: ids that are empty or repeat, dates in the wrong order, unknown states, amounts below zero, missing days.
_SPOILT = {
    "contracts": "SELECT CASE WHEN id_contrato LIKE '%77' THEN '' WHEN id_contrato LIKE '%88' THEN 'C-8' ELSE id_contrato END AS id_contrato, CASE WHEN id_contrato LIKE '%5' THEN NULL ELSE fecha_solicitud END AS fecha_solicitud, CASE WHEN id_contrato LIKE '%3' THEN DATE '1990-01-01' ELSE fecha_firma END AS fecha_firma, CASE WHEN id_contrato LIKE '%99' THEN NULL ELSE fecha_vencimiento END AS fecha_vencimiento, CASE WHEN id_contrato LIKE '%1' THEN 'Perdido' WHEN id_contrato LIKE '%2' THEN NULL ELSE estado_revision END AS estado_revision FROM contracts",
    "litigation": "SELECT CASE WHEN id_litigio LIKE '%66' THEN '' ELSE id_litigio END AS id_litigio, CASE WHEN id_litigio LIKE '%4' THEN NULL ELSE fecha_apertura END AS fecha_apertura, CASE WHEN id_litigio LIKE '%5' THEN '' ELSE estado END AS estado, CASE WHEN id_litigio LIKE '%6' THEN 'grave' ELSE nivel_severidad END AS nivel_severidad, CASE WHEN id_litigio LIKE '%7' THEN -1 * monto_reclamado ELSE monto_reclamado END AS monto_reclamado, -1 * estimacion_interna AS estimacion_interna FROM litigation",
    "observations": "SELECT CASE WHEN code = 'KPI-RC-01' THEN 'KPI-XX-99' ELSE code END AS code, CASE WHEN year(period_start) = 1996 THEN '[]' ELSE dims END AS dims, CASE WHEN year(period_start) = 1995 THEN last_day(period_start) ELSE period_start END AS period_start, CASE WHEN year(period_start) = 1994 THEN period_start ELSE period_end END AS period_end, CASE WHEN code = 'KPI-LI-05' THEN 'TAL_VEZ' ELSE availability END AS availability, CASE WHEN year(period_start) = 1993 THEN NULL ELSE value END AS value, CASE WHEN year(period_start) = 1997 THEN code ELSE observation_id END AS observation_id FROM observations",
}


@query("R29_quality_rules", with_views(" UNION ALL ".join(_broken(name, rows) for name, rows in _SPOILT.items()), "contracts", "litigation", "observations"))
def _quality(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    n = lines.count()
    given = {"contracts": {"orders": dealt(orders, n, "o_orderkey"), "lineitem": dealt(lines, n, "l_orderkey")}}
    tables = {name: spark.sql(rows.replace(f"FROM {name}", "FROM {own}"), own=view(spark, d, name, **given.get(name, {}))) for name, rows in _SPOILT.items()}
    return rules.check_tables(tables, rules.CATALOGUE, dict.fromkeys(("contracts", "litigation"), orders.count()))
