"""Indicators, observations, signals: queries over the entity views."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import calendar, ids, scalars
from casemill.operators import indicators as ind
from casemill.operators import observations as obs
from casemill.operators import proactive as pro
from casemill.plans.fixtures import view, with_views
from casemill.plans.registry import query

RUN = "11111111-2222-5333-8444-555555555555"


def _out(df):
    return df.withColumn("value", F.round(F.col("value").cast("double"), 6))


def _kpi(name, entity, fn, sql):
    query(name, with_views(f"SELECT code, period_start, period_end, as_of, dims, round(CAST(value AS DOUBLE), 6) AS value, CASE WHEN value IS NULL THEN 'NO_DISPONIBLE' ELSE 'DISPONIBLE' END AS availability FROM ({sql})", *{entity, "requests"}))(
        lambda spark, d: _out(fn(view(spark, d, entity), view(spark, d, "requests")))
    )


SQL = {
    "KPI-RC-01": "SELECT 'KPI-RC-01' AS code, r.*, '{}' AS dims, (SELECT CAST(sum(date_diff('day', fecha_solicitud, fecha_firma)) AS DOUBLE) / nullif(count(*), 0) FROM contracts WHERE fecha_firma BETWEEN period_start AND period_end) AS value FROM requests r",
    "KPI-RC-03": "SELECT 'KPI-RC-03' AS code, r.*, '{}' AS dims, (SELECT count(*) FROM contracts WHERE estado_revision = 'No iniciado' AND fecha_vencimiento BETWEEN as_of AND as_of + INTERVAL 60 DAY) AS value FROM requests r",
    "KPI-LI-01": "SELECT 'KPI-LI-01' AS code, r.*, '{\"nivel_severidad\":\"' || s || '\"}' AS dims, coalesce((SELECT sum(coalesce(estimacion_interna, monto_reclamado)) FROM litigation WHERE estado = 'Activo' AND nivel_severidad = s), 0) AS value FROM requests r, (VALUES ('alto'), ('medio'), ('bajo')) v(s)",
    "KPI-LI-05": "SELECT 'KPI-LI-05' AS code, r.*, '{}' AS dims, (SELECT count(*) FROM litigation WHERE fecha_apertura BETWEEN period_start AND period_end) AS value FROM requests r",
    "KPI-CN-02": "SELECT 'KPI-CN-02' AS code, r.*, '{}' AS dims, (SELECT count(*) FROM obligations WHERE fecha_limite < as_of AND evidencia_cumplimiento IS NULL) AS value FROM requests r",
    "KPI-CN-03": "SELECT 'KPI-CN-03' AS code, r.*, '{\"area\":\"' || k.area || '\",\"nivel_severidad\":\"' || k.nivel_severidad || '\"}' AS dims, coalesce(n, 0) AS value FROM requests r CROSS JOIN (SELECT DISTINCT area, nivel_severidad FROM incidents) k LEFT JOIN (SELECT date_trunc('month', fecha_evento) AS mo, area, nivel_severidad, count(*) AS n FROM incidents GROUP BY ALL) i ON i.area = k.area AND i.nivel_severidad = k.nivel_severidad AND mo = r.period_start",
    "KPI-EO-01": "SELECT 'KPI-EO-01' AS code, r.*, '{\"estado\":\"' || k.estado || '\",\"tipo_asunto\":\"' || k.tipo_asunto || '\"}' AS dims, coalesce(n, 0) AS value FROM requests r CROSS JOIN (SELECT DISTINCT tipo_asunto, estado FROM matters) k LEFT JOIN (SELECT date_trunc('month', fecha) AS mo, tipo_asunto, estado, count(DISTINCT id_asunto) AS n FROM matters GROUP BY ALL) i ON i.tipo_asunto = k.tipo_asunto AND i.estado = k.estado AND mo = r.period_start",
    "KPI-CD-03": "SELECT 'KPI-CD-03' AS code, r.*, '{}' AS dims, (SELECT 100.0 * count(*) FILTER (confidence >= 0.8) / nullif(count(*), 0) FROM (SELECT * FROM ocr_runs WHERE is_final QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY processed_at DESC, version DESC, attempt DESC, run_id DESC) = 1)) AS value FROM requests r",
}


def latest_final(runs):
    """The final OCR run of each document that was processed last."""
    return obs.latest_per_key(runs.where("is_final"), ["doc_id"], F.desc("processed_at"), F.desc("version"), F.desc("attempt"), F.desc("run_id"))


_kpi("A01_contract_cycle_time", "contracts", ind.kpi_rc01, SQL["KPI-RC-01"])
_kpi("A02_expiring_unreviewed", "contracts", ind.kpi_rc03, SQL["KPI-RC-03"])
_kpi("A03_litigation_exposure", "litigation", ind.kpi_li01, SQL["KPI-LI-01"])
_kpi("A04_new_litigation", "litigation", ind.kpi_li05, SQL["KPI-LI-05"])
_kpi("A05_overdue_obligations", "obligations", ind.kpi_cn02, SQL["KPI-CN-02"])
_kpi("A06_incidents_by_area", "incidents", ind.kpi_cn03, SQL["KPI-CN-03"])
_kpi("A07_matters_by_type", "matters", ind.kpi_eo01, SQL["KPI-EO-01"])
_kpi("A08_ocr_success_rate", "ocr_runs", lambda runs, req: ind.kpi_cd03(latest_final(runs), req), SQL["KPI-CD-03"])


def entity_tables(spark, d):
    t = {n: view(spark, d, n) for n in ("contracts", "litigation", "obligations", "incidents", "matters")}
    return t | {"latest_final": latest_final(view(spark, d, "ocr_runs"))}


@query("A09_all_indicators", with_views("SELECT code, period_start, period_end, as_of, dims, round(CAST(value AS DOUBLE), 6) AS value, CASE WHEN value IS NULL THEN 'NO_DISPONIBLE' ELSE 'DISPONIBLE' END AS availability FROM (" + " UNION ALL ".join(f"SELECT code, period_start, period_end, as_of, dims, CAST(value AS DOUBLE) AS value FROM ({s})" for s in SQL.values()) + ")", "contracts", "litigation", "obligations", "incidents", "matters", "ocr_runs", "requests"))
def _all(spark, d):
    return _out(ind.kpi_all(entity_tables(spark, d), view(spark, d, "requests")))


@query("W01_latest_final_ocr", with_views("SELECT doc_id, version, attempt, run_id, confidence FROM ocr_runs WHERE is_final QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY processed_at DESC, version DESC, attempt DESC, run_id DESC) = 1", "ocr_runs"))
def _latest_final(spark, d):
    return latest_final(view(spark, d, "ocr_runs")).select("doc_id", "version", "attempt", "run_id", "confidence")


_OLD = "SELECT code, period_start, period_end, dims, period_end AS as_of, value, availability, 'run-1' AS run_id, 1 AS seq FROM observations"
_NEW = "SELECT code, period_start, period_end, dims, CASE WHEN month(period_start) % 3 = 0 THEN period_start ELSE period_end END AS as_of, CAST(value + 1 AS DECIMAL(38,10)) AS value, availability, 'run-2' AS run_id, 2 AS seq FROM observations WHERE year(period_start) % 2 = 0"


@query("A10_observation_upsert", with_views(f"""
WITH old AS ({_OLD}), new AS ({_NEW}), b AS (SELECT *, 0 AS turn FROM old UNION ALL SELECT *, 1 FROM new),
won AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY code, period_start, period_end, dims ORDER BY as_of DESC, turn DESC, seq DESC) = 1)
SELECT code, dims, period_start, as_of, round(CAST(value AS DOUBLE), 6) AS value, CASE WHEN month(period_start) = 5 THEN 'run-1' ELSE run_id END AS run_id FROM won""", "observations"))
def _upsert(spark, d):
    o = view(spark, d, "observations")
    old, new = spark.sql(_OLD.replace("observations", "{o}"), o=o), spark.sql(_NEW.replace("observations", "{o}"), o=o)
    pinned = old.where("month(period_start) = 5").select(*obs.OBS_KEY, "run_id")
    return _out(obs.upsert_observations(old, new, pinned)).select("code", "dims", "period_start", "as_of", "value", "run_id")


@query("P10_list_observations", with_views("SELECT code, dims, period_start, round(CAST(value AS DOUBLE), 6) AS value FROM observations WHERE code = 'KPI-CN-03' AND period_start >= DATE '1997-01-01' AND period_end <= DATE '1998-12-31'", "observations"))
def _list(spark, d):
    return _out(obs.list_observations(view(spark, d, "observations"), "KPI-CN-03", "1997-01-01", "1998-12-31")).select("code", "dims", "period_start", "value")


_CLOSURE = """
closure AS (SELECT * FROM (SELECT *, year(period_start) * 12 + month(period_start) - 1 AS m, max(year(period_start) * 12 + month(period_start) - 1) OVER (PARTITION BY code, dims) AS top FROM observations)
  WHERE m > top - CASE WHEN code IN ('KPI-RC-01', 'KPI-EO-01') THEN 1 WHEN code IN ('KPI-RC-03', 'KPI-CN-02') THEN 5 ELSE 6 END)"""
_LAGS = """
lags AS (SELECT *, first(v) OVER (PARTITION BY code, dims ORDER BY m RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS p, first(v) OVER (PARTITION BY code, dims ORDER BY m RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS e
  FROM (SELECT *, CASE WHEN availability = 'DISPONIBLE' THEN value END AS v FROM closure) WHERE code NOT IN ('KPI-RC-01', 'KPI-EO-01')),
sig AS (SELECT *, coalesce(CASE WHEN code IN ('KPI-RC-03', 'KPI-CN-02') THEN v > p ELSE v > p AND p > e END, false) AS s FROM lags),
rec AS (SELECT *, CAST(sum(CAST(s AS INT)) OVER (PARTITION BY code, dims ORDER BY m RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS INT) AS r, v IS NOT NULL AND p IS NOT NULL AND (code IN ('KPI-RC-03', 'KPI-CN-02') OR e IS NOT NULL) AS ok FROM sig),
evals AS (SELECT code, dims, period_start AS month, period_end, CASE WHEN ok THEN 'EVALUATED' ELSE 'INSUFFICIENT_HISTORY' END AS outcome, ok AND s AS signal,
  CASE WHEN ok AND v > p AND p > e THEN 'INCREASING' WHEN ok AND v < p AND p < e THEN 'DECREASING' END AS trend, CASE WHEN ok THEN r END AS recurrence, v AS current, p AS reference, CASE WHEN ok THEN v - p END AS change,
  CASE WHEN ok AND p <> 0 THEN round((CAST(v AS DOUBLE) - CAST(p AS DOUBLE)) / CAST(p AS DOUBLE) * 100, 4) END AS percent,
  sha1(unhex('fc14e9c479aa527bad8dfde3d7a2dc63') || encode('%s:' || code || ':' || dims || ':' || CAST(period_start AS VARCHAR))) AS h FROM rec WHERE m = top),
ids AS (SELECT *, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', 1 + instr('0123456789abcdef', substr(h,17,1)) %% 4 + CASE WHEN instr('0123456789abcdef', substr(h,17,1)) %% 4 = 0 THEN 3 ELSE -1 END, 1)||substr(h,18,3)||'-'||substr(h,21,12) AS evaluation_id FROM evals)""" % RUN


def _snapshot(spark, d):
    return pro.snapshot_closure(view(spark, d, "observations"))


@query("W03_snapshot_closure", with_views("WITH " + _CLOSURE.strip() + " SELECT code, dims, period_start, round(CAST(value AS DOUBLE), 6) AS value FROM closure", "observations"))
def _closure(spark, d):
    return _out(_snapshot(spark, d)).select("code", "dims", "period_start", "value")


@query("W04_month_lookback", with_views("""
WITH x AS (SELECT *, CASE WHEN availability = 'DISPONIBLE' THEN value END AS v FROM observations)
SELECT a.code, a.dims, a.period_start, round(CAST(a.v AS DOUBLE), 6) AS v, round(CAST(b.v AS DOUBLE), 6) AS previous, round(CAST(c.v AS DOUBLE), 6) AS earlier
FROM x a LEFT JOIN x b ON b.code = a.code AND b.dims = a.dims AND b.period_start = a.period_start - INTERVAL 1 MONTH LEFT JOIN x c ON c.code = a.code AND c.dims = a.dims AND c.period_start = a.period_start - INTERVAL 2 MONTH""", "observations"))
def _lookback(spark, d):
    r = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return pro.with_lags(view(spark, d, "observations")).select("code", "dims", "period_start", r("v"), r("previous"), r("earlier"))


@query("W05_signal_months", with_views("""
WITH x AS (SELECT *, CASE WHEN availability = 'DISPONIBLE' THEN value END AS v FROM observations WHERE code NOT IN ('KPI-RC-01', 'KPI-EO-01'))
SELECT a.code, a.dims, a.period_start FROM x a JOIN x b ON b.code = a.code AND b.dims = a.dims AND b.period_start = a.period_start - INTERVAL 1 MONTH LEFT JOIN x c ON c.code = a.code AND c.dims = a.dims AND c.period_start = a.period_start - INTERVAL 2 MONTH
WHERE a.v > b.v AND (a.code IN ('KPI-RC-03', 'KPI-CN-02') OR b.v > c.v)""", "observations"))
def _signals(spark, d):
    x = view(spark, d, "observations").where(F.col("code").isin(list(pro.RULES)))
    return pro.with_lags(x).where(pro.signal()).select("code", "dims", "period_start")


def _evaluations(spark, d):
    return pro.evaluate(_snapshot(spark, d), RUN)


@query("W08_evaluate_series", with_views("WITH " + _CLOSURE.strip() + "," + _LAGS + " SELECT evaluation_id, code, dims, month, outcome, signal, trend, recurrence, round(CAST(current AS DOUBLE), 6) AS current, round(CAST(reference AS DOUBLE), 6) AS reference, round(CAST(change AS DOUBLE), 6) AS change, percent FROM ids", "observations"))
def _evaluate(spark, d):
    r = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return _evaluations(spark, d).select("evaluation_id", "code", "dims", "month", "outcome", "signal", "trend", "recurrence", r("current"), r("reference"), r("change"), F.round("percent", 4).alias("percent"))


_TEXT = "code || ' registró una señal en ' || strftime(month, '%Y-%m') || ' para ' || dims || ': valor actual ' || {c} || ', referencia ' || {p} || ', variación absoluta ' || {d} || ', regla ' || rule || ', ' || CASE WHEN recurrence >= 3 THEN 'recurrencia ' || recurrence || '/4' ELSE 'sin patrón recurrente' END || '.'"
_NUM = "rtrim(rtrim(CAST({} AS VARCHAR), '0'), '.')"
_FIND = _LAGS + """,
found AS (SELECT *, CASE code WHEN 'KPI-RC-03' THEN 'RC03_APPEARANCE_OR_INCREASE' WHEN 'KPI-CN-02' THEN 'CN02_APPEARANCE_OR_INCREASE' WHEN 'KPI-LI-01' THEN 'LI01_STRICT_THREE_MONTH_INCREASE' WHEN 'KPI-LI-05' THEN 'LI05_STRICT_THREE_MONTH_INCREASE' ELSE 'CN03_STRICT_THREE_MONTH_INCREASE' END AS rule,
  CAST(month - CASE WHEN code IN ('KPI-RC-03', 'KPI-CN-02') THEN INTERVAL 1 MONTH ELSE INTERVAL 2 MONTH END AS DATE) AS period_start FROM ids WHERE signal)"""
_DESC = _TEXT.format(c=_NUM.format("current"), p=_NUM.format("reference"), d=_NUM.format("change"))


@query("R09_findings", with_views("WITH " + _CLOSURE.strip() + "," + _FIND + f" SELECT evaluation_id, code, dims, period_start, period_end, rule, CASE WHEN recurrence >= 3 THEN recurrence || '_OF_4' END AS pattern, {_DESC} AS description FROM found", "observations"))
def _findings(spark, d):
    return pro.findings(_evaluations(spark, d)).select("evaluation_id", "code", "dims", "period_start", "period_end", "rule", "pattern", "description")


@query("A23_executive_summary", with_views("WITH " + _CLOSURE.strip() + "," + _FIND + f" SELECT coalesce(string_agg({_DESC}, chr(10) ORDER BY code, dims, period_start), 'Análisis completado sin hallazgos.') AS summary, count(*) AS alerts FROM found", "observations"))
def _summary(spark, d):
    return pro.executive_summary(pro.findings(_evaluations(spark, d)))


@query("R10_context_references", with_views("WITH " + _CLOSURE.strip() + "," + _FIND + """ SELECT f.code, f.dims, (SELECT string_agg(observation_id, ',' ORDER BY observation_id) FROM closure c WHERE c.code = f.code AND c.dims = f.dims) AS observations,
 strftime(month, '%Y-%m-%d') || ',' || strftime(month - INTERVAL 1 MONTH, '%Y-%m-%d') || ',' || strftime(month - INTERVAL 2 MONTH, '%Y-%m-%d') || ',' || strftime(month - INTERVAL 3 MONTH, '%Y-%m-%d') AS months FROM found f""", "observations"))
def _refs(spark, d):
    found = pro.findings(_evaluations(spark, d))
    return pro.context_refs(found, _snapshot(spark, d)).join(found.select("finding_id", "code", "dims"), "finding_id").select("code", "dims", "observations", "months")


@query("A29_run_metadata", with_views("WITH " + _CLOSURE.strip() + """,
t AS (SELECT code, max(period_start) AS top FROM closure WHERE code NOT IN ('KPI-RC-01', 'KPI-EO-01') GROUP BY code, dims)
SELECT CAST(min(top - CASE WHEN code IN ('KPI-RC-03', 'KPI-CN-02') THEN INTERVAL 4 MONTH ELSE INTERVAL 5 MONTH END) AS DATE) AS window_start, max(last_day(top)) AS window_end, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM t""", "observations"))
def _metadata(spark, d):
    return pro.run_metadata(_snapshot(spark, d))


@query("F11_fingerprint", with_views("SELECT code, sha256(string_agg(code || '|' || dims || '|' || CAST(period_start AS VARCHAR) || '|' || availability, chr(10) ORDER BY code || '|' || dims || '|' || CAST(period_start AS VARCHAR) || '|' || availability)) AS fingerprint FROM observations GROUP BY code", "observations"))
def _fingerprint(spark, d):
    # one print a code: the sorted texts of a group stay within the months and dimensions of one indicator
    x = view(spark, d, "observations")
    return x.groupBy("code").agg(ids.fingerprint(F.concat_ws("|", "code", "dims", F.date_format("period_start", "yyyy-MM-dd"), "availability")).alias("fingerprint"))


@query("R13_monthly_timeline", with_views("""
WITH s AS (SELECT code, dims, min(period_start) AS a, max(period_start) AS b FROM observations GROUP BY ALL),
m AS (SELECT code, dims, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS period_start FROM s)
SELECT m.code, m.dims, m.period_start, round(CAST(value AS DOUBLE), 6) AS value FROM m LEFT JOIN observations o ON o.code = m.code AND o.dims = m.dims AND o.period_start = m.period_start""", "observations"))
def _timeline(spark, d):
    return _out(calendar.monthly_timeline(view(spark, d, "observations"), ["code", "dims"], "period_start", "value"))


@query("F23_indicator_names", with_views("SELECT code, count(*) AS n, CASE code WHEN 'KPI-RC-01' THEN 'días' WHEN 'KPI-RC-03' THEN 'contratos' WHEN 'KPI-LI-01' THEN 'importe' WHEN 'KPI-LI-05' THEN 'litigios' WHEN 'KPI-CN-02' THEN 'obligaciones' ELSE 'incidentes' END AS unit FROM observations GROUP BY code", "observations"))
def _names(spark, d):
    return scalars.with_indicator_names(view(spark, d, "observations")).groupBy("code", "unit").agg(F.count("*").alias("n"))


_RESULTS = "SELECT 'C-' || o_orderkey AS business_id, CASE o_orderkey % 5 WHEN 0 THEN 'CONTRATO' WHEN 1 THEN 'LITIGIO' WHEN 2 THEN 'OBLIGACION' WHEN 3 THEN 'INCIDENTE' ELSE 'ASUNTO' END AS entity_type, CASE WHEN o_orderkey % 4 = 0 THEN 'IDEMPOTENTE' ELSE 'INCORPORADO' END AS result, CAST(CAST(o_orderdate AS DATE) + INTERVAL '20' DAY AS DATE) AS applied, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS business FROM {orders}"


def _results(spark, d):
    return spark.sql(_RESULTS, orders=spark.read.parquet(f"{d}/orders.parquet"))


_ROUTES = "(VALUES ('CONTRATO','KPI-RC-01',false),('CONTRATO','KPI-RC-03',true),('LITIGIO','KPI-LI-01',true),('LITIGIO','KPI-LI-05',false),('OBLIGACION','KPI-CN-02',true),('INCIDENTE','KPI-CN-03',false),('ASUNTO','KPI-EO-01',false)) v(t, code, cut)"


@query("A11_affected_indicators", f"SELECT DISTINCT code FROM ({_RESULTS.format(orders='orders')}) JOIN {_ROUTES} ON t = entity_type WHERE result = 'INCORPORADO'")
def _affected(spark, d):
    return ind.affected_kpis(_results(spark, d))


@query("A12_derive_requests", f"""
WITH x AS (SELECT CASE WHEN cut THEN applied ELSE business END AS day, applied, code FROM ({_RESULTS.format(orders='orders')}) JOIN {_ROUTES} ON t = entity_type WHERE result = 'INCORPORADO'),
y AS (SELECT CAST(date_trunc('month', day) AS DATE) AS period_start, last_day(day) AS period_end, applied, code FROM x WHERE day IS NOT NULL)
SELECT period_start, period_end, greatest(period_start, least(applied, period_end)) AS as_of, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM y GROUP BY ALL""")
def _derive(spark, d):
    return ind.derive_requests(_results(spark, d))
