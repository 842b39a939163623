"""Composed reports: queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import scalars
from casemill.functions.ids import fingerprint, text_sha256
from casemill.operators import corpus, proactive, quarantine, reports, retrieval
from casemill.operators import validation as val
from casemill.plans.fixtures import table, view, with_views
from casemill.plans.registry import query


@query("F19_complete_citations", with_views("SELECT version_id, document_date IS NOT NULL AS complete FROM versions", "versions"))
def _complete(spark, d):
    v = view(spark, d, "versions")
    return v.select("version_id", reports.citation_complete(F.col("doc_id"), F.col("source"), F.col("family"), F.col("document_date"), F.col("version_id")).alias("complete"))


@query("F24_repeated_series", "SELECT l_returnflag AS code, CAST(l_linenumber AS VARCHAR) AS dims, CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _repeated(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("code"), F.col("l_linenumber").cast("string").alias("dims"), F.trunc("l_shipdate", "month").alias("period_start"))
    return reports.repeated_series(x)


_REFERENCE = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'OTRO' ELSE 'PROACTIVE_ANALYSIS_V1' END AS contract, CASE WHEN o_orderkey % 5 = 0 THEN upper(o_clerk) ELSE o_clerk END AS print, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '11111111-2222-5333-8444-555555555555' END AS job, o_orderkey % 3 <> 0 AS ordered FROM (SELECT *, sha2(CAST(o_orderkey AS VARCHAR(20)), 256) AS o_clerk FROM {orders}) o".replace("o_clerk", "print_")
_SORTED = sorted(proactive.RULES.values())


@query("F28_rules_references", f"""
WITH r AS (SELECT *, CASE WHEN ordered THEN {_SORTED} ELSE list_reverse({_SORTED}) END AS rules FROM ({_REFERENCE.replace("sha2(CAST(o_orderkey AS VARCHAR(20)), 256)", "sha256(CAST(o_orderkey AS VARCHAR))").format(orders='orders')}))
SELECT o_orderkey, contract = 'PROACTIVE_ANALYSIS_V1' AND regexp_full_match(print, '[0-9a-f]{{64}}') AND try_cast(job AS UUID) IS NOT NULL AND rules = list_sort(rules) AS ok FROM r""")
def _rules(spark, d):
    x = spark.sql(_REFERENCE, orders=table(spark, d, "orders"))
    rules = F.array(*[F.lit(r) for r in _SORTED])
    ref = F.to_json(F.struct("contract", F.col("print").alias("input_fingerprint_sha256"), F.col("job").alias("parent_job_run_id"), F.lit("11111111-2222-5333-8444-555555555555").alias("parent_operation_id"), F.when(F.col("ordered"), rules).otherwise(F.reverse(rules)).alias("signal_rules")))
    return x.select("o_orderkey", reports.valid_rules_reference(ref, list(proactive.RULES.values())).alias("ok"))


_RUNS = "SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS state, CAST(o_orderdate AS DATE) AS window_start, CAST(CAST(o_orderdate AS DATE) + INTERVAL '30' DAY AS DATE) AS window_end, CAST(o_orderdate AS DATE) AS completed_at FROM {orders}"


def _runs(spark, d):
    return spark.sql(_RUNS, orders=table(spark, d, "orders"))


@query("W15_latest_run", f"SELECT run_id FROM ({_RUNS.format(orders='orders')}) WHERE state = 'COMPLETED' ORDER BY completed_at DESC, run_id DESC LIMIT 1")
def _latest(spark, d):
    return reports.latest_run(_runs(spark, d)).select("run_id")


@query("R12_analysis_page", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN ({_RUNS.format(orders='orders')}) ON run_id = l_orderkey WHERE state = 'COMPLETED' AND window_end >= DATE '1997-03-01' AND window_start <= DATE '1997-06-30' AND l_returnflag = 'A'")
def _page(spark, d):
    found = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("code"))
    return reports.analysis_page(_runs(spark, d), found, "1997-03-01", "1997-06-30", "A").select("l_orderkey", "l_linenumber", "l_partkey")


@query("W12_technical_indicator", with_views("""
SELECT k.code, period_start, round(CAST(value AS DOUBLE), 6) AS value, coalesce(availability, 'NO_DISPONIBLE') AS availability FROM (VALUES ('KPI-CN-02')) k(code)
LEFT JOIN (SELECT * FROM observations WHERE code = 'KPI-CN-02' AND period_start BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' ORDER BY period_start DESC LIMIT 1) o ON o.code = k.code""", "observations"))
def _technical(spark, d):
    return reports.technical_kpi(view(spark, d, "observations"), "KPI-CN-02", "1996-01-01", "1996-12-31").withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("R15_ambiguous_traces", "SELECT o_custkey AS context, max(n) > 1 AS ambiguous FROM (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey")
def _traces(spark, d):
    return reports.exposure_traces(table(spark, d, "orders").select(F.col("o_custkey").alias("context"), F.trunc("o_orderdate", "month").alias("period_start")))


@query("R26_operation_outcomes", """
WITH x AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'EVIDENCIA_SUFICIENTE' WHEN event_type <> 'click' THEN 'SIN_EVIDENCIA' END AS evidence, user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AS authorized, value > 30 AS failed FROM events)
SELECT event_id, CASE WHEN NOT authorized THEN 'COMPLETED' WHEN evidence IS NULL OR failed THEN 'FAILED' ELSE 'COMPLETED' END AS operation,
 CASE WHEN NOT authorized OR evidence IS NULL THEN 'NOT_REQUESTED' WHEN failed THEN 'FAILED' WHEN evidence = 'EVIDENCIA_SUFICIENTE' THEN 'SUCCEEDED' ELSE 'NOT_REQUESTED' END AS generation,
 CASE WHEN NOT authorized THEN 'DENIED' WHEN evidence IS NULL OR failed THEN 'FAILURE' ELSE 'SUCCESS' END AS audit FROM x""")
def _outcomes(spark, d):
    sees = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("authorized"))
    evidence = F.when(F.col("event_type") == "purchase", "EVIDENCIA_SUFICIENTE").when(F.col("event_type") != "click", "SIN_EVIDENCIA")
    x = table(spark, d, "events").join(sees, "user_id", "left").select("event_id", evidence.alias("evidence"), F.coalesce("authorized", F.lit(False)).alias("authorized"), F.when(F.col("value") > 30, "x").alias("failure"))
    return reports.operation_outcome(x).select("event_id", "operation", "generation", "audit")


@query("R33_retrieval_audit", "SELECT o_orderkey AS operation_id, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)), '') AS resources FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _audit(spark, d):
    ops = table(spark, d, "orders").select(F.col("o_orderkey").alias("operation_id"), F.lit("RAG_QUERY").alias("action"), F.lit("SUCCESS").alias("audit"))
    frag = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("operation_id"), F.col("l_partkey").cast("string").alias("fragment_id"))
    return reports.rag_audit_events(ops, frag)[0].select("operation_id", "resources")


_LIVE = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS active, CASE WHEN doc_id % 7 = 0 THEN 'PROCESANDO' ELSE 'LISTA' END AS state, doc_id % 11 = 0 AS invalidated FROM {documents}"


@query("R22_active_chunks", with_views(f"SELECT version_id FROM versions v JOIN ({_LIVE.format(documents='documents')}) l ON l.doc_id = v.doc_id AND l.active = v.version WHERE state = 'LISTA' AND NOT invalidated", "versions"))
def _active(spark, d):
    return reports.active_chunks(view(spark, d, "versions"), spark.sql(_LIVE, documents=table(spark, d, "documents"))).select("version_id")


@query("A22_active_chunk_count", f"""
WITH c AS (SELECT doc_id, CASE WHEN len(w) <= 128 THEN 1 ELSE CAST(ceil((len(w) - 16) / 112.0) AS INT) END AS chunks FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents) WHERE len(w) > 0)
SELECT doc_id, chunks FROM c JOIN ({_LIVE.format(documents='documents')}) l USING (doc_id) WHERE state = 'LISTA' AND NOT invalidated AND active = 1""")
def _count(spark, d):
    docs = table(spark, d, "documents")
    chunks = corpus.chunk_fixed(docs, 128, 16).withColumn("version", F.lit(1))
    return reports.active_chunk_count(chunks, spark.sql(_LIVE, documents=docs))


@query("J16_ocr_operations", with_views("""
SELECT v.version_id, family, CASE WHEN confidence IS NULL THEN 'Pendiente' WHEN confidence >= 0.8 THEN 'Exitoso' ELSE 'Baja_confianza' END AS state, v.doc_id % 3 = 0 AS needs_ocr FROM versions v LEFT JOIN (SELECT * FROM ocr_runs QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY attempt DESC, run_id DESC) = 1) r USING (version_id)""", "versions", "ocr_runs"))
def _operations(spark, d):
    v = view(spark, d, "versions")
    pages = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(False), F.col("doc_id") % 3 == 0)).alias("requires_ocr"))
    return reports.ocr_operations(v.select("doc_id", "family").distinct(), v.drop("family"), view(spark, d, "ocr_runs"), pages).select("version_id", "family", "state", "needs_ocr")


@query("T05_ocr_page", with_views("SELECT run_id FROM ocr_runs WHERE processed_at < 4 OR processed_at = 4 AND run_id < 'V-5' ORDER BY processed_at DESC, run_id DESC LIMIT 26", "ocr_runs"))
def _ocr_page(spark, d):
    return quarantine.keyset_page(view(spark, d, "ocr_runs"), ["processed_at", "run_id"], (4, "V-5"), 25, descending=True).select("run_id")


@query("R28_audit_page", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' || event_id || ',b' ELSE '' END AS resources FROM (SELECT event_id FROM events WHERE user_id % 3 = 1 AND user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 21)""")
def _audit_page(spark, d):
    e = table(spark, d, "events")
    ev = e.select("event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("occurred_at"))
    rs = e.where("event_id % 2 = 0").select("event_id", F.explode(F.array(F.struct(F.lit(2).alias("position"), F.lit("b").alias("resource")), F.struct(F.lit(1).alias("position"), F.concat(F.lit("a"), F.col("event_id")).alias("resource")))).alias("r")).select("event_id", "r.*")
    return reports.audit_page(ev, rs, None, 20, actor=7).select("event_id", "resources")


#: The columns of a file, by the order that it stands for.
_COLUMNS = {"ID_Incidente": "o_orderstatus <> 'P'", "Fecha_Evento": "o_totalprice > 30000", "Area": "o_orderpriority < '4'", "Nivel_Severidad": "o_custkey % 2 = 0", "ID_Asunto": "o_orderstatus <> 'F'", "Tipo_Asunto": "o_totalprice < 200000", "Estado": "o_orderpriority > '2'", "Fecha": "o_custkey % 3 <> 0"}
_HEADERS = "SELECT o_orderkey AS file_id, " + ", ".join(f"CASE WHEN {rule} THEN '{name}' END AS c{i}" for i, (name, rule) in enumerate(_COLUMNS.items())) + " FROM {orders}"
_LACKS = lambda cs: "list_filter([" + ", ".join(f"CASE WHEN c{i} IS NULL THEN '{name}' END" for i, name in cs) + "], lambda x: x IS NOT NULL)"


@query("P04_composite_structure", f"""
WITH l AS (SELECT file_id, {_LACKS(list(enumerate(_COLUMNS))[:4])} AS a, {_LACKS(list(enumerate(_COLUMNS))[4:])} AS b FROM ({_HEADERS.format(orders='orders')}))
SELECT file_id, array_to_string(CASE WHEN len(a) <= len(b) THEN a ELSE b END, ',') AS missing FROM l""")
def _composite(spark, d):
    x = spark.sql(_HEADERS, orders=table(spark, d, "orders"))
    headers = x.select("file_id", F.filter(F.array(*[f"c{i}" for i in range(len(_COLUMNS))]), lambda c: c.isNotNull()).alias("headers"))
    rows = headers.select("file_id", F.lit(2).alias("row_number"), F.size("headers").alias("width"))
    return val.validate_structure(rows, headers, *val.AUDIT).select("file_id", "missing")


#: One rule of the corpus broken by each: no certificate, an older text, contract or model, another width, a source that was not loaded or not accepted, no receipt, one of an older contract.
_CERTS = "SELECT doc_id, version, CASE WHEN doc_id % 13 = 6 THEN 'older ' || text ELSE text END AS text, CASE WHEN doc_id % 17 = 3 THEN 'index-v0' ELSE 'index-v1' END AS contract, CASE WHEN doc_id % 19 = 5 THEN 'other' ELSE 'model-v1' END AS model, CASE WHEN doc_id % 23 = 7 THEN 32 ELSE 64 END AS dimensions FROM versions WHERE doc_id % 9 <> 4"
_SOURCES = "SELECT doc_id, CASE WHEN doc_id % 29 = 8 THEN 'EN_PROCESO' ELSE 'COMPLETADO' END AS state, CASE WHEN doc_id % 31 = 9 THEN 'REJECTED' ELSE 'ACCEPTED' END AS result FROM {documents}"
_RECEIPTS = "SELECT version_id AS chunk_id, CASE WHEN doc_id % 37 = 10 THEN 'index-v0' ELSE 'index-v1' END AS contract FROM versions WHERE doc_id % 41 <> 11"


@query("P15_retrievable_corpus", with_views(f"""
WITH l AS ({_LIVE.format(documents='documents')}), own AS (SELECT v.doc_id, v.version, v.version_id, text, state, invalidated FROM versions v JOIN l ON l.doc_id = v.doc_id AND l.active = v.version),
certs AS (SELECT doc_id, version, sha256(text) AS h FROM ({_CERTS}) WHERE contract = 'index-v1' AND model = 'model-v1' AND dimensions = 64)
SELECT own.doc_id, own.version, own.version_id AS chunk_id FROM own JOIN certs ON certs.doc_id = own.doc_id AND certs.version = own.version AND certs.h = sha256(text) JOIN embeddings ON vec_id = own.doc_id
WHERE state = 'LISTA' AND NOT invalidated AND own.doc_id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'es')) AND own.doc_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error') AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
AND own.doc_id IN (SELECT doc_id FROM ({_SOURCES.format(documents='documents')}) WHERE state = 'COMPLETADO' AND result = 'ACCEPTED') AND own.version_id IN (SELECT chunk_id FROM ({_RECEIPTS}) WHERE contract = 'index-v1')""", "versions"))
def _retrievable(spark, d):
    v, docs = view(spark, d, "versions"), table(spark, d, "documents")
    live = spark.sql(_LIVE, documents=docs).withColumnRenamed("active", "version").join(v.select("doc_id", "version", text_sha256(F.col("text")).alias("text_sha256")), ["doc_id", "version"])
    of_versions = lambda sql: spark.sql(sql.replace("FROM versions", "FROM {versions}"), versions=v)
    certificates = of_versions(_CERTS).withColumn("text_sha256", text_sha256(F.col("text"))).drop("text")
    chunks = v.select("doc_id", "version", F.col("version_id").alias("chunk_id")).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    held = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("doc_id"))
    sources, allowed = spark.sql(_SOURCES, documents=docs), docs.where("lang in ('en', 'es')").select("doc_id")
    return retrieval.authorized_corpus(chunks, live, certificates, of_versions(_RECEIPTS), sources, allowed, held).select("doc_id", "version", "chunk_id")


_PRINT = "sha256(string_agg(dims || '|' || strftime(period_start, '%Y-%m-%d') || '|' || availability || '|' || coalesce(CAST(value AS VARCHAR), '-'), chr(10) ORDER BY dims || '|' || strftime(period_start, '%Y-%m-%d') || '|' || availability || '|' || coalesce(CAST(value AS VARCHAR), '-')))"


@query("R07_change_detection", with_views(f"""
WITH now AS (SELECT code, {_PRINT} AS fingerprint FROM observations GROUP BY code),
before AS (SELECT code, {_PRINT} AS fingerprint FROM observations WHERE code <> 'KPI-RC-01' AND NOT (code = 'KPI-CN-03' AND year(period_start) = 1995) GROUP BY code)
SELECT now.code, now.fingerprint, CASE WHEN now.fingerprint = before.fingerprint THEN 'NO_RELEVANT_WORK' ELSE 'RUN' END AS decision FROM now LEFT JOIN before ON before.code = now.code""", "observations"))
def _change(spark, d):
    x = view(spark, d, "observations")
    line = F.concat_ws("|", "dims", F.date_format("period_start", "yyyy-MM-dd"), "availability", F.coalesce(F.col("value").cast("string"), F.lit("-")))
    prints = lambda rows, name: rows.groupBy("code").agg(fingerprint(line).alias(name))
    then = x.where("code <> 'KPI-RC-01' and not (code = 'KPI-CN-03' and year(period_start) = 1995)")
    return proactive.needs_run(prints(x, "fingerprint"), prints(then, "last"), ["code"])


@query("R08_snapshot_freeze", with_views("""
WITH c AS (SELECT DISTINCT observation_id, code FROM (SELECT *, year(period_start) * 12 + month(period_start) - 1 AS m, max(year(period_start) * 12 + month(period_start) - 1) OVER (PARTITION BY code, dims) AS top FROM observations)
  WHERE m > top - CASE WHEN code IN ('KPI-RC-01', 'KPI-EO-01') THEN 1 WHEN code IN ('KPI-RC-03', 'KPI-CN-02') THEN 5 ELSE 6 END),
h AS (SELECT *, sha1(unhex('651f6d11b34d54bc86db55175b20d59e') || encode('run-9:' || observation_id)) AS h FROM c WHERE code <> 'KPI-LI-05')
SELECT observation_id, 'run-9' AS run_id, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', 1 + (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4, 1)||substr(h,18,3)||'-'||substr(h,21,12) AS snapshot_id FROM h""", "observations"))
def _freeze(spark, d):
    closure = proactive.snapshot_closure(view(spark, d, "observations"))
    # one indicator was frozen for the job before; rows of another job do not count
    frozen = closure.where("code = 'KPI-LI-05'").select("observation_id", F.lit("job-9").alias("job_id")).unionByName(closure.select("observation_id", F.lit("job-8").alias("job_id")))
    return proactive.freeze_snapshot(closure, frozen, "run-9", "job-9").select("observation_id", "run_id", "snapshot_id")


@query("J13_run_context", "SELECT event_id AS reference_id, user_id AS finding_id, o_orderstatus AS code FROM events JOIN orders ON o_orderkey = user_id WHERE o_orderpriority = '1-URGENT'")
def _context(spark, d):
    found = table(spark, d, "orders").select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderpriority").alias("run_id"), F.col("o_orderstatus").alias("code"), F.lit("{}").alias("dims"), F.col("o_orderdate").alias("period_start"))
    refs = table(spark, d, "events").select(F.col("event_id").alias("reference_id"), F.col("user_id").alias("finding_id"))
    return proactive.run_context(found, refs, "1-URGENT").select("reference_id", "finding_id", "code")


@query("F26_array_rules", r"""
WITH w AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, coalesce(lang IN ('en', 'fr'), false) AS listed, len(w) AS n, octet_length(encode(text)) AS bytes, coalesce(trim(text) = '', true) AS blank, CAST((doc_id IS NOT NULL) AS INT) + CAST((lang IS NOT NULL) AS INT) + CAST((text IS NOT NULL) AS INT) AS known FROM w""")
def _arrays(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    known = sum((F.col(c).isNotNull().cast("int") for c in ("doc_id", "lang", "text")), F.lit(0))
    listed = F.coalesce(F.array_contains(F.array(F.lit("en"), F.lit("fr")), F.col("lang")), F.lit(False))
    return table(spark, d, "documents").select("doc_id", listed.alias("listed"), F.when(F.col("text").isNotNull(), F.size(words)).alias("n"), F.octet_length("text").alias("bytes"), scalars.is_absent(F.col("text")).alias("blank"), known.alias("known"))


@query("F27_json_fields", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events")
def _json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
