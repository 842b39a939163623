"""Landing, validation, quarantine, projection: queries over dirty records."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import calendar, ids, scalars
from casemill.operators import projection as proj
from casemill.operators import quarantine as quar
from casemill.operators import validation as val
from casemill.plans.fixtures import VIEWS, table, view, with_views
from casemill.plans.registry import query

_FIELDS = ["ID_Contrato", "Fecha_Solicitud", "Fecha_Firma", "Fecha_Vencimiento", "Estado_Revision"]


def _records(spark, d):
    pairs = [x for n in _FIELDS for x in (F.lit(n), F.col(n))]
    return view(spark, d, "dirty").select("record_id", "file_id", F.create_map(*pairs).alias("payload"))


_PARSE = """CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN CAST(try_strptime({0}, '%Y-%m-%d') AS DATE) WHEN regexp_full_match({0}, '\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') THEN CAST(try_strptime({0}, '%Y/%m/%d') AS DATE)
 WHEN regexp_full_match({0}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime({0}, '%d/%m/%Y') AS DATE) END"""
_BLANK = "({0} IS NULL OR trim({0}) = '')"
_p = lambda c: _PARSE.format(f'"{c}"')
_CHECKED = f"""checked AS (SELECT *, CASE WHEN {_BLANK.format('"ID_Contrato"')} THEN 'MISSING_REQUIRED_FIELD/ID_Contrato' WHEN {_BLANK.format('"Fecha_Solicitud"')} THEN 'MISSING_REQUIRED_FIELD/Fecha_Solicitud' WHEN {_p("Fecha_Solicitud")} IS NULL THEN 'INVALID_DATE/Fecha_Solicitud'
 WHEN NOT {_BLANK.format('"Fecha_Firma"')} AND {_p("Fecha_Firma")} IS NULL THEN 'INVALID_DATE/Fecha_Firma' WHEN {_BLANK.format('"Fecha_Vencimiento"')} THEN 'MISSING_REQUIRED_FIELD/Fecha_Vencimiento' WHEN {_p("Fecha_Vencimiento")} IS NULL THEN 'INVALID_DATE/Fecha_Vencimiento'
 WHEN trim("Estado_Revision") NOT IN ('No iniciado', 'En revisión', 'En renovación', 'Renovado', 'Cancelado') THEN 'OUT_OF_CATALOG/Estado_Revision' WHEN {_p("Fecha_Firma")} < {_p("Fecha_Solicitud")} THEN 'DATE_ORDER_VIOLATION/Fecha_Firma' END AS failure FROM dirty)"""


@query("P05_validate_records", with_views(f"WITH {_CHECKED} SELECT record_id, failure IS NULL AS conforming, split_part(failure, '/', 1) AS cause, split_part(failure, '/', 2) AS field FROM checked", "dirty").replace("split_part(failure, '/', 1)", "CASE WHEN failure IS NOT NULL THEN split_part(failure, '/', 1) END").replace("split_part(failure, '/', 2) AS", "CASE WHEN failure IS NOT NULL THEN split_part(failure, '/', 2) END AS"))
def _validated(spark, d):
    return val.validate_records(_records(spark, d), val.CONTRACT).select("record_id", "conforming", "cause", "field")


@query("P02_contract_columns", with_views(f'SELECT record_id, trim("ID_Contrato") AS id, {_p("Fecha_Solicitud")} AS requested, {_p("Fecha_Firma")} AS signed, {_p("Fecha_Vencimiento")} AS expires, trim("Estado_Revision") AS state FROM dirty', "dirty"))
def _typed(spark, d):
    x = val.project_contract(_records(spark, d), val.CONTRACT)
    return x.select("record_id", *[F.col(a).alias(b) for a, b in zip(_FIELDS, ["id", "requested", "signed", "expires", "state"])])


@query("P07_quarantine_split", with_views(f"WITH {_CHECKED} SELECT file_id, count(*) FILTER (failure IS NULL) AS kept, count(*) FILTER (failure IS NOT NULL) AS held FROM checked GROUP BY file_id", "dirty"))
def _split(spark, d):
    good, bad = val.split_validated(val.validate_records(_records(spark, d), val.CONTRACT))
    both = good.select("file_id", F.lit(1).alias("k")).unionByName(bad.select("file_id", F.lit(0).alias("k")))
    return both.groupBy("file_id").agg(F.sum("k").alias("kept"), F.sum(1 - F.col("k")).alias("held"))


@query("F22_cause_descriptions", with_views(f"WITH {_CHECKED} SELECT split_part(failure, '/', 1) AS cause, CASE split_part(failure, '/', 1) WHEN 'MISSING_REQUIRED_FIELD' THEN 'Falta un campo obligatorio' WHEN 'INVALID_DATE' THEN 'Fecha no válida' WHEN 'OUT_OF_CATALOG' THEN 'Valor fuera del catálogo' ELSE 'Orden de fechas no válido' END AS description, count(*) AS n FROM checked WHERE failure IS NOT NULL GROUP BY ALL", "dirty"))
def _causes(spark, d):
    bad = val.validate_records(_records(spark, d), val.CONTRACT).where("not conforming")
    return bad.select("cause", scalars.cause_description(F.col("cause")).alias("description")).groupBy("cause", "description").agg(F.count("*").alias("n"))


@query("F01_parse_dates", with_views(f'SELECT record_id, {_p("Fecha_Solicitud")} AS day FROM dirty', "dirty"))
def _dates(spark, d):
    return view(spark, d, "dirty").select("record_id", calendar.parse_date(F.col("Fecha_Solicitud")).alias("day"))


_AMOUNTS = "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' 1,234.50 ' WHEN 1 THEN '-' || o_custkey WHEN 2 THEN '1.5e3' WHEN 3 THEN 'NaN' WHEN 4 THEN 'doce' ELSE CAST(o_custkey AS VARCHAR(20)) || '.25' END AS amount FROM {orders}"


@query("F02_parse_amounts", f"SELECT o_orderkey, CAST(CASE WHEN amount = 'NaN' THEN NULL ELSE try_cast(replace(trim(amount), ',', '') AS DECIMAL(28,10)) END AS DOUBLE) AS amount FROM ({_AMOUNTS.format(orders='orders')})")
def _amounts(spark, d):
    return spark.sql(_AMOUNTS, orders=table(spark, d, "orders")).select("o_orderkey", scalars.parse_decimal(F.col("amount")).cast("double").alias("amount"))


@query("P06_audit_records", """
WITH x AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'I-' || o_orderkey END AS inc, CASE WHEN o_orderkey % 5 = 0 THEN 'grave' ELSE 'alto' END AS sev, CASE WHEN o_orderkey % 2 = 0 THEN 'A-' || o_orderkey END AS mat FROM orders),
y AS (SELECT *, inc IS NOT NULL AS ai, mat IS NOT NULL AS am FROM x)
SELECT record_id, CASE WHEN ai THEN CASE WHEN sev = 'grave' THEN 'OUT_OF_CATALOG' END WHEN NOT am THEN 'MISSING_REQUIRED_FIELD' END AS cause, CASE WHEN ai THEN CASE WHEN sev = 'grave' THEN 'Nivel_Severidad' END WHEN NOT am THEN 'ID_Incidente' END AS field FROM y""")
def _audit(spark, d):
    k = F.col("o_orderkey")
    here = k % 3 != 0
    even = k % 2 == 0
    values = {"ID_Incidente": F.when(here, F.concat(F.lit("I-"), k)), "Fecha_Evento": F.when(here, F.lit("2024-01-05")), "Area": F.when(here, F.lit("TI")), "Nivel_Severidad": F.when(here, F.when(k % 5 == 0, "grave").otherwise("alto")),
              "ID_Asunto": F.when(even, F.concat(F.lit("A-"), k)), "Tipo_Asunto": F.when(even, F.lit("Contrato")), "Estado": F.when(even, F.lit("abierto")), "Fecha": F.when(even, F.lit("5/1/2024"))}
    payload = F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)])
    return val.validate_records(table(spark, d, "orders").select(k.alias("record_id"), payload.alias("payload")), *val.AUDIT).select("record_id", "cause", "field")


@query("P03_file_structure", with_views("""
SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 'Estado_Revision' ELSE '' END AS missing, count(*) FILTER (record_id % 50 = 7) AS ragged, file_id % 4 <> 0 AND count(*) FILTER (record_id % 50 = 7) = 0 AS ok FROM dirty GROUP BY file_id""", "dirty"))
def _structure(spark, d):
    x = view(spark, d, "dirty")
    names = F.array(*[F.lit(n) for n in _FIELDS[:4]])
    headers = x.select("file_id").distinct().select("file_id", F.when(F.col("file_id") % 4 == 0, F.concat(names, F.array(F.lit("Otra")))).otherwise(F.concat(names, F.array(F.lit(_FIELDS[4])))).alias("headers"))
    rows = x.select("file_id", F.col("record_id").alias("row_number"), F.when(F.col("record_id") % 50 == 7, 6).otherwise(5).alias("width"))
    return val.validate_structure(rows, headers, val.CONTRACT)


@query("P08_check_provenance", """
WITH r AS (SELECT o_orderkey AS record_id, o_orderkey % 20 AS file_id, CASE WHEN o_orderkey % 100 = 3 THEN o_orderkey + 20 ELSE o_orderkey END AS row_number FROM orders)
SELECT record_id, file_id, row_number, 'UNKNOWN_POSITION' AS problem FROM r WHERE record_id <> row_number
UNION ALL SELECT record_id, file_id, row_number, 'DUPLICATE_POSITION' FROM r WHERE (file_id, row_number) IN (SELECT (file_id, row_number) FROM r GROUP BY file_id, row_number HAVING count(*) > 1)""".replace("(file_id, row_number) IN (SELECT (file_id, row_number) FROM r", "file_id || '/' || row_number IN (SELECT file_id || '/' || row_number FROM r"))
def _provenance(spark, d):
    k = F.col("o_orderkey")
    source = table(spark, d, "orders").select(k.alias("record_id"), (k % 20).alias("file_id"), k.alias("row_number"))
    claimed = source.withColumn("row_number", F.when(F.col("record_id") % 100 == 3, F.col("record_id") + 20).otherwise(F.col("record_id")))
    return val.check_provenance(claimed, source)


_ITEMS = "SELECT o_orderkey AS item_id, o_orderkey AS record_id, o_orderkey % 20 AS file_id, CASE o_orderkey % 5 WHEN 0 THEN 'Descartado' ELSE 'Pendiente' END AS state, CASE o_orderkey % 3 WHEN 0 THEN 'INVALID_DATE' ELSE 'OUT_OF_CATALOG' END AS cause, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM {orders}"


def _items(spark, d):
    return spark.sql(_ITEMS, orders=table(spark, d, "orders"))


@query("P09_query_quarantine", f"SELECT item_id, o_custkey AS row_number, 'LITIGIOS' AS family FROM ({_ITEMS.format(orders='orders')}) JOIN orders ON o_orderkey = record_id WHERE state = 'Pendiente' AND cause = 'INVALID_DATE' AND file_id % 4 = 1 AND created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1998-01-01'")
def _quarantine(spark, d):
    orders = table(spark, d, "orders")
    files = spark.range(20).select(F.col("id").alias("file_id"), F.when(F.col("id") % 4 == 1, "LITIGIOS").otherwise("CUMPLIMIENTO").alias("family"))
    records = orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("row_number"))
    return quar.query_quarantine(_items(spark, d), files, records, "Pendiente", "INVALID_DATE", "LITIGIOS", "1997-01-01", "1998-01-01").select("item_id", "row_number", "family")


@query("T04_quarantine_page", f"SELECT item_id, created_at FROM ({_ITEMS.format(orders='orders')}) WHERE created_at > TIMESTAMP '1996-06-01' OR created_at = TIMESTAMP '1996-06-01' AND item_id > 100 ORDER BY created_at, item_id LIMIT 51")
def _page(spark, d):
    return quar.keyset_page(_items(spark, d), ["created_at", "item_id"], (F.lit("1996-06-01").cast("timestamp"), F.lit(100)), 50).select("item_id", "created_at")


_ACTIONS = "SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN 'REINJECT' ELSE 'DISCARD' END AS action, o_orderkey % 4 = 0 AS conforming, 'NEGATIVE_AMOUNT' AS new_cause, 'nuevo' AS candidate, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'duplicado' END AS reason FROM {orders} WHERE o_orderkey % 6 <> 5"
_MOVED = f"""SELECT *, CASE WHEN action IS NULL THEN 'NONE' WHEN state <> 'Pendiente' THEN 'REFUSED' WHEN action = 'REINJECT' AND conforming THEN 'Reinyectado' WHEN action = 'REINJECT' THEN 'RETRY' WHEN trim(reason) <> '' THEN 'Descartado' ELSE 'REFUSED' END AS outcome FROM ({_ITEMS.format(orders='orders')}) LEFT JOIN ({_ACTIONS.format(orders='orders')}) USING (item_id)"""


@query("R04_quarantine_transitions", f"SELECT item_id, CASE WHEN outcome IN ('Reinyectado', 'Descartado') THEN outcome ELSE state END AS state, CASE WHEN outcome = 'RETRY' THEN new_cause ELSE cause END AS cause, CASE WHEN outcome = 'RETRY' THEN candidate END AS candidate, outcome FROM ({_MOVED})")
def _transitions(spark, d):
    return quar.apply_transitions(_items(spark, d), spark.sql(_ACTIONS, orders=table(spark, d, "orders")))


@query("R05_transition_log", f"SELECT item_id, state AS from_state, CASE WHEN outcome = 'RETRY' THEN state ELSE outcome END AS to_state, outcome FROM ({_MOVED}) WHERE outcome IN ('Reinyectado', 'RETRY', 'Descartado')")
def _log(spark, d):
    return quar.transition_log(_items(spark, d), _transitions(spark, d))


_LINES = "SELECT l_orderkey * 100 + l_partkey * 1000000 + l_suppkey AS record_id, 'O-' || l_orderkey || '-' || l_linenumber AS oid, CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) AS due, CASE WHEN l_returnflag <> 'N' THEN 'evidencia' END AS ev, CASE WHEN l_quantity < 5 THEN 'I-' || l_orderkey || '-' || l_partkey END AS inc, l_returnflag AS area, CASE WHEN l_linenumber = 1 AND l_quantity < 10 THEN 'A-' || l_orderkey END AS mat FROM {lineitem}"


def _validated_lines(spark, d, lines=None):
    x = spark.sql(_LINES, lineitem=table(spark, d, "lineitem") if lines is None else lines)
    inc, mat = F.col("inc").isNotNull(), F.col("mat").isNotNull()
    values = {"ID_Obligacion": F.col("oid"), "Fecha_Limite": F.col("due"), "Evidencia_Cumplimiento": F.col("ev"), "ID_Incidente": F.col("inc"), "Fecha_Evento": F.when(inc, F.col("due")), "Area": F.when(inc, F.col("area")), "Nivel_Severidad": F.when(inc, F.lit("alto")),
              "ID_Asunto": F.col("mat"), "Tipo_Asunto": F.when(mat, F.lit("Cumplimiento")), "Estado": F.when(mat, F.lit("abierto")), "Fecha": F.when(mat, F.col("due"))}
    return x.select("record_id", F.lit("CUMPLIMIENTO").alias("family"), F.create_map(*[y for n, v in values.items() for y in (F.lit(n), v)]).alias("payload"))


@query("R01_project_targets", f"""
WITH x AS ({_LINES.format(lineitem='lineitem')})
SELECT record_id, 'OBLIGACION' AS entity_type, oid AS business_id, due || '|' || coalesce(ev, '-') AS shown FROM x
UNION ALL SELECT record_id, 'INCIDENTE', inc, due || '|' || area || '|alto' FROM x WHERE inc IS NOT NULL
UNION ALL SELECT record_id, 'ASUNTO', mat, 'Cumplimiento|abierto|' || due FROM x WHERE mat IS NOT NULL""")
def _targets(spark, d):
    t = proj.project_targets(_validated_lines(spark, d))
    v = F.col("values")
    shown = F.when(F.col("entity_type") == "OBLIGACION", F.concat_ws("|", v["Fecha_Limite"], F.coalesce(v["Evidencia_Cumplimiento"], F.lit("-")))).when(F.col("entity_type") == "INCIDENTE", F.concat_ws("|", v["Fecha_Evento"], v["Area"], v["Nivel_Severidad"])).otherwise(F.concat_ws("|", v["Tipo_Asunto"], v["Estado"], v["Fecha"]))
    return t.select("record_id", "entity_type", "business_id", shown.alias("shown"))


_APPLY = f"""x AS ({_LINES.format(lineitem='lineitem')}),
t AS (SELECT record_id, oid, due || '|' || coalesce(ev, '-') AS p FROM x WHERE record_id % 10 <> 0),
held AS (SELECT oid, min(due || '|' || coalesce(ev, '-')) AS h FROM x WHERE record_id % 10 = 0 GROUP BY oid),
r AS (SELECT record_id, t.oid, p, h, row_number() OVER w AS n, first(p) OVER w AS lead FROM t LEFT JOIN held ON held.oid = t.oid WINDOW w AS (PARTITION BY t.oid ORDER BY record_id, p)),
res AS (SELECT *, CASE WHEN h IS NULL AND n = 1 THEN 'INCORPORADO' WHEN p = coalesce(h, lead) THEN 'IDEMPOTENTE' ELSE 'CONFLICTO' END AS result FROM r)"""


def _applied(spark, d):
    x = spark.sql(_LINES, lineitem=table(spark, d, "lineitem")).select("record_id", F.lit("OBLIGACION").alias("entity_type"), F.col("oid").alias("business_id"), F.concat_ws("|", "due", F.coalesce("ev", F.lit("-"))).alias("payload_sha256"))
    held = x.where("record_id % 10 = 0").groupBy("entity_type", "business_id").agg(F.min("payload_sha256").alias("payload_sha256"))
    none = x.where("1 = 0").withColumn("result", F.lit(""))
    new = x.where("record_id % 10 <> 0").withColumn("turn", F.struct("record_id", "payload_sha256"))
    return proj.apply_targets(new, held, none), held


@query("R02_identity_resolution", f"WITH {_APPLY} SELECT oid AS business_id, result, count(*) AS n FROM res GROUP BY ALL")
def _identity(spark, d):
    return _applied(spark, d)[0].groupBy("business_id", "result").agg(F.count("*").alias("n"))


@query("R03_identity_conflicts", f"WITH {_APPLY} SELECT record_id, oid AS business_id, h AS original, p AS candidate FROM res WHERE result = 'CONFLICTO' AND h IS NOT NULL")
def _conflicts(spark, d):
    results, held = _applied(spark, d)
    return proj.conflict_items(results, held).select("record_id", "business_id", F.col("original_sha256").alias("original"), F.col("candidate_sha256").alias("candidate"))


_FIXED = f"""fixed AS (SELECT item_id FROM ({_MOVED}) WHERE outcome = 'Reinyectado'),
x AS (SELECT l.* FROM ({_LINES.replace('SELECT ', 'SELECT l_orderkey AS item, ', 1).format(lineitem='lineitem')}) l JOIN fixed ON item_id = item),
o AS (SELECT 'OBLIGACION' AS t, oid AS k, record_id, due || '|' || coalesce(ev, '-') AS p, due FROM x UNION ALL SELECT 'INCIDENTE', inc, record_id, due || '|' || area, due FROM x WHERE inc IS NOT NULL UNION ALL SELECT 'ASUNTO', mat, record_id, due, due FROM x WHERE mat IS NOT NULL),
done AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY t, k ORDER BY record_id) = 1)"""


@query("R06_reinjected_requests", f"""
WITH {_FIXED}, r AS (SELECT CASE t WHEN 'OBLIGACION' THEN 'KPI-CN-02' WHEN 'INCIDENTE' THEN 'KPI-CN-03' ELSE 'KPI-EO-01' END AS code, CASE WHEN t = 'OBLIGACION' THEN DATE '1998-06-15' ELSE CAST(due AS DATE) END AS day FROM done)
SELECT CAST(date_trunc('month', day) AS DATE) AS period_start, last_day(day) AS period_end, greatest(CAST(date_trunc('month', day) AS DATE), least(DATE '1998-06-15', last_day(day))) AS as_of, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM r GROUP BY ALL""")
def _reinjected(spark, d):
    moved = _transitions(spark, d)
    lines = table(spark, d, "lineitem")
    own = lines.join(moved.where("outcome = 'Reinyectado'").select(F.col("item_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    corrected = _validated_lines(spark, d, own)
    items = spark.sql(_LINES, lineitem=own).select("record_id").distinct().withColumn("outcome", F.lit("Reinyectado"))
    none = corrected.select(F.lit("").alias("entity_type"), F.lit("").alias("business_id"), F.lit("").alias("payload_sha256"), "record_id", F.lit("").alias("result")).where("1 = 0")
    return proj.reproject_reinjected(items, corrected, none.select("entity_type", "business_id", "payload_sha256"), none, "1998-06-15")[1]


@query("J01_relationships", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey * 2) THEN l_orderkey * 2 END AS linked FROM lineitem")
def _relations(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_orderkey") * 2).alias("linked"))
    return proj.resolve_relationships(x, table(spark, d, "orders"), "linked", "o_orderkey")


@query("F10_name_ids", "SELECT o_orderkey, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', 1 + (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4, 1)||substr(h,18,3)||'-'||substr(h,21,12) AS id FROM (SELECT o_orderkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('order:' || o_orderkey)) AS h FROM orders)")
def _uuids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ids.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("order:"), F.col("o_orderkey"))).alias("id"))


_PATHS = "CASE o_orderkey % 7 WHEN 0 THEN 'in/' || o_custkey WHEN 1 THEN 'a..b/' || o_custkey WHEN 2 THEN '/abs/' || o_custkey WHEN 3 THEN 'in/../' || o_custkey WHEN 4 THEN 'C:' || o_custkey WHEN 5 THEN ' ' ELSE chr(92) || o_custkey END"


@query("F29_locators", f"SELECT o_orderkey, NOT (trim(p) = '' OR starts_with(p, '/') OR starts_with(p, chr(92)) OR regexp_matches(p, '^[A-Za-z]:') OR list_contains(string_split(replace(p, chr(92), '/'), '/'), '..')) AS ok FROM (SELECT o_orderkey, {_PATHS} AS p FROM orders)")
def _locators(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalars.valid_locator(F.expr(_PATHS)).alias("ok"))
