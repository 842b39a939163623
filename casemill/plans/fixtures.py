"""Views over the driver's tables that stand for the entities, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "contracts": """
SELECT 'C-' || o_orderkey AS id_contrato, CAST(o_orderdate AS DATE) AS fecha_solicitud,
  min(CASE WHEN CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) THEN CAST(l_shipdate AS DATE) END) AS fecha_firma,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL '180' DAY AS DATE) AS fecha_vencimiento,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'No iniciado' WHEN '2-HIGH' THEN 'En revisión' WHEN '3-MEDIUM' THEN 'En renovación' WHEN '4-NOT SPECIFIED' THEN 'Renovado' ELSE 'Cancelado' END AS estado_revision
FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate, o_orderpriority""",
    "litigation": """
SELECT 'L-' || o_orderkey AS id_litigio, CAST(o_orderdate AS DATE) AS fecha_apertura,
  CASE o_orderstatus WHEN 'O' THEN 'Activo' WHEN 'F' THEN 'Cerrado' ELSE 'Suspendido' END AS estado,
  CASE WHEN o_orderpriority < '3' THEN 'alto' WHEN o_orderpriority < '4' THEN 'medio' ELSE 'bajo' END AS nivel_severidad,
  CAST(o_totalprice AS DECIMAL(18,2)) AS monto_reclamado,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(20,3)) END AS estimacion_interna
FROM {orders}""",
    "obligations": """
SELECT 'O-' || l_orderkey || '-' || l_linenumber AS id_obligacion, min(CAST(l_shipdate AS DATE)) AS fecha_limite,
  max(CASE WHEN l_returnflag <> 'N' THEN 'evidencia' END) AS evidencia_cumplimiento
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "incidents": """
SELECT 'I-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id_incidente, CAST(l_shipdate AS DATE) AS fecha_evento, l_returnflag AS area,
  CASE WHEN l_quantity >= 34 THEN 'alto' WHEN l_quantity >= 17 THEN 'medio' ELSE 'bajo' END AS nivel_severidad
FROM {lineitem}""",
    "matters": """
SELECT 'A-' || o_custkey AS id_asunto,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Contrato' WHEN '2-HIGH' THEN 'Litigio' WHEN '3-MEDIUM' THEN 'Cumplimiento' WHEN '4-NOT SPECIFIED' THEN 'Auditoría' ELSE 'Otro' END AS tipo_asunto,
  o_orderstatus AS estado, CAST(o_orderdate AS DATE) AS fecha
FROM {orders}""",
    "versions": """
SELECT doc_id, CAST(v AS INT) AS version, lang, source, text, 'V-' || doc_id || '-' || v AS version_id,
  CASE lang WHEN 'en' THEN 'CONTRATOS_DOCUMENTOS' WHEN 'es' THEN 'LITIGIOS' WHEN 'fr' THEN 'CUMPLIMIENTO' ELSE 'AUDITORIA_INTERNA' END AS family,
  CASE WHEN doc_id % 10 = 0 THEN NULL ELSE DATE '2024-01-01' END AS document_date
FROM {documents} CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v) x WHERE v = 1 OR doc_id % 5 = 0""",
    "ocr_runs": """
SELECT doc_id, version, attempt, version_id, version_id || '-' || attempt AS run_id,
  CASE WHEN (doc_id + attempt) % 13 = 0 THEN NULL ELSE CAST((doc_id * 37 + version * 11 + attempt * 5) % 101 AS DOUBLE) / 100 END AS confidence,
  attempt = 2 OR doc_id % 3 <> 0 AS is_final, CAST(doc_id % 7 AS INT) AS processed_at
FROM (SELECT doc_id, CAST(v AS INT) AS version, 'V-' || doc_id || '-' || v AS version_id, CAST(a AS INT) AS attempt
  FROM {documents} CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v) x CROSS JOIN (SELECT 1 AS a UNION ALL SELECT 2 AS a) y WHERE (v = 1 OR doc_id % 5 = 0) AND (a = 1 OR doc_id % 2 = 0)) r""",
    "requests": """
SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start, last_day(CAST(o_orderdate AS DATE)) AS period_end, last_day(CAST(o_orderdate AS DATE)) AS as_of
FROM {orders}""",
    "observations": """
SELECT code, dims, period_start, last_day(period_start) AS period_end, CASE WHEN m % 11 = 5 THEN 'NO_DISPONIBLE' ELSE 'DISPONIBLE' END AS availability,
  CASE WHEN m % 11 = 5 THEN NULL ELSE CAST(value AS DECIMAL(38,10)) END AS value, code || '/' || dims || '/' || CAST(period_start AS VARCHAR(20)) AS observation_id
FROM (
  SELECT code, dims, month AS period_start, year(month) * 12 + month(month) AS m, value FROM (
    SELECT 'KPI-LI-05' AS code, '{{}}' AS dims, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(count(*) AS DECIMAL(30,2)) AS value FROM {orders} GROUP BY 3
    UNION ALL SELECT 'KPI-RC-03', '{{}}', CAST(date_trunc('month', o_orderdate) AS DATE), CAST(count(CASE WHEN o_orderpriority < '2' AND o_custkey % 5 = 0 THEN 1 END) AS DECIMAL(30,2)) FROM {orders} GROUP BY 3
    UNION ALL SELECT 'KPI-CN-02', '{{}}', CAST(date_trunc('month', o_orderdate) AS DATE), CAST(count(CASE WHEN o_orderkey % 29 = 0 THEN 1 END) AS DECIMAL(30,2)) FROM {orders} GROUP BY 3
    UNION ALL SELECT 'KPI-RC-01', '{{}}', CAST(date_trunc('month', o_orderdate) AS DATE), CAST(max(o_orderkey % 90) AS DECIMAL(30,2)) FROM {orders} GROUP BY 3
    UNION ALL SELECT 'KPI-LI-01', CASE WHEN o_orderpriority < '3' THEN '{{"nivel_severidad":"alto"}}' WHEN o_orderpriority < '4' THEN '{{"nivel_severidad":"medio"}}' ELSE '{{"nivel_severidad":"bajo"}}' END, CAST(date_trunc('month', o_orderdate) AS DATE), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(30,2)) FROM {orders} GROUP BY 2, 3
    UNION ALL SELECT 'KPI-CN-03', '{{"area":"' || l_returnflag || '","nivel_severidad":"' || CASE WHEN l_quantity >= 34 THEN 'alto' WHEN l_quantity >= 17 THEN 'medio' ELSE 'bajo' END || '"}}', CAST(date_trunc('month', l_shipdate) AS DATE), CAST(count(*) AS DECIMAL(30,2)) FROM {lineitem} GROUP BY 2, 3) x) y
WHERE m % 13 <> length(dims) % 13 OR code = 'KPI-CN-03' AND m % 3 = 0""",
    "dirty": """
SELECT o_orderkey AS record_id, o_orderkey % 20 AS file_id,
  CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE 'C-' || o_orderkey END AS "ID_Contrato",
  CASE WHEN o_orderkey % 11 = 0 THEN '31/02/2024' WHEN o_orderkey % 11 = 1 THEN '2024/3/' || (1 + o_orderkey % 28) ELSE '2024-03-' || (10 + o_orderkey % 19) END AS "Fecha_Solicitud",
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '5/1/2023' ELSE '2024-05-01' END AS "Fecha_Firma",
  CASE WHEN o_orderkey % 17 = 0 THEN 'pronto' ELSE '2025-01-31' END AS "Fecha_Vencimiento",
  CASE WHEN o_orderkey % 19 = 0 THEN 'Perdido' ELSE ' Renovado' END AS "Estado_Revision"
FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """The view of a name over the driver's tables; tables that the caller has, dealt in another way, are given by name."""
    sql = re.sub(r'AS "(\w+)"', r"AS `\1`", VIEWS[name])
    used = {t: given[t] if t in given else table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that all machines share, under spark.checkpoint.dir; a local session without that setting gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
    return f"{at}/{name}-{uuid.uuid4().hex}"


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that starts from the named views."""
    own = [f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    head, rest = ("WITH ", sql.strip())
    if rest.upper().startswith("WITH "):
        rest = rest[5:]
        return head + ",\n".join(own) + ",\n" + rest
    return head + ",\n".join(own) + "\n" + rest
