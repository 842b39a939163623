"""Data-quality rules of tables as data, compiled to columns and anti joins.

A check is broken where its condition is false; where it is unknown, by a null, it holds, as in SQL.  Unique
columns are broken by rows that share all of them; a row with a null among them is unlike any other.  A
reference is broken where its target lacks the value; a null refers to nothing.  A required column is broken
by a null.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.operators.parts import dealt


@dataclass(frozen=True)
class Rules:
    """Of one table: its key, required columns, checks (name -> condition in SQL), unique sets of columns, and references (columns -> table and its columns)."""

    key: str
    required: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[tuple[str, ...], tuple[str, tuple[str, ...]]] = field(default_factory=dict)

    def names(self) -> list[str]:
        """Of all rules, as violations call them."""
        return [f"REQUIRED_{c}" for c in self.required] + list(self.checks) + ["UNIQUE_" + "_".join(u) for u in self.unique] + ["REFERENCE_" + "_".join(r) for r in self.references]


#: Copies of a row that are told at once.
TOLD = 1 << 16


def _as_often(df: DataFrame, n: str) -> DataFrame:
    """Each row of df as often as its column n tells, TOLD at once."""
    steps = df.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(`{n}` - 1) div {TOLD}"))).alias("_step"))
    return steps.select(*df.columns, F.explode(F.sequence(F.lit(1), F.least(F.lit(TOLD), F.col(n) - F.col("_step") * TOLD))).alias("_copy")).drop("_copy")


def broken_rules(name: str, df: DataFrame, rules: Rules, tables: dict[str, DataFrame], rows: int | None = None) -> DataFrame:
    """(table, key, rule): a row for each rule that a row of df breaks; a row that repeats is told as often as it is there.

    Checks and required columns are one reading without a shuffle.  Unique sets are counted; where the key
    is one of their columns the counts tell the rows, else they are told by joining the sets that repeat.
    With the number of df's rows, a task counts a bounded part of them.  References are anti joins with the
    targets' distinct values.
    """
    tell = lambda rows, rule: rows.select(F.lit(name).alias("table"), F.col(rules.key).cast("string").alias("key"), F.lit(rule).alias("rule"))
    plain = [F.when(F.col(c).isNull(), F.lit(f"REQUIRED_{c}")) for c in rules.required]
    plain += [F.when(~F.expr(condition), F.lit(rule)) for rule, condition in rules.checks.items()]
    found = [df.select(F.lit(name).alias("table"), F.col(rules.key).cast("string").alias("key"), F.explode(F.filter(F.array(*plain), lambda r: r.isNotNull())).alias("rule"))] if plain else []
    # values of these types that group as one are written alike
    plain_key = dict(df.dtypes)[rules.key].split("(")[0] in ("string", "tinyint", "smallint", "int", "bigint", "date", "timestamp", "decimal", "boolean")
    for columns in rules.unique:
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        twice = dealt(df.where(whole).select(*columns), rows, *columns).groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1")
        told = _as_often(twice, "_n") if plain_key and rules.key in columns else df.join(twice.drop("_n"), list(columns), "left_semi")
        found.append(tell(told, "UNIQUE_" + "_".join(columns)))
    for columns, (target, theirs) in rules.references.items():
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        there = tables[target].select(*[F.col(t).alias(c) for c, t in zip(columns, theirs)]).distinct()
        found.append(tell(df.where(whole).join(there, list(columns), "left_anti"), "REFERENCE_" + "_".join(columns)))
    return reduce(DataFrame.unionByName, found)


def check_tables(tables: dict[str, DataFrame], catalogue: dict[str, Rules], rows: dict[str, int] | None = None) -> DataFrame:
    """The broken rules of all tables that the catalogue names and that are there. rows: of tables, where they are known."""
    return reduce(DataFrame.unionByName, [broken_rules(name, tables[name], rules, tables, (rows or {}).get(name)) for name, rules in catalogue.items() if name in tables])


def _filled(*columns: str) -> dict[str, str]:
    return {f"FILLED_{c}": f"{c} <> ''" for c in columns}


def _among(column: str, *values: str) -> dict[str, str]:
    return {f"KNOWN_{column}": f"{column} IN ({', '.join(repr(v) for v in values)})"}


def _in_order(first: str, last: str) -> dict[str, str]:
    return {f"ORDER_{first}_{last}": f"{last} >= {first}"}


def _at_least(least: str, *columns: str) -> dict[str, str]:
    return {f"LEAST_{c}": f"{c} >= {least}" for c in columns}


_DIGEST = {"DIGEST": "length(payload_sha256) = 64"}
_MONTH = {"MONTH_START": "day(period_start) = 1", "MONTH_END": "period_end = last_day(period_start)"}
_VALUE = {"AVAILABLE_VALUE": "(availability = 'DISPONIBLE') = (value IS NOT NULL)"}
_CODES = ("KPI-RC-01", "KPI-RC-03", "KPI-LI-01", "KPI-LI-05", "KPI-CN-02", "KPI-CN-03", "KPI-EO-01", "KPI-CD-03")
#: What must hold of the tables that this library keeps.
CATALOGUE = {
    "files": Rules(
        "file_id", ("locator", "family", "state"),
        {**_among("family", "CONTRATOS_DOCUMENTOS", "LITIGIOS", "CUMPLIMIENTO", "AUDITORIA_INTERNA"), **_among("state", "RECIBIDO", "EN_PROCESO", "COMPLETADO", "RECHAZADO", "FALLIDO"), **_at_least("0", "length"), **_at_least("1", "revision"), "REFUSED_CAUSE": "state <> 'RECHAZADO' OR cause IS NOT NULL"},
        (("file_id",), ("locator", "revision")),
    ),
    "records": Rules("record_id", ("file_id",), {**_at_least("1", "row_number"), "RECORD_DIGEST": "length(record_sha256) = 64"}, (("record_id",), ("file_id", "row_number")), {("file_id",): ("files", ("file_id",))}),
    "applications": Rules(
        "record_id", ("record_id", "entity_type", "result"),
        {**_filled("business_id"), **_DIGEST, **_among("entity_type", "CONTRATO", "LITIGIO", "OBLIGACION", "INCIDENTE", "ASUNTO"), **_among("result", "INCORPORADO", "IDEMPOTENTE", "CONFLICTO")},
        (("record_id", "entity_type", "business_id"),), {("record_id",): ("records", ("record_id",))},
    ),
    "quarantine": Rules(
        "item_id", ("record_id", "cause"),
        {**_among("state", "Pendiente", "Reinyectado", "Descartado"), "DISCARD_REASON": "state <> 'Descartado' OR trim(reason) <> ''", "OPEN_END": "(state = 'Pendiente') = (ended_at IS NULL)", **_in_order("created_at", "ended_at")},
        (("item_id",),), {("record_id",): ("records", ("record_id",))},
    ),
    "contracts": Rules("id_contrato", ("fecha_solicitud", "fecha_vencimiento"), {**_filled("id_contrato"), **_in_order("fecha_solicitud", "fecha_firma"), **_among("estado_revision", "No iniciado", "En revisión", "En renovación", "Renovado", "Cancelado")}, (("id_contrato",),)),
    "litigation": Rules("id_litigio", ("fecha_apertura",), {**_filled("id_litigio", "estado"), **_among("nivel_severidad", "alto", "medio", "bajo"), **_at_least("0", "monto_reclamado", "estimacion_interna")}, (("id_litigio",),)),
    "obligations": Rules("id_obligacion", ("fecha_limite",), _filled("id_obligacion"), (("id_obligacion",),)),
    "incidents": Rules("id_incidente", ("fecha_evento",), {**_filled("id_incidente", "area"), **_among("nivel_severidad", "alto", "medio", "bajo")}, (("id_incidente",),)),
    "matters": Rules("id_asunto", ("fecha",), {**_filled("id_asunto", "estado"), **_among("tipo_asunto", "Contrato", "Litigio", "Cumplimiento", "Auditoría")}, (("id_asunto",),)),
    "observations": Rules("observation_id", ("code", "period_start", "period_end"), {**_among("code", *_CODES), **_among("availability", "DISPONIBLE", "NO_DISPONIBLE"), **_MONTH, **_VALUE, "GROUP_IS_OBJECT": "dims LIKE '{%}'"}, (("observation_id",), ("code", "period_start", "period_end", "dims"))),
    "findings": Rules("finding_id", ("evaluation_id",), {**_filled("description", "rule"), **_in_order("period_start", "period_end")}, (("finding_id",), ("evaluation_id", "rule")), {("evaluation_id",): ("evaluations", ("evaluation_id",))}),
    "evaluations": Rules(
        "evaluation_id", ("code", "dims", "month"),
        {**_among("outcome", "EVALUATED", "INSUFFICIENT_HISTORY"), **_among("trend", "INCREASING", "DECREASING"), "RECURRENCE_RANGE": "recurrence BETWEEN 0 AND 4", "UNSURE_WITHOUT_SIGNAL": "outcome = 'EVALUATED' OR NOT signal", "SURE_WITH_VALUES": "outcome <> 'EVALUATED' OR current IS NOT NULL AND reference IS NOT NULL AND recurrence IS NOT NULL"},
        (("evaluation_id",),),
    ),
    "chunks": Rules("chunk_id", ("version_id", "content"), {**_at_least("0", "ordinal"), **_at_least("1", "token_count", "page_start"), **_in_order("page_start", "page_end")}, (("chunk_id",), ("version_id", "ordinal"))),
    "terms": Rules("chunk_id", (), {**_filled("lexeme"), **_at_least("1", "tf")}, (("chunk_id", "lexeme"),), {("chunk_id",): ("chunks", ("chunk_id",))}),
    "receipts": Rules("chunk_id", ("contract",), _at_least("0", "lexical_terms"), (("chunk_id",),), {("chunk_id",): ("chunks", ("chunk_id",))}),
    "certificates": Rules(
        "version_id", ("contract", "model"),
        {**_at_least("1", "chunks", "dimensions"), "EMBEDDED_WITHIN": "embedded BETWEEN 0 AND chunks", "LEXICAL_WITHIN": "lexical BETWEEN 0 AND chunks", "EMPTY_WITHIN": "without_terms BETWEEN 0 AND lexical", "OVERLAP_WITHIN": "chunk_overlap >= 0 AND chunk_overlap < chunk_size", "TEXT_DIGEST": "length(text_sha256) = 64"},
        (("version_id",),),
    ),
}
