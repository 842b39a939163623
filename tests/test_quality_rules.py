"""Each rule of the catalogue is broken by a row that breaks nothing else, and held by nulls."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casemill.operators import rules

DAY, H = dt.date(2024, 3, 1), "a" * 64
#: A row of each table that breaks nothing, and values that break one rule each.
GOOD = {
    "files": ({"file_id": "f", "locator": "a/b", "family": "LITIGIOS", "state": "COMPLETADO", "length": 1, "revision": 1, "cause": None}, "file_id string, locator string, family string, state string, length long, revision int, cause string"),
    "records": ({"record_id": "r", "file_id": "f", "row_number": 2, "record_sha256": H}, "record_id string, file_id string, row_number int, record_sha256 string"),
    "applications": ({"record_id": "r", "entity_type": "CONTRATO", "result": "INCORPORADO", "business_id": "C", "payload_sha256": H}, "record_id string, entity_type string, result string, business_id string, payload_sha256 string"),
    "quarantine": ({"item_id": "q", "record_id": "r", "cause": "X", "state": "Descartado", "reason": "dup", "created_at": DAY, "ended_at": DAY}, "item_id string, record_id string, cause string, state string, reason string, created_at date, ended_at date"),
    "contracts": ({"id_contrato": "C", "fecha_solicitud": DAY, "fecha_firma": DAY, "fecha_vencimiento": DAY, "estado_revision": "Renovado"}, "id_contrato string, fecha_solicitud date, fecha_firma date, fecha_vencimiento date, estado_revision string"),
    "litigation": ({"id_litigio": "L", "fecha_apertura": DAY, "estado": "Activo", "nivel_severidad": "alto", "monto_reclamado": 1.0, "estimacion_interna": 0.0}, "id_litigio string, fecha_apertura date, estado string, nivel_severidad string, monto_reclamado double, estimacion_interna double"),
    "obligations": ({"id_obligacion": "O", "fecha_limite": DAY}, "id_obligacion string, fecha_limite date"),
    "incidents": ({"id_incidente": "I", "fecha_evento": DAY, "area": "R", "nivel_severidad": "bajo"}, "id_incidente string, fecha_evento date, area string, nivel_severidad string"),
    "matters": ({"id_asunto": "A", "fecha": DAY, "estado": "x", "tipo_asunto": "Litigio"}, "id_asunto string, fecha date, estado string, tipo_asunto string"),
    "observations": ({"observation_id": "o", "code": "KPI-LI-05", "period_start": DAY, "period_end": dt.date(2024, 3, 31), "dims": "{}", "availability": "DISPONIBLE", "value": 1.0}, "observation_id string, code string, period_start date, period_end date, dims string, availability string, value double"),
    "findings": ({"finding_id": "h", "evaluation_id": "e", "description": "d", "rule": "r", "period_start": DAY, "period_end": DAY}, "finding_id string, evaluation_id string, description string, rule string, period_start date, period_end date"),
    "evaluations": ({"evaluation_id": "e", "code": "KPI-LI-05", "dims": "{}", "month": DAY, "outcome": "EVALUATED", "trend": None, "recurrence": 1, "signal": True, "current": 2.0, "reference": 1.0}, "evaluation_id string, code string, dims string, month date, outcome string, trend string, recurrence int, signal boolean, current double, reference double"),
    "chunks": ({"chunk_id": "c", "version_id": "v", "content": "x", "ordinal": 0, "token_count": 1, "page_start": 1, "page_end": 2}, "chunk_id string, version_id string, content string, ordinal int, token_count int, page_start int, page_end int"),
    "terms": ({"chunk_id": "c", "lexeme": "x", "tf": 1}, "chunk_id string, lexeme string, tf int"),
    "receipts": ({"chunk_id": "c", "contract": "k", "lexical_terms": 0}, "chunk_id string, contract string, lexical_terms int"),
    "certificates": ({"version_id": "v", "contract": "k", "model": "m", "chunks": 2, "dimensions": 4, "embedded": 2, "lexical": 2, "without_terms": 0, "chunk_size": 5, "chunk_overlap": 1, "text_sha256": H}, "version_id string, contract string, model string, chunks int, dimensions int, embedded int, lexical int, without_terms int, chunk_size int, chunk_overlap int, text_sha256 string"),
}
BAD = {
    "REFUSED_CAUSE": {"state": "RECHAZADO"}, "RECORD_DIGEST": {"record_sha256": "x"}, "DIGEST": {"payload_sha256": ""}, "DISCARD_REASON": {"reason": " "}, "OPEN_END": {"state": "Pendiente"}, "MONTH_START": {"period_start": dt.date(2024, 3, 2)},
    "MONTH_END": {"period_end": dt.date(2024, 3, 30)}, "AVAILABLE_VALUE": {"value": None}, "GROUP_IS_OBJECT": {"dims": "[]"}, "RECURRENCE_RANGE": {"recurrence": 5}, "UNSURE_WITHOUT_SIGNAL": {"outcome": "INSUFFICIENT_HISTORY"}, "SURE_WITH_VALUES": {"reference": None},
    "EMBEDDED_WITHIN": {"embedded": 3}, "LEXICAL_WITHIN": {"lexical": 3}, "EMPTY_WITHIN": {"without_terms": 3}, "OVERLAP_WITHIN": {"chunk_overlap": 5}, "TEXT_DIGEST": {"text_sha256": "x"},
}


def spoilt(row, rule):
    """What must change in a row so that it breaks the rule."""
    kind, _, rest = rule.partition("_")
    if rule in BAD:
        return BAD[rule]
    if kind == "REQUIRED":
        return {rest: None}
    if kind == "FILLED":
        return {rest: ""}
    if kind == "KNOWN":
        return {rest: "nothing of the kind"}
    if kind == "LEAST":
        return {rest: type(row[rest])(-1)}
    if kind == "ORDER":
        last = next(c for c in row if rest.endswith("_" + c))
        return {last: dt.date(1990, 1, 1) if isinstance(row[last], dt.date) else -1}
    return {}


@pytest.fixture(scope="module")
def found(spark):
    tables, planted = {}, set()
    for name, r in rules.CATALOGUE.items():
        row, layout = GOOD[name]
        rows = [row]
        for rule in r.names():
            new = dict(row)
            if rule.startswith("UNIQUE_"):
                columns = next(u for u in r.unique if "UNIQUE_" + "_".join(u) == rule)
                if r.key not in columns:
                    new[r.key] = rule
            elif rule.startswith("REFERENCE_"):
                columns = next(c for c in r.references if "REFERENCE_" + "_".join(c) == rule)
                new.update({r.key: rule, columns[0]: "nowhere"})
            else:
                new[r.key] = rule
                new.update(spoilt(row, rule))
            rows.append(new)
            planted.add((name, rule))
        rows.append({c: None for c in row})
        tables[name] = spark.createDataFrame([tuple(x[c] for c in row) for x in rows], layout)
    got = rules.check_tables(tables, rules.CATALOGUE)
    return planted, {(r["table"], r.rule) for r in got.collect()}, [(r["table"], r.key, r.rule) for r in got.where(F.col("key").isNull()).collect()]


def test_every_rule_is_broken_once(found):
    planted, got, _ = found
    assert planted - got == set()
    assert len(planted) > 90


def test_nulls_break_required_columns_alone(found):
    assert {rule.partition("_")[0] for _, _, rule in found[2]} == {"REQUIRED"}


def test_good_rows_break_nothing(spark):
    tables = {name: spark.createDataFrame([tuple(row.values())], layout) for name, (row, layout) in GOOD.items()}
    assert rules.check_tables(tables, rules.CATALOGUE).collect() == []
