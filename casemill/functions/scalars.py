"""Scalar rules on columns: blanks, amounts, catalogues, vectors, citations."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Readable texts of the causes.
CAUSES = {
    "MISSING_REQUIRED_FIELD": "Falta un campo obligatorio",
    "INVALID_TYPE": "Tipo de dato no válido",
    "INVALID_DATE": "Fecha no válida",
    "OUT_OF_CATALOG": "Valor fuera del catálogo",
    "NEGATIVE_AMOUNT": "Importe negativo",
    "DATE_ORDER_VIOLATION": "Orden de fechas no válido",
    "STRUCTURAL_INCONSISTENCY": "Estructura inconsistente",
    "IDENTITY_CONFLICT": "Conflicto de identidad",
    "TECHNICAL_READ_FAILURE": "Fallo técnico de lectura",
    "OTHER_CAUSE": "Otra causa de rechazo",
    "FORMAT_MISMATCH": "El formato detectado no coincide con la extensión declarada",
    "ARCHIVE_LIMIT_EXCEEDED": "El contenedor supera los límites de tamaño o entradas",
    "ARCHIVE_COMPRESSION_RATIO_EXCEEDED": "El contenedor supera el límite de compresión",
    "CORRUPT_ARCHIVE": "El contenedor está corrupto o no puede leerse",
    "BINARY_CONTENT": "El archivo tabular contiene datos binarios",
    "UNSUPPORTED_ENCODING": "La codificación del archivo no está admitida",
    "UNDETERMINABLE_STRUCTURE": "No puede determinarse una estructura tabular consistente",
    "AMBIGUOUS_DELIMITER": "El separador de campos es ambiguo",
    "PROTECTED_PDF": "El PDF está protegido y no puede leerse",
    "CORRUPT_PDF": "La estructura del PDF está corrupta",
    "UNSUPPORTED_FORMAT": "El contenido no corresponde a un formato admitido",
    "TABULAR_LIMIT_EXCEEDED": "El contenido tabular supera los límites de filas, columnas o celdas",
    "PROTECTED_DOCUMENT": "El documento está protegido y no puede extraerse",
    "EMPTY_DOCUMENT": "El documento no contiene contenido extraíble",
    "TECHNICAL_FAILURE": "Fallo técnico de procesamiento",
}
#: Name, class and unit of each indicator.
INDICATORS = {
    "KPI-RC-01": ("Tiempo de ciclo del contrato", "MVP-COMPLEMENTARIO", "días"),
    "KPI-RC-03": ("Contratos próximos a vencimiento sin revisión", "MVP-NÚCLEO", "contratos"),
    "KPI-LI-01": ("Exposición total por litigios activos", "MVP-NÚCLEO", "importe"),
    "KPI-LI-05": ("Nuevos litigios por periodo", "MVP-NÚCLEO", "litigios"),
    "KPI-CN-02": ("Obligaciones regulatorias vencidas sin atender", "MVP-NÚCLEO", "obligaciones"),
    "KPI-CN-03": ("Incidentes de incumplimiento por periodo", "MVP-NÚCLEO", "incidentes"),
    "KPI-EO-01": ("Volumen de asuntos jurídicos gestionados", "MVP-COMPLEMENTARIO", "asuntos"),
}
SEVERITIES = ["alto", "medio", "bajo"]
LOW_CONFIDENCE = 0.80


def trimmed(text: Column) -> Column:
    """Without white space at either end, line ends and tabs included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_absent(text: Column) -> Column:
    return text.isNull() | text.rlike(r"^\s*$")


def parse_decimal(text: Column) -> Column:
    """Decimal from text; thousands commas and exponents allowed; null for anything else, NaN and infinities included."""
    return F.regexp_replace(trimmed(text), ",", "").try_cast("decimal(38,10)")


def in_catalog(text: Column, values: list[str]) -> Column:
    return trimmed(text).isin(values)


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def cause_description(cause: Column) -> Column:
    return F.coalesce(_looked_up(cause, CAUSES), F.lit(CAUSES["OTHER_CAUSE"]))


def with_indicator_names(observations: DataFrame, code: str = "code") -> DataFrame:
    """Observations of known indicators with their name, class and unit."""
    rows = [(k, *v) for k, v in INDICATORS.items()]
    table = observations.sparkSession.createDataFrame(rows, f"{code} string, name string, class string, unit string")
    return observations.join(F.broadcast(table), code)  # seven rows


def severity(dims: Column) -> Column:
    """The dimension nivel_severidad of a JSON text where it is a known level."""
    level = F.get_json_object(dims, "$.nivel_severidad")
    return F.when(level.isin(SEVERITIES), level)


def ocr_state(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "Pendiente").when(confidence >= LOW_CONFIDENCE, "Exitoso").otherwise("Baja_confianza")


def valid_locator(path: Column) -> Column:
    """A relative path without drive or parent steps."""
    return F.coalesce(~is_absent(path) & ~path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|\x00"), F.lit(False))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def finite_vector(v: Column) -> Column:
    """Not null, without null or non-finite parts, and not all zero."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def valid_vector(v: Column, width: int) -> Column:
    """Of the given length, finite, and not all zero."""
    return F.coalesce(F.size(v) == width, F.lit(False)) & finite_vector(v)


def reciprocal_rank(*ranks: Column) -> Column:
    """Sum of 1 / (60 + rank) over the ranks that are there."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(1.0 / (60 + r), F.lit(0.0))
    return total


def variation_percent(current: Column, previous: Column) -> Column:
    return F.when(previous != 0, (current - previous).cast("double") / previous.cast("double") * 100)


def actor_type(account: Column, process: Column) -> Column:
    return F.when(account.isNotNull(), "HUMAN").when(~is_absent(process), "PROCESS").otherwise("ANONYMOUS")


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC and case folding, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def _query_text(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n")).strip() or None)


def query_hash(text: Column) -> Column:
    """SHA-256 of a query with line ends unified, in NFC, stripped; null for empty ones."""
    return F.sha2(F.encode(_query_text(text), "UTF-8"), 256)


def lexemes(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
