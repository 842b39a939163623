"""Landing folders: files, formats, delimiters, records, receipts."""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The family of each landing folder.
FAMILIES = {"contratos_documentos": "CONTRATOS_DOCUMENTOS", "litigios": "LITIGIOS", "cumplimiento": "CUMPLIMIENTO", "auditoria_interna": "AUDITORIA_INTERNA"}
#: Limits of a table, and the delimiters that are tried.
MAX_ROWS, MAX_COLUMNS, MAX_CELLS = 250_000, 256, 5_000_000
MAX_BYTES = 52_428_800
DELIMITERS = {",": "comma", ";": "semicolon", "\t": "tab", "|": "pipe"}
SAMPLE = 65_536


def family_of(path):
    folder = F.lower(F.element_at(F.split(path, "/"), -2))
    return F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), folder)


def _locator(path):
    return F.concat_ws("/", F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1))


def list_landing(spark: SparkSession, root: str, before: str) -> DataFrame:
    """(locator, length, modificationTime) of the files in the known folders that had come before a time, without opening them."""
    raw = spark.read.format("binaryFile").load(f"{root}/*/").select("path", "length", "modificationTime").where(F.col("modificationTime") < F.lit(before).cast("timestamp"))
    return raw.where(family_of(F.col("path")).isNotNull()).select(_locator(F.col("path")).alias("locator"), "length", "modificationTime")


def read_landing(spark: SparkSession, root: str, stream: bool = False, before: str | None = None) -> DataFrame:
    """(file_id, locator, family, length, content, content_sha256) of the files in the known folders under root, those that had come before a time if there is one."""
    if stream:
        raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", 100).load(f"{root}/*/")
    else:
        raw = spark.read.format("binaryFile").load(f"{root}/*/")
        raw = raw if before is None else raw.where(F.col("modificationTime") < F.lit(before).cast("timestamp"))
    x = raw.withColumn("family", family_of(F.col("path"))).where("family is not null")
    digest = F.sha2(F.col("content"), 256)
    return x.select(F.sha2(F.concat_ws("/", _locator(F.col("path")), digest), 256).alias("file_id"), _locator(F.col("path")).alias("locator"), "family", "length", "content", digest.alias("content_sha256"))


def classify_files(files: DataFrame) -> DataFrame:
    """files with detected_format (PDF, ZIP, CSV), accepted and cause: by magic bytes, then NUL bytes, then encoding, then the declared suffix."""
    head = F.substring("content", 1, 5)
    kind = F.when(head == F.lit(b"%PDF-"), "PDF").when(F.substring("content", 1, 4) == F.lit(b"PK\x03\x04"), "ZIP").otherwise("CSV")
    suffix = F.lower(F.regexp_extract("locator", r"\.([A-Za-z0-9]+)$", 1))
    # NUL bytes survive a Latin-1 reading, which maps every byte to one character
    nul = F.decode("content", "ISO-8859-1").contains("\x00")
    declared = F.when(suffix == "pdf", "PDF").when(suffix.isin("xlsx", "docx"), "ZIP").when(suffix == "csv", "CSV")
    cause = F.when((F.col("detected_format") == "CSV") & nul, "BINARY_CONTENT").when((F.col("detected_format") == "CSV") & ~F.is_valid_utf8(F.col("content").cast("string")), "UNSUPPORTED_ENCODING").when(declared.isNull(), "UNSUPPORTED_EXTENSION").when(declared != F.col("detected_format"), "FORMAT_MISMATCH")
    x = files.withColumn("detected_format", kind).withColumn("cause", cause)
    return x.withColumn("accepted", F.col("cause").isNull())


def _widths(text: str, mark: str) -> Counter | None:
    """How many rows have how many fields; None where the quotes are out of order."""
    try:
        return Counter(map(len, filter(None, csv.reader(io.StringIO(text), delimiter=mark, strict=True))))
    except csv.Error:
        return None


#: By whether one mark fits, several, or none, and whether some mark cuts unevenly: the cause, if it is one.
_OUTCOME = {("one", False): None, ("one", True): None, ("none", False): None, ("none", True): "UNDETERMINABLE_STRUCTURE", ("several", False): "AMBIGUOUS_DELIMITER", ("several", True): "AMBIGUOUS_DELIMITER"}


def _table(content: bytes) -> tuple[str | None, str | None]:
    """(delimiter, cause) of a CSV file, from a sample without its cut last line; the quotes count to the file's end."""
    text = content[:SAMPLE].decode("utf-8-sig", "ignore")
    text = text if len(content) <= SAMPLE else text[: text.rfind("\n") + 1]
    counts = {mark: _widths(text, mark) for mark in DELIMITERS}
    even = [mark for mark, n in counts.items() if n is not None and len(n) == 1 and max(n) > 1]
    cause = _OUTCOME[("none", "one", "several")[min(len(even), 2)], any(n is not None and len(n) > 1 for n in counts.values())]
    mark = even[0] if even else ","
    broken = None in counts.values() or cause is None and len(content) > SAMPLE and _widths(content.decode("utf-8-sig", "replace"), mark) is None
    cause = "UNDETERMINABLE_STRUCTURE" if broken else cause
    return (None if cause else mark), cause


def infer_delimiter(files: DataFrame) -> DataFrame:
    """(file_id, delimiter, cause) of CSV files: the only mark that gives one width above one; a file that none splits has one column."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [_table(bytes(c)) for c in f["content"]]
            yield pd.DataFrame({"file_id": f["file_id"], "delimiter": [x[0] for x in found], "cause": [x[1] for x in found]})

    return files.select("file_id", "content").mapInPandas(each, "file_id string, delimiter string, cause string")


def read_delimited(files: DataFrame) -> DataFrame:
    """(file_id, row_number, cells) of CSV files (file_id, content, delimiter): the header is row 1; ragged rows stay as they are, blank lines do not count.  Quotes are read strictly, as infer_delimiter did for the whole file."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file_id, content, mark in zip(f["file_id"], f["content"], f["delimiter"]):
                rows = []
                for n, r in enumerate(csv.reader(io.StringIO(bytes(content).decode("utf-8-sig")), delimiter=mark, strict=True), 1):
                    rows.append((file_id, n, r))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["file_id", "row_number", "cells"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file_id", "row_number", "cells"])

    return files.where("delimiter is not null").select("file_id", "content", "delimiter").mapInPandas(each, "file_id string, row_number int, cells array<string>").where(F.size("cells") > 0)


def headers_of(rows: DataFrame) -> DataFrame:
    """(file_id, headers): the first row of each file."""
    return rows.where("row_number = 1").select("file_id", F.col("cells").alias("headers"))


def to_payload(rows: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(file_id, row_number, width, payload, record_sha256): cells by header, surplus ones as column_<n>; headers repeated keep the last cell.  headers: headers_of(rows), if it is there already."""
    x = rows.where("row_number > 1").join(headers_of(rows) if headers is None else headers, "file_id")
    names = F.transform(F.sequence(F.lit(1), F.size("cells")), lambda i: F.coalesce(F.try_element_at("headers", i), F.concat(F.lit("column_"), i.cast("string"))))
    payload = F.map_from_entries(F.transform(F.array_distinct(names), lambda k: F.struct(k, F.element_at("cells", F.size("cells") - F.array_position(F.reverse(names), k).cast("int") + 1))))
    x = x.select("file_id", "row_number", F.size("cells").alias("width"), payload.alias("payload"))
    return x.withColumn("record_sha256", F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("payload")))), 256))


def enforce_tabular_limits(rows: DataFrame, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS, max_cells: int = MAX_CELLS) -> DataFrame:
    """(file_id, cause) of files beyond the limits of rows, columns or cells; the header is a row of columns only."""
    body = rows.where("row_number > 1")
    n = rows.groupBy("file_id").agg(F.max(F.size("cells")).alias("columns"))
    c = body.groupBy("file_id").agg(F.count("*").alias("rows"), F.sum(F.size("cells")).alias("cells"))
    return n.join(c, "file_id", "left").where((F.col("columns") > max_columns) | (F.col("rows") > max_rows) | (F.col("cells") > max_cells)).select("file_id", F.lit("TABULAR_LIMIT_EXCEEDED").alias("cause"))


def reject_oversize(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Receipts of files over the size limit: refused, with the size seen and no digest."""
    return files.where(F.col("length") > max_bytes).select("locator", "family", F.lit("RECHAZADO").alias("state"), F.lit("RESOURCE_LIMIT_EXCEEDED").alias("cause"), F.col("length").alias("observed_bytes"), F.lit(None).cast("string").alias("content_sha256"))


def reject_empty_invalid(headers: DataFrame, rows: DataFrame, required: list[str]) -> DataFrame:
    """Files without rows that also lack required columns."""
    full = rows.where("row_number > 1").select("file_id").distinct()
    missing = F.array_except(F.array(*[F.lit(c) for c in required]), "headers")
    return headers.join(full, "file_id", "left_anti").where(F.size(missing) > 0).select("file_id", F.lit("RECHAZADO").alias("state"), F.lit("STRUCTURAL_INCONSISTENCY").alias("cause"))


def dedupe_receipts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new (locator, content_sha256, actor, idempotency_key, turn) with outcome NEW, REPLAYED or CONFLICT.

    The same locator and content as a receipt, or as an earlier row of the batch, is a replay; a key of
    the same actor that stands for other content is a conflict.
    """
    seen = existing.select("locator", "content_sha256").distinct().withColumn("seen", F.lit(True))
    keys = existing.where("idempotency_key is not null").groupBy("actor", "idempotency_key").agg(F.min("content_sha256").alias("held"))
    x = new.join(seen, ["locator", "content_sha256"], "left").join(keys, ["actor", "idempotency_key"], "left")
    by_key = Window.partitionBy("actor", "idempotency_key").orderBy("turn")
    x = x.withColumn("lead", F.when(F.col("idempotency_key").isNotNull(), F.first("content_sha256").over(by_key)))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("locator", "content_sha256").orderBy("turn")))
    outcome = F.when(F.coalesce("held", "lead") != F.col("content_sha256"), "CONFLICT").when(F.col("seen") | (F.col("n") > 1), "REPLAYED").otherwise("NEW")
    return x.withColumn("outcome", outcome).drop("seen", "held", "lead", "n")


def next_revision(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new receipts with their revision, counted on from the locator's highest."""
    top = existing.groupBy("locator").agg(F.max("revision").alias("top"))
    return new.join(top, "locator", "left").withColumn("revision", F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("locator").orderBy("turn"))).drop("top")


def route_receipts(receipts: DataFrame) -> DataFrame:
    """receipts (state, detected_format) with the target: validation for tables, documents for documents, nothing for what was not completed."""
    return receipts.withColumn("target", F.when(F.col("state") != "COMPLETADO", "NONE").when(F.col("detected_format").isin("CSV", "XLSX"), "VALIDATION").when(F.col("detected_format").isin("PDF", "DOCX"), "DOCUMENT").otherwise("NONE"))


def renumber(records: DataFrame) -> DataFrame:
    """records (file_id, sheet, row, record_id) with position 1, 2 …: by sheet, row (nulls last), id."""
    return records.withColumn("position", F.row_number().over(Window.partitionBy("file_id").orderBy("sheet", F.col("row").asc_nulls_last(), "record_id")))
