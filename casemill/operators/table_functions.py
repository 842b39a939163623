"""Table functions for SQL: chunks and offsets of the texts of a table.

    SELECT * FROM chunk_fixed(TABLE(docs), 512, 50)
    SELECT * FROM chunk_structural(TABLE(docs), 512, 50)
    SELECT * FROM token_offsets(TABLE(docs))

The table has the columns doc_id, of any type, and text; others may be there.  Null texts have no words.
A session that registers them for one type of doc_id has token_offsets by columns, for tables of that type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from casemill.operators.corpus import OVERLAP, SIZE, _portions, structural_chunks, token_offsets

#: Words whose rows a task sends at once.
WORDS = 1 << 17


def _key(table: AnalyzeArgument) -> StructField:
    if not table.isTable or not {"doc_id", "text"} <= set(table.dataType.names):
        raise ValueError("the first argument is a table with the columns doc_id and text")
    return StructField("doc_id", table.dataType["doc_id"].dataType)


def _number(argument: AnalyzeArgument | None, default: int) -> int:
    if argument is None:
        return default
    if not isinstance(argument.dataType, IntegerType) or argument.value is None:
        raise ValueError("size and overlap are integer constants")
    return argument.value


def _layout(table: AnalyzeArgument, size: AnalyzeArgument | None, overlap: AnalyzeArgument | None, *more: tuple[str, type]) -> AnalyzeResult:
    if not 0 <= _number(overlap, OVERLAP) < _number(size, SIZE):
        raise ValueError("the overlap must be smaller than the window")
    return AnalyzeResult(StructType([_key(table), *(StructField(name, kind()) for name, kind in more)]))


@udtf
class ChunkFixed:
    """(doc_id, ordinal, first, token_count, content): windows of words, each sharing `overlap` with the next."""

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _layout(table, size, overlap, ("ordinal", IntegerType), ("first", IntegerType), ("token_count", IntegerType), ("content", StringType))

    def eval(self, row: Row, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple]:
        words = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
        for k, first in enumerate(range(0, max(len(words) - overlap, 1), size - overlap) if words else ()):
            part = words[first : first + size]
            yield row["doc_id"], k, first, len(part), " ".join(part)


@udtf
class ChunkStructural:
    """(doc_id, ordinal, token_count, section, clause, content, start, end): windows that end where the text's structure does."""

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _layout(table, size, overlap, ("ordinal", IntegerType), ("token_count", IntegerType), ("section", StringType), ("clause", StringType), ("content", StringType), ("start", IntegerType), ("end", IntegerType))

    def eval(self, row: Row, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple]:
        for chunk in structural_chunks(row["text"] or "", size, overlap):
            yield row["doc_id"], *chunk


@udtf
class TokenOffsets:
    """(doc_id, ordinal, start, end) of every word."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType([_key(table), *(StructField(name, IntegerType()) for name in ("ordinal", "start", "end"))]))

    def eval(self, row: Row) -> Iterator[tuple]:
        for k, (start, end) in enumerate(token_offsets(row["text"] or "")):
            yield row["doc_id"], k, start, end


class OffsetColumns:
    """TokenOffsets by columns, a part of the table at once; Spark asks for the result's types beforehand."""

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in _portions([table]):
            found = [np.fromiter(chain.from_iterable(m.span() for m in re.finditer(r"\S+", t or "")), np.int32).reshape(-1, 2) for t in b.column("text").to_pylist()]
            row, ordinal = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate([np.arange(len(x), dtype=np.int32) for x in found])
            start, end = np.concatenate(found).T
            for a in range(0, len(row), WORDS):
                own = slice(a, a + WORDS)
                columns = [b.column("doc_id").take(pa.array(row[own])), *(pa.array(np.ascontiguousarray(x[own])) for x in (ordinal, start, end))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ordinal", "start", "end"])


def register(spark: SparkSession, key: str | None = None) -> None:
    """Makes the functions known to the session's SQL; with key, the type of the tables' doc_id, token_offsets goes by columns."""
    offsets = TokenOffsets if key is None else arrow_udtf(OffsetColumns, returnType=f"doc_id {key}, ordinal int, start int, end int")
    for name, function in (("chunk_fixed", ChunkFixed), ("chunk_structural", ChunkStructural), ("token_offsets", offsets)):
        spark.udtf.register(name, function)
