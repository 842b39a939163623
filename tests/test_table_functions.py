"""Token offsets in SQL are made by columns, a part of the table at once."""

import pyarrow as pa

from casemill.operators import corpus, table_functions
from tests.test_portions import TEXTS


def test_offsets_by_sql_are_columns(spark):
    spark.createDataFrame([(f"d{i}", i, t) for i, t in enumerate(TEXTS)], "doc_id string, other int, text string").repartition(3).createOrReplaceTempView("offset_texts")
    want = sorted((f"d{i}", k, *o) for i, t in enumerate(TEXTS) for k, o in enumerate(corpus.token_offsets(t or "")))
    for key in (None, "string"):
        table_functions.register(spark, key)
        found = spark.sql("SELECT * FROM token_offsets(TABLE(offset_texts))")
        assert ("ArrowEvalPythonUDTF" in found._jdf.queryExecution().executedPlan().toString()) == (key is not None)
        assert found.dtypes == [("doc_id", "string"), ("ordinal", "int"), ("start", "int"), ("end", "int")]
        assert sorted(map(tuple, found.collect())) == want
        assert spark.sql("SELECT * FROM token_offsets(TABLE(SELECT * FROM offset_texts WHERE text IS NULL))").isEmpty()


def test_long_texts_are_told_in_parts(monkeypatch):
    monkeypatch.setattr(table_functions, "WORDS", 7)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b " * 20, "c"])], ["doc_id", "text"])
    parts = list(table_functions.OffsetColumns().eval(batch))
    assert max(p.num_rows for p in parts) == 7
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == [(1, k, *o) for k, o in enumerate(corpus.token_offsets("a b " * 20))] + [(2, 0, 0, 1)]
