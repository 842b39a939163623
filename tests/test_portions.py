"""Python steps over texts hold the rows of a bounded part of a batch."""

import pyarrow as pa

from casemill.operators import corpus

TEXTS = [None, "", " \n", "uno dos tres", "Cláusula 1\n x y.", "Sección 2\ntexto", "a" * 5000] * 40


def test_portions_are_bounded(monkeypatch):
    monkeypatch.setattr(corpus, "PART", 6000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS, pa.string())], ["doc_id", "text"])
    parts = list(corpus._portions([batch, batch.slice(3, 0), batch.slice(5)]))
    assert sum(p.num_rows for p in parts) == 2 * len(TEXTS) - 5
    assert len(parts) > 60 and all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 6000 for p in parts)
    assert [d for p in parts for d in p.column("doc_id").to_pylist()] == [*range(len(TEXTS)), *range(5, len(TEXTS))]


def test_portions_change_no_row(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r.doc_id: [tuple(o) for o in r.offsets] for r in corpus.with_token_offsets(docs).collect()}
    assert got == {i: corpus.token_offsets(t or "") for i, t in enumerate(TEXTS)}
    heads = sorted((r.doc_id, r.start, r.section, r.clause) for r in corpus.structural_metadata(docs).collect())
    want = [(i, m.start(), m.group(0).strip()) for i, t in enumerate(TEXTS) for m in corpus.HEADING.finditer(t or "")]
    assert [(i, a, s or c) for i, a, s, c in heads] == want and {c for *_, c in heads} == {None, "Cláusula 1"}
    cut = sorted((r.doc_id, r.ordinal, r.token_count, r.content) for r in corpus.chunk_structural(docs, 3, 1).collect())
    assert cut == sorted((i, c[0], c[1], c[4]) for i, t in enumerate(TEXTS) for c in corpus.structural_chunks(t or "", 3, 1))


def test_terms_are_counted_where_their_chunk_is(spark):
    from collections import Counter

    texts = [(1, "uno dos Uno, UNO"), (2, None), (3, ""), (4, "ß ss dos"), (5, "--")]
    found = corpus.term_index(spark.createDataFrame(texts, "chunk_id int, content string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(1, w, n) for w, n in Counter(["uno", "dos", "uno", "uno"]).items()} | {(4, "ss", 2), (4, "dos", 1)}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
