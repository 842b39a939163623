import numpy as np

from casemill.operators import retrieval


def test_vector_topk_in_blocks(spark, monkeypatch):
    """More queries than a block: each has the same neighbours as by brute force."""
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 7, raising=False)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7, raising=False)
    monkeypatch.setattr(retrieval, "COLUMNS", 3, raising=False)
    v = np.random.RandomState(4).standard_normal((200, 8))
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "fragment_id long, embedding array<double>")
    queries = corpus.where("fragment_id < 20").withColumnRenamed("fragment_id", "query_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, int(i), n + 1) for q in range(20) for n, i in enumerate(np.argsort(1 - u @ u[q], kind="stable")[:5])}
    assert {(r.query_id, r.fragment_id, r["rank"]) for r in retrieval.vector_topk(queries, corpus, 5).collect()} == want
    assert retrieval.vector_topk(queries.where("1 = 0"), corpus, 5).collect() == []
