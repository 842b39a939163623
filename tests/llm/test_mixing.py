import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.llm.mixing import mix_sources, op5, pivotal, source_targets


def shares(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """sizes: source -> size. Reshares the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        give = {s: left * w[s] / total for s in free}
        left = 0.0
        for s in list(free):
            target[s] += give[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def test_pivotal_keeps_the_sum_and_the_chances():
    r = np.random.RandomState(0)
    total = np.zeros(5)
    for _ in range(4000):
        p = pivotal(np.array([0.2, 0.7, 0.5, 0.9, 0.4]), r.uniform(size=5))
        assert abs(p.sum() - 2.7) < 1e-6 and ((p > 0) & (p < 1)).sum() <= 1
        total += p
    assert np.abs(total / 4000 - [0.2, 0.7, 0.5, 0.9, 0.4]).max() < 0.04


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "é": 30, "z": 1000, None: 7}, {"a": 10, "b": 0}, {"a": 0}, {None: 5}, {f"s{i}": 60 for i in range(50)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, v) for s, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = shares(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_chances_over_two_levels(spark):
    # 4000 sources of six documents in three blocks: the tree meets twice, and each document's chance is its fraction
    n = 4000
    df = spark.range(n * 6).selectExpr("id as doc_id", "concat('s', id div 6) as source", "10 as size")
    got = mix_sources(df, size=F.col("size"), weights=(1,), share=1.3, block_rows=2).collect()
    assert {r.copies for r in got} <= {1, 2}
    per_source = {}
    rate = np.zeros(6)
    for r in got:
        rate[r.doc_id % 6] += r.copies - 1
        per_source[r.source] = per_source.get(r.source, 0) + r.copies
    assert all(abs(v - 7.8) < 1 for v in per_source.values())
    assert np.abs(rate / n - 0.3).max() < 4.5 * (0.3 * 0.7 / n) ** 0.5


def test_repeated_rows_draw_apart(spark):
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'s' as source", "'a b' as text")
    got = mix_sources(df, block_rows=16).collect()
    assert len(got) == 3000 and {r.copies for r in got} == {1, 2}
    assert abs(sum(r.copies for r in got) - 4500) <= 1


def test_mix(spark):
    got = op5(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, op5(spark, "/root/testdata/sf0.01").collect()))
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    assert {r.doc_id: r["size"] for r in got} == size
    source = {r.doc_id: r.source for r in rows}
    total, taken, target = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        total[s] = total.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken <= 2 * r["size"]
    assert all(abs(target[s] - v) < 1e-6 * v + 1e-6 for s, v in shares(total).items())
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + max(size.values()) for s in total)


def test_edges(spark):
    schema = "doc_id long, text string, source string, size string, block string"
    rows = [(1, None, None, "x", None), (1, None, None, "x", None), (None, "a b", None, None, None), (2, "", "s", None, None), (3, "word " * 5000, "s", None, None)]
    got = mix_sources(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == 7502 // 5002 * 0 + sum(r["size"] * r.copies for r in got)
    assert mix_sources(spark.createDataFrame([], schema)).collect() == []
