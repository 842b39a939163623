"""The written index, the clusters and the span joins against plain searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.operators import nearest, postings, retrieval, spans
from casemill.sources import tables


def corpus(spark, n=3000, seed=0):
    """Fragments of common and rare words; a common word is in nearly all."""
    r = np.random.RandomState(seed)
    rows = []
    for i in range(n):
        words = {"the": int(r.randint(1, 4))} | {f"w{int(k)}": int(r.randint(1, 5)) for k in np.unique(r.zipf(1.5, size=r.randint(1, 6) if i % 1000 < 90 else r.randint(8, 20))) if k < 500}
        if i % 500 == 7:
            words["rare"] = 9
        rows += [(i, w, tf) for w, tf in words.items()]
    return spark.createDataFrame([(i,) for i in range(n)] + [(n,)], "fragment_id long"), spark.createDataFrame(rows, "fragment_id long, lexeme string, tf long")


def rows_of(df):
    return sorted((r.query_id, r.fragment_id, r["rank"], round(r.score, 6)) for r in df.collect())


def test_bm25_search_skips_blocks_and_loses_nothing(spark, tmp_path):
    fragments, terms = corpus(spark)
    q = spark.createDataFrame([(1, "the"), (1, "rare"), (2, "w3"), (2, "w7"), (2, "w3"), (3, "nowhere"), (4, "rare"), (5, "the")], "query_id long, lexeme string")
    index = postings.build_postings(fragments, terms, str(tmp_path / "i"), block=64)
    want = rows_of(retrieval.bm25_topk(q, fragments, terms, 5))
    assert len(want) == 20 and rows_of(postings.bm25_search(index, q, str(tmp_path), 5)) == want
    # an index that was written is read by another session of the same code
    assert rows_of(postings.bm25_search(postings.read_postings(spark, str(tmp_path / "i")), q, str(tmp_path), 5)) == want
    pairs = postings.open_blocks(index, q, 5, str(tmp_path / "p"))[2]
    opened, every = pairs.where("opened").count(), pairs.count()
    print("blocks opened", opened, "of", every)
    assert opened < 0.7 * every


def test_bm25_search_by_scope(spark, tmp_path):
    fragments, terms = corpus(spark, 600, 1)
    scoped = fragments.withColumn("scope", F.explode(F.when(F.col("fragment_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))))
    q = spark.createDataFrame([(1, "w3", "a"), (1, "the", "a"), (2, "w3", "b"), (3, "w3", "c")], "query_id long, lexeme string, scope string")
    index = postings.build_postings(scoped, terms, str(tmp_path / "i"), block=32)
    want = rows_of(retrieval.bm25_topk(q, scoped, terms, 7))
    assert rows_of(postings.bm25_search(index, q, str(tmp_path), 7)) == want and {r[0] for r in want} == {1, 2} and all(r[1] % 3 == 0 for r in want if r[0] == 1)


def test_postings_of_nothing(spark, tmp_path):
    fragments, terms = corpus(spark, 20)
    q = spark.createDataFrame([(1, "the")], "query_id long, lexeme string")
    assert postings.bm25_search(postings.build_postings(fragments.limit(0), terms.limit(0), str(tmp_path / "a")), q, str(tmp_path)).collect() == []
    assert postings.bm25_search(postings.build_postings(fragments, terms, str(tmp_path / "b")), q.limit(0), str(tmp_path)).collect() == []
    with pytest.raises(ValueError):
        postings.build_postings(fragments, terms, str(tmp_path / "c"), block=100)


def vectors(spark, n=4000, width=12, seed=0):
    r = np.random.RandomState(seed)
    centre = r.standard_normal((30, width))
    x = centre[r.randint(30, size=n)] + 0.15 * r.standard_normal((n, width))
    x[1::50] = x[1]  # copies
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * width), (n + 2, [float("nan")] * width)]
    return spark.createDataFrame(rows, "fragment_id long, embedding array<double>")


@pytest.mark.parametrize("block", [10_000, 7])
def test_nearest_reads_few_clusters_and_loses_nothing(spark, tmp_path, block):
    df = vectors(spark)
    q = df.where("fragment_id % 97 = 1 or fragment_id >= 4000").withColumnRenamed("fragment_id", "query_id")
    clusters = nearest.cluster_vectors(df, str(tmp_path))
    got, counts = nearest.nearest(q, clusters, str(tmp_path), block=block)
    key = lambda d: sorted((r.query_id, r.fragment_id, r["rank"], round(r.distance, 6)) for r in d.collect())
    assert key(got) == key(retrieval.vector_topk(q, df))
    print("vectors compared", counts["compared"] / counts["pairs"])
    assert counts["compared"] < 0.25 * counts["pairs"]
    if block == 7:
        again, _ = nearest.nearest(q, nearest.read_clusters(spark, str(tmp_path)), str(tmp_path))
        assert key(again) == key(got)


def test_nearest_of_nothing(spark, tmp_path):
    df = vectors(spark, 100)
    q = df.withColumnRenamed("fragment_id", "query_id")
    clusters = nearest.cluster_vectors(df.limit(0), str(tmp_path / "a"))
    assert nearest.nearest(q, clusters, str(tmp_path))[0].collect() == []
    clusters = nearest.cluster_vectors(df, str(tmp_path / "b"))
    assert nearest.nearest(q.limit(0), clusters, str(tmp_path))[0].collect() == []
    few = nearest.nearest(q.where("query_id = 3"), clusters, str(tmp_path), k=1000)[0]
    assert few.count() == 100


def test_overlap_join(spark):
    r = np.random.RandomState(3)
    length = lambda: int(r.choice([0, 1, 1, 2, 5, 30, 64, 1000]))
    a = [(int(r.randint(3)), i, int(s), int(s) + length()) for i, s in enumerate(r.randint(-50, 300, size=150))] + [(None, 900, 0, 5), (0, 901, None, 5), (1, 902, 0, 100_000)]
    b = [(int(r.randint(3)), i, int(s), int(s) + length()) for i, s in enumerate(r.randint(-50, 300, size=150))] + [(None, 900, 0, 5), (1, 902, -9, 70_000)]
    want = sorted((x[1], y[1]) for x in a for y in b if None not in x and None not in y and x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3]))
    left, right = spark.createDataFrame(a, "doc int, l int, start long, end long"), spark.createDataFrame(b, "doc int, r int, start long, end long")
    got = sorted((x.l, x.r) for x in spans.overlap_join(left, right, "doc").collect())
    assert got == want and len(want) > 500
    assert spans.overlap_join(left.limit(0), right, "doc").collect() == []


def test_pages_and_sections(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 25), (1, 2, 90, 95), (2, 0, 0, 5)], "doc_id int, chunk_id int, start int, end int")
    pages = spark.createDataFrame([(1, 1, 0, 8), (1, 2, 8, 20), (1, 3, 20, 30), (3, 1, 0, 9)], "doc_id int, page int, start int, end int")
    assert sorted(map(tuple, spans.page_ranges(chunks, pages).drop("start", "end").collect())) == [(1, 0, 1, 2), (1, 1, 2, 3), (1, 2, None, None), (2, 0, None, None)]
    sections = spark.createDataFrame([(1, "one", 1, 0, 12), (1, "two", 2, 5, 60)], "doc_id int, name string, ordinal int, start int, end int")
    assert sorted(map(tuple, spans.section_at(chunks, sections).select("doc_id", "chunk_id", "section").collect())) == [(1, 0, "one"), (1, 1, "one"), (1, 2, None), (2, 0, None)]


def test_a_batch_rewrites_its_partitions_alone(spark, tmp_path):
    at = tmp_path / "t"
    df = lambda rows: spark.createDataFrame(rows, "k int, v string, o int, m map<string,int>")
    tables.write_table(spark, df([(i, "a", 1, {"x": i}) for i in range(500)]), str(at), ["k"], "update", "o", parts=16)
    before = {str(p): p.stat().st_mtime_ns for p in at.glob("part=*/*.parquet")}
    assert len({p.parent for p in at.glob("part=*/*.parquet")}) == 16
    out = tables.write_table(spark, df([(7, "b", 3, {}), (7, "c", 2, {}), (7, "old", 1, {})]), str(at), ["k"], "update", "o")
    after = {str(p): p.stat().st_mtime_ns for p in at.glob("part=*/*.parquet")}
    assert len(set(before) - set(after)) == 1 and len({p.parent for p in at.glob("part=*/*.parquet")}) == 16  # the number of partitions stays
    rows = {r.k: r.v for r in out.collect()}
    assert rows[7] == "b" and len(rows) == 500 and out.count() == 500 and "part" not in out.columns
    assert tables.write_table(spark, df([(7, "z", 9, {}), (501, "n", 2, {}), (501, "m", 1, {})]), str(at), ["k"], "ignore", "o").where("k in (7, 501)").orderBy("k").select("v").collect() == [("b",), ("m",)]
    assert tables.write_table(spark, df([]), str(at), ["k"], "update", "o").count() == 501
    assert tables.partitions_of(spark, str(at), df([(7, "", 0, {})]), ["k"]).count() < 100
    assert not list(tmp_path.glob("t.*"))


def test_null_keys_and_a_crash_before_the_partitions_are_in_place(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    tables.write_table(spark, df((1, "a"), (None, "n"), (None, "n")), at, ["k"], "update")
    apply = tables._apply
    monkeypatch.setattr(tables, "_apply", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        tables.write_table(spark, df((1, "b"), (None, "m")), at, ["k"], "update")
    assert sorted(r.v for r in tables.read_table(spark, at).collect()) == ["a", "n"]
    monkeypatch.setattr(tables, "_apply", apply)
    out = tables.write_table(spark, df((2, "c")), at, ["k"], "update")
    assert sorted(r.v for r in out.collect()) == ["b", "c", "m"]
    (tmp_path / "t.next").mkdir()  # a write that was cut short
    assert tables.write_table(spark, df((3, "d")), at, ["k"], "ignore").count() == 4
