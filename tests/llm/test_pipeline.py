import corpus_pipeline as p
from tests.llm.test_decontaminate import copies
from tests.llm.test_jaccard import brute as near
from tests.llm.test_lines import brute as lines

AT = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{AT}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    at = {}
    for name, step in p.STAGES:
        docs = p.stage(step(spark, docs, AT), "test")
        rows = docs.collect()
        at[name] = {r.doc_id: r for r in rows}
        assert len(at[name]) == len(rows) and docs.columns[:5] == p.COLUMNS
    quality, deduped, single, clean, mixed = (at[n] for n, _ in p.STAGES)
    kept = [i in quality for i, y in labels.items() if y == 1]
    gone = [i not in quality for i, y in labels.items() if y == 0]
    assert sum(kept) >= 0.97 * len(kept) and sum(gone) >= 0.75 * len(gone)
    assert all(quality[i] == before[i] for i in quality)
    want = {r[0]: r[5] for r in lines([(i, r.text) for i, r in quality.items()], 20)}
    assert {i: r.text for i, r in deduped.items()} == {i: t for i, t in want.items() if t.strip() or t == quality[i].text}
    assert all(r.n_chars == len(r.text) for i, r in deduped.items() if r.text != before[i].text)
    assert set(single) == {i for i, _, c in near([(i, r.text) for i, r in deduped.items()], 5, 80, 100) if i == c}
    leaks = {i for i, _ in copies([(i, r.text) for i, r in single.items()], items)}
    assert not leaks & set(clean) and len(set(single) - set(clean) - leaks) <= 2 + 0.01 * len(single)
    assert set(mixed) <= set(clean) and {r.copies for r in mixed.values()} <= {1, 2}


def test_run(spark):
    a, b = (sorted((r.doc_id, r.copies) for r in p.run(spark, AT).collect()) for _ in range(2))
    assert a == b and a


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __text string, kept string, id int"


def odd(rows):
    return [(i, t, "en", s, None if t is None else len(t), "clash", None, 1) for i, t, s in rows]


def test_rows_without_ids_of_their_own(spark):
    long = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    line = "a line of more than twenty characters"
    rows = odd([(1, long, "a"), (1, long, "a"), (1, other, "a"), (2, line, "b"), (2, f"bbb\n{line}", "b"), (None, f"ccc\n{line}", None), (None, f"ddd\n{line}", None), (None, None, None), (3, "", "a"), (3, " ", None)])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    texts = sorted(str(r.text) for r in p.drop_repeated_lines(spark, docs, AT).collect())
    assert texts == sorted(map(str, [long, other, line, "bbb", "ccc", "ddd", None, "", " "]))
    got = p.drop_near_duplicates(spark, docs, AT)
    assert got.columns == p.COLUMNS and got.count() == 9 and got.where(got.text == long).count() == 1
    assert p.drop_leaks(spark, docs, AT).count() == 10
    mixed = p.mix(spark, docs, AT)
    assert mixed.columns == [*p.COLUMNS, "copies"]
    drawn = [(r.doc_id, r.text) for r in mixed.collect()]
    left = [r[:2] for r in rows]
    for x in drawn:  # each row is taken once at most, whatever its id
        left.remove(x)
    assert any(i is None for i, _ in drawn)
    assert p.keep_quality(spark, docs, AT).columns == p.COLUMNS


def test_stages_without_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, step in p.STAGES:
        assert step(spark, docs, AT).collect() == []


def test_one_document_after_another(spark):
    docs = spark.createDataFrame(odd([(1, "a b c", "s")]), SCHEMA)
    for name, step in p.STAGES:
        docs = p.stage(step(spark, docs, AT), "test")
    assert docs.columns == [*p.COLUMNS, "copies"] and docs.count() <= 1
