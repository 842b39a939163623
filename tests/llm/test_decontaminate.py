import random
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from casemill.llm import decontaminate
from casemill.llm.decontaminate import Items, Terms, answer_of, common_subsequence, find_leaks, op3
from casemill.llm.shared import bounded_batches


def lcs(a, b):
    @cache
    def f(i, j):
        return 0 if i == len(a) or j == len(b) else 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

    return f(0, 0)


def test_common_subsequence():
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(0, 12))] for _ in range(2))
        assert common_subsequence(a, b) == lcs(tuple(a), tuple(b))
    assert answer_of("who is it? it is him.".split()) == "is it? it is him.".split()


def test_items_are_the_dense_matrix():
    r = np.random.RandomState(3)
    parts = [r.randint(0, 1 << 62, 40).astype(np.uint64)[r.randint(0, 40, 25)] for _ in range(7)] + [np.zeros(0, np.uint64)]
    terms = Terms(np.concatenate(parts)[::2])
    idf = r.uniform(1, 5, len(terms.hashes))
    dense = np.zeros((8, len(idf)))
    for i, h in enumerate(parts):
        np.add.at(dense[i], terms.find(h)[1], idf[terms.find(h)[1]])
    length = np.linalg.norm(dense, axis=1)
    dense /= np.maximum(length, 1e-12)[:, None]
    x = Items(parts, terms, idf)
    q, y = r.standard_normal((len(idf), 5)), r.standard_normal((8, 3))
    assert np.allclose(x.length, length) and np.allclose(x.times(q), dense @ q) and np.allclose(x.back(y), dense.T @ y)


def copies(rows, items):
    """Pairs whose whole item, as words, is in the document."""
    line = lambda t: " " + " ".join((t or "").encode().lower().decode().split(" ")) + " "
    words = lambda t: " " + " ".join(w.decode() for w in (t or "").encode().lower().split()) + " "
    return {(i, k) for i, t in rows for k, x in items if words(x).strip() and words(x) in words(t)}


def test_table(spark):
    at = "/root/testdata/sf0.1"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op3(spark, at).collect()}
    want = copies(rows, items)
    print("found", len(got), "copies", len(want), "missed", len(want - got), "more", len(got - want))
    assert len(want) > 100 and want <= got
    assert len(got - want) <= 0.1 * len(want)


def test_paraphrases_and_edges(spark):
    r = np.random.RandomState(1)
    words = [f"w{i}" for i in range(3000)] + ["the"] * 300
    new = lambda n: list(r.choice(words, n))
    items = [(i, " ".join(new(30)) + ". " + " ".join(new(6)) + ".") for i in range(20)] + [(98, None), (99, ""), (3, None)]
    docs, want = [], set()
    for d in range(60):
        x = new(r.randint(0, 400))
        if d % 3 == 0:
            item = items[d % 20][1].split()
            body = [w if r.rand() > 0.25 else "other" for w in item[:-6]] + item[-6:]
            at = r.randint(0, len(x) + 1)
            x[at:at] = body
            want.add((d, d % 20))
        docs.append((d, " ".join(x), "clash"))
    docs += [(100, None, "c"), (101, "", "c"), (102, "the " * 50_000 + items[5][1].upper(), "c"), (None, items[6][1], "c"), docs[0]]
    want |= {(102, 5), (None, 6)}
    df = spark.createDataFrame(docs, "doc_id long, text string, item string")
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id long")
    for block in (5000, 7):
        got = [(r.doc_id, r.item_id) for r in find_leaks(df, bench, block_items=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert find_leaks(df, bench.where("1 = 0")).collect() == [] and find_leaks(df.where("1 = 0"), bench).collect() == []


def test_frequent_items(spark):
    """Items copied into a third of the documents, or made of words that all documents have, lose no copy."""
    r = np.random.RandomState(2)
    words, common = [f"w{i}" for i in range(3000)], [f"c{i}" for i in range(12)]
    new = lambda n, of: list(r.choice(of, n))
    items = [(0, " ".join(new(30, words))), (1, " ".join(new(30, common))), *((i, " ".join(new(30, words))) for i in range(2, 20)), (20, "c1 c0 c2")]
    docs = []
    for d in range(300):
        x = new(60, words) + new(60, common)
        r.shuffle(x)
        at = r.randint(0, len(x) + 1)
        inside = ([0] if d % 3 == 0 else []) + ([1] if d % 25 == 0 else []) + ([d // 30 + 2] if d % 30 == 0 else []) + ([20] if d % 40 == 0 else [])
        x[at:at] = [w for i in inside for w in items[i][1].split()]
        docs.append((d, " ".join(x)))
    want = copies(docs, items)
    assert len(want) > 115
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda rows: {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    got = found(docs)
    assert want <= got and {i for _, i in got - want} <= {1, 20}
    few = docs[:12]
    assert copies(few, items) <= found(few)


def test_long_items(spark):
    """Items of hundreds of words are found, verbatim and with every fourth word changed."""
    r = np.random.RandomState(3)
    words = [f"w{i}" for i in range(3000)] + ["the"] * 300
    new = lambda n: list(r.choice(words, n))
    items = [(i, " ".join(new(n))) for i, n in enumerate([30, 65, 130, 400, 400, 3000])]
    docs, want = [], set()
    for d in range(60):
        x = new(r.randint(0, 400))
        if d % 5 == 0:
            i = d // 5 % 6
            item = items[i][1].split()
            x[(at := r.randint(0, len(x) + 1)) : at] = item if d < 30 else ["other" if j % 4 == 3 else w for j, w in enumerate(item)]
            want.add((d, i))
        docs.append((d, " ".join(x)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (5000, 20):
        assert {(x.doc_id, x.item_id) for x in find_leaks(df, bench, block_items=block).collect()} == want


def test_basis_is_of_all_documents(spark, monkeypatch):
    """The fit is that of the dense matrix over every text, 5000 of them; a part of a batch is added up at once."""
    r = np.random.RandomState(5)
    words = [f"w{i}" for i in range(40)]
    # words w30 to w39 are in few texts, anywhere
    texts = [" ".join(r.choice(words[:30], r.randint(0, 30))) + (" " + " ".join(r.choice(words[30:], 4)) if d % 50 == 7 else "") for d in range(4997)] + ["", None, " ".join(words * 5)]
    hashes = [decontaminate._hashes(" ".join(words[k : k + 20])) for k in (0, 10, 20)]
    terms, half = Terms(np.concatenate(hashes)), 4
    n = len(terms.hashes)
    place = np.where(np.arange(n) % 7 == 3, -1, 0)
    place[place == 0] = np.arange((place == 0).sum())
    idf = r.uniform(1, 4, (place >= 0).sum())
    items = Items(hashes, Terms(terms.hashes[place >= 0]), idf)
    known = decontaminate.known_terms(spark.createDataFrame([(t,) for t in texts], "text string"), terms, half).persist()
    df = decontaminate.document_frequency(known, n)
    passages, seen = [], np.zeros(n, int)
    for t in texts:
        h = decontaminate._hashes(t or "")
        at, k = terms.find(h)
        seen[np.unique(k)] += 1
        for a in range(0, len(h), half):
            x = np.zeros(len(idf))
            np.add.at(x, [j for i, j in zip(at, place[k]) if a <= i < a + 2 * half and j >= 0], 1)
            passages.append(x * idf)
    assert (df == seen).all()
    dense = np.array(passages)
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-12)[:, None]
    got = decontaminate.latent_basis(known, place, idf, items, 6)
    q = np.linalg.qr(np.random.RandomState(11).standard_normal((len(idf), 6)))[0]
    for _ in range(decontaminate.POWER):
        q = np.linalg.qr(dense.T @ (dense @ q) / len(dense) + 4 * items.back(items.times(q)) / 3)[0]
    assert np.allclose(got @ got.T, q @ q.T, atol=1e-3)
    batch = known.toArrow().combine_chunks().to_batches()[0].slice(7)
    whole = list(decontaminate._known(batch))
    monkeypatch.setattr(decontaminate, "WORDS", 50)
    parts = list(decontaminate._known(batch))
    assert len(parts) > 100 and all((np.concatenate([p[2] for p in parts]) == np.concatenate([p[2] for p in whole])))


def test_group_sums():
    r = np.random.RandomState(6)
    x, n = r.standard_normal((9, 3)), np.array([1, 40, 2, 16, 17, 1, 3])
    at, first = r.randint(0, 9, n.sum()), np.cumsum(n) - n
    assert np.allclose(decontaminate._group_sums(x, at, first), np.add.reduceat(x[at], first, axis=0))


def test_texts_are_read_once(spark):
    """What is fitted and searched reads the known words: texts go through Python once, null and blank ones too."""
    r = np.random.RandomState(7)
    items = [(i, " ".join(r.choice([f"w{j}" for j in range(200)], 30))) for i in range(8)]
    rows = [(d, " ".join(["x"] * r.randint(0, 90)) + " " + items[d % 8][1]) for d in range(40)] + [(40, None), (None, " "), (None, items[3][1])]
    read = spark.sparkContext.accumulator(0)

    def text(t):
        read.add(1)
        return t

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("text", F.udf(text, "string")("text"))
    got = {(x.doc_id, x.item_id) for x in find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, d % 8) for d in range(40)} | {(None, 3)}
    assert read.value == len(rows)


def test_half_windows_without_known_words_have_no_vectors():
    start, row = np.array([0, 4, 1_000_004, 1_000_009]), np.array([3, 9, 9, 500_000, 1_000_004])
    at, bounds, short = decontaminate._filled(start, row)
    assert at.tolist() == [2, 3, 8, 9, 499_999, 500_000, 1_000_003, 1_000_004]
    assert (at[short] == row).all() and bounds.tolist() == [0, 2, 4, 6, 7, 8]


def test_batches_are_bounded(spark):
    """Texts come to a task a few MB at a time, and the caller's setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with bounded_batches(spark, 1 << 20):
        docs = spark.range(0, 4000, 1, 1).selectExpr("repeat('word ', 1000) AS text")
        sizes = [x.n for x in docs.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()]
    assert len(sizes) >= 15 and max(sizes) < 2 << 20 and spark.conf.get(key) == before
