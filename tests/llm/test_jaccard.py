import math
import random
import re
from collections import Counter
from itertools import chain

import pytest

from casemill.llm.jaccard_join import link_documents, op2

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, least, of):
    sets = {i: shingles(t, k) for i, t in rows}
    own = {i: i for i in sets}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for ids in where.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    if of * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                        x, y = sorted((root(a), root(b)))
                        own[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def near_copies(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "Of", "é"]) if r.random() < 0.3 else f"w{r.randrange(400)}"
    texts = []
    for size in (1, 2, 3, 5, 8, 12, 15, 20, 40, 60, 90, 150, 300):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 0, 1, 1, 1, 2, 2, 3, 4, 5, 7, 9, 12):
            x = list(base)
            for _ in range(edits if edits < size else size // 3):
                at = r.randrange(len(x))
                x[at : at + 1] = r.choice([[word()], [], [word(), word()]]) or ["z"]
            texts.append(" ".join(x))
    texts += [None, "", " \n", texts[0].upper(), texts[-1] + " end", "same " * 500, "same " * 501, "z " * 20_000]
    chain = [word() for _ in range(200)]
    for i in range(30):  # each links with the next, the ends do not link
        chain[i * 6] = f"new{i}"
        texts.append(" ".join(chain))
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "least", "work", "leaf", "limit"), [(3, 90, 10**9, 128, 1 << 26), (5, 80, 10**9, 128, 1 << 26), (1, 60, 10**9, 4, 1 << 26), (5, 80, 10**9, 2, -1), (5, 80, 3000, 2, 1 << 26), (1, 60, 3000, 2, -1)])
def test_links(spark, monkeypatch, k, least, work, leaf, limit):
    monkeypatch.setattr("casemill.llm.jaccard_join.CLUSTER_WORK", work)
    monkeypatch.setattr("casemill.llm.jaccard_join.LEAF", leaf)
    rows = near_copies(k)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, sig string, n int").repartition(4)
    got = sorted(tuple(x) for x in link_documents(df, words=k, least=least, limit=limit).collect())
    want = brute(rows, k, least, 100)
    assert got == want
    assert len({c for _, n, c in got}) < len(got) - 40


def test_every_row_is_a_document(spark):
    rows = near_copies(5)
    ids = [None if k % 11 == 3 else i // 2 for k, (i, _) in enumerate(rows)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in zip(ids, rows)], "doc_id int, text string").repartition(4)
    order = sorted(range(len(rows)), key=lambda k: (ids[k] is None, ids[k] or 0))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = [(ids[order[a]], n, ids[order[c]]) for a, n, c in brute([(place, rows[k][1]) for place, k in enumerate(order)], 5, 80, 100)]
    got = [tuple(x) for x in link_documents(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sorted(tuple(x) for x in op2(spark, "/root/testdata/sf0.01").collect()) == brute(rows, 3, 90, 100)


def test_empty(spark):
    assert link_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_regions_make_the_links_of_the_given_table(spark, monkeypatch):
    """On the driver's own documents: clusters go by pivots, regions and windows, and come out as by brute force."""
    import numpy as np

    from casemill.llm import jaccard_join as jj

    seen = {"regions": 0, "copied": 0}
    plain = jj.voronoi

    def counted(to, near):
        for region, window in plain(to, near):
            seen["regions"] += bool(region.any())
            seen["copied"] += int((window & ~region).sum()) if region.any() else 0
            yield region, window

    monkeypatch.setattr(jj, "voronoi", counted)
    texts = sorted({r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()})
    sets = [s for s in map(frozenset, (shingles(t, 3) for t in texts)) if s]
    sets = list(dict.fromkeys(sets))
    own = list(range(len(sets)))

    def root(i):
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    many = Counter(chain.from_iterable(sets))
    where = {}
    for i, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (many[x], x))[: len(s) - math.ceil(0.9 * len(s)) + 1]:
            where.setdefault(x, []).append(i)
    for ids in where.values():
        for b in ids[1:]:
            if 2 * len(sets[b] & sets[ids[0]]) >= len(sets[b] | sets[ids[0]]):
                own[root(b)] = root(ids[0])
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(root(i), []).append(i)
    large = sorted((g for g in groups.values() if 4 < len(g) < 400), key=len)[-30:]
    assert large
    for g in large:
        code = {x: k for k, x in enumerate(sorted(set().union(*(sets[i] for i in g))))}
        n = np.array([len(sets[i]) for i in g])
        flat = np.concatenate([sorted(code[x] for x in sets[i]) for i in g]).astype(np.uint64)
        cluster = jj.Cluster(np.arange(len(g)), n, flat, np.arange(len(g)), np.zeros(len(g), int), False, 90, 100)
        cluster.join(np.arange(len(g)))
        want = list(range(len(g)))
        for _ in g:
            for a in range(len(g)):
                for b in range(a):
                    x, y = sets[g[a]], sets[g[b]]
                    if want[a] != want[b] and 100 * len(x & y) >= 90 * len(x | y):
                        low, high = sorted((want[a], want[b]))
                        want = [low if w == high else w for w in want]
            break
        assert cluster.forest().tolist() == want
    print(seen)
    assert seen["regions"] > 5
