import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from casemill.llm.periodic_runs import Minima, find_runs, op11, periodic_runs, suffix_array

SCHEMA = "doc_id long, text string, runs string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, copies=4, least=6):
    n, out = len(w), []
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, copies * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def made(seed, docs=150):
    r = np.random.RandomState(seed)
    texts = []
    for _ in range(docs):
        kinds, n = r.randint(1, 5), r.randint(0, 60)
        w = [f"w{k}" for k in r.randint(kinds, size=n)]
        for _ in range(r.randint(0, 3)):
            unit = [f"w{k}" for k in r.randint(kinds + 1, size=r.randint(1, 7))]
            at = r.randint(0, len(w) + 1)
            w[at:at] = (unit * 9)[: r.randint(2, 5 * len(unit) + 3)]
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("copies,least", [(4, 6), (2, 1), (3, 10)])
def test_against_brute_force(spark, copies, least):
    texts = made(copies)
    texts += [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x" * 100_000 + " y" * 8, "é é\té é\né é", " ".join(["a", "b"] * 40 + ["c"] + ["a", "b"] * 40)]
    rows = [(k, t, "extra") for k, t in enumerate(texts)] + [(None, "b b b b b b b", ""), (3, texts[3], ""), (3, texts[3], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in find_runs(df, copies=copies, least=least).collect())
    want = []
    for i, t, _ in rows:
        w = split(t)
        found = brute(w, copies, least)
        want.append((i is None, i or 0, len(w), tuple(found), collapse(w, found)))
    assert got == sorted(want)
    assert find_runs(df.limit(0)).collect() == []


def test_long_documents():
    """Runs of many thousand words, found without looking at each word's copies."""
    r = np.random.RandomState(5)
    unit = r.randint(50, size=37)
    word = np.concatenate([r.randint(1000, 2000, size=9000), np.tile(unit, 1500)[:50_011], [3], np.tile([7], 20_000), r.randint(1000, 2000, size=5000)])
    n = len(word)
    zero = np.zeros(n, np.int64)
    a, b, q = periodic_runs(word, zero, zero, np.full(n, n), 4, 6)
    assert (9000, 59_011, 37) in list(zip(a.tolist(), b.tolist(), q.tolist())) and (59_012, 79_012, 1) in list(zip(a.tolist(), b.tolist(), q.tolist()))
    assert len(a) < 200


def test_suffix_array():
    r = np.random.RandomState(2)
    for _ in range(30):
        parts = [np.tile(r.randint(3, size=r.randint(1, 5)), 60)[: r.randint(0, 150)] for _ in range(4)]
        word = np.concatenate(parts).astype(np.int64)
        doc = np.repeat(np.arange(4), [len(p) for p in parts])
        ends = np.cumsum([len(p) for p in parts])
        sa, isa, lcp = suffix_array(word, doc, ends[doc])
        own = lambda i: word[i : ends[doc[i]]].tolist()
        assert sa.tolist() == sorted(range(len(word)), key=lambda i: (doc[i], own(i)))
        assert (isa[sa] == np.arange(len(sa))).all()
        for j in range(1, len(sa)):
            x, y = own(sa[j - 1]), own(sa[j])
            same = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))) if doc[sa[j]] == doc[sa[j - 1]] else 0
            assert lcp[j] == same


def test_minima():
    r = np.random.RandomState(4)
    for n in (1, 63, 64, 65, 1000, 9000):
        x = r.randint(0, 30, size=n).astype(np.int32)
        x[r.rand(n) < 0.9] += 20
        x[0] = 0
        m = Minima(x)
        lo = r.randint(n, size=300)
        hi = np.array([r.randint(a + 1, n + 1) for a in lo])
        assert m.least(lo, hi).tolist() == [x[a:b].min() for a, b in zip(lo, hi)]
        at = np.flatnonzero(x > 0)
        assert m.nearest(at, x[at], -1).tolist() == [max(k for k in range(j) if x[k] < x[j]) for j in at]
        assert m.nearest(at, x[at], 1).tolist() == [next((k for k in range(j + 1, n) if x[k] < x[j]), n) for j in at]


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in op11(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    hit = 0
    for x in rows:
        w = split(x.text)
        h = crc32(str(x.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        found, r = brute(w), got[x.doc_id]
        best = min(found, key=lambda t: (-t[1], t[0], t[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(collapse(w, found).encode()).hexdigest()
        hit += bool(found)
    assert hit > 5
