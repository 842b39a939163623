import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from casemill.llm import arrays
from casemill.llm.substring_dedup import dedup_words
from casemill.llm.suffix_dedup import cover_for, dedup_bytes, difference_cover

SCHEMA = "doc_id long, text string, starts string, key string"


def corpus(seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(60)]
    sep = [" ", "\n", "  ", "  ", "\t"]
    new = lambda n: "".join(r.choice(words) + r.choice(sep) for _ in range(n))
    shared = [new(r.randint(20, 60)) for _ in range(4)]
    rows = []
    for _ in range(40):
        rows.append("".join(new(r.randint(0, 50)) + r.choice(shared) for _ in range(r.randint(0, 3))) + new(r.randint(0, 40)))
    rows += [rows[3], rows[3], rows[5], "", None, "a", "a", "xyz " * 400, new(3000) + rows[7]]
    return [(i, t, "clash", None) for i, t in enumerate(rows)] + [(3, rows[3], "clash", None), (None, rows[9], None, None), (None, None, None, None)]


def brute_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = True
        lo, _ = arrays.runs(gone)
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), len(lo), sha256(kept).hexdigest()))
    return out


def brute_words(texts, window):
    data = [(t or "").encode().split() for t in texts]
    n = Counter(tuple(d[i : i + window]) for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if n[tuple(d[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sha256(kept).hexdigest()))
    return out


def test_cover():
    for length in (1, 2, 7, 50, 100, 200, 1000):
        v, cover = cover_for(length)
        assert length - v + 1 >= 1
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert difference_cover(11)[0] == 133 and len(difference_cover(11)[1]) == 12


def test_tokens():
    texts = [" a b  ÉC\x0b", None, "", "x", "y\x1fz", "\n\n"]
    s = next(arrays.slices(pa.array(texts)))
    t = arrays.tokens(s, True)
    got = [[bytes(t.data[a:b]) for a, b in zip(t.start[x:y], t.end[x:y])] for x, y in zip(t.first, t.first[1:])]
    assert got == [(x or "").encode().lower().split() for x in texts]
    assert len({int(h) for h in t.hashes()}) == len(t.start)


def regular(n, swapped=False):
    """The Thue-Morse order of two letters, which sums of powers modulo 2**64 cannot tell from its swap."""
    return ["ab"[(i.bit_count() + swapped) % 2] for i in range(n)]


def test_hashes_tell_regular_texts_apart():
    one, other = regular(2048), regular(2048, True)
    for sep in ("", " "):
        text = sep.join(one) + "\n" + sep.join(other)
        s = next(arrays.slices(pa.array([text])))
        t = arrays.tokens(s)
        h = t.hashes()
        for k in (1, 3, 5, 18, 35, 1024, 2048):
            if k <= len(h):
                want = {tuple(text.split()[i : i + k]) for i in range(len(h) - k + 1)}
                assert len({*arrays.window_hash(h, k).tolist()}) == len(want)
        for k in (1, 7, 8, 9, 68, 200, 2048):
            want = {text[i : i + k] for i in range(len(text) - k + 1)}
            at = np.arange(len(text) - k + 1)
            assert len({*arrays.byte_hashes(s.data, k).tolist()}) == len({*arrays.sampled_hashes(s.data, at, k).tolist()}) == len(want)
    h = np.random.RandomState(1).randint(0, 1 << 62, 500).astype(np.uint64)
    at = np.arange(400)
    for k in (1, 2, 3, 64, 100):
        assert (arrays.span_hash(h, at, at + k) == arrays.window_hash(h, k)[at]).all()


def test_regular_texts_are_no_repeats(spark):
    rows = [(1, " ".join(regular(1024)[:40])), (2, " ".join(regular(1024, True)[:40])), (3, "x " * 30), (4, "".join(regular(256))), (5, "".join(regular(256, True)))]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in dedup_words(df).select("n_words", "n_removed", "kept_sha256").collect())
    assert got == sorted(brute_words([r[1] for r in rows], 35))
    got = sorted(tuple(r) for r in dedup_bytes(df).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == sorted(brute_bytes([r[1] for r in rows], 200))


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_bytes(spark, limit):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for length in (60, 200):
        got = sorted(tuple(r)[1:] for r in dedup_bytes(df, length=length, limit=limit).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
        assert got == sorted(brute_bytes([r[1] for r in rows], length))


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_words(spark, limit):
    rows = corpus(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for window in (6, 35):
        got = sorted(tuple(r)[1:] for r in dedup_words(df, window=window, limit=limit).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
        assert got == sorted(brute_words([r[1] for r in rows], window))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dedup_bytes(df).collect() == [] and dedup_words(df).collect() == []
