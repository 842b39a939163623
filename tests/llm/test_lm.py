import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from casemill.llm import lm_score
from casemill.llm.arrays import pack_planes, pack_sorted, unpack_planes, unpack_sorted
from casemill.llm.lm_score import level_value, levels, op1, score_texts
from casemill.llm.shared import shared_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)) + [None]


def brute(rows, training):
    uni, bi = Counter(), Counter()
    for t in training:
        x = toks(t)
        uni.update(x)
        bi.update(zip([None, *x], x))
    follow = Counter(v for v, _ in bi)
    total, distinct = sum(uni.values()), len(uni)
    out = []
    for t in rows:
        x = toks(t)
        base = score = 0.0
        for v, w in zip([None, *x], x):
            p1 = (uni[w] + 0.5) / (total + 0.5 * (distinct + 1))
            c = min(float(level_value(levels(np.array([bi[v, w]])))[0]) if bi[v, w] else 0.0, uni[v], uni[w])
            base += math.log10(p1)
            score += math.log10((c + follow[v] * p1) / (uni[v] + follow[v]) if uni[v] else p1)
        out.append((len(x), sum(uni[w] > 0 for w in x), total, base, score))
    return out


@pytest.mark.parametrize("limit", [1 << 28, -1])
def test_scores(spark, limit):
    r = np.random.RandomState(0)
    texts = [" ".join(r.choice(["a", "B", "b", "É", "é", "c\x0bd", "the", f"w{r.randint(300)}"], p=[0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.2]) for _ in range(r.randint(0, 90))) for _ in range(60)]
    texts += [None, "", "  \n", texts[0], texts[0], "word " * 60_000]
    df = spark.createDataFrame([(i % 64, t, "clash") for i, t in enumerate(texts)] + [(None, None, None)], "doc_id long, text string, score string")
    training = df.where("doc_id % 2 = 0")
    got = sorted(tuple(x)[1:] for x in score_texts(df, training, limit=limit).collect())
    want = sorted(brute([*texts, None], [t for i, t in enumerate(texts) if i % 64 % 2 == 0]))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    off = np.abs(np.array([g[4] for g in got]) - [w[4] for w in want])
    # a false hit of the filter lifts a score; on so few texts most are exact
    assert off.max() < 25 and np.median(off) < 1e-6
    empty = df.where("1 = 0")
    assert score_texts(empty, empty, limit=limit).collect() == []
    alone = score_texts(df.limit(1), empty, limit=limit).first()
    assert abs(alone.base_score - alone.score) < 1e-9 and alone.n_known == 0


def test_scores_are_the_same_at_any_limit(spark):
    at = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(at).select("doc_id", "text")
    ways = [{r.doc_id: r for r in score_texts(docs, docs.where("doc_id % 3 = 0"), limit=limit).collect()} for limit in (1 << 28, -1)]
    assert ways[0].keys() == ways[1].keys()
    for i, a in ways[0].items():
        b = ways[1][i]
        assert tuple(a)[:4] == tuple(b)[:4] and abs(a.base_score - b.base_score) < 1e-6 and abs(a.score - b.score) < 1e-6


def test_packed_keys():
    r = np.random.RandomState(1)
    for x in ([], [0], [2**64 - 1], [0, 2**64 - 1], r.randint(0, 2**62, 5000), range(1000)):
        keys = np.unique(np.array(list(x), np.uint64))
        assert (unpack_sorted(pack_sorted(keys)) == keys).all() and len(pack_sorted(keys)) <= 9 + 8 * len(keys)
    n = r.randint(0, 2**31, 1000)
    assert (unpack_planes(pack_planes(n, 4), 4) == n).all() and len(unpack_planes(pack_planes(n[:0], 4), 4)) == 0


@pytest.mark.parametrize("limit", [1 << 28, -1])
def test_disk(spark, monkeypatch, limit):
    """What a run writes on the way is a few times its texts on both sides of the limit, and goes with it; texts that ask in many chunks get the scores of one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(4)
    one = {r.doc_id: r for r in score_texts(docs, docs.where("doc_id % 3 = 0"), limit=limit).collect()}
    written, plain = [], lm_score.stage
    size = lambda at: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(at.removeprefix("file:")) for f in names)

    def staged(df, name, *used):
        out = plain(df, name, *used)
        written.append(size(out.staged_at))
        return out

    monkeypatch.setattr(lm_score, "stage", staged)
    monkeypatch.setattr(lm_score, "CHUNK", 1000, raising=False)
    before = size(shared_dir(spark))
    got = {r.doc_id: r for r in score_texts(docs, docs.where("doc_id % 3 = 0"), limit=limit).collect()}
    texts = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert sum(written) < 2 * texts
    assert size(shared_dir(spark)) - before < 0.1 * texts
    assert got.keys() == one.keys() and all(tuple(got[k])[:4] == tuple(r)[:4] and abs(got[k].score - r.score) < 1e-6 for k, r in one.items())


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], [r.text for r in rows if not held[r.doc_id]])))
    got = {r.doc_id: r for r in op1(spark, "/root/testdata/sf0.01").collect()}
    for k, w in want.items():
        g = got[k]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[k], *w[:3]) and abs(g.base_score - w[3]) < 1e-6 * abs(w[3])
    mean = lambda f: sum(f(k) for k in want if held[k]) / sum(want[k][0] for k in want if held[k])
    print("held out, log10 a token: base", mean(lambda k: got[k].base_score), "model", mean(lambda k: got[k].score), "exact counts", mean(lambda k: want[k][4]))
    assert abs(mean(lambda k: got[k].score) - mean(lambda k: want[k][4])) < 0.05
