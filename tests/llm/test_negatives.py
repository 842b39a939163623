import math

import numpy as np
import pytest

from casemill.llm import hard_negatives
from casemill.llm.hard_negatives import Anchors, dots, mine_negatives, spanning_tree

SCHEMA = "vec_id long, embedding array<float>, label int, row string"


def brute(rows, positives=5, negatives=10, low=30, high=90):
    own = []
    for i, v, lab, *_ in rows:
        if lab is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        own.append((i, lab, [math.floor(256 * c) for c in v]))
    out = []
    for a, (i, lab, x) in enumerate(own):
        if i is None or i % 100:
            continue
        order = lambda t: (-t[0], t[1] is None, t[1] or 0)
        score = [(sum(p * q for p, q in zip(x, y)), j, m == lab) for b, (j, m, y) in enumerate(own) if b != a and len(x) == len(y)]
        for s, j, _ in sorted((t for t in score if t[2]), key=order)[:positives]:
            fits = sorted((t for t in score if not t[2] and low * s <= 100 * t[0] <= high * s), key=order)[:negatives]
            out += [(i, j, k + 1, t[1], s, t[0]) for k, t in enumerate(fits)]
    return out


def made(seed=0, n=400, width=8, step=20):
    r = np.random.RandomState(seed)
    base = r.standard_normal((5, width))
    rows = [(i * step, [float(np.float32(c)) for c in base[i % 5] + r.standard_normal(width) * r.choice([0.0, 0.1, 0.5])], int(r.randint(3)), "x") for i in range(n)]
    bad = [None, [], [float("nan")] * width, [None] * width, [float("inf")] + [1.0] * (width - 1)]
    rows += [(n * step + 100 * i, v, 1, "x") for i, v in enumerate(bad)]
    rows += [(n * step + 1000, rows[0][1], None, "x"), (n * step + 1100, [0.0] * width, 1, "x"), (n * step + 1200, [1.0, 2.0], 1, "x"), (n * step + 1201, [1.0, 1.5], 1, "x"), (n * step + 1202, [0.5, 0.75], 2, "x")]
    return rows


def same(got, want):
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("block,rows_at_once,seeds", [(2048, 1024, 4096), (7, 16, 20), (1, 64, 1)])
def test_against_brute_force(spark, monkeypatch, block, rows_at_once, seeds):
    monkeypatch.setattr(hard_negatives, "ROWS", rows_at_once)
    monkeypatch.setattr(hard_negatives, "SEEDS", seeds)
    rows = made(step=20 if block > 1 else 5)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert len(want) > 200
    same(mine_negatives(df, "vec_id % 100 = 0", block=block).collect(), want)


def test_repeated_and_null_ids(spark):
    rows = made(n=60, step=25)
    rows += [(100, rows[4][1], 1, "x"), (100, rows[4][1], 1, "x"), (None, rows[7][1], 2, "x"), (None, rows[8][1], 0, "x"), (200, rows[9][1], 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    same(mine_negatives(df, "vec_id % 100 = 0", positives=3, negatives=200, low=-50, high=100).collect(), brute(rows, 3, 200, -50, 100))


def test_edges(spark):
    assert mine_negatives(spark.createDataFrame([], SCHEMA), "vec_id % 100 = 0").collect() == []
    assert mine_negatives(spark.createDataFrame(made(n=20), SCHEMA), "vec_id = -1").collect() == []
    with pytest.raises(OverflowError):
        dots(np.full((1, 4), 2.0**31), np.full((1, 4), 2.0**31))


def test_tree():
    r = np.random.RandomState(1)
    x = np.floor(r.standard_normal((60, 6)) * 100)
    parent, edge, levels = spanning_tree(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    reached, total = {0}, 0.0
    while len(reached) < 60:
        w, k = min((d[a, b], b) for a in reached for b in range(60) if b not in reached)
        reached.add(k)
        total += w
    assert np.isclose(edge.sum(), total) and np.allclose(edge, d[np.arange(60), parent])
    assert sorted(np.concatenate(levels).tolist()) == list(range(60)) and all(set(parent[b]) <= set(a) for a, b in zip(levels, levels[1:]))


def test_bounds_leave_scores_out():
    """Only pairs whose bounds meet the window are scored, and none that counts is left out."""
    r = np.random.RandomState(2)
    centre = r.standard_normal((4, 32))
    near = lambda n: np.floor(256 * (centre[r.randint(4, size=n)] + 0.02 * r.standard_normal((n, 32))))
    anchors, x = Anchors(np.arange(40), np.zeros(40, np.int64), near(40)), near(500)
    all_scores = dots(x, anchors.vectors)
    least = int(np.quantile(all_scores, 0.9))
    got = np.zeros_like(all_scores, bool)

    def met(a, rows, score):
        assert (all_scores[rows, a] == score).all()
        got[rows, a] = True

    done = anchors.scores(x, lambda level, low, high: high >= least, met)
    assert (got | (all_scores < least)).all() and done == got.sum() and done < 0.6 * got.size
