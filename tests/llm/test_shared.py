import random

import pytest

from casemill.llm import shared
from casemill.llm.shared import components, discard, hot_join, stage


def brute(edges):
    own = {}
    for a, b in edges:
        if a != b:
            own.setdefault(a, {a}), own.setdefault(b, {b})
            if own[a] is not own[b]:
                both = own[a] | own[b]
                for x in both:
                    own[x] = both
    return sorted((x, min(s)) for x, s in own.items())


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", limit)
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(500, 500 + i) for i in range(200)] + [(900 + i, 901 + i) for i in range(40)] + [(7, 7)]
    assert sorted(tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()) == brute(edges)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join(spark, how):
    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)] + [(None, 1000), (99, 1001)], "k int, v int")
    right = stage(left.where("k < 9").groupBy("k").count(), "right")
    want = sorted(map(str, left.join(right, "k", how).collect()))
    for most in (2, 10_000):
        assert sorted(map(str, hot_join(left, right, "k", "count", how, limit=-1, most=most).collect())) == want
    discard(right)
