import math
import random
import re
from hashlib import sha256

import numpy as np
import pytest

from casemill.llm.quality import class_prior, fit_pu, fit_quality, op8, pu_risk, score_quality
from casemill.llm.secret_scan import op7, scan_secrets


def brute_base(text):
    text = text or ""
    out = []
    for m in re.finditer("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    for k, pattern, n in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= n]
    out.sort()
    named = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in out)
    return [sum(x[1] == k for x in out) for k in range(3)], sha256(named.encode()).hexdigest(), named


def test_base_and_ownership(spark):
    live, copied = "Zk39dLq8Xw2Rt7Yp4Bn6", "Ab12Cd34Ef56Gh78Ij90"
    texts = [
        (1, f"é password = '{live}' x", "a"), (2, f"token:{copied}", "a"), (3, f"token:{copied}", "b"), (4, f"bare {live}, and {copied}", "a"),
        (5, "secret: token = abcdefgh password: short", "a"), (6, None, None), (7, "", "b"), (8, "AKIA" + "A" * 12 + " AKIAAAA " + "ab" * 16, "b"),
        (9, "ſecret=abcdefgh toKen=abcdefgh", "b"), (10, "f" * 31, "a"), (11, "e" * 10, "c"), (11, "e" * 30, "c"), (12, "x" * 200_000 + ' API_KEY: "q1w2e3r4t5y6"', "c"),
    ]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, source string, row string")
    got = scan_secrets(df, ["source"], ["source"]).collect()
    key = lambda x: (x[0], x[2])
    want = sorted(((i, *brute_base(t)) for i, t, _ in texts), key=key)
    assert sorted(((r.doc_id, [r.n_assign, r.n_access, r.n_hex], r.base_sha256) for r in got), key=key) == [w[:3] for w in want]
    by = {r.doc_id: r for r in got}
    assert by[1].n_live == 1 and by[2].n_live == 0 and by[2].n_example == 1
    assert by[4].spans == "bare:5:25" and by[4].n_added == 1
    assert scan_secrets(spark.createDataFrame([], df.schema), ["source"], ["source"]).collect() == []


def brute_owners(rows):
    """Counts and spans by the rule: values of two owners or more are examples, others that look random are live."""
    found = []
    for n, (i, text, source, lang) in enumerate(rows):
        base = [tuple(x.split(":")) for x in brute_base(text)[2].split(",") if x]
        spans = [(int(a), ("assign", "access", "hex").index(k), int(b)) for k, a, b in base]
        for a, k, b in spans:
            v = text[a:b]
            if k == 0:
                v = re.search("[A-Za-z0-9+/_.=-]+$", v)[0]
            found.append((n, a, k, b, v, source))
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or ""):
            if not any(a < m.end() and m.start() < b for a, _, b in spans):
                found.append((n, m.start(), 3, m.end(), m[0], source))
    bits = lambda v: -sum(v.count(c) / len(v) * math.log2(v.count(c) / len(v)) for c in set(v))
    owners, named = {}, set()
    for _, _, k, _, v, source in found:
        owners.setdefault(v, set()).add(source)
        if k < 3:
            named.add(v)
    out = []
    for n, (i, text, source, lang) in enumerate(rows):
        live = example = added = 0
        spans = []
        for m, a, k, b, v, _ in found:
            if m != n:
                continue
            own = len(owners[v]) < 2
            random_ = bits(v) >= 3 if k < 3 else bits(v) >= 3.5 and all(re.search(x, v) for x in ("[0-9]", "[a-z]", "[A-Z]"))
            if k < 3:
                live += own and random_
                example += not own
                spans.append((a, k, b))
            elif own and (random_ or v in named):
                added += 1
                spans.append((a, k, b))
        out.append((i, live, example, added, ",".join(f"{('assign', 'access', 'hex', 'bare')[k]}:{a}:{b}" for a, k, b in sorted(spans))))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_ownership(spark, monkeypatch, limit):
    monkeypatch.setattr("casemill.llm.shared.hot_join.__defaults__", ("inner", 64, limit, 3))
    r = random.Random(5)
    values = ["".join(r.choice("ABCDEFabcdef0123456789") for _ in range(r.choice([8, 20, 24, 40]))) for _ in range(30)] + ["a" * 24, "AKIA" + "Z9" * 8, "0123456789abcdef" * 2, "hot1HOT2hot3HOT4hot5"]
    rows = []
    for i in range(150):
        parts = [r.choice(["é", "token: {}", "PASSWORD='{}'", "{}", "key {}"]).format(r.choice(values)) for _ in range(r.randrange(4))]
        rows.append((i % 140, " ".join([*parts, values[-1]] if i % 3 == 0 else parts), r.choice(["a", "b", "c", None]), r.choice(["en", None])))
    rows += [(200, None, None, None), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = scan_secrets(df, ["source", "lang"], ["source"]).collect()
    assert sorted(((x.doc_id, x.n_live, x.n_example, x.n_added, x.spans) for x in got), key=str) == brute_owners(rows)
    assert sum(x.n_live for x in got) and sum(x.n_example for x in got) and sum(x.n_added for x in got)


def test_base_on_table(spark):
    got = {r.doc_id: r for r in op7(spark, "/root/testdata/sf0.01").collect()}
    found = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        n, digest, named = brute_base(r.text)
        found += sum(n)
        assert [got[r.doc_id].n_assign, got[r.doc_id].n_access, got[r.doc_id].n_hex] == n and got[r.doc_id].base_sha256 == digest
        assert set(filter(None, named.split(","))) <= set(got[r.doc_id].spans.split(","))
    assert found


def test_quality(spark):
    at = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op8(spark, at).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    right = np.mean([p == y for p, y in held])
    kept = np.mean([p for p, y in held if y == 1])
    caught = np.mean([1 - p for p, y in held if y == 0])
    print(f"held out: right {right:.4f}, good kept {kept:.4f}, bad caught {caught:.4f}")
    assert right > 0.97 and kept > 0.98 and caught > 0.85


def test_risk_and_gradient():
    r = np.random.RandomState(2)
    p, u, w = r.standard_normal((40, 5)) + 0.7, r.standard_normal((90, 5)), r.standard_normal(5)
    loss = lambda z, y: np.log1p(np.exp(-y * z))
    for prior in (0.2, 0.7):
        up, down, g_up, g_down = pu_risk(w, p, u, prior)
        assert np.isclose(up, prior * np.mean(loss(p @ w, 1)))
        assert np.isclose(down, np.mean(loss(u @ w, -1)) - prior * np.mean(loss(p @ w, -1)))
        for k in range(5):
            step = np.eye(5)[k] * 1e-6
            a, b = pu_risk(w + step, p, u, prior), pu_risk(w - step, p, u, prior)
            assert np.isclose((a[0] - b[0]) / 2e-6, g_up[k], atol=1e-6) and np.isclose((a[1] - b[1]) / 2e-6, g_down[k], atol=1e-6)


def test_fit_lowers_the_risk():
    r = np.random.RandomState(3)
    p = r.standard_normal((400, 3)) + 1.5
    u = np.concatenate([r.standard_normal((300, 3)) + 1.5, r.standard_normal((700, 3)) - 1.5])
    model = fit_pu(p, u, 0.3)
    score = model.score(u)
    assert (score[:300] >= 0.5).mean() > 0.95 and (score[300:] < 0.5).mean() > 0.95


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_prior_needs_no_negatives(share):
    r = np.random.RandomState(4)
    n = 4000
    p = r.standard_normal((n, 3)) + 1.5
    u = np.concatenate([r.standard_normal((int(n * share), 3)) + 1.5, r.standard_normal((n - int(n * share), 3)) - 1.5])
    assert abs(class_prior(p, r.permutation(u), 0.1) - share) < 0.08


def test_quality_without_documents(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = fit_quality(docs, labels)
    assert model is None and score_quality(docs, model).collect() == []
    one = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    assert len(score_quality(one, fit_quality(one, labels)).collect()) == 9


def test_quality_edges(spark):
    schema = "doc_id long, text string, score string"
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", "x"), (2, "a " * 100_000, None)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert fit_quality(docs, none) is None
    assert [r.score for r in score_quality(docs, None).collect()] == [0.5] * 4
    assert score_quality(spark.createDataFrame([], schema), None).collect() == []
