import numpy as np

from casemill.llm.embedding_dedup import near_links, op10, tables_for


def brute(rows, threshold):
    n = len(rows)
    unit = []
    for _, v, lab, *_ in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v is not None else np.array([np.nan])
        unit.append(x / np.linalg.norm(x) if lab is not None and np.isfinite(x).all() and (x != 0).any() else None)
    adj = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in adj[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        low = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((rows[i][0], len(adj[i]), low, rows[i][0] == low))
    return out


def made(seed=0, n=120, width=16):
    r = np.random.RandomState(seed)
    rows = []
    base = r.standard_normal((8, width))
    for i in range(n):
        x = base[i % 8] + r.standard_normal(width) * r.choice([0.02, 0.1, 0.25, 3.0])
        rows.append((i, [float(c) for c in x], int(i % 3), "x"))
    bad = [None, [], [0.0] * width, [float("nan")] * width, [None] * width, [float("inf")] + [1.0] * (width - 1)]
    rows += [(n + i, v, 1, "x") for i, v in enumerate(bad)]
    rows += [(200, rows[0][1], None, "x"), (201, rows[0][1], 0, "x"), (201, rows[0][1], 0, "x"), (202, [2 * c for c in rows[0][1]], 0, "x"), (203, rows[0][1][:4], 0, "x")]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def test_links(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    rows = [tuple(r) for r in df.collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    for block in (512, 4):
        got = [tuple(r) for r in near_links(df, recall=0.9999999, block_rows=block).collect()]
        assert sorted(got, key=key) == sorted(brute(rows, 0.93), key=key)


def test_recall(spark):
    r = np.random.RandomState(3)
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    rows = [(x.vec_id, [float(c) for c in x.embedding], x.label) for x in rows]
    size = np.mean([np.linalg.norm(x[1]) for x in rows]) / 8
    rows += [(1000 + i, [float(c + e) for c, e in zip(v, r.standard_normal(64) * size * r.uniform(0.1, 0.4))], lab) for i, v, lab in rows]
    got = {r.vec_id: r.n_links for r in near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = {r[0]: r[1] for r in brute(rows, 0.93)}
    assert all(got[k] <= want[k] for k in want)
    print("recall", sum(got.values()) / sum(want.values()))
    assert sum(got.values()) >= 0.95 * sum(want.values()) > 0
    assert len(op10(spark, "/root/testdata/sf0.01").collect()) == 500


def test_tables():
    assert tables_for(0, 0.93, 0.97)[0] >= 4
    small, large = tables_for(1000, 0.93, 0.97), tables_for(10**9, 0.93, 0.97)
    assert large[0] > small[0] and large[1] > small[1]


def test_empty(spark):
    assert near_links(spark.createDataFrame([], SCHEMA)).collect() == []
