"""Rows of known number are dealt to tasks of bounded size, whatever Spark would join to few."""

import random

from casemill.operators import audit, parts


def test_small_tables_are_left_alone(spark):
    df = spark.range(100)
    assert parts.dealt(df, 100, "id") is df and parts.dealt(df, None, "id") is df


def test_run_binding_in_bounded_tasks(spark, monkeypatch):
    r = random.Random(4)
    jobs = [(j, r.choice(["a", "b", None])) for j in range(300)]
    snapshots = [(j, f"{j}-{r.choice('xyz')}") for j in range(250) for _ in range(r.randint(1, 4))] + [(7, "lost"), (260, "lost"), (8, None), (None, "0-x")]
    runs = [(run, r.choice(["a", "b", None])) for run in sorted({s[1] for s in snapshots if s[1] not in (None, "lost")})]
    runs += runs[:20]  # a run that is told twice is one run
    parent = dict(runs)
    want = set()
    for job, own in jobs:
        found = {run for j, run in snapshots if j == job and run in parent}
        if not found:
            want.add((job, "NO_RUN"))
        elif len(found) > 1:
            want.add((job, "SEVERAL_RUNS"))
        elif parent[min(found)] != own:
            want.add((job, "OTHER_PARENT"))
    frames = spark.createDataFrame(jobs, "job_id int, parent string"), spark.createDataFrame(snapshots, "job_id int, run_id string"), spark.createDataFrame(runs, "run_id string, parent string")
    monkeypatch.setattr(parts, "ROWS", 20)
    for rows in (None, len(snapshots)):
        found = audit.check_run_binding(*frames, rows)
        assert {tuple(x) for x in found.collect()} == want and found.count() == len(want)
    n = -(-len(snapshots) // 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert n > 8 and plan.count(f", {n}), REPARTITION_BY_NUM") >= 2


def test_unique_keys_are_told_by_their_counts(spark, monkeypatch):
    from collections import Counter

    from casemill.operators import rules

    r = random.Random(5)
    rows = [(r.choice([None, "", *map(str, range(40))]), r.choice([None, 1, 2])) for _ in range(300)]
    df = spark.createDataFrame(rows, "id string, n int")
    monkeypatch.setattr(parts, "ROWS", 20)
    monkeypatch.setattr(rules, "TOLD", 3)
    ids, both = Counter(a for a, _ in rows if a is not None), Counter(x for x in rows if None not in x)
    want = Counter((a, "UNIQUE_id") for a, _ in rows if ids[a] > 1) + Counter((a, "UNIQUE_id_n") for a, n in rows if both[a, n] > 1) + Counter((a, "UNIQUE_n") for a, n in rows if n)
    for known in (None, {"t": len(rows)}):
        x = rules.check_tables({"t": df}, {"t": rules.Rules("id", unique=(("id",), ("id", "n"), ("n",)))}, known)
        assert Counter((v.key, v.rule) for v in x.collect()) == want
        own = rules.check_tables({"t": df}, {"t": rules.Rules("id", unique=(("id",),))}, known)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in own and ("REPARTITION_BY_NUM" in own) == (known is not None)
