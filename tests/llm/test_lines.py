import random

import duckdb
import pytest

from casemill.llm import shared
from casemill.llm.line_dedup import OP4_SQL, dedup_lines, longest_earlier, op4


def earlier(rows):
    """(id, pos) -> the most lines that a place shares with an earlier one."""
    places, out = {}, {}
    texts = {i: (t or "").split("\n") for i, t in rows}
    for i in sorted(texts):
        own = texts[i]
        for p in range(len(own)):
            best = 0
            for j, q in places.get(own[p], []):
                n = 0
                while p + n < len(own) and q + n < len(texts[j]) and own[p + n] == texts[j][q + n]:
                    n += 1
                best = max(best, n)
            if best:
                out[i, p] = best
            places.setdefault(own[p], []).append((i, p))
    return out


def brute(rows, min_chars):
    found, out = earlier(rows), []
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        gone, sizes, reach = [False] * len(lines), [], 0
        for p in range(len(lines)):
            n = found.get((i, p), 0)
            if p + n > reach and n:
                reach = p + n
                if len("\n".join(lines[p : p + n])) >= min_chars:
                    sizes.append(n)
                    gone[p : p + n] = [True] * n
        out.append((i, len(lines), sum(gone), len(sizes), max(sizes, default=0), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def made(seed):
    r = random.Random(seed)
    rows = []
    shared_runs = [[f"s{r.randrange(9)}" for _ in range(n)] for n in (2, 3, 5, 7, 12, 21)]
    for i in range(60):
        lines = []
        for _ in range(r.randrange(4)):
            x = list(r.choice(shared_runs))
            lines += x[r.randrange(3) :] + [f"own {i} {r.randrange(99)}"] * r.randrange(2) + ["ab"] * r.randrange(3)
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_longest_earlier(spark, monkeypatch, limit):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", limit)
    monkeypatch.setattr("casemill.llm.line_dedup.LIMIT", limit)
    rows = made(limit > 0)
    got = {(r.id, r.pos): r.lines for r in longest_earlier(spark.createDataFrame(rows, "id long, text string")).collect()}
    want = earlier(rows)
    assert got == want and len(set(want.values())) > 8


def test_lines(spark):
    long = "\n".join(f"line {i % 37} of a long text" for i in range(500))
    rows = [(1, "a\nb\nc"), (2, "b\nc\na"), (3, None), (4, ""), (5, "a"), (6, "a\na\na\na"), (7, "this is a line of some length\nz"), (8, "y\nthis is a line of some length"), (9, "a\nb\nc\nnew\n\n"), (10, long), (11, long), (12, "q\n" + long)]
    rows += [(20, "\n".join("abcdefghijk")), (21, "\n".join("abcdefghijk")), (22, "\n".join("abcdefgxhijk")), (23, "x\n" * 40)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, line string, pos int")
    want = brute(rows, 20)
    assert sorted(tuple(r) for r in dedup_lines(df).collect()) == want
    by = {w[0]: w for w in want}
    # eleven short lines go as one run of eleven, and not where the run is broken
    assert by[21][1:5] == (11, 11, 1, 11) and by[22][2] == 0
    assert dedup_lines(df.where("1 = 0")).collect() == []


def test_every_row_is_a_document(spark):
    text = "this is a line of some length\nand here is another one\nshort"
    rows = [(1, "a"), (2, text), (2, text), (3, "x\n" + text), (None, text), (None, text), (4, None), (4, None)]
    got = [tuple(r) for r in dedup_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    want = [(rows[order[place]][0], *rest) for place, *rest in brute([(place, rows[k][1]) for place, k in enumerate(order)], 20)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) == 8
    # ids of any type
    named = spark.createDataFrame([("b", text), ("a", text), ("c", "z")], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in dedup_lines(named).collect()} == {"a": 0, "b": 3, "c": 0}


def test_very_many_runs(spark):
    lines = [f"line {k % 50} of a list with many runs" for k in range(400)]
    text = "\n".join(x for k, line in enumerate(lines) for x in (line, f"own {k}"))
    rows = [(1, "\n".join(lines[:50])), (2, text)]
    assert sorted(tuple(r) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows, 20)


def test_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{at}/documents.parquet'")
    want = sorted(con.sql(OP4_SQL).fetchall())
    got = sorted(tuple(r) for r in op4(spark, at).collect())
    assert got == want and sum(r[2] for r in got) > 100
