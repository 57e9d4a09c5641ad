"""Budgets, condensing, deltas, decisions, reports."""

import random

from pyspark.sql import functions as F

from auditlake.operators import context as X
from auditlake.operators import jobs, runlog as L


def loop_budget(files, limit):
    used, out = 0, []
    for f, rows in files:
        if used >= limit:
            break
        for i, size in enumerate(rows, 1):
            out.append((f, i))
            if used + size > limit:
                break
            used += size
    return out


def test_budget_matches_the_loop(spark):
    rnd = random.Random(2)
    runs = {r: [(f, [rnd.choice([0, 1, 5, 9, 30]) for _ in range(rnd.randint(1, 8))]) for f in range(rnd.randint(1, 6))] for r in range(40)}
    runs[100] = [(1, [50]), (2, [1])]
    runs[101] = [(1, [51]), (2, [1])]
    runs[102] = [(1, [20, 40, 1]), (2, [30, 1]), (3, [1])]
    rows = [(r, f, i, "x" * s) for r, fs in runs.items() for f, sizes in fs for i, s in enumerate(sizes, 1)]
    df = spark.createDataFrame(rows, "run bigint, file bigint, row bigint, line string")
    got: dict = {}
    for r in X.budget_prefix(df, "run", "file", "row", F.length("line"), 50).orderBy("run", "file", "row").collect():
        got.setdefault(r.run, []).append((r.file, r.row))
    assert got == {r: loop_budget(fs, 50) for r, fs in runs.items()}


def test_condense(spark):
    short = "\n".join(f"line {i}" for i in range(10))
    long = "\n".join(["same words here"] * 300 + [f"other line {i}" for i in range(300)])
    docs = spark.createDataFrame([(1, short), (2, long), (3, "")], "i int, t string")
    got = {r.i: r.t for r in X.condense(docs, "t", threshold=500, words=200).collect()}
    assert got[1] == short and got[3] == ""
    first, second = got[2].split("\n\n")
    assert first.split("\n")[:2] == ["same words here", "other line 0"]
    # 100 words per chunk: three for the repeated line, then 32 lines of three.
    assert len(first.split("\n")) == 33 and len(second.split("\n")) == 33


def test_condense_goes_on_and_keeps_something(spark):
    many = "\n".join(f"line {i}" for i in range(30000))
    wide = "\n".join(["long " * 400 + str(i) for i in range(600)])
    mixed = "\n".join(["long " * 400] + [f"short {i}" for i in range(599)])
    docs = spark.createDataFrame([(1, many), (2, wide), (3, mixed)], "i int, t string")
    got = {r.i: r.t.split("\n") for r in X.condense(docs, "t", threshold=500, words=200).collect()}
    assert all(0 < len(x) < 500 for x in got.values())
    assert got[1][0] == "line 0" and got[2][0] == " ".join(["long"] * 100) and "short 0" in got[3]


def loop_deltas(texts):
    out, acc = [], ""
    for i, t in enumerate(texts):
        if not t:
            continue
        if t.startswith(acc):
            if t[len(acc):]:
                out.append((i, t[len(acc):]))
                acc = t
        else:
            out.append((i, t))
            acc += t
    return out


def test_text_deltas_match_the_loop(spark):
    rnd = random.Random(4)
    keys = {
        "grow": ["a", "ab", "ab", "abc"], "restart": ["ab", "x", "abx", "abxy", "ab"], "whole": ["q", "w", "e"], "empty": ["", "a", "", "ab"],
        "again": ["ab", "ab", "abab", "c", "ababc"],
    }
    for i in range(40):
        keys[f"r{i}"] = ["".join(rnd.choices("ab", k=rnd.randint(0, 5))) for _ in range(rnd.randint(1, 9))]
    df = spark.createDataFrame([(k, i, t) for k, v in keys.items() for i, t in enumerate(v)], "k string, i bigint, t string")
    got: dict = {}
    for r in L.text_deltas(df, "k", "i", "t").orderBy("key", "seq").collect():
        got.setdefault(r.key, []).append((r.seq, r.delta))
    assert got == {k: loop_deltas(v) for k, v in keys.items() if loop_deltas(v)}


def test_loop_decisions(spark):
    rows = [("a", 1, 50), ("a", 2, 90), ("a", 3, 99), ("b", 1, 10), ("b", 2, 20), ("b", 3, 30), ("b", 4, 95), ("c", 1, 90)]
    got = sorted(map(tuple, L.loop_decisions(spark.createDataFrame(rows, "run_id string, iteration int, score int"), 3).collect()))
    assert got == [
        ("a", 1, 50, True), ("a", 2, 90, False), ("b", 1, 10, True), ("b", 2, 20, True), ("b", 3, 30, False), ("c", 1, 90, False),
    ]


def test_audit_report(spark):
    evaluations = spark.createDataFrame(
        [("r", 1, 40, "goal", "gap", "first"), ("r", 2, 92, "goal", "fine", "second")],
        "run_id string, iteration int, score int, objective string, explanation string, analysis string",
    )
    step = "array<struct<tool:string,query_string:string,status:string,explanation:string>>"
    plans = spark.createDataFrame(
        [("r", 1, [("t1", "q1", "done", "e1")]), ("r", 2, [("t2", "q2", None, "e2")]), ("r", 3, [("t3", "q3", None, "e3")])],
        f"run_id string, iteration int, steps {step}",
    )
    lines = [r.line for r in jobs.audit_run(evaluations, plans).orderBy("section", "iteration", "step_no").collect()]
    assert lines == [
        "- **Objective**: goal", "- **Confidence Score**: 92/100", "- **Total Iterations Completed**: 2", "fine", "second",
        "### Iteration 1 Action Plan", "- **Tool**: `t1` | **Query**: `q1` | **Status**: `done`\n  *Explanation*: e1",
        "### Iteration 2 Action Plan", "- **Tool**: `t2` | **Query**: `q2` | **Status**: `done`\n  *Explanation*: e2",
    ]


def test_listings_and_context(spark):
    columns = spark.createDataFrame([("a.csv", 1, "x"), ("a.csv", 2, "y")], "file string, ordinal int, column_name string")
    assert [r.line for r in X.column_listing(columns).orderBy("file", "ordinal").collect()] == ["Dataset: a.csv", "  - x", "  - y"]
    one = spark.createDataFrame([("t",)], "text string")
    assert [r.iteration for r in X.append_context(X.append_context(None, one, 1), one, 2).collect()] == [1, 2]
