"""Column functions on names, lines, fences and paths."""

from pyspark.sql import functions as F

from auditlake.functions import text as X


def values(spark, fn, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_normalize_name(spark):
    cases = {
        "Google Inc.": "google-inc",
        "A & B Corporation?": "a-and-b-corporation",
        "  -Clean--Me- ": "clean-me",
        "!!!SpecialChars!!!": "specialchars",
        "": "concept",
        "Crédit\u00a0Line": "crdit-line",
        "tab\tand\nbreak": "tab-and-break",
    }
    assert values(spark, X.normalize_name, cases) == list(cases.values())


def test_tokens_keep_repeats_and_accents(spark):
    assert values(spark, X.tokens, ["Crédit crédit, A_1 -- b2!", "", "¿?"]) == [["crédit", "crédit", "a_1", "b2"], [], []]


def test_lines_and_line_count(spark):
    texts = ["", "\n", "a", "a\n", "a\nb", "a\r\nb\r\n", "a\rb", "\n\n", "a\n\n"]
    expected = [t.replace("\r\n", "\n").replace("\r", "\n").splitlines() for t in texts]
    assert values(spark, X.lines, texts) == expected
    assert values(spark, X.line_count, texts) == [len(e) for e in expected]


def test_strip_fence(spark):
    cases = {
        '```json\n{"a": 1}\n```': '{"a": 1}',
        "  ```\nx\ny\n``` \n": "x\ny",
        "```json\nopen": "```json\nopen",
        "plain ": "plain",
        "```\n```": "",
        "text ```\nx\n```": "text ```\nx\n```",
    }
    assert values(spark, X.strip_fence, cases) == list(cases.values())


def test_table_name(spark):
    cases = {"/d/Loan-data.v1.csv": "loan_data_v1", "x.csv": "x", ".csv": "_csv", "/a.b/c": "c", "a..csv": "a_"}
    assert values(spark, X.table_name, cases) == list(cases.values())


def test_local_name(spark):
    cases = {"http://x/y#z": "z", "http://x/y": "y", "z": "z", "http://x/": ""}
    assert values(spark, X.local_name, cases) == list(cases.values())


def test_decode_list_of_broken_text_is_empty(spark):
    assert values(spark, X.decode_list, ['["a","b"]', "[]", "no", None]) == [["a", "b"], [], [], []]


def test_fenced_blocks(spark):
    page = "x\n```mermaid\nA-->B\n```\n```python\nq\n```\n```mermaid \nC\nD\n  ```\n```mermaid\n \n```"
    assert values(spark, X.fenced_blocks, [page]) == [["A-->B", "C\nD"]]


def test_url_base64(spark):
    import base64

    texts = ["subjects?_d=1&k=~~~", "ÿþ>>>", "x" * 200]
    assert values(spark, X.url_base64, texts) == [base64.urlsafe_b64encode(t.encode()).decode() for t in texts]


def test_fixed_rounds_like_the_exact_value(spark):
    import random

    rnd = random.Random(8)
    numbers = [15.625, 0.265, 0.275, 0.285, 1.005, 2.675, 0.0, 100.0, 99.995, 6.625, 0.125, 0.375]
    numbers += [rnd.randint(0, 400) / rnd.choice([32, 800, 20000, 1000, 7]) * 100.0 for _ in range(3000)]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(numbers)], "i int, v double")
    got = [r[0] for r in rows.orderBy("i").select(X.fixed(F.col("v"))).collect()]
    assert got == [f"{v:.2f}" for v in numbers]


def test_percent_and_limits(spark):
    row = spark.range(1).select(
        X.percent(F.lit(1), F.lit(2)), X.percent(F.lit(1), F.lit(0)), X.chunk_word_limit(10_000, F.lit(3)),
        X.chunk_word_limit(100, F.lit(30)), X.relative_path(F.lit("/a/b/c.ttl"), "/a"), X.relative_path(F.lit("/ab/c"), "/a"),
    ).first()
    assert list(row) == ["50.00%", "0.00%", 3333, 50, "b/c.ttl", "/ab/c"]


def test_name_parts(spark):
    assert values(spark, X.name_parts, ["hasOriginalLoan", "log.annual.inc", "a_b-B"]) == [
        ["has", "loan", "original"], ["annual", "inc", "log"], ["a", "b"],
    ]
