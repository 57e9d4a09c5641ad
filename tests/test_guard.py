"""SQL checks, guarded execution, table operations."""

import pytest
from pyspark.sql import functions as F

from auditlake.functions.sqltext import lint_reason, resolve_names
from auditlake.operators import tables as T
from auditlake.operators.cube import CubeSpec, Measure, Rule, data_cube, filtered_aggregates, scorecard
from auditlake.operators.guard import guarded_sql, run_sql

ACCEPTED = [
    "SELECT 'a -- b', 'c /* d */' FROM x", "VALUES (1), (2)", "FROM x", "\tselect 'drop'", 'SELECT "a;b" FROM x ;', "SELECT reflection(a) FROM x",
    "SELECT 'reflect(' FROM x", "SELECT 1 /* ; insert */", "WITH w AS (SELECT 'insert' AS i) SELECT i FROM w", "SELECT `x--y` FROM x",
]
REJECTED = {
    "SELECT 'a' ; SELECT 'b'": "many statements", "MERGE INTO x USING y ON 1 = 1": "not a select", "with w as (select 1) delete from x": "not a select",
    "TRUNCATE TABLE x": "not a select", "SELECT a FROM pg_tables": "catalog", "SELECT a FROM Information_Schema.columns": "catalog",
    "SELECT * FROM parquet_scan(a)": "function", "SELECT glob(a)": "function", "SELECT reflect\t('a', 'b')": "function",
    "SELECT `reflect` ('a')": "function", 'SELECT "java_method"(a)': "function", "SELECT reflect/* */('a')": "function", "SELECT input_file_name()": "function",
    "SELECT a FROM x WHERE b = 'd.json'": "location", 'SELECT "http://h/p"': "location", "\n\t": "empty", "/* nothing */ ;": "no statement",
}


def test_lint(spark):
    rows = spark.createDataFrame([(q,) for q in ACCEPTED + list(REJECTED)], "q string")
    got = {r.q: r.r for r in rows.select("q", lint_reason(F.col("q")).alias("r")).collect()}
    assert got == {**{q: None for q in ACCEPTED}, **REJECTED}


@pytest.fixture(scope="module")
def numbers(spark):
    df = spark.range(500).select(F.col("id").alias("int.rate"), (F.col("id") % 3).alias("g"))
    df.createOrReplaceTempView("numbers")
    return df


def test_guarded_sql_caps_and_keeps_order(spark, numbers):
    got = guarded_sql(spark, 'SELECT "int.rate" FROM numbers ORDER BY "int.rate" DESC LIMIT 400 -- no limit', 5).collect()
    assert [r[0] for r in got] == [499, 498, 497, 496, 495]
    assert guarded_sql(spark, "SELECT * FROM numbers").count() == 100


@pytest.mark.parametrize(
    "sql",
    [
        "DROP VIEW numbers", "SELECT 1; SELECT 2", "SELECT * FROM text.`/etc/hostname`", "SELECT reflect\t('java.lang.Math', 'max', 1, 2)",
        "SELECT `reflect`('java.lang.Math', 'max', 1, 2)", "SHOW TABLES", "SELECT FROM WHERE ((", "SELECT 1 + FROM",
    ],
)
def test_guarded_sql_refuses(spark, numbers, sql):
    with pytest.raises(Exception):
        guarded_sql(spark, sql).collect()
    assert spark.catalog.tableExists("numbers")


def test_guard_leaves_literals_alone(spark):
    assert tuple(guarded_sql(spark, "SELECT 'a/*1*/b' AS x, 'a -- b' AS y -- end").first()) == ("a/*1*/b", "a -- b")


def test_run_sql_restores_settings(spark, numbers):
    before = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
    assert run_sql(spark, 'SELECT max("int.rate") AS m FROM numbers').first().m == 499
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == before


def test_cube_limits_and_dotted_names(numbers):
    spec = CubeSpec([Measure("SUM", "`int.rate`", "s"), Measure("COUNT", "*", "n")], ["g"], "`int.rate` < 10", [("s", True)], 2)
    assert [tuple(r) for r in data_cube(numbers, spec).collect()] == [(0, 18, 4), (2, 15, 3)]
    with pytest.raises(ValueError):
        Measure("MEDIAN", "x", "m").column([])


def test_names_with_dots_and_double_quotes(numbers):
    assert T.select_table(numbers, None, 'int.rate < 3 AND "g" = 1').count() == 1
    assert T.update_rows(numbers, {"g": F.lit(7)}, "int.rate > 497.5").filter("g = 7").count() == 2
    spec = CubeSpec([Measure("MAX", "int.rate", "hi"), Measure("SUM", '"int.rate" * 2', "s")], ["g"], '"int.rate" < 6', [("g", False)])
    assert [tuple(r) for r in data_cube(numbers, spec).collect()] == [(0, 3, 6), (1, 4, 10), (2, 5, 14)]
    assert scorecard(numbers, [Rule("high", "int.rate > 489", "major")], []).first()["violations"] == 10
    assert filtered_aggregates(numbers, ["g"], "int.rate", '"int.rate" = 0').filter("flagged_records = 1").count() == 1


def test_resolve_names():
    names = ["log.annual.inc", "int.rate", "x", "a b"]
    assert resolve_names("log.annual.inc * 12 + int.rate", names) == "`log.annual.inc` * 12 + `int.rate`"
    assert resolve_names("coalesce(int.rate, 'int.rate', \"a b\", `x`)", names) == "coalesce(`int.rate`, 'int.rate', `a b`, `x`)"


def test_table_operations(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "B", None)], "id int, `n.m` string, v double")
    assert T.select_table(df, ["n.m"], "id = 2").collect()[0][0] == "B"
    assert T.equal_ignoring_case(df, "n.m", "b").count() == 1
    assert T.append_rows(df, spark.createDataFrame([(3,)], "id int")).filter("v IS NULL").count() == 2
    with pytest.raises(ValueError):
        T.append_rows(df, spark.createDataFrame([(3,)], "nope int"))
    assert [r.v for r in T.update_rows(df, {"v": F.lit(0)}, "v > 1").orderBy("id").collect()] == [0.0, None]
    assert [r.v for r in T.update_rows(df, {"v": F.lit(9)}).collect()] == [9.0, 9.0]
    got = {r.column_name: (r.null_count, r.distinct_count) for r in T.profile(df, "t", exact=True).collect()}
    assert got == {"id": (0, 2), "n.m": (0, 2), "v": (1, 1)}
    assert T.profile(df, "t").count() == 3
    assert T.missing_references(df, "id", df.filter("id = 1"), "id").first()[0] == 2
