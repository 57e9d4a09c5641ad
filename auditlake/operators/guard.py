"""SQL over registered tables, plain and guarded."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.sqltext import lint_reason, strip_comments


@contextmanager
def _settings(spark: SparkSession, **pairs: str):
    old = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in pairs}
    try:
        for key, value in pairs.items():
            spark.conf.set(key.replace("__", "."), value)
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Any SQL over the session's tables; double quotes name columns."""
    with _settings(spark, spark__sql__ansi__enabled="true", spark__sql__ansi__doubleQuotedIdentifiers="true"):
        return spark.sql(sql)


def check_sql(spark: SparkSession, sql: str) -> str:
    """The text without comments; raises on anything but one read-only SELECT that parses."""
    row = spark.range(1).select(lint_reason(F.lit(sql)).alias("r"), strip_comments(F.lit(sql)).alias("q")).first()
    if row["r"] is not None:
        raise ValueError(f"Disallowed SQL: {row['r']}")
    clean = row["q"].strip().rstrip(";")
    try:
        with _settings(spark, spark__sql__ansi__enabled="true", spark__sql__ansi__doubleQuotedIdentifiers="true"):
            spark._jsparkSession.sessionState().sqlParser().parsePlan(clean)
    except ParseException as error:
        raise ValueError(f"Disallowed SQL: does not parse: {error.getCondition()}") from error
    return clean


def guarded_sql(spark: SparkSession, sql: str, row_limit: int | None = 100) -> DataFrame:
    """One checked SELECT with its result capped.

    Wrapped as a subquery, commands do not parse; files cannot be read by path.
    """
    clean = check_sql(spark, sql)
    with _settings(
        spark,
        spark__sql__ansi__enabled="true",
        spark__sql__ansi__doubleQuotedIdentifiers="true",
        spark__sql__runSQLOnFiles="false",
    ):
        result = spark.sql(f"SELECT * FROM ({clean}\n) AS q")
    return result if row_limit is None else result.limit(row_limit)


def lint(queries: DataFrame, key: str, sql: str) -> DataFrame:
    """Verdict per logged query: accepted or the first rule it breaks."""
    return queries.select(key, lint_reason(F.col(sql)).alias("reason")).select(
        key, F.col("reason").isNull().alias("accepted"), F.coalesce("reason", F.lit("ok")).alias("reason")
    )
