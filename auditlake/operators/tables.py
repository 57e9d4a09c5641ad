"""Plain table operations: select, insert, update, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.sqltext import resolve_names

# Bookkeeping tables left out of every catalog view.
BOOKKEEPING_TABLES = [
    "processed_classes", "attribute_mappings", "file_line_sequence", "text_segments", "concepts",
    "concept_segment_mapping", "loan_prediction_train",
]


def quoted(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def select_table(df: DataFrame, columns: list[str] | None = None, condition: str = "", limit: int | None = 100) -> DataFrame:
    """Project, filter and cap a table."""
    rows = df.filter(resolve_names(condition, df.columns)) if condition.strip() else df
    rows = rows.select(*[quoted(c) for c in columns]) if columns else rows
    return rows if limit is None else rows.limit(limit)


def equal_ignoring_case(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column equals the value whatever the case."""
    return df.filter(F.lower(quoted(column)) == F.lower(F.lit(value)))


def append_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert rows that name only some of the columns; the others are NULL."""
    unknown = set(rows.columns) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return df.unionByName(rows, allowMissingColumns=True)


def update_rows(df: DataFrame, values: dict[str, Column], condition: str = "") -> DataFrame:
    """Set columns where the condition is true; without a condition, everywhere."""
    hit = F.expr(resolve_names(condition, df.columns)) if condition.strip() else F.lit(True)
    types = dict(df.dtypes)
    unknown = set(values) - set(types)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return df.select(
        *[
            (F.when(hit, values[c].cast(types[c])).otherwise(quoted(c)).alias(c) if c in values else quoted(c))
            for c in df.columns
        ]
    )


def profile(df: DataFrame, table: str, exact: bool = False) -> DataFrame:
    """One row per column: position, type, nulls, distinct values, smallest and largest value.

    ``exact`` replaces the distinct sketch by exact counts, made in one more scan for all columns.
    """
    plain = [(i, n, t) for i, (n, t) in enumerate(df.dtypes)]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, name, _ in plain:
        col = quoted(name)
        aggs += [
            F.count(col).alias(f"c{i}"),
            F.min(col).cast("string").alias(f"lo{i}"),
            F.max(col).cast("string").alias(f"hi{i}"),
        ]
        if not exact:
            aggs.append(F.approx_count_distinct(col).alias(f"d{i}"))
    one = df.agg(*aggs)
    cells = F.array(
        *[
            F.struct(
                F.lit(i + 1).cast("bigint").alias("ordinal"),
                F.lit(name).alias("column_name"),
                F.lit(kind).alias("data_type"),
                (F.col("n") - F.col(f"c{i}")).alias("null_count"),
                F.col(f"lo{i}").alias("min_value"),
                F.col(f"hi{i}").alias("max_value"),
                (F.lit(None).cast("bigint") if exact else F.col(f"d{i}")).alias("distinct_count"),
            )
            for i, name, kind in plain
        ]
    )
    rows = one.select(F.lit(table).alias("table_name"), F.col("n").alias("row_count"), F.explode(cells).alias("c")).select(
        "table_name", "row_count", "c.*"
    )
    if not exact:
        return rows
    # One scan gives (column, value) pairs; a repeated value shrinks before the shuffle and no task counts a whole column.
    cells = F.array(*[F.struct(F.lit(name).alias("column_name"), quoted(name).cast("string").alias("v")) for _, name, _ in plain])
    pairs = df.select(F.explode(cells).alias("c")).select("c.column_name", "c.v").distinct()
    counts = pairs.groupBy("column_name").agg(F.count("v").alias("distinct_count"))
    return rows.drop("distinct_count").join(counts, "column_name", "left").fillna(0, ["distinct_count"])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once; none means the key is unique."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def missing_references(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct non-null values of a reference column that have no parent row."""
    values = df.select(quoted(column).alias("missing_value")).filter("missing_value IS NOT NULL").distinct()
    return values.join(parent.select(quoted(key).alias("missing_value")), "missing_value", "left_anti")
