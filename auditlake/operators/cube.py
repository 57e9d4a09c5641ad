"""Data cubes, filtered aggregates and risk-indicator scorecards."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.sqltext import resolve_names
from auditlake.operators.tables import quoted

# Aggregate functions a cube may use.
CUBE_FUNCTIONS = ["SUM", "COUNT", "AVG", "MIN", "MAX"]


@dataclass(frozen=True)
class Measure:
    """``function`` over a SQL expression (``*`` for COUNT), named ``alias``."""

    function: str
    expression: str
    alias: str
    digits: int | None = None

    def column(self, columns: list[str]) -> Column:
        name = self.function.upper()
        if name not in CUBE_FUNCTIONS:
            raise ValueError(f"unsupported aggregate: {self.function}")
        value = F.expr(f"{name}({resolve_names(self.expression, columns)})")
        return (value if self.digits is None else F.round(value, self.digits)).alias(self.alias)


@dataclass(frozen=True)
class CubeSpec:
    """Measures by dimensions under a filter, sorted and capped.

    ``sort_order`` holds ``(name, descending)`` pairs. ``grouping`` is ``group``,
    ``rollup`` or ``cube``.
    """

    measures: list[Measure]
    dimensions: list[str]
    filtering_conditions: str = ""
    sort_order: list[tuple[str, bool]] = field(default_factory=list)
    row_limit: int | None = 100
    grouping: str = "group"


def data_cube(df: DataFrame, spec: CubeSpec) -> DataFrame:
    """Run a cube definition: filter, group, aggregate, order, cap."""
    rows = df.filter(resolve_names(spec.filtering_conditions, df.columns)) if spec.filtering_conditions.strip() else df
    keys = [quoted(d) for d in spec.dimensions]
    grouped = {"group": rows.groupBy, "rollup": rows.rollup, "cube": rows.cube}[spec.grouping](*keys)
    result = grouped.agg(*[m.column(df.columns) for m in spec.measures])
    order = [
        quoted(name).desc_nulls_last() if descending else quoted(name).asc_nulls_last()
        for name, descending in spec.sort_order
    ]
    if order:
        result = result.orderBy(*order)
    return result if spec.row_limit is None else result.limit(spec.row_limit)


def filtered_aggregates(df: DataFrame, by: list[str], value: str, flag: str) -> DataFrame:
    """Record count, flagged count and share, and the spread of one value, per group."""
    hit = F.expr(resolve_names(flag, df.columns))
    return df.groupBy(*[quoted(b) for b in by]).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(hit).alias("flagged_records"),
        F.round(F.count_if(hit) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), 2).alias("flagged_pct"),
        F.round(F.avg(quoted(value)), 4).alias("avg_value"),
        F.min(quoted(value)).alias("min_value"),
        F.max(quoted(value)).alias("max_value"),
    )


@dataclass(frozen=True)
class Rule:
    """A risk indicator: records where ``predicate`` holds violate it."""

    rule_id: str
    predicate: str
    severity: str


def scorecard(df: DataFrame, rules: list[Rule], by: list[str]) -> DataFrame:
    """Violations per rule and group in one scan: all rules count in the same aggregate."""
    counts = [F.count_if(F.expr(resolve_names(r.predicate, df.columns))).alias(f"_{i}") for i, r in enumerate(rules)]
    wide = df.groupBy(*[quoted(b) for b in by]).agg(F.count(F.lit(1)).alias("total_records"), *counts)
    cells = F.array(
        *[
            F.struct(
                F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.col(f"_{i}").alias("violations")
            )
            for i, r in enumerate(rules)
        ]
    )
    long = wide.select(*[quoted(b) for b in by], "total_records", F.explode(cells).alias("c"))
    return long.select(
        *[quoted(b) for b in by],
        "c.rule_id",
        "c.severity",
        "c.violations",
        "total_records",
        F.round(F.col("c.violations") * 100.0 / F.nullif(F.col("total_records"), F.lit(0)), 2).alias("violation_pct"),
    )
