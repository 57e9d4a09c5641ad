"""Column profiles that add up: mergeable sketches per part of a table, kept and merged.

A part (a file, a day) gives one row per column with exact counts and bounds and with sketches:
a HyperLogLog of its values, quantiles of its numbers (KLL), and a theta sketch for questions about
two columns. Rows of parts are kept, so when a part comes only that part is read; merging reads
sketches of a few kilobytes, never values. A theta sketch that still holds all values answers
exactly, beyond ``2 ** THETA_BITS`` values within the stated error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.tables import quoted

#: Registers and entries are two to the power of these; ``K`` bounds the levels of a quantile sketch.
HLL_BITS, THETA_BITS, K = 12, 12, 200
#: Errors that an estimate keeps to with 99 % and more: three standard errors, and the rank error of quantiles.
HLL_ERROR = 3 * 1.04 / math.sqrt(2**HLL_BITS)
THETA_ERROR = 3 / math.sqrt(2**THETA_BITS)
RANK_ERROR = 0.02


def is_number(kind: str) -> bool:
    """Whether a column of this type has quantiles."""
    return kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def sketch_parts(df: DataFrame, part: Column) -> DataFrame:
    """One row per part and column: ``part, ordinal, column_name, n, nulls, low, high, distinct, quantiles, theta``.

    One scan for all columns, reduced on the map side; a part with all rows of a table is no hot group.
    Values are compared as text, so that columns of different types can be held against each other.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (name, kind) in enumerate(df.dtypes):
        text = quoted(name).cast("string")
        number = quoted(name).cast("double") if is_number(kind) else F.lit(None).cast("double")
        aggs += [
            F.count(quoted(name)).alias(f"c{i}"), F.min(text).alias(f"l{i}"), F.max(text).alias(f"h{i}"), F.hll_sketch_agg(text, HLL_BITS).alias(f"d{i}"),
            F.kll_sketch_agg_double(number, K).alias(f"q{i}"), F.theta_sketch_agg(text, THETA_BITS).alias(f"t{i}"),
        ]
    cells = F.array(
        *[
            F.struct(
                F.lit(i + 1).cast("bigint").alias("ordinal"), F.lit(name).alias("column_name"), "n", (F.col("n") - F.col(f"c{i}")).alias("nulls"),
                F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"), F.col(f"d{i}").alias("distinct"),
                (F.col(f"q{i}") if is_number(kind) else F.lit(None).cast("binary")).alias("quantiles"), F.col(f"t{i}").alias("theta"),
            )
            for i, (name, kind) in enumerate(df.dtypes)
        ]
    )
    return df.groupBy(part.alias("part")).agg(*aggs).select("part", F.explode(cells).alias("c")).select("part", "c.*")


def merged(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sketches of all parts of a column as one row; ``keys`` defaults to the column alone."""
    return parts.groupBy(*(keys or ["column_name"])).agg(
        F.min("ordinal").alias("ordinal"), F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.theta_union_agg("theta").alias("theta"),
    )


def estimates(sketches: DataFrame, ranks: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Add ``distinct_estimate`` and ``quantile_estimates`` (null for columns without numbers)."""
    some = F.kll_sketch_get_n_double("quantiles") > 0
    found = F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit(r) for r in ranks])))
    return sketches.withColumns({"distinct_estimate": F.hll_sketch_estimate("distinct"), "quantile_estimates": found})


def inclusion(children: DataFrame, parents: DataFrame, on: Column) -> DataFrame:
    """For pairs of columns of two merged tables: distinct values of the child, those the parent has too, and their share.

    ``on`` picks the pairs and may name the sides ``child`` and ``parent``; a share near 1 suggests a reference.
    """
    pairs = children.alias("child").join(parents.alias("parent"), on)
    both = F.theta_sketch_estimate(F.theta_intersection(F.col("child.theta"), F.col("parent.theta")))
    all_ = F.theta_sketch_estimate(F.col("child.theta"))
    return pairs.select(
        F.col("child.column_name").alias("child_column"), F.col("parent.column_name").alias("parent_column"), all_.alias("child_values"),
        both.alias("shared_values"), F.when(all_ > 0, both / all_).alias("share"),
    )
