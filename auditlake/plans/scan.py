"""Running aggregates over groups that may hold a large share of all rows.

A plain ``partitionBy(group)`` window sends a whole group to one task. Here each
group is cut into order-preserving buckets: bucket totals are pre-aggregated and
scanned (few rows), and only rows of one bucket meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.plans.sized import parted
from auditlake.session import materialize

BUCKET_WIDTH = 65_536
PART_SIZE = 1_000


def bucket_of(order: str | Column, width: int = BUCKET_WIDTH) -> Column:
    """Order-preserving bucket of an integer key."""
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(width))


def range_bucketed(df: DataFrame, groups: list[str], order: list[str], out: str, parts: int | None = None) -> DataFrame:
    """Add an order-preserving bucket for keys of any type, such as names.

    Rows are range-partitioned by group and order, so Spark's sampling evens out the
    buckets, and written once: a bucket number stays the same however often it is read.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts or usual, *groups, *order)
    return materialize(placed.withColumn(out, F.spark_partition_id()), "ranges")


def prior(
    df: DataFrame,
    groups: list[str],
    bucket: Column,
    order: list[str],
    agg: Callable[[Column], Column],
    value: Column,
    out: str,
    parts: int | None = None,
) -> DataFrame:
    """Add ``out`` = ``agg(value)`` over the earlier rows of the group; NULL on its first row.

    ``agg`` is ``F.sum``, ``F.max`` or ``F.min``. ``bucket`` must not decrease along
    ``order``; ``groups`` and ``bucket`` must be non-null and ``order`` total in a group.
    ``parts`` is the number of partitions of the rows' shuffle.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = rows.groupBy(*groups, "_bucket").agg(agg(F.col("_value")).alias("_total"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(*groups, "_bucket", agg(F.col("_total")).over(before).alias("_carry"))
    inside = (
        Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = agg(F.col("_value")).over(inside)
    carry = F.col("_carry")
    if agg is F.sum:
        both = F.when(carry.isNull() & F.col("_local").isNull(), F.lit(None)).otherwise(
            F.coalesce(carry, F.lit(0)) + F.coalesce(F.col("_local"), F.lit(0))
        )
    elif agg is F.max:
        both = F.greatest(carry, F.col("_local"))
    elif agg is F.min:
        both = F.least(carry, F.col("_local"))
    else:
        raise ValueError("agg must be F.sum, F.max or F.min")
    return (
        parted(rows, parts, *groups, "_bucket").join(carries, [*groups, "_bucket"])
        .withColumn("_local", local)
        .withColumn(out, both)
        .drop("_bucket", "_value", "_carry", "_local")
    )


def ordinal(df: DataFrame, groups: list[str], bucket: Column, order: list[str], out: str, parts: int | None = None) -> DataFrame:
    """Add the 1-based position of each row in its group."""
    counted = prior(df, groups, bucket, order, F.sum, F.lit(1).cast("bigint"), "_before", parts)
    return counted.withColumn(out, F.coalesce(F.col("_before"), F.lit(0)) + 1).drop("_before")


def ordered_parts(
    df: DataFrame,
    groups: list[str],
    bucket: Column,
    order: list[str],
    items: list[str],
    out: str,
    part_size: int = PART_SIZE,
    parts: int | None = None,
) -> DataFrame:
    """Collect each group in order as parts of at most ``part_size`` items.

    One row per ``(groups, part_no)``; all parts together hold the whole group.
    """
    placed = ordinal(df, groups, bucket, order, "_pos", parts)
    return (
        parted(placed.withColumn("part_no", F.floor((F.col("_pos") - 1) / part_size)), parts, *groups, "part_no")
        .groupBy(*groups, "part_no")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", *items))).alias("_collected"))
        .withColumn(out, F.transform("_collected", lambda i: F.struct(*[i[c].alias(c) for c in items])))
        .drop("_collected")
    )
