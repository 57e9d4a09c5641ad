"""Inclusive line intervals: union length, merging, coverage of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.plans.scan import BUCKET_WIDTH, bucket_of, prior
from auditlake.session import materialize


def valid_intervals(df: DataFrame, start: str, end: str) -> DataFrame:
    """Drop intervals that end before they start."""
    return df.filter(F.col(start) <= F.col(end))


def _longest_per_start(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals sharing a start reduce to the longest one; combines before the shuffle.

    Written once, as the scan that follows reads it twice.
    """
    return materialize(
        valid_intervals(df, start, end)
        .groupBy(key, F.col(start).cast("bigint").alias("start_line"))
        .agg(F.max(F.col(end).cast("bigint")).alias("end_line")),
        "spans",
    )


def _with_reach(spans: DataFrame, key: str, width: int) -> DataFrame:
    """Add ``reach``, the largest end among earlier intervals of the file."""
    return prior(spans, [key], bucket_of("start_line", width), ["start_line"], F.max, F.col("end_line"), "reach")


def covered_lines(df: DataFrame, key: str, start: str, end: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """Number of distinct lines covered per file."""
    spans = _with_reach(_longest_per_start(df, key, start, end), key, width)
    before = F.col("start_line") - 1
    fresh = F.greatest(F.lit(0), F.col("end_line") - F.greatest(before, F.coalesce(F.col("reach"), before)))
    return spans.groupBy(key).agg(F.sum(fresh).cast("bigint").alias("lines_covered"))


def merged_intervals(df: DataFrame, key: str, start: str, end: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """Merge overlapping or touching-by-line intervals of each file.

    A new merged interval begins where the start lies beyond every earlier end. A
    closing marker two lines past the last end tells the last interval its end.
    """
    spans = _longest_per_start(df, key, start, end)
    markers = spans.groupBy(key).agg((F.max("end_line") + 2).alias("start_line")).select(
        key, "start_line", F.col("start_line").alias("end_line"), F.lit(True).alias("marker")
    )
    marked = spans.withColumn("marker", F.lit(False)).unionByName(markers)
    first = F.col("reach").isNull() | (F.col("start_line") > F.col("reach"))
    heads = materialize(_with_reach(marked, key, width).filter(first), "spans")
    # The end of a merged interval is what the next head could reach back to.
    backward = heads.withColumn("_back", -F.col("start_line"))
    closed = prior(backward, [key], bucket_of("_back", width), ["_back"], F.min, F.col("reach"), "_end")
    return closed.filter(~F.col("marker")).select(key, "start_line", F.col("_end").alias("end_line"))


def line_coverage(segments: DataFrame, totals: DataFrame, key: str, total: str) -> DataFrame:
    """Coverage of every file that has segments; an empty file counts as one line."""
    covered = covered_lines(segments, key, "segment_start_line_no_global", "segment_end_line_no_global")
    lines_total = F.greatest(F.lit(1), F.coalesce(F.col(total), F.lit(1))).cast("bigint")
    return covered.join(totals.select(key, total), key, "left").select(
        key,
        lines_total.alias("total_lines"),
        "lines_covered",
        (F.col("lines_covered") / lines_total * 100.0).alias("coverage_pct"),
    )
