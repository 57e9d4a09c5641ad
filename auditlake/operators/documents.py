"""Documents as numbered lines, overlapping chunks and segments.

A document is one row, so everything derived from one document stays in its row
until the final explode: no shuffle of text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import lines, numbered_line

RANGE_BLOCK = 1_000
HEADING = r"^#{1,6}\s"


def doc_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line: key, 1-based ``line_no``, ``total_lines`` of the document, ``line``."""
    # What stands beside a generator is computed once per line, so the text is split below it. The
    # outer form keeps Spark from adding a not-empty filter that would split every text twice.
    body = docs.select(key, lines(text).alias("_lines"))
    each = body.select(key, F.size("_lines").alias("n"), F.posexplode_outer("_lines").alias("p", "line"))
    return each.filter("p IS NOT NULL").select(
        key, (F.col("p") + 1).cast("bigint").alias("line_no"), F.col("n").cast("bigint").alias("total_lines"), "line"
    )


def _step(size: int) -> int:
    return size - int(size * 0.1) or size


def _last_chunk(total: Column, size: int) -> Column:
    step = _step(size)
    return F.greatest(F.lit(0), F.floor((total - F.lit(size) + F.lit(step - 1)) / F.lit(step))).cast("bigint")


def chunk_ranges(files: DataFrame, key: str, total: str, size: int) -> DataFrame:
    """Inclusive line ranges of ``size`` lines that overlap by a tenth and cover each file."""
    step = _step(size)
    chunks = files.select(key, total, F.explode(F.sequence(F.lit(0).cast("bigint"), _last_chunk(F.col(total), size))).alias("chunk_no"))
    start = F.lit(1) + F.col("chunk_no") * step
    return chunks.select(
        key,
        "chunk_no",
        start.cast("bigint").alias("start_line_no"),
        F.greatest(F.lit(1), F.least(start + size - 1, F.col(total))).cast("bigint").alias("end_line_no"),
    )


def chunk_lines(numbered: DataFrame, size: int) -> DataFrame:
    """Lines with the chunk(s) they fall in: computed from the line number, no range join."""
    step = _step(size)
    no, total = F.col("line_no"), F.col("total_lines")
    first = F.greatest(F.lit(0), F.floor((no - size + step - 1) / step)).cast("bigint")
    last = F.least(_last_chunk(total, size), F.floor((no - 1) / step).cast("bigint"))
    placed = numbered.withColumn("chunk_no", F.explode(F.sequence(first, last)))
    relative = F.col("line_no") - 1 - F.col("chunk_no") * step
    return placed.withColumn("relative_line", relative.cast("bigint")).withColumn(
        "numbered_line", numbered_line("relative_line", "line")
    )


def lines_in_ranges(numbered: DataFrame, ranges: DataFrame, key: str, block: int = RANGE_BLOCK) -> DataFrame:
    """Join lines with arbitrary line ranges of their file.

    Both sides meet in blocks of ``block`` lines, so this is an equi-join and a long
    file is spread over many keys.
    """
    left = numbered.withColumn("_block", F.floor(F.col("line_no") / block))
    right = ranges.withColumn(
        "_block",
        F.explode(F.sequence(F.floor(F.col("start_line_no") / block), F.floor(F.col("end_line_no") / block))),
    )
    inside = F.col("line_no").between(F.col("start_line_no"), F.col("end_line_no"))
    return left.join(right, [key, "_block"]).filter(inside).drop("_block")


def block_starts(body: Column) -> Column:
    """0-based numbers of the lines that begin a block: the first, headings, lines after blank ones."""

    def starts(line: Column, i: Column) -> Column:
        after_blank = (F.trim(line) != "") & (F.trim(F.get(body, i - 1)) == "")
        return F.when((i == 0) | line.rlike(HEADING) | F.coalesce(after_blank, F.lit(False)), i)

    return F.filter(F.transform(body, starts), lambda i: i.isNotNull())


def segment_bounds(blocks: Column, count: Column, max_lines: int) -> Column:
    """Blocks cut every ``max_lines`` lines, as 0-based ``(first, last)`` pairs covering every line."""

    def cut(first: Column, n: Column) -> Column:
        last = F.coalesce(F.get(blocks, n + 1), count) - 1
        pieces = F.sequence(F.lit(0), F.floor((last - first) / max_lines).cast("int"))
        return F.transform(
            pieces,
            lambda q: F.struct(
                (first + q * max_lines).alias("first"),
                F.least(first + (q + 1) * max_lines - 1, last).alias("last"),
            ),
        )

    return F.flatten(F.transform(blocks, cut))


def segments(
    docs: DataFrame, key: str, text: str, size: int, max_lines: int, starts: Callable[[Column], Column] = block_starts
) -> DataFrame:
    """Cut every chunk of every document into segments with global line numbers.

    A segment begins where a block does and holds at most ``max_lines`` lines. ``starts`` tells of an
    array of lines where blocks begin, the first line being one (:mod:`auditlake.operators.cohesion` cuts by topic).
    """
    step = _step(size)
    body = docs.select(key, lines(text).alias("_lines"))
    chunked = body.select(
        key,
        "_lines",
        F.explode(F.sequence(F.lit(0).cast("bigint"), _last_chunk(F.size("_lines"), size))).alias("chunk_no"),
    ).select(key, "chunk_no", F.slice("_lines", (F.col("chunk_no") * step + 1).cast("int"), size).alias("_part"))
    blocks = chunked.select(key, "chunk_no", "_part", starts(F.col("_part")).alias("_starts"))
    bounds = segment_bounds(F.col("_starts"), F.size("_part"), max_lines)
    cut = blocks.select(key, "chunk_no", "_part", F.posexplode(bounds).alias("segment_no", "_b"))
    start = F.lit(1) + F.col("chunk_no") * step
    first, last = F.col("_b.first"), F.col("_b.last")
    return cut.select(
        F.concat_ws("-", F.col(key).cast("string"), F.col("chunk_no").cast("string"), F.col("segment_no").cast("string")).alias("segment_id"),
        F.array_join(F.slice("_part", first + 1, last - first + 1), "\n").alias("segment_text"),
        F.col(key).alias("filename"),
        (start + first).cast("bigint").alias("segment_start_line_no_global"),
        (start + last).cast("bigint").alias("segment_end_line_no_global"),
    )
