"""Segments by topic: lines are cut where the words before and after them have least in common.

At each gap between two lines the words of the ``window`` lines before it are compared with those
of the ``window`` lines after it, by the cosine of their sets. A gap's depth is how far its value
lies below the peaks that the values climb to on both sides. Lines are cut at the lowest gap of each
valley whose depth is above the mean and at least ``least_depth``, and before headings. Values
are whole thousandths, so sums and comparisons are exact. All of it is array work on the row that
holds the chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import once, tokens
from auditlake.operators.documents import HEADING

WINDOW = 3
#: Letters of a word that is compared; shorter ones are mostly function words.
LETTERS = 4
LEAST_DEPTH = 150


def _cosines(sets: Column, window: int) -> Column:
    """Thousandths of likeness at each gap of an array of word sets, one for each line."""

    def union(first: Column, size: Column) -> Column:
        return F.array_distinct(F.flatten(F.slice(sets, first, size)))

    def at(gap: Column) -> Column:
        before = F.least(gap + 1, F.lit(window))
        both = F.struct(union(gap + 2 - before, before).alias("a"), union(gap + 2, F.lit(window)).alias("b"))

        def cosine(x: Column) -> Column:
            shared = F.size(F.array_intersect(x["a"], x["b"]))
            sizes = F.size(x["a"]).cast("double") * F.size(x["b"])
            return F.when(shared > 0, F.floor(F.lit(1000) * shared / F.sqrt(sizes) + F.lit(1e-9))).otherwise(F.lit(0)).cast("int")

        return once(both, cosine)

    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(F.size(sets), F.lit(1))), F.lit(1), F.greatest(F.size(sets) - 1, F.lit(0))), at)


def _peaks(values: Column) -> Column:
    """For each value, where the values before it climb to as one goes back from it."""

    def step(acc: Column, v: Column) -> Column:
        climbs = acc["last"] >= v
        peak = F.when(climbs, acc["peak"]).otherwise(v)
        return once(peak, lambda p: F.struct(v.alias("last"), p.alias("peak"), F.concat(acc["out"], F.array(p)).alias("out")))

    start = F.struct(F.lit(-1).alias("last"), F.lit(-1).alias("peak"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, step, lambda acc: acc["out"])


def _valleys(values: Column) -> Column:
    """For each gap: its value, depth, and whether the values rise after it."""
    sides = F.struct(values.alias("v"), _peaks(values).alias("l"), F.reverse(_peaks(F.reverse(values))).alias("r"))

    def valley(s: Column) -> Column:
        return F.transform(
            s["v"], lambda v, i: F.struct(v.alias("v"), (F.get(s["l"], i) + F.get(s["r"], i) - 2 * v).alias("d"), (F.get(s["r"], i) > v).alias("rises"))
        )

    return once(sides, valley)


def cohesive_starts(window: int = WINDOW, least_depth: int = LEAST_DEPTH, letters: int = LETTERS) -> Callable[[Column], Column]:
    """For :func:`auditlake.operators.documents.segments`: 0-based numbers of the lines that begin a topic."""

    def starts(body: Column) -> Column:
        sets = F.transform(body, lambda x: F.array_distinct(F.filter(tokens(x), lambda t: F.length(t) >= letters)))

        def cut(x: Column) -> Column:
            total = F.aggregate(x, F.lit(0), lambda a, y: a + y["d"])

            def begins(line: Column, i: Column) -> Column:
                gap = F.get(x, i - 1)
                lowest = (F.get(x, i - 2)["v"] > gap["v"]) & gap["rises"]
                deep = (gap["d"] >= least_depth) & (gap["d"] * F.size(x) > total)
                return F.when((i == 0) | line.rlike(HEADING) | (lowest & deep), i)

            return F.filter(F.transform(body, begins), lambda i: i.isNotNull())

        values = once(sets, lambda s: _cosines(s, window))
        return once(once(values, _valleys), cut)

    return starts
