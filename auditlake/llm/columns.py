"""Column helpers the operators share: words, bound values, match spans, digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the white space that separates words.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    A lambda variable is never inlined, unlike a projected column.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """All words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def match_spans(text: Column, pattern: str, groups: tuple[int, ...] = ()) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start,end,match,g1..>>`` in code points, end exclusive.

    What lies between the matches gives the positions: each match starts where the pieces
    before it end. ``groups`` adds the text of those groups as ``g<number>``.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [F.split(text, pattern, -1).alias("gap"), found.alias("match")]
    parts += [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]

    def placed(x: Column) -> Column:
        size = F.size(x["match"])
        lengths = F.zip_with(
            F.slice(x["gap"], F.lit(1), size), x["match"], lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))
        )
        ends = F.aggregate(
            lengths,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
            lambda acc, n: bind(
                acc["at"] + n["g"] + n["m"],
                lambda end: F.struct(end.alias("at"), F.concat(acc["ends"], F.array(end)).alias("ends")),
            ),
            lambda acc: acc["ends"],
        )
        return bind(
            ends,
            lambda e: F.transform(
                x["match"],
                lambda m, i: F.struct(
                    (F.get(e, i) - F.length(m)).alias("start"),
                    F.get(e, i).alias("end"),
                    m.alias("match"),
                    *[F.get(x[f"g{g}"], i).alias(f"g{g}") for g in groups],
                ),
            ),
        )

    return F.when(text.rlike(pattern), bind(F.struct(*parts), placed)).otherwise(no_spans(groups))


def no_spans(groups: tuple[int, ...] = ()) -> Column:
    """An empty array of the type of :func:`match_spans`."""
    extra = "".join(f",g{g}:string" for g in groups)
    return F.array().cast(f"array<struct<start:int,end:int,match:string{extra}>>")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of spans (start, rank, end, kind), comma-joined in the order of start and rank."""
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name`` or a longer one that is no column of the table."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
