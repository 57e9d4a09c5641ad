"""Unique concept names: the first free of ``base``, ``base-1``, ``base-2``, ...

Names are given out in arrival order against names already taken. Arrivals of one
base take its suffixes in order, so the m-th arrival takes the m-th suffix that is
free. A suffix ``j`` of ``base`` is blocked when the name ``base-j`` exists before
the run, or is itself a base whose first arrival comes before ``base`` reaches ``j``.
All of this is counting, done with bucketed scans; no group meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.plans.scan import BUCKET_WIDTH, bucket_of, ordinal, prior
from auditlake.session import materialize

SUFFIXED = r"^(.+)-(0|[1-9][0-9]{0,17})$"


def _as_suffix(names: DataFrame, name: str) -> DataFrame:
    """Names that end in a number, as ``(base, j)`` of the base they would block."""
    return names.filter(F.col(name).rlike(SUFFIXED)).select(
        "*",
        F.regexp_extract(name, SUFFIXED, 1).alias("base"),
        F.regexp_extract(name, SUFFIXED, 2).cast("bigint").alias("j"),
    ).filter("j > 0")


def _reached(arrivals: DataFrame, literals: DataFrame, seq: str, width: int) -> DataFrame:
    """Arrivals of ``base`` before each literal name first arrives, as column ``n``."""
    events = arrivals.select("base", F.col(seq).alias("at"), F.lit(1).cast("bigint").alias("one"), F.lit(None).cast("bigint").alias("j"))
    marks = literals.select("base", F.col("first_seen").alias("at"), F.lit(0).cast("bigint").alias("one"), "j")
    both = events.unionByName(marks)
    counted = prior(both, ["base"], bucket_of("at", width), ["at", "one"], F.sum, F.col("one"), "n")
    return counted.filter("j IS NOT NULL").select("base", "j", F.coalesce("n", F.lit(0)).alias("n"))


def _given(state: DataFrame) -> DataFrame:
    """Literal names that a shorter base gave out before their own first arrival."""
    return state.filter("NOT blocked AND n >= 0").select(
        F.concat_ws("-", "base", F.col("j").cast("string")).alias("base")
    )


def _without_zero(state: DataFrame, taken: DataFrame) -> DataFrame:
    """Bases whose plain name is not available to their first arrival."""
    return taken.select(F.col("taken").alias("base")).unionByName(_given(state)).distinct().withColumn(
        "zero", F.lit(1).cast("bigint")
    )


def _blocked(candidates: DataFrame, taken: DataFrame, width: int) -> DataFrame:
    """Suffixes that may be blocked, with ``below`` = blocked suffixes of the base smaller than ``j``.

    ``j`` is blocked when ``n + zero + below <= j``. This depends on smaller suffixes and
    shorter bases only, so repeating the count settles from the smallest up.
    """
    state = materialize(candidates.withColumn("blocked", F.lit(True)), "names")
    if state.isEmpty():
        return state.withColumn("below", F.lit(0).cast("bigint"))
    while True:
        counted = prior(
            state, ["base"], bucket_of("j", width), ["j"], F.sum, F.col("blocked").cast("bigint"), "below"
        ).withColumn("below", F.coalesce("below", F.lit(0)))
        zero = F.coalesce("zero", F.lit(0))
        nxt = materialize(
            counted.join(_without_zero(state, taken), "base", "left").withColumn(
                "next", F.col("n") + zero + F.col("below") <= F.col("j")
            ),
            "names",
        )
        if nxt.filter("next <> blocked").isEmpty():
            return nxt.select("base", "j", "n", "below", "blocked")
        state = nxt.select("base", "j", "n", F.col("next").alias("blocked"))


def unique_names(
    arrivals: DataFrame, seq: str, base: str, existing: DataFrame | None = None, name: str = "concept_name",
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Add ``concept_name``, unique among all arrivals and ``existing[name]``.

    ``seq`` is a unique non-null integer giving the arrival order.
    """
    rows = arrivals.withColumn("base", F.col(base))
    firsts = materialize(rows.groupBy("base").agg(F.min(seq).alias("first_seen")), "names")
    bases = firsts.select("base")
    if existing is None:
        taken = bases.limit(0).withColumnRenamed("base", "taken")
    else:
        taken = materialize(existing.select(F.col(name).alias("taken")).filter("taken IS NOT NULL").distinct(), "names")

    old = _as_suffix(taken, "taken").join(bases, "base", "left_semi").select("base", "j", F.lit(-1).cast("bigint").alias("n"))
    new = _as_suffix(firsts.withColumnRenamed("base", "word"), "word").join(bases, "base", "left_semi")
    new = new.join(taken.withColumnRenamed("taken", "word"), "word", "left_anti")
    literals = _reached(rows, new.select("base", "j", "first_seen"), seq, width)
    settled = _blocked(old.unionByName(literals), taken, width)
    blocked = settled.filter("blocked").select("base", "j", "below")

    # Suffix 0 is the base itself: taken before the run, or given out by a shorter base first.
    zero = _without_zero(settled, taken)

    placed = ordinal(rows, ["base"], bucket_of(seq, width), [seq], "_m")
    placed = placed.join(zero, "base", "left").withColumn(
        "_free", F.col("_m") - 1 + F.coalesce("zero", F.lit(0))
    )
    # Blocked suffix j comes before the suffix of free rank r when j - below <= r.
    cols = [c for c in placed.columns if c not in ("_m", "zero")]
    steps = blocked.select("base", (F.col("j") - F.col("below")).alias("_free"), "j").withColumn("_one", F.lit(1).cast("bigint"))
    both = placed.select(*cols, F.lit(0).cast("bigint").alias("_one")).unionByName(steps, allowMissingColumns=True)
    shifted = prior(
        both, ["base"], bucket_of("_free", width), ["_free", F.col("_one").desc(), "j", seq], F.sum, F.col("_one"), "_shift"
    ).filter("_one = 0")
    suffix = F.col("_free") + F.coalesce("_shift", F.lit(0))
    final = F.when(suffix == 0, F.col("base")).otherwise(F.concat_ws("-", "base", suffix.cast("string")))
    keep = [c for c in arrivals.columns if c != "concept_name"]
    return shifted.select(*keep, final.alias("concept_name"))
