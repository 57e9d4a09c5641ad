"""Quality rules: a table of thresholds compiled into one projection, native functions only.

Defined cases: a null text counts as empty (0 words, rejected for its length); ties and
repeated rows are judged one by one; an empty table gives an empty table; other columns
pass through, and result names replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.columns import WORD, bind, words

# Frequent function words of the four languages of the texts.
STOP_WORDS = (
    "the of and to in is it that for was with as by on at this be are from or an "
    "der die und das ist nicht mit von den im zu auf für ein eine auch sich dem des "
    "de la le et les en que du un une pour par sur dans est pas au qui il elle avec "
    "el los las una y se por del con no su es al lo"
).split()
# As written in lower case and at the start of a sentence.
STOP_FORMS = [*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]]
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high``; a missing bound does not bind."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    base: bool = False


# One row per rule; the two base rules are those of the result's contract.
RULES = (
    Rule("few_words", "n_words", low=50, base=True),
    Rule("repeated_words", "repeat_pct", high=50, base=True),
    Rule("word_length", "mean_word_chars", low=2.5, high=12),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("capitals", "upper_ratio", high=0.3),
    Rule("no_letters", "letter_ratio", low=0.6),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("bullets", "bullet_line_ratio", high=0.9),
    Rule("cut_lines", "ellipsis_line_ratio", high=0.3),
)


# Bits of a packed long that hold a word's position; the others hold a hash.
POSITION_BITS = 30


def _same(s: Column, x: Column, i: Column, key: Callable[[Column], Column]) -> Column:
    """True where an element of a sorted array has the key of a neighbour."""
    return (key(x) == key(F.get(s, i - F.lit(1)))) | (key(x) == key(F.get(s, i + F.lit(1))))


def _covered(w: Column, size: int) -> Column:
    """Words in windows of ``size`` words that occur twice or more; exact.

    Sorted longs of hash and position show which windows may be repeated; only those
    are compared as whole strings.
    """
    last = F.size(w) - F.lit(size - 1)
    low = (1 << POSITION_BITS) - 1

    packed = F.transform(
        F.slice(w, F.lit(1), F.greatest(last, F.lit(0))),
        lambda x, i: F.shiftleft(F.xxhash64(x, *[F.get(w, i + F.lit(k)) for k in range(1, size)]), POSITION_BITS).bitwiseOR(i.cast("bigint")),
    )

    def maybe(s: Column) -> Column:
        found = F.filter(s, lambda x, i: _same(s, x, i, lambda y: F.shiftright(y, POSITION_BITS)))
        return F.transform(found, lambda x: x.bitwiseAND(F.lit(low)).cast("int"))

    def exact(at: Column) -> Column:
        pairs = F.transform(
            at, lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + F.lit(k)) for k in range(size)]).alias("t"), i.alias("i"))
        )
        found = bind(F.sort_array(pairs), lambda s: F.filter(s, lambda x, i: _same(s, x, i, lambda y: y["t"])))
        spread = F.flatten(F.transform(found, lambda x: F.array(*[x["i"] + F.lit(k) for k in range(size)])))
        return F.size(F.array_distinct(spread))

    return bind(bind(F.sort_array(packed), maybe), lambda at: F.when(F.size(at) > 1, exact(at)).otherwise(F.lit(0)))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _is_cut(line: Column) -> Column:
    end = F.rtrim(line, F.lit(" \t\r\f"))
    return F.endswith(end, F.lit("...")) | F.endswith(end, F.lit("…"))


def _counts(text: Column) -> Column:
    """What the rules need of one text, as a struct."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))

        def inner(x: Column) -> Column:
            w, ls = x["w"], x["lines"]
            return F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.length(F.concat_ws("", w)).cast("bigint").alias("word_chars"),
                x["symbols"].cast("bigint").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
                _covered(w, 3).cast("bigint").alias("n_repeat_words"),
                x["upper"].alias("n_upper"),
                F.size(F.array_intersect(w, F.array(*[F.lit(y) for y in STOP_FORMS]))).alias("n_stop_words"),
                x["letters"].alias("n_letters"),
                F.size(ls).alias("n_lines"),
                F.size(F.filter(ls, lambda y: y.rlike(r"^\s*[-*•]"))).alias("n_bullets"),
                F.size(F.filter(ls, _is_cut)).alias("n_cut"),
            )

        return bind(
            F.struct(
                words(t).alias("w"),
                lines.alias("lines"),
                F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).alias("symbols"),
                (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).alias("upper"),
                (F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))).alias("letters"),
            ),
            inner,
        )

    return bind(F.coalesce(text, F.lit("")), of)


def _metrics(c: Column) -> dict[str, Column]:
    n, lines = c["n_words"], c["n_lines"]
    return {
        "n_words": n,
        "repeat_pct": _ratio(100 * c["n_repeat_words"], n),
        "mean_word_chars": _ratio(c["word_chars"], n),
        "symbol_ratio": _ratio(c["n_symbols"], n),
        "upper_ratio": _ratio(c["n_upper"], c["word_chars"]),
        "letter_ratio": _ratio(c["n_letters"], c["word_chars"]),
        "n_stop_words": c["n_stop_words"],
        "dup_line_ratio": _ratio(c["n_dup_lines"], lines),
        "bullet_line_ratio": _ratio(c["n_bullets"], lines),
        "ellipsis_line_ratio": _ratio(c["n_cut"], lines),
    }


def _fails(rule: Rule, metrics: dict[str, Column]) -> Column:
    m, tests = metrics[rule.metric], []
    if rule.low is not None:
        tests.append(m < F.lit(rule.low))
    if rule.high is not None:
        tests.append(m > F.lit(rule.high))
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the counts, ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    counts = _counts(F.col(text))

    def judged(c: Column) -> Column:
        metrics = _metrics(c)
        failed = F.filter(
            F.array(*[F.when(_fails(r, metrics), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
        )
        base = F.lit(False)
        for r in rules:
            base = base | _fails(r, metrics) if r.base else base
        return F.struct(*[c[k].alias(k) for k in COUNTS], base.alias("base_failed"), failed.alias("failed_rules"))

    out = [*COUNTS, "base_failed", "failed_rules", "kept"]
    verdict = "_verdict"
    while verdict in df.columns:
        verdict = "_" + verdict
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in out]
    scored = df.withColumn(verdict, bind(counts, judged))
    return scored.select(
        *rest,
        *[F.col(verdict)[k].alias(k) for k in [*COUNTS, "base_failed", "failed_rules"]],
        (F.size(F.col(verdict)["failed_rules"]) == 0).alias("kept"),
    )


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass every rule, with their columns as they were."""
    mark = "_kept"
    while mark in df.columns:
        mark = "_" + mark

    def passes(c: Column) -> Column:
        metrics, ok = _metrics(c), F.lit(True)
        for r in rules:
            ok = ok & ~_fails(r, metrics)
        return ok

    return df.withColumn(mark, bind(_counts(F.col(text)), passes)).filter(F.col(mark)).drop(mark)
