"""Secret scan: fixed patterns, and strings whose sliding-window entropy is high; native functions only.

Defined cases: a null text counts as empty and has no spans; a text of any length is
scanned whole; equal rows give equal rows; an empty table gives an empty table. Other
columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.columns import bind, match_spans, spans_text

# The base patterns and the sizes of their matches.
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 6
# Runs cut at their minimum give the same spans as longer runs that are dropped when short.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
# Whole runs of key characters with a digit and a letter in them.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"


@dataclass(frozen=True)
class CharClass:
    """Candidates that match ``pattern`` are measured over ``alphabet``."""

    name: str
    pattern: str
    alphabet: str
    bits: float


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The first class that fits is taken; a window of random characters of the class has more bits.
CLASSES = (
    CharClass("hex", r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdefABCDEF", 3.0),
    CharClass("base32", r"^[0-9A-Z]+$", DIGITS + UPPER, 3.5),
    CharClass("base64", r"^[A-Za-z0-9+/_=-]+$", DIGITS + LOWER + UPPER + "+/_=-", 3.7),
)
#: A candidate that is one of these is no secret.
ALLOWED = (
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("digest", r"^(sha|SHA)(1|224|256|384|512)[-=]"),
    ("words", r"^[A-Za-z]{2,}([_=-][A-Za-z]{2,})*[_=-][0-9]{1,4}$"),
)
#: A candidate that matches one of these is none, unless a segment of it is.
ALLOWED_AROUND = (
    ("path", r"^/?([A-Za-z_-]+/)+[A-Za-z0-9_-]*$"),
    ("date", r"[12][0-9]{3}-[01][0-9]-[0-3][0-9]"),
    ("placeholder", r"(?i)(example|sample|dummy|placeholder|xxxx|0123456789|abcdefgh)"),
)
#: What parts segments: a secret may itself hold ``-`` or ``_``, so all three cuts are tried.
CUTS = ("[/=]", "[/=-]", "[/=_-]")
#: A segment of plain words and short numbers, or with no digit or no letter, is no secret either.
_PART = r"([A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]{1,4}"
PLAIN = rf"^(({_PART})([_-]({_PART}))*|[^0-9]*|[^A-Za-z]*)$"

WINDOW = 20


def window_entropy(candidate: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any window of a candidate's characters.

    One character enters and one leaves per step: with f(c) = c log2 c, only the terms of
    those two counts change. Null for a candidate shorter than the window.
    """
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    ids = F.transform(
        F.filter(F.split(candidate, ""), lambda ch: ch != ""), lambda ch: F.call_function("instr", F.lit(alphabet), ch) - F.lit(1)
    )
    state = "struct<counts:array<int>,sum:double,best:double>"

    def run(x: Column) -> Column:
        ch, table = x["ids"], x["f"]

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(ch, i), F.when(i >= window, F.get(ch, i - F.lit(window))).otherwise(F.lit(-1))

            def moved(m: Column) -> Column:
                c_in = F.get(acc["counts"], m["enters"])
                c_out = F.get(acc["counts"], m["leaves"]) + F.when(m["enters"] == m["leaves"], 1).otherwise(0)
                added = F.get(table, c_in + F.lit(1)) - F.get(table, c_in)
                gone = F.when(m["leaves"] >= 0, F.get(table, c_out - F.lit(1)) - F.get(table, c_out)).otherwise(F.lit(0.0))
                total = acc["sum"] + added + gone
                counts = F.transform(
                    acc["counts"],
                    lambda c, k: c + F.when(k == m["enters"], 1).otherwise(0) - F.when(k == m["leaves"], 1).otherwise(0),
                )
                bits = F.when(i >= window - 1, F.lit(math.log2(window)) - total / window)
                return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best")).cast(state)

            return bind(F.struct(enters.alias("enters"), leaves.alias("leaves")), moved)

        start = F.struct(
            F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("best")
        ).cast(state)
        return F.aggregate(F.sequence(F.lit(0), F.size(ch) - 1), start, step, lambda acc: acc["best"])

    return F.when(F.length(candidate) >= window, bind(F.struct(ids.alias("ids"), f.alias("f")), run))


def _any(candidate: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    found = F.lit(False)
    for _, pattern in patterns:
        found = found | candidate.rlike(pattern)
    return found


def _high(candidate: Column, window: int) -> Column:
    high = F.lit(False)
    for c in reversed(CLASSES):
        high = F.when(candidate.rlike(c.pattern), window_entropy(candidate, c.alphabet, window) >= c.bits).otherwise(high)
    return high


def _is_secret(candidate: Column, window: int) -> Column:
    segments = F.array_distinct(F.concat(*[F.split(candidate, cut, -1) for cut in CUTS]))
    inside = F.exists(
        F.filter(segments, lambda s: F.length(s) >= window),
        lambda s: ~(s.rlike(PLAIN) | _any(s, ALLOWED) | _any(s, ALLOWED_AROUND[1:])) & _high(s, window),
    )
    return ~_any(candidate, ALLOWED) & F.when(_any(candidate, ALLOWED_AROUND), inside).otherwise(_high(candidate, window))


def _named(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match")
        ),
    )


def _scan(text: Column, window: int) -> Column:
    def of(t: Column) -> Column:
        assign = F.filter(match_spans(t, ASSIGN, (1,)), lambda s: F.length(s["g1"]) >= ASSIGN_CHARS)
        base = F.concat(_named(assign, "assign"), _named(match_spans(t, ACCESS), "access"), _named(match_spans(t, HEX), "hex"))

        def more(x: Column) -> Column:
            found = F.filter(
                _named(x["candidates"], "entropy"),
                lambda c: ~F.exists(x["base"], lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])) & _is_secret(c["match"], window),
            )
            return F.struct(F.sort_array(x["base"]).alias("base"), F.sort_array(F.concat(x["base"], found)).alias("spans"))

        return bind(F.struct(base.alias("base"), match_spans(t, CANDIDATE).alias("candidates")), more)

    return bind(F.coalesce(text, F.lit("")), of)


def secret_spans(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add ``base_spans`` and ``secret_spans``: arrays of (start, rank, end, kind, match) in the order of the text.

    Base spans are the matches of the three patterns. The method adds, as kind ``entropy``,
    candidate strings outside them with a window of high entropy that no allow rule excuses.
    """
    out = ["base_spans", "secret_spans"]
    found = "_found"
    while found in df.columns:
        found = "_" + found
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in out]
    return df.withColumn(found, _scan(F.col(text), window)).select(
        *rest, F.col(found)["base"].alias("base_spans"), F.col(found)["spans"].alias("secret_spans")
    )


def _number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def span_digests(spans: str, base: str, kinds: list[str]) -> list[Column]:
    """Counts of base spans per kind, the digest of the base spans, and all spans as text."""
    counts = [_number_of(F.col(base), k).alias(f"n_{k}") for k in kinds]
    return [*counts, F.sha2(spans_text(F.col(base)), 256).alias("base_sha256"), spans_text(F.col(spans)).alias("spans")]
