"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides; native functions only.

Base patterns find e-mail, IP, card and phone spans that always stay. Wider patterns give
further candidates (local phone numbers, spelled-out e-mails, account numbers, names).
Labelers - strict form, gazetteer, cue words before the span, counter-cues, check digits,
what stands at its edges - vote yes, no or nothing on every candidate, base ones included.
Their votes are counted per combination over all documents, which is a table bounded by
the number of combinations; expectation-maximisation on it estimates each labeler's
reliability without labels, and its posteriors train a logistic span classifier.

Defined cases: a null text counts as empty; texts are scanned whole; repeated rows are
counted as often as they occur; an empty table, or one without candidates, adds no spans;
only the columns named in ``carry`` pass through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.columns import bind, match_spans
from auditlake.session import materialize

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "email_words", "phone_local", "account", "name"]

# The base patterns. A look-behind or a possessive quantifier changes no match; it spares retries.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Further candidates.
EMAIL_WORDS = r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{2,64}+(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z]{2,24})"
PHONE_LOCAL = r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

# Gazetteers: short lists of my own choosing, fixed values.
FIRST_NAMES = (
    "Anna Maria John James Mary Robert Michael Linda David Sarah Peter Paul Laura Julia Thomas Martin "
    "Hans Klaus Karin Jean Pierre Marie Claire Jose Juan Carlos Carmen Ana Luis Emma Lukas Sophie"
).split()
NAME = rf"(?<!\p{{L}})(?:{'|'.join(FIRST_NAMES)})\x20\p{{Lu}}\p{{Ll}}{{2,20}}(?!\p{{L}})"
ACCOUNT_COUNTRIES = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
DOMAIN_ENDS = "com org net edu gov info io de fr es uk eu us ch at it nl".split()
CUES = {
    "email": "e-?mail|mail|contact|correo|courriel|kontakt|write to",
    "ip": "ip|host|server|address|adresse|client",
    "card": "card|visa|mastercard|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|cell|telefon|tél|móvil|contact",
    "account": "iban|account|konto|compte|cuenta|bank",
    "name": "mr|mrs|ms|dr|name|dear|herr|frau|monsieur|madame|señor|señora|sincerely|contact",
}
CUES |= {"email_words": CUES["email"], "phone_local": CUES["phone"]}
COUNTER_CUES = "version|order|invoice|isbn|part|serial|page|chapter|total|section|bestellung|commande|pedido"
CUE_CHARS = 40

LABELERS = ["form", "gazetteer", "cue", "counter_cue", "check_digit", "edges"]
FEATURES = ["cue", "counter_cue", "gazetteer", "form", "check_digit", "edges", "long", "mostly_digits", "separators"]
RELIABILITY_START = 0.8
PRIOR_START = 0.5
EM_ROUNDS = 50
STEPS, RATE, RIDGE = 400, 0.5, 0.01


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """True if the check digit of a string of digits is right."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))

    def term(n: Column, i: Column) -> Column:
        twice = n * (F.lit(1) + i % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.transform(values, term), F.lit(0), lambda a, n: a + n) % 10 == 0


def _octets(text: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(bare) <= 3) & (bare.try_cast("int") <= 255)

    return F.forall(F.split(text, r"\."), small)


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _only(condition: Column, spans: Column) -> Column:
    """Spans where a cheap test of the text holds; the pattern is not tried elsewhere."""
    return F.when(condition, spans).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def _candidates(t: Column) -> dict[str, Column]:
    digit = t.rlike("[0-9]")

    def card(s: Column) -> Column:
        return bind(_digits(s["match"]), lambda d: _between(F.length(d), 12, 19) & luhn(d))

    return {
        "email": _only(F.contains(t, F.lit("@")), match_spans(t, EMAIL)),
        "ip": _only(digit, F.filter(match_spans(t, IP), lambda s: _octets(s["match"]))),
        "card": _only(digit, F.filter(match_spans(t, CARD), card)),
        "phone": _only(
            F.contains(t, F.lit("+")),
            F.filter(match_spans(t, PHONE), lambda s: _between(F.length(_digits(s["match"])), 9, 15)),
        ),
        "email_words": _only(t.rlike(r"(?i)[(\[\x20]at[)\]\x20]"), match_spans(t, EMAIL_WORDS)),
        "phone_local": _only(digit, match_spans(t, PHONE_LOCAL)),
        "account": _only(digit, match_spans(t, ACCOUNT)),
        "name": match_spans(t, NAME),
    }


def _listed(name: Column) -> Column:
    return F.substring_index(name, " ", 1).isin(FIRST_NAMES)


def _vote(yes: Column, no: Column) -> Column:
    """1, -1, or 0 for no vote."""
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(t: Column, s: Column, kind: str) -> Column:
    """The labelers' votes on a span, and the shape of it, as a struct of small integers."""
    text = s["match"]

    def of(c: Column) -> Column:
        before, after, digits = c["before"], c["after"], c["digits"]
        never, n = F.lit(False), F.length(digits)
        form = {
            "email": _vote(text.rlike(r"^[A-Za-z0-9][^@]*@[^@]*\.[A-Za-z]{2,24}$"), text.rlike(r"\.\.|\.[0-9]+$")),
            "ip": _vote(text.rlike(r"^[1-9]"), text.rlike(r"^0|^[0-9]\.[0-9]\.[0-9]\.[0-9]$")),
            "card": _vote(text.rlike(r"^[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{1,7}$"), never),
            "phone": _vote(_between(n, 10, 15), n < 9),
            "email_words": _vote(text.rlike(r"\(at\)|\[at\]"), never),
            "phone_local": _vote(text.rlike(r"^\([0-9]{3}\)"), text.rlike(r"^[0-9]{3}\x20[0-9]{3}\x20[0-9]{4}$")),
            "account": _vote(_between(F.length(F.regexp_replace(text, r"\x20", "")), 15, 34), never),
            "name": _vote(never, never),
        }[kind]
        gazetteer = {
            "email": _vote(F.lower(F.substring_index(text, ".", -1)).isin(DOMAIN_ENDS), text.rlike(r"\.[0-9]+$")),
            "ip": _vote(never, text.rlike(r"^(0|127|255)\.")),
            "card": _vote(text.rlike("^[3456]"), text.rlike("^[0789]")),
            "phone": _vote(text.rlike(r"^\+[1-9]"), text.rlike(r"^\+0")),
            "email_words": _vote(F.lower(F.regexp_extract(text, r"([A-Za-z]+)$", 1)).isin(DOMAIN_ENDS), never),
            "phone_local": _vote(digits.rlike("^[2-9]"), digits.rlike("^[01]")),
            "account": _vote(F.substring(text, 1, 2).isin(ACCOUNT_COUNTRIES), ~F.substring(text, 1, 2).isin(ACCOUNT_COUNTRIES)),
            "name": _vote(_listed(text), never),
        }[kind]
        check = {
            "card": _vote(luhn(digits), ~luhn(digits)),
            "account": _vote(never, n < 10),
        }.get(kind, _vote(never, never))
        same = text.rlike(r"([0-9])\1{5}")
        return F.struct(
            form.alias("form"),
            gazetteer.alias("gazetteer"),
            _vote(before.rlike(rf"(?i)(?<!\p{{L}})({CUES[kind]})(?!\p{{L}})"), never).alias("cue"),
            _vote(never, before.rlike(rf"(?i)(?<!\p{{L}})({COUNTER_CUES})(?!\p{{L}})")).alias("counter_cue"),
            F.when(same, -1).otherwise(check).alias("check_digit"),
            _vote(
                before.rlike(r"(^|[\s(<\[\"':;,])$") & after.rlike(r"^($|[\s)>\]\"';:,.!?])"),
                before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]"),
            ).alias("edges"),
            (F.length(text) >= 16).cast("int").alias("long"),
            (n * 2 >= F.length(text)).cast("int").alias("mostly_digits"),
            text.rlike(r"[\x20().-]").cast("int").alias("separators"),
        )

    around = F.struct(
        F.substring(t, F.greatest(s["start"] - F.lit(CUE_CHARS), F.lit(0)) + 1, F.least(s["start"], F.lit(CUE_CHARS))).alias("before"),
        F.substring(t, s["end"] + 1, F.lit(1)).alias("after"),
        _digits(text).alias("digits"),
    )
    return bind(around, of)


def _voted(text: Column) -> Column:
    """All candidates of a text with votes and shape, base kinds first."""

    def of(t: Column) -> Column:
        parts = []
        for rank, (kind, spans) in enumerate(_candidates(t).items()):
            parts.append(_marked(t, spans, kind, rank))
        return F.concat(*parts)

    return bind(F.coalesce(text, F.lit("")), of)


def _marked(t: Column, spans: Column, kind: str, rank: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            s["match"].alias("match"), _votes(t, s, kind).alias("seen"),
        ),
    )


def estimate(patterns: Sequence[tuple[tuple[int, ...], float]], labelers: int, rounds: int = EM_ROUNDS) -> tuple[list, float, list[float]]:
    """EM for a two-class model of independent labelers that may abstain.

    ``patterns``: distinct vote tuples with their number of spans. Returns each labeler's
    (P(yes | real), P(yes | not)) among its votes, the share of real spans, and each
    pattern's posterior. One pseudo-vote of the starting reliability keeps the classes apart.
    """
    total = sum(n for _, n in patterns)
    rates, prior, posterior = [(RELIABILITY_START, 1 - RELIABILITY_START)] * labelers, PRIOR_START, []
    for _ in range(rounds):
        posterior = []
        for votes, _n in patterns:
            real, other = math.log(prior), math.log(1 - prior)
            for (yes, false), v in zip(rates, votes, strict=True):
                if v:
                    real += math.log(yes if v > 0 else 1 - yes)
                    other += math.log(false if v > 0 else 1 - false)
            posterior.append(1 / (1 + math.exp(min(700.0, max(-700.0, other - real)))))
        prior = (sum(p * n for p, (_, n) in zip(posterior, patterns, strict=True)) + 1) / (total + 2)
        rates = []
        for j in range(labelers):
            weights = [[0.0, 0.0], [0.0, 0.0]]
            for p, (votes, n) in zip(posterior, patterns, strict=True):
                if votes[j]:
                    weights[0][votes[j] > 0] += p * n
                    weights[1][votes[j] > 0] += (1 - p) * n
            strength = max(1.0, 0.05 * (sum(weights[0]) + sum(weights[1])))
            rates.append(
                tuple(
                    (w[1] + strength * start) / (w[0] + w[1] + strength)
                    for w, start in zip(weights, (RELIABILITY_START, 1 - RELIABILITY_START), strict=True)
                )
            )
    return rates, prior, posterior


def train(rows: Sequence[tuple[str, tuple[int, ...], float, float]]) -> tuple[dict[str, float], list[float]]:
    """Logistic weights from (kind, features, posterior, number) by gradient steps; a bias for each kind."""
    kinds = {k: 0.0 for k, *_ in rows}
    weights = [0.0] * (len(rows[0][1]) if rows else 0)
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(STEPS):
        slope, bias = [RIDGE * w for w in weights], {k: RIDGE * b for k, b in kinds.items()}
        for kind, x, target, n in rows:
            z = kinds[kind] + sum(w * v for w, v in zip(weights, x, strict=True))
            miss = (1 / (1 + math.exp(-min(700.0, max(-700.0, z)))) - target) * n / total
            bias[kind] += miss
            slope = [g + miss * v for g, v in zip(slope, x, strict=True)]
        weights = [w - RATE * g for w, g in zip(weights, slope, strict=True)]
        kinds = {k: b - RATE * bias[k] for k, b in kinds.items()}
    return kinds, weights


def fit(candidates: DataFrame, spans: str) -> tuple[dict[str, float], list[float]]:
    """Votes counted per combination over all spans, reliabilities by EM, then the classifier.

    A combination is a kind, three-valued votes and two-valued shapes: the collected table has
    a bound of its own, whatever the number of documents.
    """
    seen = list(dict.fromkeys([*LABELERS, *FEATURES]))
    counted = (
        candidates.select(F.explode(spans).alias("s"))
        .groupBy(F.col("s.kind").alias("kind"), *[F.col(f"s.seen.{c}").alias(c) for c in seen])
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    counted = sorted(counted, key=lambda r: tuple(str(v) for v in r))
    votes: dict[tuple[int, ...], float] = {}
    for r in counted:
        key = tuple(r[c] for c in LABELERS)
        votes[key] = votes.get(key, 0.0) + r["n"]
    if not votes:
        return {}, []
    patterns = sorted(votes.items())
    _, _, posterior = estimate(patterns, len(LABELERS))
    chance = {k: p for (k, _), p in zip(patterns, posterior, strict=True)}
    return train(
        [(r["kind"], tuple(r[c] for c in FEATURES), chance[tuple(r[c] for c in LABELERS)], float(r["n"])) for r in counted]
    )


def _chosen(spans: Column, kinds: dict[str, float], weights: list[float]) -> Column:
    """Base spans, and the others that the classifier takes and no base span covers."""

    def real(s: Column) -> Column:
        z = F.lit(-1e9)
        for kind, b in kinds.items():
            z = F.when(s["kind"] == kind, F.lit(float(b))).otherwise(z)
        for name, w in zip(FEATURES, weights, strict=True):
            z = z + F.lit(float(w)) * s["seen"][name]
        return z > 0

    def of(x: Column) -> Column:
        base = F.filter(x, lambda s: s["rank"] < len(BASE_KINDS))
        if not weights:
            return base
        return bind(
            base,
            lambda b: F.concat(
                b,
                F.filter(
                    x,
                    lambda s: (s["rank"] >= len(BASE_KINDS))
                    & ~F.exists(b, lambda y: (y["start"] < s["end"]) & (s["start"] < y["end"]))
                    & real(s),
                ),
            ),
        )

    chosen = bind(spans, of)
    return F.sort_array(
        F.transform(chosen, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "match")]))
    )


def pii_spans(df: DataFrame, carry: Sequence[str], text: str = "text") -> DataFrame:
    """The ``carry`` columns with ``base_spans`` and ``pii_spans``: arrays of (start, rank, end, kind, match).

    Candidates are found in one pass over the texts and written without them; counting and
    deciding read that small table.
    """
    found = "_candidates"
    while found in carry:
        found = "_" + found
    table = materialize(df.select(*[F.col(f"`{c}`") for c in carry], _voted(F.col(f"`{text}`")).alias(found)), "pii")
    kinds, weights = fit(table, found)
    keep = [F.col(f"`{c}`") for c in carry if c.lower() not in ("base_spans", "pii_spans")]
    return table.select(
        *keep,
        _chosen(F.col(found), {}, []).alias("base_spans"),
        _chosen(F.col(found), kinds, weights).alias("pii_spans"),
    )
