"""Covers of attributes by several columns against a plain loop."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from auditlake.operators import cover
from auditlake.operators import ontology as O
from auditlake.operators.jobs import create_mapping
from auditlake.operators.mapping import Catalog, sanitize, semantic_view
from auditlake.sources.sinks import Store
from test_similar import distance


def parts(name):
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return sorted(set(re.findall(r"[a-z0-9]+", spaced.lower())))


def quality(a, b):
    if a == b:
        return 1.0
    if a in cover.PERIODS and b in cover.PERIODS:
        return cover.PERIOD
    if re.search("[0-9]", a + b):
        return 0
    short = min(len(a), len(b))
    return cover.NEAR if distance(a, b) <= (0 if short < 4 else 1 if short < 8 else 2) else 0


def plain_cover(attributes, columns, threshold, most):
    sets = {tuple(parts(a)) for a in attributes if parts(a)}
    weight = {w: round(math.log(1 + len(sets) / sum(w in s for s in sets)), 6) for s in sets for w in s}
    tables, out = {}, {}
    for t, c in set(columns):
        tables.setdefault(t, []).append(c)
    for a in attributes:
        words, best = parts(a), None
        for t, names in tables.items():
            offers = []
            for c in names:
                got = [min(((-quality(w, o), w) for w in words if quality(w, o)), default=None) for o in parts(c)]
                hit = [(w, -q) for q, w in filter(None, got)]
                if hit and 2 * len(hit) >= len(got):
                    offers.append((len(got) - len(hit), c, hit))
            picked, covered, total = [], set(), 0.0
            for _ in range(most):
                def gain(o, covered=covered):
                    best_q = {}
                    for w, q in o[2]:
                        if w not in covered:
                            best_q[w] = max(best_q.get(w, 0), q)
                    return round(sum(weight[w] * q for w, q in sorted(best_q.items())), 6)
                top = min(((-gain(o), o[0], o[1], o[2]) for o in offers), default=(0,))
                if top[0] >= 0:
                    break
                picked.append(top[2])
                total -= top[0]
                covered = covered | {w for w, _ in top[3]}
            share = round(total / sum(sorted(weight[w] for w in words)), 4) if words else 0
            if picked and share >= threshold:
                best = min(best or (1,), (-share, len(picked), t, picked))
        out[a] = (best[3], -best[0]) if best else ([], None)
    return out


@pytest.mark.parametrize("seed,threshold,most", [(1, 0.5, 3), (2, 0.3, 2), (3, 0.8, 1), (4, 0.0, 5)])
def test_cover(spark, seed, threshold, most):
    rnd = random.Random(seed)
    words = ["loan", "amount", "income", "applicant", "coapplicant", "annual", "monthly", "rate", "rates", "interest", "term", "x1", "x2", "date"]

    def name():
        ws = rnd.sample(words, rnd.randint(1, 4))
        if rnd.random() < 0.3:
            w = rnd.choice(ws)
            ws[ws.index(w)] = w[:2] + rnd.choice("aeiou") + w[2:]
        return ws

    attributes = ["has" + "".join(w.title() for w in name()) for _ in range(60)] + ["", "---"]
    columns = [(rnd.choice("ABC"), rnd.choice([".", "_", " "]).join(name())) for _ in range(60)] + [("A", "..."), ("B", "loan")]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(attributes)], "id long, name string")
    cols = spark.createDataFrame(columns, "file string, c string")
    found = cover.cover_match(df, "name", cols, "c", within="file", threshold=threshold, most=most).collect()
    assert len(found) == len(attributes)
    want = plain_cover(attributes, columns, threshold, most)
    for r in found:
        assert (r.mapped_columns, r.similarity and pytest.approx(r.similarity, abs=1e-4)) == want[r.name], r.name
        assert r.not_enough_information == (not r.mapped_columns)
        assert all((next(t for t, c in columns if c == m)) for m in r.mapped_columns)


def test_formulas_are_evaluated(spark):
    columns = ["applicant_income", "coapplicant.income", "monthly_rent", "First Name", "last_name", "loan_id"]
    attributes = ["hasApplicantAndCoapplicantIncome", "hasAnnualRent", "hasFirstAndLastName", "hasLoanId", "hasUnknownThing"]
    df = spark.createDataFrame([(a,) for a in attributes], "name string").withColumn("similarity", F.lit("old"))
    typed = spark.createDataFrame([(c, "ame" not in c) for c in columns], "c string, number boolean")
    found = cover.cover_match(df, "name", typed, "c", number="number", threshold=0.4)
    rows = {r.name: (sorted(r.mapped_columns), r.sql_formula) for r in found.collect()}
    assert rows["hasAnnualRent"] == (["monthly_rent"], "monthly_rent * 12") and rows["hasLoanId"] == (["loan_id"], None)
    assert rows["hasUnknownThing"] == ([], None) and rows["hasFirstAndLastName"][0] == ["First Name", "last_name"]
    data = spark.createDataFrame([(100, 20, 5, "Ada", "Lovelace", 7)], ["applicant_income", "coapplicant.income", "monthly_rent", "First Name", "last_name", "loan_id"])
    mapped = [(r.name, r.mapped_columns, r.sql_formula) for r in found.collect() if r.mapped_columns]
    row = semantic_view(data, mapped, []).first()
    assert row["hasFirstAndLastName"] in ("Ada Lovelace", "Lovelace Ada") and row["hasApplicantAndCoapplicantIncome"] == 120 and row["hasAnnualRent"] == 60 and row["hasLoanId"] == 7
    kept = sanitize(found.drop("similarity"), Catalog.of({"t": columns})).collect()
    assert {r.name: r.sql_formula for r in kept}["hasAnnualRent"] == "monthly_rent * 12"


def test_empty_sides(spark):
    none = spark.createDataFrame([], "name string")
    some = spark.createDataFrame([("loan",)], "name string")
    assert cover.cover_match(none, "name", some, "name").count() == 0
    assert cover.cover_match(some, "name", none, "name").first().not_enough_information


def test_deletions_meet_within_the_bound(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 10))) for _ in range(120)} | {"a1", "b1"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.word, r.other) for r in cover.word_pairs(df, df).collect()}
    assert got == {(a, b) for a in words for b in words if quality(a, b)}


def test_mapping_job_combines_columns(spark, tmp_path):
    h = "http://x.org/"
    names = ["hasApplicantAndCoapplicantIncome", "hasAnnualRent", "hasUnknownThing"]
    rows = [("f", f"{h}C", O.RDF_TYPE, O.OWL_CLASS)] + [("f", f"{h}{n}", O.RDFS_DOMAIN, f"{h}C") for n in names]
    triples = spark.createDataFrame(rows, "source_file string, subject string, predicate string, object string")
    columns = spark.createDataFrame(
        [("d.csv", 1, "applicant_income"), ("d.csv", 2, "coapplicant.income"), ("e.csv", 1, "monthly_rent"), ("e.csv", 2, "term")],
        "file string, ordinal int, column_name string",
    )
    store = Store(spark, str(tmp_path / "s"))
    lines = [r.line for r in create_mapping(triples, columns, store, combine=True).orderBy("source_file").collect()]
    assert lines[0] == "# Coverage: 75.00% (3 out of 4 CSV columns successfully mapped)"
    kept = {r.attribute_name: (sorted(r.mapped_columns), r.sql_formula, r.not_enough_information) for r in store.mapped().collect()}
    assert kept["hasAnnualRent"] == (["monthly_rent"], "monthly_rent * 12", False) and kept["hasUnknownThing"] == ([], None, True)
    assert kept["hasApplicantAndCoapplicantIncome"][0] == ["applicant_income", "coapplicant.income"]
    assert "hasUnknownThing" not in lines[1] and '"sql_formula":"monthly_rent * 12"' in lines[1]
