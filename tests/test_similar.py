"""Leaders of similar names against a plain loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions.text import SPACE, name_parts, normalize_name
from auditlake.operators import similar
from auditlake.operators.concepts import match_key, reconcile

WORDS = ["loan", "credit", "amount", "borrower", "rate", "annual", "income", "house", "7", "12", "a", "fund"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain_similar(a, b, edit=0.15, word=0.6):
    wa, wb = ({w for w in x.split("-") if w} for x in (a, b))
    na, nb = ({w for w in s if any(c.isdigit() for c in w)} for s in (wa, wb))
    if na != nb:
        return False
    small, large = sorted((wa - na, wb - nb), key=len)
    if small and small <= large and len(small) >= word * len(large) - 1e-9:
        return True
    return distance(a, b) <= math.floor(max(len(a), len(b)) * edit + 1e-9)


def plain_leaders(names, known, **shares):
    """names: (type, key, name, seq); known: (type, key, name)."""
    lead, out = {}, {}
    for t, k, n in sorted(known):
        lead.setdefault(t, []).append((k, n))
    for t, k, n, _ in sorted(names, key=lambda r: r[3]):
        found = next((x for x, m in lead.get(t, []) if plain_similar(n, m, **shares)), None)
        if found is None:
            lead.setdefault(t, []).append((k, n))
        out[t, k] = found or k
    return out


def misspelt(rnd, name):
    at = rnd.randrange(len(name))
    return rnd.choice([name[:at] + name[at + 1 :], name[:at] + rnd.choice("xyz-") + name[at:], name[:at] + "q" + name[at + 1 :]]) or "q"


def some_names(seed, n):
    rnd = random.Random(seed)
    bases = ["-".join(rnd.sample(WORDS, rnd.randint(1, 5))) for _ in range(n // 6)] + ["aaaaaaaa", "ab", "a"]
    names = set()
    while len(names) < n:
        name = rnd.choice(bases)
        for _ in range(rnd.randrange(3)):
            name = misspelt(rnd, name) if rnd.random() < 0.7 else name + "-" + rnd.choice(WORDS)
        names.add((rnd.choice("ST"), name))
    seqs = rnd.sample(range(10 * n), n)
    return [(t, f"{x}~key", x, s) for (t, x), s in zip(sorted(names), seqs, strict=True)]


@pytest.mark.parametrize("seed,first_batch,edit", [(1, 4096, 0.15), (2, 8, 0.2), (3, 1, 0.15), (4, 30, 0.0)])
def test_leaders(spark, seed, first_batch, edit):
    rows = some_names(seed, 150)
    known = [(t, k, n) for t, k, n, s in rows if s % 9 == 0]
    rows = [r for r in rows if r[3] % 9]
    names = spark.createDataFrame(rows, "concept_type string, key string, name string, seq long")
    old = spark.createDataFrame(known, "concept_type string, key string, name string")
    found = similar.leaders(names, old, edit_share=edit, first_batch=first_batch).collect()
    got = {(r.concept_type, r.key): r.lead_key for r in found}
    assert len(found) == len(rows) and got == plain_leaders(rows, known, edit=edit)
    assert any(k != v for (_, k), v in got.items())


def test_no_similar_pair_is_missed(spark):
    """The prefix filter alone: all pairs of a set of names that share long stretches."""
    rnd = random.Random(9)
    names = sorted({"".join(rnd.choice("ab-") for _ in range(rnd.randint(1, 24))) for _ in range(150)})
    names += [misspelt(rnd, n) for n in names if len(n) > 6]
    rows = [("S", f"{k}", n, k) for k, n in enumerate(dict.fromkeys(names))]
    df = spark.createDataFrame(rows, "concept_type string, key string, name string, seq long").withColumn(
        "at", F.struct(F.lit(1).alias("new"), "seq", "key")
    )
    nodes = similar._with_prefixes(df.withColumn("traits", similar.name_traits(F.col("name"))), 0.2, 0.6)
    got = {(r.key, r.lead) for r in similar._pairs(nodes, nodes, 0.2, 0.6).collect()}
    assert got == {(b[1], a[1]) for a in rows for b in rows if a[3] < b[3] and plain_similar(a[2], b[2], edit=0.2)}


def test_few_small_names_are_spread(spark, tmp_path):
    """Pairs of a small table of names are looked for by all cores."""
    rows = [("S", f"{k}", f"annual-income-{k:03d}" if k % 2 else f"annual-income{'x' * k}", k) for k in range(60)]
    df = spark.createDataFrame(rows, "concept_type string, key string, name string, seq long").withColumn("at", F.struct(F.lit(1).alias("new"), "seq", "key"))
    similar._with_prefixes(df.withColumn("traits", similar.name_traits(F.col("name"))), 0.15, 0.6).coalesce(1).write.parquet(f"{tmp_path}/names")
    nodes = spark.read.parquet(f"{tmp_path}/names")
    similar._pairs(nodes, nodes, 0.15, 0.6).withColumn("part", F.spark_partition_id()).write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    assert found.count() > 0 and found.select("part").distinct().count() > 1


@pytest.mark.parametrize("name", ["Annual Income", "income--annual", " - ", "", None, "A&B b", "camelCase Word", "x\u00a0y\nz 12-3", "-é-", "É1 \u2003 b- a -b\n"])
def test_match_key_is_that_of_the_slug_words(spark, name):
    df = spark.createDataFrame([(name,)], "n string")
    slug = F.regexp_replace(F.regexp_replace(F.replace(F.lower("n"), F.lit("&"), F.lit("and")), rf"[^a-z0-9{SPACE}\-]", ""), rf"[{SPACE}\-]+", "-")
    plain = F.coalesce(F.nullif(F.regexp_replace(slug, "^-+|-+$", ""), F.lit("")), F.lit("concept"))
    row = df.select(normalize_name("n").alias("a"), plain.alias("b"), match_key(F.col("n")).alias("c"), F.array_join(name_parts(plain), "-").alias("d")).first()
    assert row.a == row.b and row.c == row.d


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "concept_type string, key string, name string, seq long")
    one = spark.createDataFrame([("S", "k", "", 5)], none.schema)
    assert similar.leaders(none, none.drop("seq")).count() == 0
    assert similar.leaders(one, none.drop("seq")).collect() == [("S", "k", "k")]
    with pytest.raises(ValueError):
        similar.leaders(one, none, edit_share=0.3)


def test_reconcile_folds_what_is_misspelt(spark):
    rows = [
        ("s1", 1, "Loan", "Annual Income"), ("s2", 2, "Loan", "Anual Income"), ("s3", 3, "Loan", "Income Annual"), ("s4", 4, "Loan", "Annual Income Check"),
        ("s5", 5, "Loan", "Interest Rate"), ("s6", 6, "Loan", "Intrest Rate"), ("s7", 7, "Fund", "Annual Incomes"), ("s8", 8, "Loan", "Tier 1 Income"),
        ("s9", 9, "Loan", "Tier 2 Income"),
    ]
    candidates = spark.createDataFrame(rows, "segment_id string, seq long, concept_type string, concept_name string").select(
        "*", F.lit("r").alias("rationale"), F.concat(F.lit("sum "), "segment_id").alias("summary"),
        F.create_map(F.col("segment_id"), F.lit("v")).alias("attributes_and_values"),
    )
    existing = spark.createDataFrame(
        [("Loan", "old", "interest-rate", {"old": "v"}, "old")],
        "concept_type string, rationale string, concept_name string, attributes_and_values map<string,string>, summary string",
    )
    found, mapping = reconcile(candidates, existing, similar=True)
    by_segment = {r.segment_id: r.concept_name for r in mapping.collect()}
    assert by_segment == {
        "s1": "annual-income", "s2": "annual-income", "s3": "annual-income", "s4": "annual-income", "s5": "interest-rate", "s6": "interest-rate",
        "s7": "annual-incomes", "s8": "tier-1-income", "s9": "tier-2-income",
    }
    by_name = {r.concept_name: r for r in found.collect()}
    assert len(by_name) == 5 and by_name["annual-income"].summary == "sum s4" and set(by_name["annual-income"].attributes_and_values) == {"s1", "s2", "s3", "s4"}
    assert set(by_name["interest-rate"].attributes_and_values) == {"old", "s5", "s6"}
