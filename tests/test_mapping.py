"""Ontology classes and attribute mappings."""

import json

from pyspark.sql import functions as F

from auditlake.operators import mapping as M
from auditlake.operators import ontology as O
from auditlake.sources.text import parse_triples

MAPPING = (
    "source_ttl_file string, class_name string, attribute_name string, mapped_columns array<string>, sql_formula string, "
    "explanation string, not_enough_information boolean, seq int"
)


def test_classes_from_triples(spark):
    h = "http://x.org/o/"
    rows = [
        ("f1", h + "Loan", O.RDF_TYPE, O.OWL_CLASS), ("f1", h + "Loan", O.RDFS_LABEL, "a loan"), ("f1", h + "Loan", O.SKOS_DEFINITION, ""),
        ("f1", h + "Loan", O.CMNS_DEFINITION, "money lent"), ("f1", "_:b1", O.RDF_TYPE, O.OWL_CLASS), ("f1", "urn:x", O.RDF_TYPE, O.OWL_CLASS),
        ("f1", h + "hasAmount", O.RDFS_DOMAIN, h + "Loan"), ("f1", h + "Loan", O.RDFS_SUBCLASS, "_:r"), ("f1", "_:r", O.OWL_ON_PROPERTY, h + "p#hasTerm"),
        ("f2", h + "Loan", O.RDF_TYPE, O.OWL_CLASS), ("f2", "_:r", O.OWL_ON_PROPERTY, h + "other"), ("f2", h + "x", O.RDFS_DOMAIN, h + "Missing"),
    ]
    triples = spark.createDataFrame(rows, "source_file string, subject string, predicate string, object string")
    got = {r.source_file: (r.class_name, r.label, r.definition, r.properties) for r in O.class_records(triples).collect()}
    assert got == {"f1": ("Loan", "a loan", "money lent", ["hasAmount", "hasTerm"]), "f2": ("Loan", "Loan", "", [])}


def test_triples_from_text(spark):
    lines = [
        '<http://a> <http://p> "say \\"hi\\" \\\\n\\n"@en .', "<http://a> <http://p> _:x .", "_:x <http://p> <http://b>.", "# no", "",
        '<http://a> <http://p> "1"^^<http://int> .', "broken",
    ]
    df = spark.createDataFrame([("f", x) for x in lines], "f string, v string")
    got = [(r.subject, r.object, r.is_iri) for r in parse_triples(df, "f", "v").collect()]
    assert got == [("http://a", 'say "hi" \\n\n', False), ("http://a", "_:x", False), ("_:x", "http://b", True), ("http://a", "1", False)]


def test_sanitize(spark):
    catalog = M.Catalog.of({"loan_data": ["credit_policy", "int_rate", "installment", "log.annual.inc"], "loan_prediction_train": ["gender"]})
    rows = [
        ("1", ["nonexistent_col", "credit_policy"], "nonexistent_col + credit_policy"), ("2", ["fico"], "fico"),
        ("3", ["int_rate", "INSTALLMENT"], "int_rate * installment"), ("4", ["log.annual.inc"], "log.annual.inc * 12"),
        ("5", ["int_rate"], "loan_data.int_rate + loan_data.log.annual.inc"), ("6", ["int_rate"], "other.int_rate"),
        ("7", ["int_rate"], "coalesce(int_rate, 'not a column')"), ("8", ["int_rate"], "ROUND(int_rate)"), ("9", None, None), ("10", ["gender"], None),
        ("11", ["int_rate"], ""),
    ]
    df = spark.createDataFrame([(a, c, f, "why", False) for a, c, f in rows], "a string, mapped_columns array<string>, sql_formula string, explanation string, not_enough_information boolean")
    clean = M.sanitize(df, catalog)
    assert "explanation" not in clean.columns
    got = {r.a: (r.mapped_columns, r.sql_formula, r.not_enough_information) for r in clean.collect()}
    assert got == {
        "1": (["credit_policy"], None, False), "2": ([], None, True), "3": (["int_rate", "INSTALLMENT"], "int_rate * installment", False),
        "4": (["log.annual.inc"], "log.annual.inc * 12", False), "5": (["int_rate"], "loan_data.int_rate + loan_data.log.annual.inc", False),
        "6": (["int_rate"], None, False), "7": (["int_rate"], "coalesce(int_rate, 'not a column')", False), "8": (["int_rate"], None, False),
        "9": ([], None, True), "10": ([], None, True), "11": (["int_rate"], "", False),
    }


def test_existing_columns_join_keeps_order(spark):
    df = spark.createDataFrame([(1, ["b", "X", "a", "B"]), (2, ["x"]), (3, [])], "k int, c array<string>")
    known = spark.createDataFrame([("A",), ("b",), ("b",)], "column_name string")
    got = {r.k: r.mapped_columns for r in M.existing_columns_join(df, "k", "c", known).collect()}
    assert got == {1: ["b", "a", "B"], 2: [], 3: []}


def test_schema_match(spark):
    attributes = spark.createDataFrame([(1, "hasIntRate"), (2, "annualIncome"), (3, "unrelated"), (4, "hasIntRate")], "i int, a string")
    columns = spark.createDataFrame([("int.rate",), ("annual_income",), ("income",), ("x",)], "c string")
    got = {r.i: (r.mapped_column, r.not_enough_information) for r in M.schema_match(attributes, "a", columns, "c").collect()}
    assert got == {1: ("int.rate", False), 2: ("annual_income", False), 3: (None, True), 4: ("int.rate", False)}


def test_export_prunes_and_counts(spark):
    rows = [
        ("/b/o.ttl", "C", "kept", ["col_rep"], "col_rep * 2", "old", False, 1), ("/b/o.ttl", "C", "kept", ["col_rep"], None, "new", False, 2),
        ("/b/o.ttl", "C", "none", [], None, "", False, 3), ("/b/o.ttl", "D", "unsure", ["other_col"], None, "", True, 4),
        ("/b/p.ttl", "E", "case", ["COL_REP"], None, "", True, 5),
    ]
    columns = spark.createDataFrame([("col_rep",), ("other_col",)], "column_name string")
    lines = [r.line for r in M.mapping_export(spark.createDataFrame(rows, MAPPING), "seq", columns, "/b").orderBy("source_file").collect()]
    assert lines[0] == "# Coverage: 50.00% (1 out of 2 CSV columns successfully mapped)"
    assert [json.loads(x) for x in lines[1:]] == [
        {"source_file": "o.ttl", "class_name": "C", "attributes": {"kept": {"mapped_columns": ["col_rep"], "sql_formula": None, "explanation": "new"}}}
    ]


def test_coverage_counts_case_and_no_columns(spark):
    used = spark.createDataFrame([(["A", "b"],), (["b", "zz"],)], "mapped_columns array<string>")
    columns = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "column_name string")
    row = M.column_coverage(used, columns).first()
    assert (row.mapped_columns, row.total_columns) == (1, 3)
    assert M.column_coverage(used, columns.limit(0)).first().coverage_pct == 0.0


def test_tree_and_reading_back(spark):
    rows = [(f"f{i % 2}", "C", f"a{i // 2:02d}", [f"c{i}"], None, "e", False, i) for i in range(20)]
    tree = M.mapping_tree(spark.createDataFrame(rows, MAPPING), "seq", part_size=4)
    nested = tree.select(
        F.to_json(F.create_map("source_ttl_file", F.create_map("class_name", F.struct("attributes"))), {"ignoreNullFields": "false"}).alias("j")
    )
    back = M.read_mapping_json(nested, "j")
    assert sorted((r.source_ttl_file, r.class_name, r.attribute_name, r.mapped_columns) for r in back.collect()) == sorted(
        (a, b, c, d) for a, b, c, d, *_ in rows
    )


def test_formulas_over_dotted_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], ["id", "int.rate", "log.annual.inc"])
    row = M.semantic_view(df, [("income", ["log.annual.inc"], "log.annual.inc * 12"), ("rate", ["int.rate"], "")], ["id"]).first()
    assert list(row) == [1, 36.0, 2.0]


def test_names_sharing_one_word_do_not_all_meet(spark):
    left = M._name_sets(spark.createDataFrame([(f"deliveredBy{i}x",) for i in range(300)], "n string"), "n", "l")
    right = M._name_sets(spark.createDataFrame([(f"delivered.by{i}x",) for i in range(300)], "n string"), "n", "r")
    rarity = right.select(F.explode("r_set").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    assert M.name_pairs(left, right, rarity, 0.5).count() == 300


def test_rare_words_lose_no_match(spark):
    import random

    rnd = random.Random(4)
    names = [" ".join(rnd.sample("abcdefgh", rnd.randint(1, 5))) for _ in range(120)]
    sides = [M._name_sets(spark.createDataFrame([(n,) for n in half], "n string"), "n", p) for half, p in ((names[:60], "l"), (names[60:], "r"))]
    rarity = sides[1].select(F.explode("r_set").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    met = {(r.l_key, r.r_key) for r in M.name_pairs(*sides, rarity, 0.5).collect()}
    sets = [{r[0] for r in side.select(f"{p}_key").collect()} for side, p in zip(sides, "lr")]
    for a in sets[0]:
        for b in sets[1]:
            x, y = set(a.split()), set(b.split())
            assert len(x & y) < 0.5 * len(x | y) or (a, b) in met


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_classes_of_few_and_of_many_rows_give_the_same_lines(spark, monkeypatch):
    rows = []
    for c, size in (("A", 3), ("B", 12), ("C", 1), (None, 9)):
        for i in range(size):
            for seq in range(1 + i % 2):
                # The later row of an attribute counts, also where it unmaps it.
                rows.append(("/b/o.ttl", c, f"a{i:02d}", [] if i == 1 and c == "A" and seq else [f"col{i}", f"{c}{seq}"], None, f"why {seq}", False, seq))
    rows += [("/b/p.ttl", "D", "only", [], None, "", False, 0), ("/b/p.ttl", "E", "unsure", ["col1"], None, "", True, 0), ("/b/p.ttl", "F", "no time", ["col1"], None, "", False, None)]
    columns = spark.createDataFrame([(f"col{i}",) for i in range(20)], "column_name string")
    ranged = []
    keep = M.range_bucketed
    monkeypatch.setattr(M, "range_bucketed", lambda df, *a, **k: ranged.append(df.select("class_name").distinct().collect()) or keep(df, *a, **k))

    def lines(part_size):
        got = M.mapping_export(spark.createDataFrame(rows, MAPPING), "seq", columns, "/b", part_size).collect()
        return {(r.source_file, r.class_name, r.part_no): r.line for r in got}

    few = lines(1_000)
    # Classes of few rows are not ranged; of the nameless only the columns count.
    assert [{r[0] for r in x} for x in ranged] == [{None}]
    assert set(few) == {("", "", 0), ("o.ttl", "A", 0), ("o.ttl", "B", 0), ("o.ttl", "C", 0)}
    assert few["", "", 0] == "# Coverage: 60.00% (12 out of 20 CSV columns successfully mapped)"
    for c, size in (("A", 3), ("B", 12), ("C", 1)):
        want = {f"a{i:02d}": {"mapped_columns": [f"col{i}", f"{c}{i % 2}"], "sql_formula": None, "explanation": f"why {i % 2}"} for i in range(size) if (c, i) != ("A", 1)}
        assert json.loads(few["o.ttl", c, 0])["attributes"] == want
        assert list(json.loads(few["o.ttl", c, 0])["attributes"]) == sorted(want)
    many = lines(5)
    assert {r[0] for r in ranged[-1]} == {None, "B"}
    assert {k: v for k, v in many.items() if k[1] != "B"} == {k: v for k, v in few.items() if k[1] != "B"}
    parts = [json.loads(many["o.ttl", "B", p])["attributes"] for p in range(3)]
    assert [len(p) for p in parts] == [5, 5, 2] and parts[0] | parts[1] | parts[2] == json.loads(few["o.ttl", "B", 0])["attributes"]


def test_names_are_matched_once_for_all_their_attributes(spark):
    """Whole names are found again; null, wordless and unknown ones stay unmapped."""
    names = ["intRate", "INT_rate", None, "??", "zzz", "intRate"]
    attributes = spark.createDataFrame(list(enumerate(names)), "i int, `a.b` string")
    columns = spark.createDataFrame([("int.rate",), ("int.rate",), ("other",)], "c string")
    got = {r.i: (r["a.b"], r.mapped_column, r.not_enough_information) for r in M.schema_match(attributes, "a.b", columns, "c").collect()}
    assert got == {i: (n, "int.rate" if n and "rate" in n.lower() else None, not (n and "rate" in n.lower())) for i, n in enumerate(names)}


def test_properties_come_by_class_and_hot_keys_are_spread(spark, monkeypatch):
    from auditlake.plans import sized

    rows = [("f", f"http://x#C{i % 4}", O.RDFS_SUBCLASS, f"_:n{i % 7}") for i in range(60)]
    rows += [("f", f"_:n{i % 7}", O.OWL_ON_PROPERTY, f"http://x#p{i % 3}") for i in range(12)]
    rows += [("f", f"http://x#d{i}", O.RDFS_DOMAIN, f"http://x#C{i % 5}") for i in range(30)] + [("g", "http://x#C0", O.RDFS_SUBCLASS, "_:n1"), (None, "http://x#C0", O.RDFS_SUBCLASS, "_:n1")]
    triples = spark.createDataFrame(rows, "source_file string, subject string, predicate string, object string")
    least = {f"_:n{j}": min(f"p{i % 3}" for i in range(12) if i % 7 == j) for j in range(7)}
    want = sorted({("f", s, least[o]) for f, s, p, o in rows if p == O.RDFS_SUBCLASS and f == "f"} | {("f", o, s[9:]) for f, s, p, o in rows if p == O.RDFS_DOMAIN})
    found = O.class_properties(triples)
    plain = _exchanges(found)
    assert sorted(map(tuple, found.collect())) == want
    # Nodes meet in one shuffle, and the properties are dealt out by class, for the join with the classes.
    assert plain == 2
    monkeypatch.setattr(sized, "HOT_KEY_ROWS", 3)
    hot = O.class_properties(triples)
    assert sorted(map(tuple, hot.collect())) == want and _exchanges(hot) > plain


def test_rows_of_known_keys_are_not_shuffled(spark):
    from auditlake.plans.sized import known_only

    big = spark.createDataFrame([(i % 5, i) for i in range(40)] + [(None, 99)], "k int, v int")
    side = spark.createDataFrame([(k,) for k in range(5)] * 2, "k int")
    kept = known_only(big, side, ["k"])
    assert sorted(r.v for r in kept.collect()) == list(range(40))
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.v for r in known_only(big, side.filter("k < 2"), ["k"]).collect()) == [i for i in range(40) if i % 5 < 2]
    assert known_only(big, side.limit(0), ["k"]).count() == 0
