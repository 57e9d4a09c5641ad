"""Scans and joins that must not depend on how a group is cut or salted."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.plans import scan, sized


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 9)}", i, rnd.randint(0, 50)) for i in range(600)]
    return rows, spark.createDataFrame(rows, "k string, i bigint, v bigint").cache()


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_prior_is_independent_of_the_bucket_width(skewed, width):
    rows, df = skewed
    for agg, fold in ((F.sum, sum), (F.max, max), (F.min, min)):
        got = {r.i: r.o for r in scan.prior(df, ["k"], scan.bucket_of("i", width), ["i"], agg, F.col("v"), "o").collect()}
        seen: dict = {}
        for k, i, v in rows:
            assert got[i] == (fold(seen[k]) if k in seen else None)
            seen.setdefault(k, []).append(v)


def test_parts_hold_the_whole_group_in_order(skewed):
    rows, df = skewed
    parts = scan.ordered_parts(df, ["k"], scan.bucket_of("i", 11), ["i"], ["i"], "items", 20).orderBy("k", "part_no").collect()
    got: dict = {}
    for p in parts:
        assert len(p["items"]) <= 20
        got.setdefault(p.k, []).extend(x["i"] for x in p["items"])
    expected: dict = {}
    for k, i, _ in rows:
        expected.setdefault(k, []).append(i)
    assert got == expected


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    _, df = skewed
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("zz", 4)], "k string, s int")
    plain = sorted(map(str, df.join(side, "k", how).collect()))
    assert sorted(map(str, sized.salted_join(df, side, ["k"], how, hot_rows=100).collect())) == plain
    assert sorted(map(str, sized.lookup_join(df, side, ["k"], how, max_rows=1).collect())) == plain
    assert sorted(map(str, sized.lookup_join(df, side, ["k"], how).collect())) == plain


def test_size_check(spark):
    wide = spark.createDataFrame([("x" * 1000,)] * 10, "v string")
    assert sized.is_small(wide, 10, 100_000)
    assert not sized.is_small(wide, 9, 100_000)
    assert not sized.is_small(wide, 10, 5_000)
    assert sized.is_small(wide.limit(0))


def test_partitions_follow_the_rows(spark, monkeypatch):
    from auditlake.operators import ontology as O

    monkeypatch.setattr(sized, "TASK_ROWS", 10)
    rows = [("f", f"http://x#C{i % 40}", O.RDFS_SUBCLASS, f"_:n{i % 90}", False) for i in range(400)]
    rows += [("f", f"_:n{i}", O.OWL_ON_PROPERTY, f"http://x#p{i % 7}", True) for i in range(90)]
    rows += [("f", f"http://x#d{i % 3}", O.RDFS_DOMAIN, f"http://x#C{i}", True) for i in range(50)]
    rows += [("f", f"http://x#C{i}", O.RDF_TYPE, O.OWL_CLASS, True) for i in range(45)]
    triples = spark.createDataFrame(rows, "source_file string, subject string, predicate string, object string, is_iri boolean")
    nodes = {f"_:n{i}": f"p{i % 7}" for i in range(90)}
    want = {(s, nodes[o]) for _, s, p, o, _ in rows if p == O.RDFS_SUBCLASS} | {(o, s[9:]) for _, s, p, o, _ in rows if p == O.RDFS_DOMAIN}
    found = O.class_properties(triples)
    assert {(r.class_uri, r.property) for r in found.collect()} == want
    # 540 rows of 10 a task; the session's partitions alone would be 8.
    assert found.rdd.getNumPartitions() >= 54
    assert {r.class_uri: r.properties for r in O.class_records(triples).collect()} == {
        f"http://x#C{i}": sorted(p for c, p in want if c == f"http://x#C{i}") for i in range(45)
    }
    big = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    side = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    for hot in (50, 1000):
        joined = sized.salted_join(big, side, ["k"], "left", hot, parts=5)
        assert sorted((r.id, r.v) for r in joined.collect()) == [(i, {0: "a", 1: "b"}.get(i % 3)) for i in range(300)]


def test_no_key_is_counted_apart_where_none_is_hot(spark, monkeypatch):
    big = spark.range(3000).select((F.col("id") % 1500).alias("k"), "id")
    side = spark.range(1500).select(F.col("id").alias("k"))
    written = []
    keep = sized.materialize
    monkeypatch.setattr(sized, "materialize", lambda df, label: written.append(df.columns) or keep(df, label))
    assert sized.salted_join(big, side, ["k"], "inner", 50, parts=3).count() == 3000
    assert written == [["_bucket"]]
    monkeypatch.setattr(sized, "HASH_BUCKETS", 2)
    assert sized.salted_join(big, side, ["k"], "inner", 50, parts=3).count() == 3000


def test_classes_are_grouped_in_parts_by_their_rows(spark, monkeypatch):
    from auditlake.operators import ontology as O

    monkeypatch.setattr(sized, "TASK_ROWS", 10)
    rows = [("f", f"http://x#C{i}", p, o) for i in range(100) for p, o in ((O.RDF_TYPE, O.OWL_CLASS), (O.RDFS_LABEL, f"c{i}"))]
    found = O.classes(spark.createDataFrame(rows, "source_file string, subject string, predicate string, object string"))
    assert found.count() == 100 and found.rdd.getNumPartitions() >= 20
