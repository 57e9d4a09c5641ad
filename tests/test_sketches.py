"""Mergeable column sketches against exact figures."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import sketches as S


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    data = [(k, rnd.randrange(9000), rnd.gauss(0, 5), rnd.choice(["a", "b", None]), None) for k in range(20_000)]
    return spark.createDataFrame(data, "id long, ref int, x double, s string, nothing double").repartition(4)


def test_parts_add_up(spark, rows):
    parts = S.sketch_parts(rows, F.pmod("id", F.lit(7)))
    assert parts.count() == 7 * 5
    found = {r.column_name: r for r in S.estimates(S.merged(parts)).collect()}
    exact = {c: {v for (v,) in rows.select(c).distinct().collect() if v is not None} for c in rows.columns}
    for c, r in found.items():
        assert abs(r.distinct_estimate - len(exact[c])) <= S.HLL_ERROR * len(exact[c]) + 1
        assert r.n == 20_000 and r.nulls == rows.filter(F.col(c).isNull()).count()
    assert found["s"].quantile_estimates is None and found["nothing"].quantile_estimates is None and found["nothing"].distinct_estimate == 0
    values = sorted(v for (v,) in rows.select("x").collect())
    for rank, q in zip((0.25, 0.5, 0.75), found["x"].quantile_estimates, strict=True):
        assert abs(sum(v <= q for v in values) / len(values) - rank) <= S.RANK_ERROR
    assert (found["s"].low, found["s"].high) == ("a", "b")


def test_a_new_part_is_merged_with_kept_ones(spark, rows, tmp_path):
    S.sketch_parts(rows.filter("id < 15000"), F.lit("old")).write.parquet(str(tmp_path / "kept"))
    S.sketch_parts(rows.filter("id >= 15000"), F.lit("new")).write.mode("append").parquet(str(tmp_path / "kept"))
    kept = {r.column_name: r for r in S.estimates(S.merged(spark.read.parquet(str(tmp_path / "kept")))).collect()}
    once = {r.column_name: r for r in S.estimates(S.merged(S.sketch_parts(rows, F.lit("all")))).collect()}
    for c, r in kept.items():
        assert (r.n, r.nulls, r.low, r.high) == (once[c].n, once[c].nulls, once[c].low, once[c].high)
        assert r.distinct_estimate == pytest.approx(once[c].distinct_estimate, rel=S.HLL_ERROR, abs=1)


def test_inclusion_tells_references(spark, rows):
    parent = spark.range(9000).select(F.col("id").alias("key"))
    children, parents = S.merged(S.sketch_parts(rows, F.lit(1))), S.merged(S.sketch_parts(parent, F.lit(1)))
    found = {r.child_column: r for r in S.inclusion(children, parents, F.lit(True)).collect()}
    assert found["ref"].share == pytest.approx(1, abs=S.THETA_ERROR) and found["id"].share == pytest.approx(0.45, abs=2 * S.THETA_ERROR)
    assert found["s"].shared_values == 0 and found["nothing"].share is None


def test_no_rows(spark, rows):
    assert S.merged(S.sketch_parts(rows.limit(0), F.lit(1))).count() == 0
