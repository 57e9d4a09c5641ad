"""Cubes, risk indicators, SQL surface and table operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.registry import query, table
from auditlake.operators import runlog, sketches, tables
from auditlake.operators.cube import CubeSpec, Measure, Rule, data_cube, filtered_aggregates, scorecard
from auditlake.operators.guard import guarded_sql, run_sql
from auditlake.operators.mapping import semantic_view
from auditlake.plans.sized import lookup_join
from auditlake.session import materialize


@query(
    "cube_returnflag",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
           round(avg(l_quantity), 4) AS avg_qty, count(*) AS n, max(l_tax) AS max_tax
    FROM lineitem WHERE l_quantity >= 2 GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 100
    """,
)
def cube_returnflag(spark, sf_dir):
    spec = CubeSpec(
        [
            Measure("SUM", "l_quantity", "sum_qty", 2),
            Measure("SUM", "l_extendedprice * (1 - l_discount)", "revenue", 2),
            Measure("AVG", "l_quantity", "avg_qty", 4),
            Measure("COUNT", "*", "n"),
            Measure("MAX", "l_tax", "max_tax"),
        ],
        ["l_returnflag", "l_linestatus"],
        "l_quantity >= 2",
        [("l_returnflag", False), ("l_linestatus", False)],
    )
    return data_cube(table(spark, sf_dir, "lineitem"), spec)


def _orders_by_customer(spark, sf_dir):
    """Orders with the customer's segment and nation."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    placed = lookup_join(customer, nation.select("c_nationkey", "n_name"), ["c_nationkey"])
    return lookup_join(orders, placed, ["c_custkey"])


@query(
    "cube_filtered_topk",
    """
    SELECT n_name, c_mktsegment, round(sum(o_totalprice), 2) AS total_price, count(*) AS n_orders
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
    GROUP BY 1, 2 ORDER BY total_price DESC, n_name, c_mktsegment LIMIT 20
    """,
)
def cube_filtered_topk(spark, sf_dir):
    spec = CubeSpec(
        [Measure("SUM", "o_totalprice", "total_price", 2), Measure("COUNT", "*", "n_orders")],
        ["n_name", "c_mktsegment"],
        "o_orderpriority IN ('1-URGENT', '2-HIGH')",
        [("total_price", True), ("n_name", False), ("c_mktsegment", False)],
        row_limit=20,
    )
    return data_cube(_orders_by_customer(spark, sf_dir), spec)


@query(
    "cube_rollup",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS price, count(*) AS n
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
    """,
)
def cube_rollup(spark, sf_dir):
    spec = CubeSpec(
        [Measure("SUM", "l_extendedprice", "price", 2), Measure("COUNT", "*", "n")],
        ["l_returnflag", "l_linestatus"],
        grouping="rollup",
        row_limit=None,
    )
    return data_cube(table(spark, sf_dir, "lineitem"), spec)


@query(
    "cube_all_groupings",
    """
    SELECT o_orderstatus, o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n
    FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
    """,
)
def cube_all_groupings(spark, sf_dir):
    spec = CubeSpec(
        [Measure("MIN", "o_totalprice", "low"), Measure("MAX", "o_totalprice", "high"), Measure("COUNT", "*", "n")],
        ["o_orderstatus", "o_orderpriority"],
        grouping="cube",
        row_limit=None,
    )
    return data_cube(table(spark, sf_dir, "orders"), spec)


@query(
    "kri_filter",
    """
    SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem
    WHERE (l_discount > 0.08 OR l_tax > 0.07) AND l_returnflag IN ('A', 'R') AND l_shipdate IS NOT NULL
    """,
)
def kri_filter(spark, sf_dir):
    return tables.select_table(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey", "l_linenumber", "l_discount", "l_tax"],
        "(l_discount > 0.08 OR l_tax > 0.07) AND l_returnflag IN ('A', 'R') AND l_shipdate IS NOT NULL",
        limit=None,
    )


RULES = [
    Rule("urgent_large", "o_orderpriority = '1-URGENT' AND o_totalprice > 400000", "high"),
    Rule("negative_balance", "c_acctbal < 0", "medium"),
    Rule("open_or_pending", "o_orderstatus IN ('O', 'P')", "low"),
]


@query(
    "kri_scorecard",
    """
    WITH r AS (SELECT c_mktsegment, o_orderpriority, o_totalprice, c_acctbal, o_orderstatus
               FROM orders JOIN customer ON o_custkey = c_custkey),
    f AS (SELECT c_mktsegment, 'urgent_large' AS rule_id, 'high' AS severity,
                 o_orderpriority = '1-URGENT' AND o_totalprice > 400000 AS hit FROM r
          UNION ALL SELECT c_mktsegment, 'negative_balance', 'medium', c_acctbal < 0 FROM r
          UNION ALL SELECT c_mktsegment, 'open_or_pending', 'low', o_orderstatus IN ('O', 'P') FROM r)
    SELECT c_mktsegment, rule_id, severity, count(*) FILTER (WHERE hit) AS violations, count(*) AS total_records,
           round(count(*) FILTER (WHERE hit) * 100.0 / nullif(count(*), 0), 2) AS violation_pct
    FROM f GROUP BY 1, 2, 3
    """,
)
def kri_scorecard(spark, sf_dir):
    return scorecard(_orders_by_customer(spark, sf_dir), RULES, ["c_mktsegment"])


@query(
    "filtered_aggregates",
    """
    SELECT l_returnflag, count(*) AS total_records, count(*) FILTER (WHERE l_discount > 0.08) AS flagged_records,
           round(count(*) FILTER (WHERE l_discount > 0.08) * 100.0 / nullif(count(*), 0), 2) AS flagged_pct,
           round(avg(l_tax), 4) AS avg_value, min(l_tax) AS min_value, max(l_tax) AS max_value
    FROM lineitem GROUP BY 1
    """,
)
def filtered(spark, sf_dir):
    return filtered_aggregates(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_tax", "l_discount > 0.08")


_RATE = """
    WITH priced AS (SELECT o_orderpriority AS priority, IF(o_totalprice > 300000, 100E0, 0E0) AS dear, o_orderstatus = 'F' AS done FROM orders)
    SELECT priority, SUM(dear) / 100 AS dear_orders, ROUND(AVG(dear), 2) AS dear_pct, COUNT(*) FILTER (WHERE done) AS finished
    FROM priced GROUP BY priority HAVING COUNT(*) > 0 ORDER BY dear_pct DESC NULLS LAST, priority
"""


@query(
    "rate_pct_by_dim",
    """
    SELECT o_orderpriority AS priority, CAST(count(*) FILTER (WHERE o_totalprice > 300000) AS DOUBLE) AS dear_orders,
           round(count(*) FILTER (WHERE o_totalprice > 300000) * 100.0 / count(*), 2) AS dear_pct, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished
    FROM orders GROUP BY ALL
    """,
)
def rate_pct_by_dim(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return run_sql(spark, _RATE)


@query(
    "select_table",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 5000",
)
def select_table(spark, sf_dir):
    return tables.select_table(
        table(spark, sf_dir, "customer"),
        ["c_custkey", "c_name", "c_acctbal"],
        "c_mktsegment = 'MACHINERY' AND c_acctbal > 5000",
        limit=None,
    )


@query("ci_equality", "SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_type) = lower('Promo')")
def ci_equality(spark, sf_dir):
    rows = tables.equal_ignoring_case(table(spark, sf_dir, "part"), "p_type", "Promo")
    return rows.select("p_partkey", "p_name", "p_type")


@query(
    "case_flags",
    """
    SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium'
           ELSE 'small' END AS size_flag, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS finished FROM orders
    """,
)
def case_flags(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(price > 400000, "large").when(price > 100000, "medium").otherwise("small").alias("size_flag"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("finished"),
    )


def _dotted(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed(
        {"l_extendedprice": "ext.price", "l_discount": "int.rate", "l_quantity": "qty.2yrs"}
    )
    rows.createOrReplaceTempView("dotted_lineitem")
    return rows


@query(
    "run_sql",
    """
    SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS high_rate, min(l_discount) AS min_rate,
           max(l_extendedprice) AS max_price FROM lineitem WHERE l_quantity > 2 GROUP BY l_returnflag
    """,
)
def sql_text(spark, sf_dir):
    _dotted(spark, sf_dir)
    return run_sql(
        spark,
        'SELECT l_returnflag, COUNT(*) FILTER (WHERE "int.rate" > 0.05) AS high_rate, MIN("int.rate") AS min_rate, '
        'MAX("ext.price") AS max_price FROM dotted_lineitem WHERE "qty.2yrs" > 2 GROUP BY l_returnflag',
    )


@query(
    "guarded_sql",
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem WHERE l_discount > 0.05
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50
    """,
)
def guarded(spark, sf_dir):
    _dotted(spark, sf_dir)
    return guarded_sql(
        spark,
        'SELECT l_orderkey, l_linenumber, "ext.price" AS price FROM dotted_lineitem WHERE "int.rate" > 0.05 '
        'ORDER BY "ext.price" DESC, l_orderkey, l_linenumber -- largest first, no limit of its own',
        row_limit=50,
    )


@query(
    "sorted_nulls_last",
    """
    SELECT c_custkey, max(o_totalprice) AS best FROM customer LEFT JOIN orders
      ON c_custkey = o_custkey AND o_totalprice > 300000
    GROUP BY c_custkey ORDER BY best DESC NULLS LAST, c_custkey
    """,
)
def sorted_nulls_last(spark, sf_dir):
    best = (
        table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
        .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    )
    return (
        table(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey", "left")
        .orderBy(F.col("best").desc_nulls_last(), "c_custkey")
    )


@query(
    "formula_functions",
    """
    SELECT p_partkey, round(p_retailprice * 1.1 + p_size / 4, 3) AS priced,
           coalesce(nullif(p_type, 'PROMO'), 'none') AS kind, CAST(p_size AS VARCHAR) || '-' || p_brand AS label,
           CASE WHEN p_size > 25 THEN p_retailprice - 5 ELSE p_retailprice END AS reduced FROM part
    """,
)
def formula_functions(spark, sf_dir):
    return semantic_view(
        table(spark, sf_dir, "part"),
        [
            ("priced", ["p_retailprice", "p_size"], "ROUND(p_retailprice * 1.1 + p_size / 4, 3)"),
            ("kind", ["p_type"], "COALESCE(NULLIF(p_type, 'PROMO'), 'none')"),
            ("label", ["p_size", "p_brand"], "CAST(p_size AS STRING) || '-' || p_brand"),
            ("reduced", ["p_retailprice"], "CASE WHEN p_size > 25 THEN p_retailprice - 5 ELSE p_retailprice END"),
        ],
        ["p_partkey"],
    )


@query(
    "semantic_view",
    """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS netPrice,
           l_discount AS hasRate, l_quantity * 12 AS yearlyQuantity FROM lineitem
    """,
)
def semantic(spark, sf_dir):
    return semantic_view(
        _dotted(spark, sf_dir),
        [
            ("netPrice", ["ext.price", "int.rate"], "ROUND(ext.price * (1 - int.rate), 4)"),
            ("hasRate", ["int.rate"], None),
            ("yearlyQuantity", ["qty.2yrs"], "qty.2yrs * 12"),
        ],
        ["l_orderkey", "l_linenumber"],
    )


@query(
    "conditional_update",
    """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_acctbal < 0 THEN 'REVIEW' ELSE c_mktsegment END AS c_mktsegment FROM customer
    """,
)
def conditional_update(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return tables.update_rows(rows, {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("REVIEW")}, "c_acctbal < 0")


@query(
    "append_missing_cols",
    """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, NULL FROM supplier
    """,
)
def append_missing_cols(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey")
    )
    return tables.append_rows(table(spark, sf_dir, "customer"), rows)


def _profile_sql(name: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, {i} AS ordinal, '{c}' AS column_name, "
        f"'{t}' AS data_type, count(*) - count({c}) AS null_count, CAST(min({c}) AS VARCHAR) AS min_value, "
        f"CAST(max({c}) AS VARCHAR) AS max_value, count(DISTINCT {c}) AS distinct_count FROM {name}"
        for i, (c, t) in enumerate(columns, 1)
    )


_ORDERS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]
_EVENTS = [
    ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string"),
]


@query("schema_profile", _profile_sql("orders", _ORDERS) + " UNION ALL " + _profile_sql("events", _EVENTS))
def schema_profile(spark, sf_dir):
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    rows = tables.profile(orders, "orders", exact=True).unionByName(tables.profile(events, "events", exact=True))
    return rows.select(
        "table_name", "row_count", "ordinal", "column_name", "data_type", "null_count", "min_value", "max_value", "distinct_count"
    )


@query("schema_sketch")
def schema_sketch(spark, sf_dir):
    return tables.profile(table(spark, sf_dir, "lineitem"), "lineitem")


# Exact figures in SQL; the query compares its estimates with the same figures and tells whether each keeps to its bound.
_SKETCHED = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]


@query(
    "sketch_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS exact_distinct, true AS distinct_within, "
        f"{'NULL' if c in ('l_returnflag', 'l_shipdate') else 'true'} AS median_within FROM lineitem"
        for c in _SKETCHED
    ),
)
def sketch_profile(spark, sf_dir):
    """Sketches of line items by supplier parts, written and merged, with the bounds checked against exact figures."""
    rows = table(spark, sf_dir, "lineitem").select(*_SKETCHED)
    parts = materialize(sketches.sketch_parts(rows, F.pmod(F.col("l_suppkey"), F.lit(8))), "column-sketches")
    found = sketches.estimates(sketches.merged(parts), (0.5,))
    median = F.col("quantile_estimates")[0]
    asked = found.select("column_name", "n", "nulls", "distinct_estimate", median.alias("median"))
    plain = F.lit(None).cast("double")
    values = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"),
                (F.col(c).cast("double") if sketches.is_number(t) else plain).alias("x"),
            )
            for c, t in rows.dtypes
        ]
    )
    # Exact distinct values, and how many numbers lie below and up to the estimated median: one scan, a join with few rows.
    pairs = rows.select(F.explode(values).alias("c")).select("c.*")
    distinct = pairs.select("column_name", "v").distinct().groupBy("column_name").agg(F.count("v").alias("exact_distinct"))
    ranks = pairs.join(F.broadcast(asked.select("column_name", "median")), "column_name").groupBy("column_name").agg(
        F.count("x").alias("numbers"), F.count_if(F.col("x") < F.col("median")).alias("below"), F.count_if(F.col("x") <= F.col("median")).alias("upto")
    )
    joined = asked.join(distinct, "column_name").join(ranks, "column_name")
    slack = F.col("numbers") * F.lit(sketches.RANK_ERROR)
    near = (F.col("below") - slack <= F.col("numbers") / 2) & (F.col("upto") + slack >= F.col("numbers") / 2)
    return joined.select(
        "column_name", "n", "nulls", "exact_distinct",
        (F.abs(F.col("distinct_estimate") - F.col("exact_distinct")) <= F.lit(sketches.HLL_ERROR) * F.col("exact_distinct") + 1).alias("distinct_within"),
        F.when(F.col("median").isNotNull(), near).alias("median_within"),
    )


_REFERENCES = [("o_custkey", "c_custkey"), ("c_custkey", "o_custkey"), ("o_orderkey", "c_custkey"), ("c_nationkey", "o_custkey")]


@query(
    "sketch_references",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS child_column, '{b}' AS parent_column, count(*) AS exact_values, count(*) FILTER (WHERE v IN (SELECT {b} FROM {pb})) AS exact_shared, "
        f"true AS within FROM (SELECT DISTINCT {a} AS v FROM {pa})"
        for (a, b), (pa, pb) in zip(_REFERENCES, [("orders", "customer"), ("customer", "orders"), ("orders", "customer"), ("customer", "orders")])
    ) + ")",
)
def sketch_references(spark, sf_dir):
    """Shares of a column's values that another column has, from theta sketches, with the bounds checked."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    parts = [sketches.sketch_parts(df, F.pmod(F.xxhash64(df.columns[0]), F.lit(4))) for df in (orders, customer)]
    both = [sketches.merged(materialize(p, "column-sketches")) for p in parts]
    every = materialize(both[0].unionByName(both[1]), "merged-sketches")
    wanted = F.lit(False)
    for child, parent in _REFERENCES:
        wanted = wanted | ((F.col("child.column_name") == child) & (F.col("parent.column_name") == parent))
    found = sketches.inclusion(every, every, wanted)

    def distinct_values(df):
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in df.columns])
        return df.select(F.explode(cells).alias("x")).select("x.*").distinct()

    known = materialize(distinct_values(orders).unionByName(distinct_values(customer)), "values")
    exact = found.select("child_column", "parent_column").join(known.withColumnRenamed("c", "child_column"), "child_column")
    parents = known.select(F.col("c").alias("parent_column"), "v", F.lit(1).alias("hit"))
    counted = exact.join(parents, ["parent_column", "v"], "left").groupBy("child_column", "parent_column").agg(
        F.count(F.lit(1)).alias("exact_values"), F.count("hit").alias("exact_shared")
    )
    joined = found.join(counted, ["child_column", "parent_column"])
    slack = F.lit(sketches.THETA_ERROR) * F.greatest("exact_values", F.lit(2**sketches.THETA_BITS))
    near = F.abs(F.col("shared_values") - F.col("exact_shared")) <= slack
    return joined.select("child_column", "parent_column", "exact_values", "exact_shared", near.alias("within"))


@query(
    "key_checks",
    """
    SELECT 'duplicate lineitem key' AS finding, count(*) AS n FROM
      (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'duplicate label key', count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'order without customer', count(*) FROM
      (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
    UNION ALL SELECT 'customer without order', count(*) FROM
      (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
    """,
)
def key_checks(spark, sf_dir):
    lineitem, labels = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "labels")
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    found = {
        "duplicate lineitem key": tables.duplicate_keys(lineitem, ["l_orderkey", "l_linenumber"]),
        "duplicate label key": tables.duplicate_keys(labels, ["doc_id"]),
        "order without customer": tables.missing_references(orders, "o_custkey", customer, "c_custkey"),
        "customer without order": tables.missing_references(customer, "c_custkey", orders, "o_custkey"),
    }
    out = None
    for finding, rows in found.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(finding).alias("finding"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("batch_outcome", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def batch_outcome(spark, sf_dir):
    return runlog.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus")
