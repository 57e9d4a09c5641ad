"""Run logs, budgets, deltas and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.concepts import CONCEPTS, concepts_of, mapping_of
from auditlake.catalog.documents import CHUNKS, COVERED, LINES, SEGMENTS, coverage_of
from auditlake.catalog.registry import query, table
from auditlake.functions.text import lines
from auditlake.operators import concepts, context, jobs, runlog
from auditlake.plans.scan import bucket_of, ordinal
from auditlake.session import materialize

_TURN_LINES = r"""
    d AS (SELECT conv_id, turn, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS a FROM conversations),
    b AS (SELECT conv_id, turn, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM d)
"""


def _turn_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(lines("text")).alias("p", "line"))
    return rows.select("conv_id", "turn", (F.col("p") + 1).cast("bigint").alias("row_no"), "line")


@query(
    "budget_prefix",
    f"""
    WITH RECURSIVE {_TURN_LINES},
    n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS file, turn, a, [len(z) for z in a] AS s FROM b),
    go AS (SELECT DISTINCT conv_id, 0 AS file, CAST(NULL AS BIGINT) AS turn, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS shown FROM n
      UNION ALL
      SELECT go.conv_id, n.file, n.turn,
             CASE WHEN go.used >= 900 THEN go.used ELSE go.used + coalesce(list_max(list_filter(
               [coalesce(list_sum(n.s[1:i]), 0) for i in range(0, len(n.s) + 1)], lambda c: go.used + c <= 900)), 0) END,
             CASE WHEN go.used >= 900 THEN 0 ELSE least(len(n.s), len(list_filter(
               [list_sum(n.s[1:i]) for i in range(1, len(n.s) + 1)], lambda c: go.used + c <= 900)) + 1) END
      FROM go JOIN n ON go.conv_id = n.conv_id AND n.file = go.file + 1)
    SELECT go.conv_id, go.turn, i AS row_no, b.a[i] AS line
    FROM (SELECT *, unnest(range(1, shown + 1)) AS i FROM go WHERE turn IS NOT NULL) go JOIN b ON b.conv_id = go.conv_id AND b.turn = go.turn
    """,
)
def budget_prefix(spark, sf_dir):
    """Each conversation is a run, its turns are the files; 900 characters per run."""
    rows = _turn_lines(spark, sf_dir)
    return context.budget_prefix(rows, "conv_id", "turn", "row_no", F.length("line"), 900)


@query(
    "stream_delta",
    f"""
    WITH RECURSIVE {_TURN_LINES},
    g AS (SELECT conv_id, turn * 100000 + i AS seq, array_to_string(a[1:i], chr(10)) AS text
          FROM (SELECT conv_id, turn, a, unnest(range(1, len(a) + 1)) AS i FROM b)),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS step FROM g WHERE text <> ''),
    go AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS seq, '' AS emitted, '' AS delta FROM n
      UNION ALL
      SELECT go.conv_id, n.step, n.seq, CASE WHEN starts_with(n.text, go.emitted) THEN n.text ELSE go.emitted || n.text END,
             CASE WHEN starts_with(n.text, go.emitted) THEN substr(n.text, len(go.emitted) + 1) ELSE n.text END
      FROM go JOIN n ON go.conv_id = n.conv_id AND n.step = go.step + 1)
    SELECT conv_id AS key, seq, delta FROM go WHERE step > 0 AND delta <> ''
    """,
)
def stream_delta(spark, sf_dir):
    return runlog.text_deltas(snapshots_of(spark, sf_dir), "conv_id", "seq", "text")


def snapshots_of(spark, sf_dir, turns=None):
    """Snapshots of growing turns: the first line, the first two lines, and so on."""
    body = lines("text")
    turns = table(spark, sf_dir, "conversations") if turns is None else turns
    rows = turns.select("conv_id", "turn", body.alias("a")).filter(F.size("a") > 0)
    each = rows.select("conv_id", "turn", "a", F.explode(F.sequence(F.lit(1), F.size("a"))).alias("i"))
    return each.select(
        "conv_id", (F.col("turn") * 100000 + F.col("i")).alias("seq"), F.array_join(F.slice("a", F.lit(1), F.col("i")), "\n").alias("text")
    )


_SCORES = """
    sc AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS iteration,
                  least(100, CAST(floor(value) AS BIGINT)) AS score FROM events)
"""


def _scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return ordinal(rows, ["user_id"], bucket_of("event_id"), ["event_id"], "iteration").select(
        F.col("user_id").alias("run_id"), "iteration", F.least(F.lit(100), F.floor("value")).alias("score")
    )


_DECISIONS = f"""
    {_SCORES}, en AS (SELECT run_id, least(coalesce(min(iteration) FILTER (WHERE score >= 90), 40), 40) AS last FROM sc GROUP BY 1),
    de AS (SELECT sc.run_id, iteration, score, score < 90 AND iteration < 40 AS loop_back FROM sc JOIN en ON sc.run_id = en.run_id AND iteration <= last)
"""


@query("loop_decision", f"WITH {_DECISIONS} SELECT * FROM de")
def loop_decision(spark, sf_dir):
    return runlog.loop_decisions(_scores(spark, sf_dir), 40)


@query("run_outcomes", f"WITH {_DECISIONS} SELECT run_id, max(iteration) AS iterations, arg_max(score, iteration) AS confidence_score FROM de GROUP BY 1")
def run_outcomes(spark, sf_dir):
    return runlog.run_outcomes(runlog.loop_decisions(_scores(spark, sf_dir), 40))


_PLAN = """
    pl AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS iteration, o_orderkey,
                  o_orderstatus, o_orderpriority, o_totalprice FROM orders)
"""


@query(
    "plan_steps",
    f"""
    WITH {_PLAN}
    SELECT run_id, iteration, 1 AS step_no, o_orderstatus AS step FROM pl UNION ALL SELECT run_id, iteration, 2, o_orderpriority FROM pl
    """,
)
def plan_steps(spark, sf_dir):
    plans = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("steps"))
    return runlog.plan_steps(plans, "o_custkey", "o_orderkey", "steps")


@query(
    "audit_report",
    f"""
    WITH {_PLAN}, ev AS (SELECT *, least(100, CAST(floor(o_totalprice / 4500) AS BIGINT)) AS score FROM pl),
    en AS (SELECT run_id, least(coalesce(min(iteration) FILTER (WHERE score >= 90), 10), 10) AS last FROM ev GROUP BY 1),
    he AS (SELECT ev.* FROM ev JOIN en ON ev.run_id = en.run_id AND iteration <= last),
    oc AS (SELECT he.*, c_name FROM he JOIN customer ON run_id = c_custkey QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY iteration DESC) = 1)
    SELECT run_id, 1 AS section, 0 AS iteration, 0 AS step_no, '- **Objective**: ' || c_name AS line FROM oc
    UNION ALL SELECT run_id, 2, 0, 0, '- **Confidence Score**: ' || score || '/100' FROM oc
    UNION ALL SELECT run_id, 3, 0, 0, '- **Total Iterations Completed**: ' || iteration FROM oc
    UNION ALL SELECT run_id, 4, 0, 0, 'priority ' || o_orderpriority FROM oc
    UNION ALL SELECT run_id, 5, 0, 0, 'order ' || o_orderkey FROM oc
    UNION ALL SELECT run_id, 6, iteration, 0, '### Iteration ' || iteration || ' Action Plan' FROM he
    UNION ALL SELECT run_id, 6, iteration, 1, '- **Tool**: `doc_context_retrieval` | **Query**: `order ' || o_orderkey || '` | **Status**: `done`' || chr(10) || '  *Explanation*: ' || o_orderpriority FROM he
    UNION ALL SELECT run_id, 6, iteration, 2, '- **Tool**: `tabular_data_retrieval` | **Query**: `status ' || o_orderstatus || '` | **Status**: `' || o_orderstatus || '`' || chr(10) || '  *Explanation*: check' FROM he
    """,
)
def audit_report(spark, sf_dir):
    """Every customer is a run, every order an iteration of it."""
    orders = materialize(
        ordinal(table(spark, sf_dir, "orders"), ["o_custkey"], bucket_of("o_orderkey"), ["o_orderkey"], "iteration"), "orders"
    )
    key = F.col("o_orderkey").cast("string")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    evaluations = orders.join(customer, "o_custkey").select(
        F.col("o_custkey").alias("run_id"), "iteration",
        F.least(F.lit(100), F.floor(F.col("o_totalprice") / 4500)).alias("score"),
        F.col("c_name").alias("objective"),
        F.concat(F.lit("priority "), "o_orderpriority").alias("explanation"),
        F.concat(F.lit("order "), key).alias("analysis"),
    )

    def step(tool, text, status, why):
        return F.struct(F.lit(tool).alias("tool"), text.alias("query_string"), status.alias("status"), why.alias("explanation"))

    steps = F.array(
        step("doc_context_retrieval", F.concat(F.lit("order "), key), F.lit(None).cast("string"), F.col("o_orderpriority")),
        step("tabular_data_retrieval", F.concat(F.lit("status "), "o_orderstatus"), F.col("o_orderstatus"), F.lit("check")),
    )
    plans = orders.select(F.col("o_custkey").alias("run_id"), "iteration", steps.alias("steps"))
    return jobs.audit_run(evaluations, plans, 10)


@query(
    "coverage_report",
    f"""
    WITH {LINES}, {CHUNKS}, {SEGMENTS}, {COVERED}, {CONCEPTS},
    nn AS (SELECT c.concept_name, c.concept_type, count(m.segment_id) AS z
           FROM concepts c LEFT JOIN mapping m ON c.concept_name = m.concept_name GROUP BY 1, 2),
    ty AS (SELECT concept_type, count(*) AS q, count(*) FILTER (WHERE z > 1) AS r FROM nn GROUP BY 1)
    SELECT 1 AS section, concept_type AS item, concept_type || ': ' || q AS line FROM ty
    UNION ALL SELECT 2, concept_type, concept_type || ': ' || r FROM ty
    UNION ALL SELECT 3, CAST(filename AS VARCHAR), 'File: ' || filename || chr(10) || '  Total Lines: ' || total_lines || chr(10) ||
      '  Lines Covered: ' || lines_covered || chr(10) || printf('  Coverage: %.2f%%', lines_covered / total_lines * 100.0) FROM v JOIN t ON filename = doc_id
    """,
)
def coverage_report(spark, sf_dir):
    by_type = concepts.multi_segment_by_type(concepts_of(spark, sf_dir), mapping_of(spark, sf_dir))
    return runlog.coverage_report(by_type, coverage_of(spark, sf_dir))


@query(
    "append_context",
    """
    SELECT 1 AS iteration, 'benchmark' AS tool, item_id AS query, text AS result FROM benchmark
    UNION ALL SELECT 2, 'documents', doc_id, text FROM documents
    """,
)
def append_context(spark, sf_dir):
    first = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("tool"), F.col("item_id").alias("query"), F.col("text").alias("result"))
    second = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tool"), F.col("doc_id").alias("query"), F.col("text").alias("result"))
    return context.append_context(context.append_context(None, first, 1), second, 2)
