"""Concepts over customers (concepts) and their orders (segments)."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.documents import CHUNKS, LINES, SEGMENTS, segments_of
from auditlake.catalog.registry import query, table
from auditlake.functions.text import normalize_name
from auditlake.operators import concepts, context, naming
from auditlake.plans.scan import bucket_of
from auditlake.plans.sized import lookup_join

# Customers are concepts; every order is a segment that mentions its customer.
CONCEPTS = """
    concepts AS (SELECT 'cust-' || c_custkey AS concept_name, c_mktsegment AS concept_type, c_name || ' nation ' || c_nationkey AS summary
                 FROM customer),
    mapping AS (SELECT CAST(o_orderkey AS VARCHAR) AS segment_id, 'cust-' || o_custkey AS concept_name FROM orders),
    segs AS (SELECT CAST(o_orderkey AS VARCHAR) AS segment_id, o_orderkey AS filename,
                    o_orderstatus || ' ' || o_orderpriority || ' order ' || o_orderkey AS segment_text FROM orders)
"""


def concepts_of(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("concept_name"),
        F.col("c_mktsegment").alias("concept_type"),
        F.concat_ws(" ", "c_name", F.lit("nation"), F.col("c_nationkey").cast("string")).alias("summary"),
    )


def mapping_of(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("segment_id"),
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("concept_name"),
    )


def segments_of_orders(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        key.alias("segment_id"),
        F.col("o_orderkey").alias("filename"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority", F.lit("order"), key).alias("segment_text"),
    )


@query("concepts_by_type", f"WITH {CONCEPTS} SELECT concept_type, count(*) AS concept_count FROM concepts GROUP BY 1 ORDER BY 1")
def concepts_by_type(spark, sf_dir):
    return concepts.count_by_type(concepts_of(spark, sf_dir)).orderBy("concept_type")


@query(
    "concept_segment_counts",
    f"""
    WITH {CONCEPTS}, used AS (SELECT concept_name, count(*) AS segment_count FROM mapping GROUP BY ALL)
    SELECT concept_name, concept_type, segment_count FROM used JOIN concepts USING (concept_name)
    """,
)
def concept_segment_counts(spark, sf_dir):
    return concepts.segment_counts(concepts_of(spark, sf_dir), mapping_of(spark, sf_dir))


@query(
    "multi_segment_concepts",
    f"""
    WITH {CONCEPTS}, often AS (SELECT concept_name FROM mapping GROUP BY ALL HAVING max(segment_id) <> min(segment_id))
    SELECT concept_type, count(*) AS concept_count, CAST(sum(CAST(concept_name IN (FROM often) AS INT)) AS BIGINT) AS multi_segment_count
    FROM concepts GROUP BY ALL
    """,
)
def multi_segment_concepts(spark, sf_dir):
    return concepts.multi_segment_by_type(concepts_of(spark, sf_dir), mapping_of(spark, sf_dir))


@query(
    "orphan_concepts",
    f"""
    WITH {CONCEPTS} SELECT concept_name FROM mapping
    EXCEPT SELECT 'cust-' || c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'
    """,
)
def orphan_concepts(spark, sf_dir):
    """Names in the mapping that a store without one type of concepts lacks."""
    stored = concepts_of(spark, sf_dir).filter("concept_type <> 'BUILDING'")
    return concepts.orphan_names(stored, mapping_of(spark, sf_dir))


_SELECTED = "SELECT concept_name FROM concepts WHERE concept_type IN ('MACHINERY', 'FURNITURE')"


@query(
    "concept_sources",
    f"""
    WITH {CONCEPTS} SELECT m.concept_name, s.segment_id, s.segment_text FROM mapping m JOIN segs s ON m.segment_id = s.segment_id
    WHERE m.concept_name IN ({_SELECTED})
    """,
)
def concept_sources(spark, sf_dir):
    selected = concepts_of(spark, sf_dir).filter(F.col("concept_type").isin("MACHINERY", "FURNITURE"))
    rows = concepts.source_segments(mapping_of(spark, sf_dir), segments_of_orders(spark, sf_dir), selected)
    return rows.select("concept_name", "segment_id", "segment_text")


@query(
    "concept_text",
    f"""
    WITH {CONCEPTS}, o AS (SELECT m.concept_name, s.*, row_number() OVER (PARTITION BY m.concept_name ORDER BY filename) - 1 AS pos
      FROM mapping m JOIN segs s ON m.segment_id = s.segment_id)
    SELECT concept_name, pos // 16 AS part_no, count(*) AS segments,
           string_agg(segment_text, chr(10) || '---' || chr(10) ORDER BY pos) AS segment_text FROM o GROUP BY 1, 2
    """,
)
def concept_text(spark, sf_dir):
    sources = concepts.source_segments(mapping_of(spark, sf_dir), segments_of_orders(spark, sf_dir))
    return concepts.concept_text(sources, bucket_of("filename"), ["filename"], part_size=16)


@query(
    "latest_update",
    """
    SELECT o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1
    """,
)
def latest_update(spark, sf_dir):
    columns = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
    return concepts.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", columns)


@query(
    "merged_attributes",
    """
    SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, 'low') AS priority,
           CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'none' END AS chosen FROM orders
    """,
)
def merged_attributes(spark, sf_dir):
    status = F.col("o_orderstatus")
    old = F.create_map(F.lit("priority"), F.lit("low"), F.lit("status"), status)
    new = F.when(status == "F", F.create_map(F.lit("priority"), F.col("o_orderpriority"))).otherwise(
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    )
    merged = F.map_filter(F.create_map(F.lit("status"), status), lambda _, v: v != "P")
    candidate = F.create_map(F.lit("status"), F.lit("none"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        concepts.merged_maps(old, new)["priority"].alias("priority"),
        concepts.merged_or_candidate(merged, candidate)["status"].alias("chosen"),
    )


def _slug(expr: str) -> str:
    return (
        "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(replace(lower(" + expr + "), '&', 'and'), "
        "'[^a-z0-9\\s\\-]', '', 'g'), '[\\s\\-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'concept')"
    )


@query(
    "unique_names",
    f"""
    WITH RECURSIVE a AS (
      SELECT p_partkey AS seq, {_slug("CASE WHEN p_type = 'SMALL' THEN p_name || ' ' || p_size ELSE p_name END")} AS base FROM part),
    e AS (SELECT DISTINCT {_slug("p_name || ' ' || (p_size // 5)")} AS name FROM part WHERE p_brand = 'Brand#7'),
    fam AS (SELECT *, regexp_replace(base, '(-[0-9]+)+$', '') AS root FROM a),
    k AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY seq) AS step FROM fam),
    r0 AS (SELECT root, coalesce(list(name) FILTER (WHERE name IS NOT NULL), []) AS used FROM
             (SELECT DISTINCT root FROM fam) f LEFT JOIN e ON regexp_replace(e.name, '(-[0-9]+)+$', '') = f.root GROUP BY 1),
    go AS (
      SELECT root, 0 AS step, used, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS concept_name FROM r0
      UNION ALL
      SELECT root, step, list_append(used, pick), seq, pick FROM (
        SELECT go.root, k.step, go.used, k.seq,
               list_filter([CASE WHEN i = 0 THEN k.base ELSE k.base || '-' || i END for i in range(0, len(go.used) + 1)],
                           lambda c: NOT list_contains(go.used, c))[1] AS pick
        FROM go JOIN k ON go.root = k.root AND k.step = go.step + 1))
    SELECT seq, concept_name FROM go WHERE seq IS NOT NULL
    """,
)
def unique_names(spark, sf_dir):
    """Part names as concept names; small parts carry a number of their own that may collide."""
    part = table(spark, sf_dir, "part")
    sized = F.when(F.col("p_type") == "SMALL", F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    arrivals = part.select(F.col("p_partkey").alias("seq"), normalize_name(sized).alias("base"))
    group = F.floor(F.col("p_size") / 5).cast("string")
    existing = part.filter("p_brand = 'Brand#7'").select(normalize_name(F.concat_ws(" ", "p_name", group)).alias("concept_name"))
    return naming.unique_names(arrivals, "seq", "base", existing).select("seq", "concept_name")


# Benchmark items are the classes; tokens weigh ln(classes / classes with the token).
CLASSIFY = r"""
    cl AS (SELECT 'item-' || item_id AS concept_type, text AS definition FROM benchmark),
    ct AS (SELECT DISTINCT concept_type, unnest(regexp_extract_all(lower(definition), '[\p{L}\p{N}_]+')) AS token FROM cl),
    cw AS (SELECT concept_type, token, ln((SELECT count(*) FROM cl) / df) AS weight
           FROM ct JOIN (SELECT token, count(*) AS df FROM ct GROUP BY 1) USING (token) WHERE df < (SELECT count(*) FROM cl)),
    sw AS (SELECT DISTINCT segment_id, unnest(regexp_extract_all(lower(segment_text), '[\p{L}\p{N}_]+')) AS token FROM s),
    ss AS (SELECT segment_id, concept_type, round(sum(weight), 9) AS score FROM sw JOIN cw USING (token) GROUP BY 1, 2),
    sb AS (SELECT * FROM ss QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, concept_type) = 1),
    sk AS (SELECT s.segment_id, coalesce(concept_type, (SELECT min(concept_type) FROM cl)) AS concept_type,
                  coalesce(score, 0) AS score FROM s LEFT JOIN sb ON s.segment_id = sb.segment_id)
"""


def classes_of(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("concept_type"), F.col("text").alias("definition")
    )


@query(
    "classify_segments",
    f"WITH {LINES}, {CHUNKS}, {SEGMENTS}, {CLASSIFY} SELECT segment_id, concept_type, score FROM sk",
)
def classify_segments(spark, sf_dir):
    return concepts.classify(
        segments_of(spark, sf_dir), "segment_id", "segment_text", classes_of(spark, sf_dir), "concept_type", ["definition"]
    )


def _candidates(spark, sf_dir):
    """Orders as candidates: type from the status, name from nation, segment and priority in two word orders."""
    customer = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_custkey").alias("o_custkey"), "n_name", "c_mktsegment")
    rows = lookup_join(table(spark, sf_dir, "orders"), customer, ["o_custkey"])
    words = ["n_name", "c_mktsegment", "o_orderpriority"]
    name = F.when(F.col("o_totalprice") > 250000, F.concat_ws(" ", *words)).otherwise(F.concat_ws(" & ", *words[::-1]))
    price = F.floor(F.col("o_totalprice") / 1000).cast("string")
    some = F.map_filter(F.create_map(F.lit("price"), price), lambda _, v: F.col("o_totalprice") > 100000)
    key = F.col("o_orderkey").cast("string")
    return rows.select(
        key.alias("segment_id"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("Status"), "o_orderstatus").alias("concept_type"),
        F.replace(name, F.lit(" & "), F.lit(" ")).alias("concept_name"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("rationale"),
        F.concat(F.lit("order "), key).alias("summary"),
        some.alias("attributes_and_values"),
    )


def _known(spark, sf_dir):
    """Concepts of an earlier run: finished urgent orders by nation and segment."""
    names = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(normalize_name(F.concat_ws(" ", "n_name", "c_mktsegment", F.lit("1-URGENT"))).alias("concept_name")).distinct()
    return names.select(
        F.lit("StatusF").alias("concept_type"), F.lit("known").alias("rationale"), "concept_name",
        F.create_map(F.lit("price"), F.lit("0")).alias("attributes_and_values"), F.lit("known").alias("summary"),
    )


def _word_key(expr: str) -> str:
    return f"array_to_string(list_sort(list_distinct(string_split({_slug(expr)}, '-'))), '-')"


_RECONCILE = f"""
    cand AS (SELECT CAST(o_orderkey AS VARCHAR) AS segment_id, o_orderkey AS seq, 'Status' || o_orderstatus AS concept_type,
                    CASE WHEN o_totalprice > 250000 THEN n_name || ' ' || c_mktsegment || ' ' || o_orderpriority
                         ELSE o_orderpriority || ' ' || c_mktsegment || ' ' || n_name END AS concept_name,
                    'customer ' || o_custkey AS rationale, 'order ' || o_orderkey AS summary,
                    CASE WHEN o_totalprice > 100000 THEN CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) END AS price,
                    {_word_key("n_name || ' ' || c_mktsegment || ' ' || o_orderpriority")} AS mk
             FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    known AS (SELECT DISTINCT 'StatusF' AS concept_type, {_slug("n_name || ' ' || c_mktsegment || ' 1-URGENT'")} AS concept_name,
                     {_word_key("n_name || ' ' || c_mktsegment || ' 1-URGENT'")} AS mk
              FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000),
    grp AS (SELECT concept_type, mk, min(seq) AS first_seq, arg_min(concept_name, seq) AS first_name,
                   arg_max(rationale, seq) AS rationale, arg_max(summary, seq) AS summary,
                   arg_max(price, seq) FILTER (WHERE price IS NOT NULL) AS price FROM cand GROUP BY 1, 2),
    kn AS (SELECT concept_type, mk, min(concept_name) AS known_name FROM known GROUP BY 1, 2),
    dec AS (SELECT grp.*, known_name, {_slug("first_name")} AS base FROM grp LEFT JOIN kn USING (concept_type, mk)),
    nw AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY first_seq) - 1
                     + CASE WHEN base IN (SELECT concept_name FROM known) THEN 1 ELSE 0 END AS sfx FROM dec WHERE known_name IS NULL),
    named AS (SELECT concept_type, mk, rationale, summary, price, CASE WHEN sfx = 0 THEN base ELSE base || '-' || sfx END AS concept_name FROM nw
              UNION ALL SELECT concept_type, mk, rationale, summary, coalesce(price, '0'), known_name FROM dec WHERE known_name IS NOT NULL)
"""


@query(
    "reconcile_concepts",
    f"""
    WITH {_RECONCILE}
    SELECT concept_type, rationale, concept_name, price, summary FROM named
    UNION ALL SELECT concept_type, 'known', concept_name, '0', 'known' FROM known WHERE concept_name NOT IN (SELECT concept_name FROM named)
    """,
)
def reconcile_concepts(spark, sf_dir):
    merged, _ = concepts.reconcile(_candidates(spark, sf_dir), _known(spark, sf_dir))
    price = F.col("attributes_and_values")["price"].alias("price")
    return merged.select("concept_type", "rationale", "concept_name", price, "summary")


@query(
    "reconcile_mapping",
    f"WITH {_RECONCILE} SELECT segment_id, named.concept_name FROM cand JOIN named USING (concept_type, mk)",
)
def reconcile_mapping(spark, sf_dir):
    return concepts.reconcile(_candidates(spark, sf_dir), _known(spark, sf_dir))[1]


@query(
    "concept_listing",
    f"""
    WITH {CONCEPTS} SELECT concept_name, '- Concept: ' || concept_name || ' (Type: ' || concept_type || ') - Summary: ' || summary AS line
    FROM concepts
    """,
)
def concept_listing(spark, sf_dir):
    return context.concept_listing(concepts_of(spark, sf_dir))
