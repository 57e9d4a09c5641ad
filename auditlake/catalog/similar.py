"""Reconciliation of misspelt and extended names over parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.concepts import _slug, _word_key
from auditlake.catalog.registry import query, table
from auditlake.functions.text import normalize_name
from auditlake.operators import concepts
from auditlake.operators.similar import EDIT_SHARE, WORD_SHARE
from auditlake.plans.sized import spread_small


def _variant(name, number):
    """Half of the names as they are, the others short of a letter, with a doubled one, or with words added."""
    kind, at = number % 8, (F.floor(number / 8) % F.length(name)).cast("int")
    head, letter, tail = F.substring(name, F.lit(1), at), F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 2, F.lit(1_000))
    return (
        F.when(kind == 4, F.concat(head, tail)).when(kind == 5, F.concat(head, letter, letter, tail))
        .when(kind == 6, F.concat(name, F.lit(" series"))).when(kind == 7, F.concat(name, F.lit(" of record"))).otherwise(name)
    )


def _candidates(spark, sf_dir):
    """Parts and customers in turn, typed by type and segment."""
    part = spread_small(table(spark, sf_dir, "part")).select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("segment_id"), (F.col("p_partkey") * 2).alias("seq"),
        F.concat(F.lit("Part "), "p_type").alias("concept_type"), _variant(F.concat("p_name", F.lit(" grade")), F.col("p_partkey")).alias("concept_name"),
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customer = spread_small(table(spark, sf_dir, "customer")).join(nation, "c_nationkey").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("segment_id"), (F.col("c_custkey") * 2 + 1).alias("seq"),
        F.concat(F.lit("Customer "), "c_mktsegment").alias("concept_type"),
        _variant(F.concat("n_name", F.lit(" customer account")), F.col("c_custkey")).alias("concept_name"),
    )
    return part.unionByName(customer).select(
        "*", F.lit("listed").alias("rationale"), F.concat(F.lit("from "), "segment_id").alias("summary"),
        F.create_map(F.lit("kind"), F.substring("segment_id", 1, 1)).alias("attributes_and_values"),
    )


def _known(spark, sf_dir):
    """Concepts of an earlier run: every other nation among the customers of one segment."""
    names = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(normalize_name(F.concat("n_name", F.lit(" customer account"))).alias("concept_name"))
    return names.select(
        F.lit("Customer BUILDING").alias("concept_type"), F.lit("known").alias("rationale"), "concept_name",
        F.create_map(F.lit("since"), F.lit("before")).alias("attributes_and_values"), F.lit("known").alias("summary"),
    )


def _variant_sql(name: str, number: str) -> str:
    at = f"CAST({number} // 8 % length({name}) AS INTEGER)"
    head, letter, tail = f"substr({name}, 1, {at})", f"substr({name}, {at} + 1, 1)", f"substr({name}, {at} + 2)"
    return (
        f"CASE {number} % 8 WHEN 4 THEN {head} || {tail} WHEN 5 THEN {head} || {letter} || {letter} || {tail} "
        f"WHEN 6 THEN {name} || ' series' WHEN 7 THEN {name} || ' of record' ELSE {name} END"
    )


def _words(name: str) -> str:
    return f"list_distinct(list_filter(string_split({name}, '-'), lambda w: w <> '' AND NOT regexp_matches(w, '[0-9]')))"


def _numbers(name: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split({name}, '-'), lambda w: regexp_matches(w, '[0-9]')))), '-')"


# One name of each type a step: it joins the first similar leader of the list, or is added to it.
_SIMILAR = f"""
    raw AS (SELECT 'p' || p_partkey AS segment_id, p_partkey * 2 AS seq, 'Part ' || p_type AS concept_type,
                   {_variant_sql("(p_name || ' grade')", "p_partkey")} AS concept_name FROM part
            UNION ALL
            SELECT 'c' || c_custkey, c_custkey * 2 + 1, 'Customer ' || c_mktsegment, {_variant_sql("(n_name || ' customer account')", "c_custkey")}
            FROM customer JOIN nation ON c_nationkey = n_nationkey),
    cand AS MATERIALIZED (SELECT *, {_word_key("concept_name")} AS mk FROM raw),
    known AS MATERIALIZED (SELECT 'Customer BUILDING' AS concept_type, {_slug("n_name || ' customer account'")} AS concept_name,
                                  {_word_key("n_name || ' customer account'")} AS mk FROM nation WHERE n_nationkey % 2 = 0),
    nodes AS (SELECT concept_type, mk, min(seq) AS seq, {_slug("arg_min(concept_name, seq)")} AS name FROM cand
              WHERE (concept_type, mk) NOT IN (SELECT (concept_type, mk) FROM known) GROUP BY ALL),
    traits AS MATERIALIZED (SELECT *, {_words("name")} AS words, {_numbers("name")} AS numbers,
                                   row_number() OVER (PARTITION BY concept_type ORDER BY seq) AS step FROM nodes),
    led(concept_type, step, leads, mk, lead) AS (
        SELECT t.concept_type, CAST(0 AS BIGINT), coalesce(k.leads, []), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
        FROM (SELECT DISTINCT concept_type FROM traits) t LEFT JOIN
             (SELECT concept_type, list({{'mk': mk, 'name': concept_name, 'words': {_words("concept_name")}, 'numbers': {_numbers("concept_name")}}} ORDER BY mk)
                     AS leads FROM known GROUP BY 1) k USING (concept_type)
        UNION ALL
        SELECT concept_type, step, CASE WHEN found IS NULL THEN list_append(leads, {{'mk': mk, 'name': name, 'words': words, 'numbers': numbers}}) ELSE leads END,
               mk, coalesce(found, mk)
        FROM (SELECT led.concept_type, t.step, led.leads, t.mk, t.name, t.words, t.numbers,
                     list_filter(led.leads, lambda x: x.numbers = t.numbers AND (
                         (least(len(x.words), len(t.words)) > 0 AND len(list_intersect(x.words, t.words)) = least(len(x.words), len(t.words))
                          AND least(len(x.words), len(t.words)) >= {WORD_SHARE} * greatest(len(x.words), len(t.words)) - 1e-9)
                         OR levenshtein(x.name, t.name) <= floor(greatest(length(x.name), length(t.name)) * {EDIT_SHARE} + 1e-9)))[1].mk AS found
              FROM led JOIN traits t ON t.concept_type = led.concept_type AND t.step = led.step + 1)),
    keyed AS MATERIALIZED (SELECT cand.* EXCLUDE (mk), coalesce(led.lead, cand.mk) AS mk FROM cand LEFT JOIN
        (SELECT concept_type, mk, lead FROM led WHERE mk IS NOT NULL) led ON led.concept_type = cand.concept_type AND led.mk = cand.mk),
    grp AS (SELECT concept_type, mk, min(seq) AS first_seq, {_slug("arg_min(concept_name, seq)")} AS base, arg_max(segment_id, seq) AS last_id,
                   count(*) AS segments FROM keyed GROUP BY 1, 2),
    dec AS (SELECT grp.*, known.concept_name AS known_name FROM grp LEFT JOIN known USING (concept_type, mk)),
    nw AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY first_seq) - 1
                     + CASE WHEN base IN (SELECT concept_name FROM known) THEN 1 ELSE 0 END AS sfx FROM dec WHERE known_name IS NULL),
    named AS (SELECT concept_type, mk, last_id, segments, CASE WHEN sfx = 0 THEN base ELSE base || '-' || sfx END AS concept_name FROM nw
              UNION ALL SELECT concept_type, mk, last_id, segments, known_name FROM dec WHERE known_name IS NOT NULL)
"""


@query(
    "reconcile_similar",
    f"""
    WITH RECURSIVE {_SIMILAR}
    SELECT concept_type, concept_name, 'from ' || last_id AS summary, segments FROM named
    UNION ALL SELECT concept_type, concept_name, 'known', 0 FROM known WHERE concept_name NOT IN (SELECT concept_name FROM named)
    """,
)
def reconcile_similar(spark, sf_dir):
    """Concepts after misspelt and extended names have joined the earliest they resemble, with their segments."""
    found, mapping = concepts.reconcile(_candidates(spark, sf_dir), _known(spark, sf_dir), similar=True)
    counted = mapping.groupBy("concept_name").agg(F.count(F.lit(1)).alias("segments"))
    return found.join(counted, "concept_name", "left").select("concept_type", "concept_name", "summary", F.coalesce("segments", F.lit(0)).alias("segments"))


@query("reconcile_similar_mapping", f"WITH RECURSIVE {_SIMILAR} SELECT segment_id, named.concept_name FROM keyed JOIN named USING (concept_type, mk)")
def reconcile_similar_mapping(spark, sf_dir):
    return concepts.reconcile(_candidates(spark, sf_dir), _known(spark, sf_dir), similar=True)[1]
