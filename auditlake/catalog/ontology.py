"""Ontology classes from triples: parts are classes, suppliers and line items give properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.registry import query, table
from auditlake.operators import ontology
from auditlake.operators.ontology import (
    CMNS_DEFINITION, OWL_CLASS, OWL_ON_PROPERTY, RDF_TYPE, RDFS_DOMAIN, RDFS_LABEL, RDFS_SUBCLASS, SKOS_DEFINITION,
)
from auditlake.plans.sized import lookup_join, parts_for, spread_small
from auditlake.session import settled
from auditlake.sources.text import parse_triples

BASE = "http://data.example.org"


def _class():
    return F.concat(F.lit(f"{BASE}/parts#P"), F.col("p_partkey").cast("string"))


def triples_of(spark, sf_dir):
    """One file per part type. Every part is a class; some have only one kind of definition, some none.

    A supplier's property has the parts it delivers as domain; a line item restricts its
    part by a property named after its flags.
    """
    part = table(spark, sf_dir, "part").withColumn("file", F.concat(F.lit("onto/"), F.lower("p_type"), F.lit(".ttl")))
    about = F.array(
        F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(OWL_CLASS).alias("o"), F.lit(True).alias("i")),
        F.struct(F.lit(RDFS_LABEL).alias("p"), F.when(F.col("p_size") > 5, F.col("p_name")).alias("o"), F.lit(False).alias("i")),
        F.struct(F.lit(SKOS_DEFINITION).alias("p"), F.when(F.col("p_size") > 30, F.concat(F.lit('A "'), "p_name", F.lit('" by '), "p_brand")).alias("o"), F.lit(False).alias("i")),
        F.struct(F.lit(CMNS_DEFINITION).alias("p"), F.when(F.col("p_size") > 15, F.concat(F.lit("Part of "), "p_brand")).alias("o"), F.lit(False).alias("i")),
    )
    facts = part.select("file", _class().alias("s"), F.explode(about).alias("t")).select("file", "s", "t.*").filter("o IS NOT NULL")
    delivered = table(spark, sf_dir, "lineitem")
    items = lookup_join(
        spread_small(delivered).withColumn("p_partkey", F.col("l_partkey")), part.select("p_partkey", "file"), ["p_partkey"],
        parts=parts_for(spark, delivered.count()),
    )
    key = F.concat_ws("x", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], "l_returnflag", "l_linestatus")
    # Names are put together once for the four triples of an item.
    named = items.select(
        "file",
        _class().alias("class"),
        F.concat(F.lit("_:r"), key).alias("node"),
        F.concat(F.lit(f"{BASE}/supply/deliveredBy"), F.col("l_suppkey").cast("string")).alias("supplier"),
        F.concat(F.lit(f"{BASE}/flags#has"), "l_returnflag", "l_linestatus").alias("flag"),
    )
    told = [
        ("supplier", RDFS_DOMAIN, F.col("class"), True), ("class", RDFS_SUBCLASS, F.col("node"), False),
        ("node", OWL_ON_PROPERTY, F.col("flag"), True), ("node", RDF_TYPE, F.lit(OWL_CLASS), True),
    ]
    four = F.array(*[F.struct(F.col(s).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(i).alias("i")) for s, p, o, i in told])
    delivered = named.select("file", F.explode(four).alias("t")).select("file", "t.*")
    triples = facts.unionByName(delivered).select(
        F.col("file").alias("source_file"), F.col("s").alias("subject"), F.col("p").alias("predicate"),
        F.col("o").alias("object"), F.col("i").alias("is_iri"),
    )
    # Triples are a table of their own, read several times by predicate.
    return settled(triples, "triples")


_CLASSES = f"""
    cls AS (SELECT 'onto/' || lower(p_type) || '.ttl' AS source_file, '{BASE}/parts#P' || p_partkey AS class_uri, 'P' || p_partkey AS class_name,
            CASE WHEN p_size > 5 THEN p_name ELSE 'P' || p_partkey END AS label,
            CASE WHEN p_size > 30 THEN 'A "' || p_name || '" by ' || p_brand WHEN p_size > 15 THEN 'Part of ' || p_brand ELSE '' END AS definition,
            p_partkey FROM part),
    prop AS (SELECT l_partkey AS p_partkey, 'deliveredBy' || l_suppkey AS property FROM lineitem
             UNION SELECT l_partkey, 'has' || l_returnflag || l_linestatus FROM lineitem)
"""


@query(
    "ontology_classes",
    f"""
    WITH {_CLASSES}, o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY property) - 1 AS pos FROM prop),
    g AS (SELECT p_partkey, pos // 25 AS part_no, string_agg(property, ', ' ORDER BY property) AS properties FROM o GROUP BY 1, 2)
    SELECT class_name, class_uri, label, definition, source_file, coalesce(part_no, 0) AS part_no, coalesce(properties, '') AS properties
    FROM cls LEFT JOIN g USING (p_partkey)
    """,
)
def ontology_classes(spark, sf_dir):
    records = ontology.class_records(triples_of(spark, sf_dir), part_size=25)
    return records.withColumn("properties", F.array_join("properties", ", "))


@query(
    "class_properties",
    f"WITH {_CLASSES} SELECT source_file, class_uri, property FROM cls JOIN prop USING (p_partkey)",
)
def class_properties(spark, sf_dir):
    return ontology.class_properties(triples_of(spark, sf_dir))


@query(
    "ntriples_parse",
    f"""
    WITH {_CLASSES}
    SELECT source_file, class_uri AS subject, '{RDFS_LABEL}' AS predicate, 'line' || chr(10) || 'tab' || chr(9) || label || '\\"' AS object, false AS is_iri FROM cls
    UNION ALL SELECT source_file, class_uri, '{RDF_TYPE}', '{OWL_CLASS}', true FROM cls
    UNION ALL SELECT source_file, '_:b' || p_partkey, '{RDFS_SUBCLASS}', class_uri, true FROM cls
    """,
)
def ntriples_parse(spark, sf_dir):
    """Classes written as N-Triples text, with escapes, comments and blank nodes, and read back."""
    kinds = ontology.classes(triples_of(spark, sf_dir))
    iri = F.concat(F.lit("<"), "class_uri", F.lit(">"))
    text = F.array(
        F.concat(iri, F.lit(f' <{RDFS_LABEL}> "line\\ntab\\t'), "label", F.lit('\\\\\\""@en .')),
        F.concat(F.lit("  "), iri, F.lit(f" <{RDF_TYPE}> <{OWL_CLASS}>.")),
        F.concat(F.lit("_:b"), F.substring("class_name", 2, 20), F.lit(f" <{RDFS_SUBCLASS}> "), iri, F.lit(" .")),
        F.lit("# a comment"),
        F.lit(""),
    )
    lines = kinds.select("source_file", F.explode(text).alias("line"))
    return parse_triples(lines, "source_file", "line")


@query(
    "concept_type_listing",
    f"""
    WITH {_CLASSES} SELECT source_file, class_uri, '- Concept Type: ' || class_name || chr(10) || '  Description: ' ||
      coalesce(nullif(definition, ''), label) AS line FROM cls
    """,
)
def concept_type_listing(spark, sf_dir):
    return ontology.concept_type_lines(ontology.classes(triples_of(spark, sf_dir)))


@query("resume_antijoin", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf_dir):
    return ontology.unprocessed(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")
