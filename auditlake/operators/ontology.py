"""Ontology classes and their properties from triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import local_name
from auditlake.plans.scan import ordered_parts, range_bucketed
from auditlake.plans.sized import full_buckets, marked, parted, parts_for, salted_join

# Vocabulary terms that describe classes.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
RDFS_DOMAIN = "http://www.w3.org/2000/01/rdf-schema#domain"
RDFS_SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
OWL_CLASS = "http://www.w3.org/2002/07/owl#Class"
OWL_ON_PROPERTY = "http://www.w3.org/2002/07/owl#onProperty"
SKOS_DEFINITION = "http://www.w3.org/2004/02/skos/core#definition"
CMNS_DEFINITION = "https://www.omg.org/spec/Commons/AnnotationVocabulary/definition"


def _parts(triples: DataFrame, *predicates: str) -> int:
    """Partitions for the triples of some predicates, by their number."""
    return parts_for(triples.sparkSession, triples.filter(F.col("predicate").isin(*predicates)).count())


def classes(triples: DataFrame) -> DataFrame:
    """Named classes per source file with label and definition, in one aggregation.

    Blank nodes are left out. Of several values the smallest is taken; without a label
    the local name stands in.
    """
    named = triples.filter(
        F.col("predicate").isin(RDF_TYPE, RDFS_LABEL, SKOS_DEFINITION, CMNS_DEFINITION) & F.startswith("subject", F.lit("http"))
    )

    def value(predicate: str) -> Column:
        return F.nullif(F.min(F.when(F.col("predicate") == predicate, F.col("object"))), F.lit(""))

    is_class = F.bool_or((F.col("predicate") == RDF_TYPE) & (F.col("object") == OWL_CLASS))
    facts = (
        parted(named, parts_for(triples.sparkSession, named.count()), "source_file", "subject")
        .groupBy("source_file", "subject")
        .agg(
            is_class.alias("is_class"),
            value(RDFS_LABEL).alias("label"),
            value(SKOS_DEFINITION).alias("skos"),
            value(CMNS_DEFINITION).alias("cmns"),
        )
    )
    name = local_name("subject")
    return facts.filter("is_class").select(
        "source_file",
        F.col("subject").alias("class_uri"),
        name.alias("class_name"),
        F.coalesce("label", name).alias("label"),
        F.coalesce("skos", "cmns", F.lit("")).alias("definition"),
    )


def class_properties(triples: DataFrame) -> DataFrame:
    """Distinct ``(source_file, class_uri, property)`` from domains and restrictions."""
    domains = triples.filter(F.col("predicate") == RDFS_DOMAIN).select(
        "source_file", F.col("object").alias("class_uri"), local_name("subject").alias("property")
    )
    parents = triples.filter(F.col("predicate") == RDFS_SUBCLASS).select(
        "source_file", F.col("subject").alias("class_uri"), F.col("object").alias("node")
    )
    parts = _parts(triples, RDFS_DOMAIN, RDFS_SUBCLASS, OWL_ON_PROPERTY)
    told = triples.filter(F.col("predicate") == OWL_ON_PROPERTY).select("source_file", F.col("subject").alias("node"), "object")
    found = domains.unionByName(_restricted(parents, told, parts))
    # By class, as what follows asks for the classes; those of very many properties are spread.
    described = domains.select("source_file", "class_uri").unionByName(parents.select("source_file", "class_uri"))
    spread = ["source_file", "class_uri"] if full_buckets(described, ["source_file", "class_uri"]).isEmpty() else found.columns
    return parted(found, parts, *spread).distinct()


def _restricted(parents: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """Properties of the nodes that are parents of a class, the smallest of each node: ``source_file, class_uri, property``."""
    node = ["source_file", "node"]
    if not full_buckets(parents, node).isEmpty():
        # A much-used node is salted.
        limits = parted(told, parts, *node).groupBy(*node).agg(F.min("object").alias("on_property"))
        joined = salted_join(parents, limits, node, "inner", parts=parts)
    else:
        # Both meet in one shuffle; the hash that is made after it spares the sort the long names.
        none = F.lit(None).cast("string")
        both = parents.withColumns({"object": none, "_parent": F.lit(True)}).unionByName(told.withColumns({"class_uri": none, "_parent": F.lit(False)}))
        met = marked(parted(both.filter("source_file IS NOT NULL AND node IS NOT NULL"), parts, *node), node)
        least = F.min("object").over(Window.partitionBy("_mark", *node))
        joined = met.withColumn("on_property", least).filter("_parent AND on_property IS NOT NULL")
    return joined.select("source_file", "class_uri", local_name("on_property").alias("property"))


def class_records(triples: DataFrame, part_size: int = 1_000) -> DataFrame:
    """Class records with sorted property lists; very long lists come in numbered parts."""
    keys = ["source_file", "class_uri"]
    parts = _parts(triples, RDFS_DOMAIN, RDFS_SUBCLASS)
    listed = ordered_parts(
        range_bucketed(class_properties(triples), keys, ["property"], "_range", parts),
        keys,
        F.col("_range"),
        ["property"],
        ["property"],
        "_items",
        part_size,
        parts,
    ).select("source_file", "class_uri", "part_no", F.transform("_items", lambda i: i["property"]).alias("properties"))
    return parted(classes(triples), parts, *keys).join(parted(listed, parts, *keys), keys, "left").select(
        "class_name",
        "class_uri",
        "label",
        "definition",
        "source_file",
        F.coalesce("part_no", F.lit(0)).cast("bigint").alias("part_no"),
        F.coalesce("properties", F.array().cast("array<string>")).alias("properties"),
    )


def concept_type_lines(records: DataFrame) -> DataFrame:
    """Listing line per class: type and description."""
    return records.select(
        "source_file",
        "class_uri",
        F.format_string(
            "- Concept Type: %s\n  Description: %s",
            "class_name",
            F.coalesce(F.nullif("definition", F.lit("")), F.col("label"), F.lit("")),
        ).alias("line"),
    )


def unprocessed(found: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed; each processed key counts once."""
    return found.join(processed.select(key).distinct(), key, "left_anti")
