"""Whole jobs put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import line_count
from auditlake.operators import concepts as C
from auditlake.operators import documents as D
from auditlake.operators import intervals as I
from auditlake.operators import mapping as M
from auditlake.operators import ontology as O
from auditlake.operators import ranking as R
from auditlake.operators import runlog as L
from auditlake.operators.context import budget_prefix
from auditlake.operators.cover import cover_match
from auditlake.operators.cube import CubeSpec, data_cube
from auditlake.plans.scan import bucket_of, prior, range_bucketed
from auditlake.session import materialize, settled
from auditlake.sources.sinks import Store


def create_mapping(triples: DataFrame, columns: DataFrame, store: Store, base: str = "/", combine: bool = False) -> DataFrame:
    """Map the attributes of classes not processed yet, store them, return the export lines.

    ``columns``: file, ordinal, column_name. With ``combine``, an attribute may be made of several
    columns of one file, or of one of another period, by a formula (:mod:`auditlake.operators.cover`);
    a boolean column ``number`` then tells which columns may be added up.
    """
    store.create()
    found = O.unprocessed(O.classes(triples), store.read("processed_classes"), "class_uri")
    # A class described in several files is mapped once, from the first of them.
    once = settled(
        found.groupBy("class_uri").agg(F.min_by(F.struct("class_name", "source_file"), "source_file").alias("c")).select("class_uri", "c.*"),
        "classes",
    )
    attributes = settled(
        O.class_properties(triples).join(once, ["source_file", "class_uri"]).select(
            "class_name", "class_uri", F.col("source_file").alias("source_ttl_file"), F.col("property").alias("attribute_name")
        ),
        "attributes",
    )
    if combine:
        number = "number" if "number" in columns.columns else None
        found = cover_match(attributes, "attribute_name", columns, "column_name", "file", number).drop("similarity")
        store.save_classes(once, materialize(found, "matches"))
        return mapping_report(store, columns, base)
    # Read by several steps, however it is made.
    columns = materialize(columns.select("column_name").distinct(), "columns")
    matched = M.schema_match(attributes, "attribute_name", columns, "column_name")
    rows = matched.select(
        *attributes.columns,
        F.when(F.col("mapped_column").isNull(), F.array().cast("array<string>")).otherwise(F.array("mapped_column")).alias("mapped_columns"),
        F.lit(None).cast("string").alias("sql_formula"),
        "not_enough_information",
        F.concat(F.lit("name similarity "), F.coalesce("similarity", F.lit(0.0)).cast("decimal(5,4)").cast("string")).alias("explanation"),
    )
    store.save_classes(once, rows)
    return mapping_report(store, columns, base)


def mapping_report(store: Store, columns: DataFrame, base: str = "/") -> DataFrame:
    """Export lines of the stored mappings."""
    return M.mapping_export(store.mapped(), "created_at", columns, base)


def _is_number(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint")


def ingest_documents(
    docs: DataFrame, classes: DataFrame, name: str, class_text: list[str], store: Store, chunk_size: int = 100, max_lines: int = 10
) -> DataFrame:
    """Documents (``filename``, a name or number, and ``text``) to segments, concepts and their mapping; returns the report.

    Concepts of earlier runs stay and are matched first. Arrival order is that of the
    file names, by number where they are numbers, then of the places in a document. All tables
    become visible together, once every mapped concept is known to exist; until then, and after a
    failure, readers see those of the run before.
    """
    with store.transaction() as save:
        save.create()
        totals = docs.select("filename", line_count("text").cast("bigint").alias("total_lines"))
        save.rebuild(
            "file_line_sequence", D.chunk_ranges(totals, "filename", "total_lines", chunk_size)
        )
        cut = D.segments(docs, "filename", "text", chunk_size, max_lines)
        save.rebuild("text_segments", cut)
        segments = save.read("text_segments")
        typed = C.classify(segments, "segment_id", "segment_text", classes, name, class_text)
        # Only titles travel from here. Documents are counted and their counts added up in order; places are numbered in each.
        slim = segments.select(
            "segment_id",
            "filename",
            F.trim(F.substring_index("segment_text", "\n", 1)).alias("title"),
            *[F.regexp_extract("segment_id", r"-([0-9]+)-([0-9]+)$", i).cast("bigint").alias(c) for i, c in ((1, "_chunk"), (2, "_seg"))],
        )
        order = F.col("filename").cast("bigint") if _is_number(docs, "filename") else F.col("filename")
        sizes = slim.groupBy("filename").agg(F.count(F.lit(1)).alias("_n")).select("filename", "_n", order.alias("_order"), F.lit(0).alias("_all"))
        sizes = range_bucketed(sizes, ["_all"], ["_order"], "_bucket")
        offsets = prior(sizes, ["_all"], F.col("_bucket"), ["_order"], F.sum, F.col("_n"), "_before").select("filename", "_before")
        inside = F.row_number().over(Window.partitionBy("filename").orderBy("_chunk", "_seg"))
        ordered = slim.withColumn("_place", inside).join(offsets, "filename")
        candidates = ordered.join(typed, "segment_id").select(
            "segment_id",
            (F.coalesce("_before", F.lit(0)) + F.col("_place")).cast("bigint").alias("seq"),
            "concept_type",
            F.col("title").alias("concept_name"),
            F.format_string("token weight %.4f", "score").alias("rationale"),
            F.col("title").alias("summary"),
            F.create_map(F.lit("filename"), F.col("filename")).alias("attributes_and_values"),
        )
        merged, mapping = C.reconcile(candidates, save.read("concepts"))
        merged = materialize(merged, "concepts")
        save.rebuild("concept_segment_mapping", mapping)
        save.rebuild("concepts", merged)
        known, mapped = save.read("concepts"), save.read("concept_segment_mapping")
        C.verify_mapping(known, mapped)
    coverage = I.line_coverage(segments, totals.withColumn("filename", F.col("filename").cast("string")), "filename", "total_lines")
    return L.coverage_report(C.multi_segment_by_type(known, mapped), coverage)


def document_context(
    sub_queries: DataFrame, concepts: DataFrame, mapping: DataFrame, segments: DataFrame, top_n: int = 100
) -> DataFrame:
    """Concept texts per sub-query (``query_id, concept_type, sub_query_string``).

    Candidates are the concepts of the type, cut to ``top_n`` by BM25 where there are more.
    """
    corpus = concepts.select(
        F.lower("concept_type").alias("corpus"),
        "concept_name",
        F.concat(F.lit("Name: "), "concept_name", F.lit(" | Summary: "), "summary").alias("listing"),
    )
    asked = sub_queries.withColumn("corpus", F.lower("concept_type"))
    chosen = materialize(
        R.threshold_rerank(corpus, "corpus", "concept_name", "listing", asked, "query_id", "sub_query_string", "corpus", top_n)
        .select("query_id", F.col("pos").alias("concept_name"), "rank"),
        "chosen",
    )
    sources = C.source_segments(mapping, segments, chosen)
    if _is_number(segments, "filename"):
        bucket, order = bucket_of("filename"), "filename"
    else:
        sources = range_bucketed(sources, ["concept_name"], ["filename"], "_place")
        bucket, order = F.col("_place"), "filename"
    texts = C.concept_text(sources, bucket, [order, "segment_start_line_no_global", "segment_id"])
    return chosen.join(texts, "concept_name").select("query_id", "rank", "concept_name", "part_no", "segment_text")


def tabular_context(df: DataFrame, cubes: list[CubeSpec], limit: int) -> DataFrame:
    """Results of several cubes as comma-joined rows within a budget of characters: ``file_no, row_no, line``.

    Every cube is capped and sorted, so numbering its rows is one small sort.
    """
    out = None
    for number, spec in enumerate(cubes, 1):
        if spec.row_limit is None or not spec.sort_order:
            raise ValueError("a cube for a context needs a row limit and a sort order")
        result = data_cube(df, spec)
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in result.columns]
        order = [F.col(f"`{c}`").desc_nulls_last() if down else F.col(f"`{c}`").asc_nulls_last() for c, down in spec.sort_order]
        rows = result.select(
            F.lit(0).cast("bigint").alias("run"),
            F.lit(number).cast("bigint").alias("file_no"),
            F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("row_no"),
            F.concat_ws(",", *cells).alias("line"),
        )
        out = rows if out is None else out.unionByName(rows)
    return budget_prefix(out, "run", "file_no", "row_no", F.length("line"), limit).drop("run")


def audit_run(evaluations: DataFrame, plans: DataFrame, max_iterations: int = 10) -> DataFrame:
    """Report lines of finished runs from their evaluations and plans.

    ``evaluations``: run_id, iteration, score, objective, explanation, analysis;
    ``plans``: run_id, iteration, steps.
    """
    held = L.loop_decisions(evaluations.select("run_id", "iteration", "score"), max_iterations)
    ends = L.run_outcomes(held)
    last = ends.join(
        evaluations.select("run_id", F.col("iteration").alias("iterations"), "objective", "explanation", "analysis"),
        ["run_id", "iterations"],
    )
    used = plans.join(held.select("run_id", "iteration"), ["run_id", "iteration"], "left_semi")
    return L.audit_report(last, L.plan_steps(used, "run_id", "iteration", "steps"))
