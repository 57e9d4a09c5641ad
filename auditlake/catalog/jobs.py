"""Sources, sinks, streams and whole jobs, run over the given tables through the shared folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.catalog.concepts import CLASSIFY, CONCEPTS, classes_of, concepts_of, mapping_of, segments_of_orders
from auditlake.catalog.documents import CHUNKS, LINES, SEGMENTS
from auditlake.catalog.ontology import _CLASSES, triples_of
from auditlake.catalog.ranking import SCORES
from auditlake.catalog.registry import ORACLES, query, table
from auditlake.catalog.runs import snapshots_of
from auditlake.functions.text import tokens
from auditlake.operators import context, jobs
from auditlake.operators.cube import CubeSpec, Measure
from auditlake.operators.decide import decided_records
from auditlake.session import fresh_path
from auditlake.sources.csv import csv_columns, load_csv_folder, write_csv
from auditlake.sources.sinks import Store
from auditlake.streaming import runs as streams


def _csv_folder(spark, sf_dir):
    """Customers and orders written as CSV, under file names that need cleaning."""
    folder = fresh_path(spark, "dataset")
    write_csv(table(spark, sf_dir, "customer"), f"{folder}/Customer-list.v1.csv")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(" order.key "), F.col("o_totalprice").alias("total, price"), F.col("o_orderstatus").alias("status")
    )
    write_csv(orders, f"{folder}/orders.csv")
    return folder


@query("csv_load", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_load(spark, sf_dir):
    loaded = load_csv_folder(spark, _csv_folder(spark, sf_dir), replace=True)["customer_list_v1"]
    return loaded.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query(
    "csv_listing",
    """
    SELECT 'Customer-list.v1.csv' AS file, 0 AS ordinal, 'Dataset: Customer-list.v1.csv' AS line
    UNION ALL SELECT 'orders.csv', 0, 'Dataset: orders.csv'
    UNION ALL SELECT 'Customer-list.v1.csv', i, '  - ' || n FROM (VALUES (1, 'c_custkey'), (2, 'c_name'), (3, 'c_nationkey'),
      (4, 'c_acctbal'), (5, 'c_mktsegment')) AS t(i, n)
    UNION ALL SELECT 'orders.csv', i, '  - ' || n FROM (VALUES (1, 'order.key'), (2, 'total, price'), (3, 'status')) AS t(i, n)
    """,
)
def csv_listing(spark, sf_dir):
    return context.column_listing(csv_columns(spark, _csv_folder(spark, sf_dir)))


@query(
    "class_checkpoints",
    """
    SELECT p_brand AS class_name, 'uri:' || p_brand AS class_uri, p_name || ' ' || p_partkey AS attribute_name,
           CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 48 AND p_type = 'PROMO') THEN 'first' ELSE 'second' END AS explanation
    FROM part
    """,
)
def class_checkpoints(spark, sf_dir):
    """Two saves into one store: classes of the first are not written again by the second."""
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_brand").alias("class_name"),
        F.concat(F.lit("uri:"), "p_brand").alias("class_uri"),
        F.lit("parts.ttl").alias("source_ttl_file"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("attribute_name"),
        F.array("p_type").alias("mapped_columns"),
        F.lit(False).alias("not_enough_information"),
    )
    store = Store(spark, fresh_path(spark, "store"))
    store.create()
    started = part.filter("p_size > 48 AND p_type = 'PROMO'").select(F.concat(F.lit("uri:"), "p_brand").alias("class_uri")).distinct()
    first = rows.join(started, "class_uri", "left_semi")
    store.save_classes(first.select("class_uri", "class_name"), first.withColumn("explanation", F.lit("first")))
    store.save_classes(rows.select("class_uri", "class_name"), rows.withColumn("explanation", F.lit("second")))
    return store.mapped().select("class_name", "class_uri", "attribute_name", "explanation")


@query(
    "create_mapping_job",
    f"""
    WITH {_CLASSES},
    co AS (SELECT 'delivered.by' || s_suppkey AS n FROM supplier UNION SELECT 'has_' || lower(l_returnflag) || 'f' FROM lineitem),
    ma AS (SELECT cls.*, property, CASE WHEN property LIKE 'delivered%' THEN 'delivered.by' || property[12:] ELSE 'has_' || lower(property[4:]) END AS n
           FROM cls JOIN prop USING (p_partkey)),
    us AS (SELECT * FROM ma WHERE n IN (SELECT n FROM co)),
    cv AS (SELECT count(*) FILTER (WHERE n IN (SELECT n FROM us)) AS m, count(*) AS t FROM co)
    SELECT '' AS source_file, '' AS class_name, 0 AS part_no,
           printf('# Coverage: %.2f%% (%d out of %d CSV columns successfully mapped)', m / t * 100.0, m, t) AS line FROM cv
    UNION ALL SELECT replace(source_file, 'onto/', ''), class_name, 0, '{{"source_file":"' || replace(source_file, 'onto/', '') || '","class_name":"' || class_name || '","attributes":{{' ||
      string_agg('"' || property || '":{{"mapped_columns":["' || n || '"],"sql_formula":null,"explanation":"name similarity 1.0000"}}', ',' ORDER BY property) || '}}}}'
    FROM us GROUP BY source_file, class_name
    """,
)
def create_mapping_job(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("delivered.by"), F.col("s_suppkey").cast("string")).alias("column_name")
    )
    flags = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("has_"), F.lower("l_returnflag"), F.lit("f")).alias("column_name")).distinct()
    return jobs.create_mapping(
        triples_of(spark, sf_dir), suppliers.unionByName(flags), Store(spark, fresh_path(spark, "store")), "onto"
    )


@query(
    "ingest_job",
    rf"""
    WITH {LINES}, {CHUNKS}, {SEGMENTS}, {CLASSIFY},
    ti AS (SELECT s.*, concept_type, trim(string_split(segment_text, chr(10))[1]) AS title FROM s JOIN sk USING (segment_id)),
    sl AS (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(replace(lower(title), '&', 'and'), '[^a-z0-9\s\p{{Z}}\-]', '', 'g'),
                  '[\s\p{{Z}}\-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'concept') AS slug FROM ti),
    cn AS (SELECT concept_type, array_to_string(list_sort(list_distinct(string_split(slug, '-'))), '-') AS mk, count(*) AS z FROM sl GROUP BY 1, 2),
    ty AS (SELECT concept_type, count(*) AS q, count(*) FILTER (WHERE z > 1) AS r FROM cn GROUP BY 1)
    SELECT 1 AS section, concept_type AS item, concept_type || ': ' || q AS line FROM ty
    UNION ALL SELECT 2, concept_type, concept_type || ': ' || r FROM ty
    UNION ALL SELECT 3, CAST(doc_id AS VARCHAR), 'File: ' || doc_id || chr(10) || '  Total Lines: ' || total_lines || chr(10) ||
      '  Lines Covered: ' || total_lines || chr(10) || '  Coverage: 100.00%' FROM t WHERE total_lines > 0
    """,
)
def ingest_job(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("filename"), "text")
    store = Store(spark, fresh_path(spark, "wiki"))
    return jobs.ingest_documents(docs, classes_of(spark, sf_dir), "concept_type", ["definition"], store, 20, 5)


@query(
    "document_context_job",
    f"""
    WITH {CONCEPTS},
    docs AS (SELECT lower(concept_type) AS corpus, concept_name AS pos, 'Name: ' || concept_name || ' | Summary: ' || summary AS body FROM concepts),
    asked AS (SELECT n_nationkey AS query_id, CASE n_regionkey WHEN 0 THEN 'machinery' WHEN 1 THEN 'furniture' WHEN 2 THEN 'household' WHEN 3 THEN 'none' ELSE 'building' END AS corpus,
                     'which customers of nation ' || n_nationkey AS q FROM nation), {SCORES},
    sz AS (SELECT corpus, count(*) AS n FROM docs GROUP BY 1),
    rk AS (SELECT al.*, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 30 THEN score ELSE 0 END DESC, pos) AS rank
           FROM al JOIN sz ON al.corpus = sz.corpus),
    o AS (SELECT m.concept_name, s.*, row_number() OVER (PARTITION BY m.concept_name ORDER BY filename) - 1 AS spot
          FROM mapping m JOIN segs s ON m.segment_id = s.segment_id),
    tx AS (SELECT concept_name, spot // 1000 AS part_no, string_agg(segment_text, chr(10) || '---' || chr(10) ORDER BY spot) AS segment_text FROM o GROUP BY 1, 2)
    SELECT query_id, rank, concept_name, part_no, segment_text FROM rk JOIN tx ON pos = concept_name WHERE rank <= 30
    """,
)
def document_context_job(spark, sf_dir):
    region = F.col("n_regionkey")
    kind = F.when(region == 0, "Machinery").when(region == 1, "FURNITURE").when(region == 2, "household").when(region == 3, "none").otherwise("Building")
    asked = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("query_id"), kind.alias("concept_type"),
        F.concat_ws(" ", F.lit("which customers of nation"), F.col("n_nationkey").cast("string")).alias("sub_query_string"),
    )
    segments = segments_of_orders(spark, sf_dir).withColumn("segment_start_line_no_global", F.lit(1))
    return jobs.document_context(asked, concepts_of(spark, sf_dir), mapping_of(spark, sf_dir), segments, 30)


@query(
    "tabular_context_job",
    """
    WITH a AS (SELECT 1 AS file_no, row_number() OVER (ORDER BY n DESC, p) AS row_no, p || ',' || n || ',' || hi AS line FROM
                 (SELECT o_orderpriority AS p, count(*) AS n, max(o_totalprice) AS hi FROM orders GROUP BY 1)),
    b AS (SELECT 2 AS file_no, row_number() OVER (ORDER BY n DESC, k) AS row_no, k || ',' || n AS line FROM
            (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY n DESC, k LIMIT 100)),
    c AS (SELECT 3 AS file_no, row_number() OVER (ORDER BY s) AS row_no, s || ',' || lo AS line FROM
            (SELECT o_orderstatus AS s, min(o_totalprice) AS lo FROM orders GROUP BY 1)),
    a2 AS (SELECT *, sum(length(line)) OVER (ORDER BY row_no) AS upto FROM a), a3 AS (SELECT max(upto) AS t FROM a2),
    b2 AS (SELECT *, t + sum(length(line)) OVER (ORDER BY row_no) AS upto FROM b, a3),
    b3 AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY row_no), t) AS before FROM b2),
    bt AS (SELECT coalesce(max(upto) FILTER (WHERE upto <= 400), max(t)) AS t FROM b3),
    c2 AS (SELECT c.*, t AS base, t + sum(length(line)) OVER (ORDER BY row_no) AS upto FROM c, bt),
    c3 AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY row_no), base) AS before FROM c2)
    SELECT file_no, row_no, line FROM a2
    UNION ALL SELECT file_no, row_no, line FROM b3 WHERE before <= 400
    UNION ALL SELECT file_no, row_no, line FROM c3 WHERE base < 400 AND before <= 400
    """,
)
def tabular_context_job(spark, sf_dir):
    cubes = [
        CubeSpec([Measure("COUNT", "*", "n"), Measure("MAX", "o_totalprice", "hi")], ["o_orderpriority"], "", [("n", True), ("o_orderpriority", False)]),
        CubeSpec([Measure("COUNT", "*", "n")], ["o_custkey"], "o_totalprice > 100000", [("n", True), ("o_custkey", False)]),
        CubeSpec([Measure("MIN", "o_totalprice", "lo")], ["o_orderstatus"], "", [("o_orderstatus", False)]),
    ]
    return jobs.tabular_context(table(spark, sf_dir, "orders"), cubes, 400)


@query(
    "decided_records",
    r"""
    SELECT doc_id AS key, len(string_split(text, ' ')) AS words, len(text) > 200 AS long,
           NULL AS problem FROM documents WHERE NOT contains(text, '###')
    UNION ALL SELECT doc_id, NULL, len(text) > 200, 'missing words' FROM documents WHERE contains(text, '###')
    """,
)
def decided(spark, sf_dir):
    """A stand-in decision over whole texts: word count and a flag; an answer about headings lacks the count."""

    def answer(text: pd.Series) -> pd.Series:
        words = text.str.split(" ").str.len()
        long = text.str.len().gt(200).map({True: "true", False: "false"})
        full = '```json\n{"words": ' + words.astype(str) + ', "long": ' + long + "}\n```"
        return full.where(~text.str.contains("###", regex=False), '{"long": ' + long + "}")

    schema = T.StructType([T.StructField("words", T.LongType()), T.StructField("long", T.BooleanType())])
    rows = decided_records(table(spark, sf_dir, "documents"), "doc_id", "text", answer, schema, ["words", "long"])
    return rows.select("key", "record.words", "record.long", "problem")


def _stream(spark, sf_dir, name):
    return streams.stream_parquet(spark, f"{sf_dir}/{name}.parquet")


@query(
    "stream_resume",
    r"SELECT doc_id, lang, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS words FROM documents",
)
def stream_resume(spark, sf_dir):
    """Two runs over the same documents; the second finds nothing new."""
    out, mark = fresh_path(spark, "resume"), fresh_path(spark, "resume-checkpoint")

    def work(rows):
        return rows.select("doc_id", "lang", F.size(tokens("text")).cast("bigint").alias("words"))

    for _ in range(2):
        streams.process_new(_stream(spark, sf_dir, "documents"), "doc_id", work, out, mark)
    return spark.read.parquet(out).select("doc_id", "lang", "words")


@query(
    "stream_event_counts",
    """
    SELECT user_id AS run_id, event_type AS event, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day,
           count(*) AS n, arg_max(value, ts) AS last_score FROM events GROUP BY 1, 2, 3
    """,
)
def stream_event_counts(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").withColumn("score", F.col("value"))
    counts = streams.event_counts(
        events, "user_id", "event_type", "ts", fresh_path(spark, "events"), fresh_path(spark, "events-checkpoint")
    )
    day = F.floor(F.unix_seconds("window_start") / 86400)
    return counts.select("run_id", "event", day.alias("day"), "n", "last_score")


@query("stream_text_delta", ORACLES["stream_delta"].replace("conv_id AS key", "CAST(conv_id AS VARCHAR) AS key"))
def stream_text_delta(spark, sf_dir):
    rows = _stream(spark, sf_dir, "conversations")
    deltas = streams.text_delta_stream(snapshots_of(spark, sf_dir, rows), "conv_id", "seq", "text")
    return streams.write_stream(deltas, fresh_path(spark, "deltas"), fresh_path(spark, "deltas-checkpoint"))


@query("stream_ordered_delta", ORACLES["stream_delta"].replace("conv_id AS key", "CAST(conv_id AS VARCHAR) AS key"))
def stream_ordered_delta(spark, sf_dir):
    """The same deltas when snapshots arrive shuffled over several batches."""
    rows = snapshots_of(spark, sf_dir).withColumn("ts", F.timestamp_seconds("seq"))
    folder = fresh_path(spark, "shuffled")
    # Batch by batch in the order of a hash, which has nothing to do with that of the snapshots; the last row ends the wait.
    # A batch is as many files as the stream takes at a time: more batches would go through the state of the same keys again.
    files = spark.sparkContext.defaultParallelism
    for number in range(4):
        rows.filter(F.pmod(F.xxhash64("conv_id", "seq"), F.lit(4)) == number).coalesce(files).write.mode("append").parquet(folder)
    end = rows.agg(F.timestamp_seconds(F.coalesce(F.max("seq"), F.lit(0)) + 2_000_000_000).alias("ts"))
    end.select(F.lit(None).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("seq"), F.lit("").alias("text"), "ts").write.mode("append").parquet(folder)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
    deltas = streams.ordered_delta_stream(source, "conv_id", "seq", "text", "ts", "1000000000 seconds")
    return streams.write_stream(deltas, fresh_path(spark, "deltas"), fresh_path(spark, "deltas-checkpoint"))
