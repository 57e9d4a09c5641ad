"""Lines, chunks, segments, intervals and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.catalog.registry import query, table
from auditlake.functions import text as X
from auditlake.operators import cohesion, context, documents, intervals
from auditlake.operators.guard import lint
from auditlake.session import fresh_path
from auditlake.sources.text import entity_names, html_text, read_lines, validate_records

# Lines of the documents, the last empty element after a final break dropped.
LINES = r"""
    d AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS a FROM documents),
    b AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM d),
    l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS line_no, len(a) AS total_lines, unnest(a) AS line FROM b)
"""
# Chunks of 20 lines that start 18 lines apart.
CHUNKS = """
    t AS (SELECT doc_id, len(a) AS total_lines FROM b),
    c AS (SELECT doc_id, chunk_no, 1 + chunk_no * 18 AS start_line_no,
                 greatest(1, least(20 + chunk_no * 18, total_lines)) AS end_line_no
          FROM (SELECT doc_id, total_lines,
                       unnest(range(0, CAST(greatest(0, ceil((total_lines - 20) / 18.0)) AS BIGINT) + 1)) AS chunk_no FROM t))
"""
# Segments: a heading or a line after blank lines starts one, as does every fifth line of a run.
SEGMENTS = r"""
    m AS (SELECT l.doc_id, chunk_no, start_line_no, line_no, line,
                 lag(line) OVER (PARTITION BY l.doc_id, chunk_no ORDER BY line_no) AS before
          FROM l JOIN c ON l.doc_id = c.doc_id AND line_no BETWEEN start_line_no AND end_line_no),
    f AS (SELECT *, sum(CASE WHEN before IS NULL OR regexp_matches(line, '^#{1,6}\s')
                        OR (trim(line) <> '' AND trim(before) = '') THEN 1 ELSE 0 END)
                 OVER (PARTITION BY doc_id, chunk_no ORDER BY line_no) AS block FROM m),
    p AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, chunk_no, block ORDER BY line_no) - 1) // 5 AS piece FROM f),
    g AS (SELECT doc_id, chunk_no, block, piece, min(line_no) AS first_no, max(line_no) AS last_no,
                 string_agg(line, chr(10) ORDER BY line_no) AS segment_text FROM p GROUP BY ALL),
    s AS (SELECT doc_id || '-' || chunk_no || '-' ||
                 (row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY block, piece) - 1) AS segment_id,
                 segment_text, doc_id AS filename, first_no AS segment_start_line_no_global,
                 last_no AS segment_end_line_no_global FROM g)
"""
CHUNK_SIZE, MAX_LINES = 20, 5


def segments_of(spark, sf_dir):
    return documents.segments(table(spark, sf_dir, "documents"), "doc_id", "text", CHUNK_SIZE, MAX_LINES)


@query("doc_lines", f"WITH {LINES} SELECT doc_id, line_no, total_lines, line FROM l")
def doc_lines(spark, sf_dir):
    return documents.doc_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


def _ranges(spark, sf_dir):
    totals = table(spark, sf_dir, "documents").select("doc_id", X.line_count("text").cast("bigint").alias("total_lines"))
    return documents.chunk_ranges(totals, "doc_id", "total_lines", CHUNK_SIZE)


@query(
    "file_lines",
    r"""
    WITH p AS (SELECT source, doc_id % 16 AS slot, doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS a FROM documents),
    l AS (SELECT source, slot, doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line FROM p)
    SELECT source, slot, row_number() OVER (PARTITION BY source, slot ORDER BY doc_id, i) AS line_no, line FROM l
    """,
)
def file_lines(spark, sf_dir):
    """Documents written to text files, sixteen for each source, and their lines read from splits."""
    docs = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 16).alias("slot"), "doc_id", "text")
    folder = fresh_path(spark, "text-files")
    placed = docs.repartition("source", "slot").sortWithinPartitions("source", "slot", "doc_id")
    placed.select("source", "slot", "text").write.partitionBy("source", "slot").text(folder)
    path = r"/source=([^/]*)/slot=([0-9]+)/"
    return read_lines(spark, folder, "*.txt").select(
        F.regexp_extract("filename", path, 1).alias("source"), F.regexp_extract("filename", path, 2).cast("bigint").alias("slot"), "line_no", "line"
    )


@query("chunk_ranges", f"WITH {LINES}, {CHUNKS} SELECT doc_id, chunk_no, start_line_no, end_line_no FROM c")
def chunk_ranges(spark, sf_dir):
    return _ranges(spark, sf_dir)


_CHUNK_LINES = f"""
    WITH {LINES}, {CHUNKS}
    SELECT l.doc_id, chunk_no, line_no, line_no - start_line_no AS relative_line,
           (line_no - start_line_no) || ': ' || line AS numbered_line
    FROM l JOIN c ON l.doc_id = c.doc_id AND line_no BETWEEN start_line_no AND end_line_no
"""


@query("chunk_lines", _CHUNK_LINES)
def chunk_lines(spark, sf_dir):
    rows = documents.doc_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return documents.chunk_lines(rows, CHUNK_SIZE).select("doc_id", "chunk_no", "line_no", "relative_line", "numbered_line")


@query("lines_in_ranges", _CHUNK_LINES)
def lines_in_ranges(spark, sf_dir):
    rows = documents.doc_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    placed = documents.lines_in_ranges(rows, _ranges(spark, sf_dir), "doc_id")
    relative = F.col("line_no") - F.col("start_line_no")
    return placed.select(
        "doc_id", "chunk_no", "line_no", relative.alias("relative_line"),
        X.numbered_line(relative, "line").alias("numbered_line"),
    )


@query("segments", f"WITH {LINES}, {CHUNKS}, {SEGMENTS} SELECT * FROM s")
def segments(spark, sf_dir):
    return segments_of(spark, sf_dir)


# Word sets around each gap, valleys by runs that fall towards them, and cuts at deep ones.
TOPICS = rf"""
    m AS (SELECT l.doc_id, chunk_no, start_line_no, line_no, line, line_no - start_line_no AS i,
                 list_distinct(list_filter(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= {cohesion.LETTERS})) AS ws
          FROM l JOIN c ON l.doc_id = c.doc_id AND line_no BETWEEN start_line_no AND end_line_no),
    e AS (SELECT doc_id, chunk_no, i, unnest(ws) AS w FROM m),
    sa AS (SELECT DISTINCT doc_id, chunk_no, gap, w FROM (SELECT *, unnest(range(i, i + {cohesion.WINDOW})) AS gap FROM e)),
    sb AS (SELECT DISTINCT doc_id, chunk_no, gap, w FROM (SELECT *, unnest(range(i - {cohesion.WINDOW}, i)) AS gap FROM e)),
    na AS (SELECT doc_id, chunk_no, gap, count(*) AS a FROM sa GROUP BY ALL), nb AS (SELECT doc_id, chunk_no, gap, count(*) AS b FROM sb GROUP BY ALL),
    ab AS (SELECT doc_id, chunk_no, gap, count(*) AS x FROM sa JOIN sb USING (doc_id, chunk_no, gap, w) GROUP BY ALL),
    v AS (SELECT m.doc_id, m.chunk_no, m.i AS gap, CASE WHEN x > 0 THEN CAST(floor(1000 * x / sqrt(CAST(a AS DOUBLE) * b) + 1e-9) AS BIGINT) ELSE 0 END AS s
          FROM m JOIN m AS nx ON nx.doc_id = m.doc_id AND nx.chunk_no = m.chunk_no AND nx.i = m.i + 1
          LEFT JOIN ab ON ab.doc_id = m.doc_id AND ab.chunk_no = m.chunk_no AND ab.gap = m.i
          LEFT JOIN na ON na.doc_id = m.doc_id AND na.chunk_no = m.chunk_no AND na.gap = m.i
          LEFT JOIN nb ON nb.doc_id = m.doc_id AND nb.chunk_no = m.chunk_no AND nb.gap = m.i),
    rn AS (SELECT *, sum(CASE WHEN ps >= s THEN 0 ELSE 1 END) OVER o AS lr, sum(CASE WHEN xs >= s THEN 0 ELSE 1 END) OVER r AS rr
           FROM (SELECT *, lag(s) OVER o AS ps, lead(s) OVER o AS xs FROM v WINDOW o AS (PARTITION BY doc_id, chunk_no ORDER BY gap))
           WINDOW o AS (PARTITION BY doc_id, chunk_no ORDER BY gap), r AS (PARTITION BY doc_id, chunk_no ORDER BY gap DESC)),
    dp AS (SELECT *, max(s) OVER (PARTITION BY doc_id, chunk_no, rr) AS rise, max(s) OVER (PARTITION BY doc_id, chunk_no, lr) + rise - 2 * s AS depth FROM rn),
    ct AS (SELECT doc_id, chunk_no, gap + 1 AS i FROM (SELECT *, sum(depth) OVER (PARTITION BY doc_id, chunk_no) AS total,
                  count(*) OVER (PARTITION BY doc_id, chunk_no) AS n FROM dp)
           WHERE ps > s AND rise > s AND depth >= {cohesion.LEAST_DEPTH} AND depth * n > total),
    f AS (SELECT m.*, sum(CASE WHEN i = 0 OR regexp_matches(line, '^#{{1,6}}\s') OR ct.i IS NOT NULL THEN 1 ELSE 0 END)
                 OVER (PARTITION BY m.doc_id, m.chunk_no ORDER BY line_no) AS block FROM m LEFT JOIN ct USING (doc_id, chunk_no, i)),
    p AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, chunk_no, block ORDER BY line_no) - 1) // 12 AS piece FROM f),
    g AS (SELECT doc_id, chunk_no, block, piece, min(line_no) AS first_no, max(line_no) AS last_no, string_agg(line, chr(10) ORDER BY line_no) AS segment_text
          FROM p GROUP BY ALL)
"""


@query(
    "topic_segments",
    f"""
    WITH {LINES}, {CHUNKS}, {TOPICS}
    SELECT doc_id || '-' || chunk_no || '-' || (row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY block, piece) - 1) AS segment_id, segment_text,
           doc_id AS filename, first_no AS segment_start_line_no_global, last_no AS segment_end_line_no_global FROM g
    """,
)
def topic_segments(spark, sf_dir):
    """Segments cut where neighbouring lines share fewest words."""
    return documents.segments(table(spark, sf_dir, "documents"), "doc_id", "text", CHUNK_SIZE, 12, cohesion.cohesive_starts())


@query(
    "global_lines",
    f"""
    WITH {LINES}, {CHUNKS}, {SEGMENTS}
    SELECT segment_id, 1 + CAST(split_part(segment_id, '-', 2) AS BIGINT) * 18 AS chunk_start,
           segment_start_line_no_global - 1 - CAST(split_part(segment_id, '-', 2) AS BIGINT) * 18 AS relative_start,
           segment_start_line_no_global AS global_start FROM s
    """,
)
def global_lines(spark, sf_dir):
    start = F.lit(1) + F.split("segment_id", "-")[1].cast("bigint") * 18
    rows = segments_of(spark, sf_dir).select(
        "segment_id", start.alias("chunk_start"), (F.col("segment_start_line_no_global") - start).alias("relative_start")
    )
    return rows.withColumn("global_start", X.global_line("chunk_start", "relative_start"))


# Line spans of events: some end before they start.
SPANS = """
    i AS (SELECT event_type, CAST(floor(value * 50) AS BIGINT) AS start_line,
                 CAST(floor(value * 50) AS BIGINT) + CAST(json_extract(props, '$.k') AS BIGINT) - 20 AS end_line FROM events)
"""


def _spans(spark, sf_dir):
    start = F.floor(F.col("value") * 50)
    return table(spark, sf_dir, "events").select(
        "event_type",
        start.alias("start_line"),
        (start + F.get_json_object("props", "$.k").cast("bigint") - 20).alias("end_line"),
    )


@query(
    "interval_union",
    f"""
    WITH {SPANS},
    o AS (SELECT *, max(end_line) OVER (PARTITION BY event_type ORDER BY start_line, end_line
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE start_line <= end_line),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach THEN 1 ELSE 0 END)
                 OVER (PARTITION BY event_type ORDER BY start_line, end_line) AS island FROM o)
    SELECT event_type, min(start_line) AS start_line, max(end_line) AS end_line FROM n GROUP BY event_type, island
    """,
)
def interval_union(spark, sf_dir):
    return intervals.merged_intervals(_spans(spark, sf_dir), "event_type", "start_line", "end_line", width=256)


@query(
    "interval_length",
    f"""
    WITH {SPANS} SELECT event_type, count(DISTINCT x) AS lines_covered
    FROM (SELECT event_type, unnest(range(start_line, end_line + 1)) AS x FROM i WHERE start_line <= end_line) GROUP BY 1
    """,
)
def interval_length(spark, sf_dir):
    return intervals.covered_lines(_spans(spark, sf_dir), "event_type", "start_line", "end_line", width=256)


COVERED = r"""
    x AS (SELECT DISTINCT filename, unnest(range(segment_start_line_no_global, segment_end_line_no_global + 1)) AS n FROM s),
    v AS (SELECT filename, count(*) AS lines_covered FROM x GROUP BY 1)
"""


def coverage_of(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    totals = docs.select(F.col("doc_id").alias("filename"), X.line_count("text").cast("bigint").alias("total_lines"))
    return intervals.line_coverage(segments_of(spark, sf_dir), totals, "filename", "total_lines")


@query(
    "line_coverage",
    f"""
    WITH {LINES}, {CHUNKS}, {SEGMENTS}, {COVERED}
    SELECT filename, total_lines, lines_covered, round(lines_covered * 100.0 / total_lines, 4) AS coverage_pct
    FROM v JOIN t ON filename = doc_id
    """,
)
def line_coverage(spark, sf_dir):
    return coverage_of(spark, sf_dir).withColumn("coverage_pct", F.round("coverage_pct", 4))


@query(
    "tokenize_stats",
    r"""
    WITH w AS (SELECT lang, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS a FROM documents)
    SELECT lang, count(*) AS documents, CAST(sum(len(a)) AS BIGINT) AS tokens, round(avg(len(a)), 4) AS mean_length,
           CAST(sum(len(list_distinct(a))) AS BIGINT) AS distinct_per_document FROM w GROUP BY 1
    """,
)
def tokenize_stats(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", X.tokens("text").alias("a"))
    return words.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.size("a")).alias("tokens"),
        F.round(F.avg(F.size("a")), 4).alias("mean_length"),
        F.sum(F.size(F.array_distinct("a"))).alias("distinct_per_document"),
    )


_BLOCKS = "p|div|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|br|head|body"


def _decoded(column: str) -> str:
    """Named entities replaced one by one, the ampersand last so that none is decoded twice."""
    names = sorted(entity_names().items(), key=lambda n: n[0] == "amp")
    for name, char in [("#39", "'"), *names]:
        column = "replace({}, '&{};', '{}')".format(column, name, char.replace("'", "''"))
    return column


@query(
    "page_text_lines",
    rf"""
    WITH a AS (SELECT page_id, regexp_replace(html, '<!--.*?-->', '', 'gs') AS x FROM pages),
    b AS (SELECT page_id, regexp_replace(x, '<(script|style)\b[^>]*>.*?</(script|style)>', '', 'gis') AS x FROM a),
    c AS (SELECT page_id, regexp_replace(x, '</?({_BLOCKS})\b[^>]*>', chr(10), 'gi') AS x FROM b),
    d AS (SELECT page_id, regexp_replace(x, '<[^>]*>', '', 'g') AS x FROM c),
    e AS (SELECT page_id, {_decoded('x')} AS x FROM d),
    f AS (SELECT page_id, string_split(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '\r\n?', chr(10), 'g'), chr(10)) AS x FROM e),
    g AS (SELECT page_id, list_filter([trim(regexp_replace(z, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) for z in x], lambda z: z <> '') AS x FROM f)
    SELECT page_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM g
    """,
)
def page_text_lines(spark, sf_dir):
    text = table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))
    return documents.doc_lines(text, "page_id", "text").select("page_id", "line_no", "line")


@query(
    "fenced_blocks",
    r"""
    WITH a AS (SELECT doc_id, source, trim(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS code FROM documents)
    SELECT code_hash, max(code_base64) AS code_base64, count(*) AS uses, count(DISTINCT source) AS sources FROM
      (SELECT source, md5(code) AS code_hash, translate(to_base64(encode(code)), '+/', '-_') AS code_base64 FROM a WHERE code <> '')
    GROUP BY 1
    """,
)
def fenced_blocks(spark, sf_dir):
    # Each document stands in a page of its own between two diagrams, one of them blank.
    page = F.concat(F.lit("# page\n```mermaid\n"), "text", F.lit("\n```\n\n```mermaid\n \n```\n"))
    blocks = table(spark, sf_dir, "documents").select("source", F.explode(X.fenced_blocks(page)).alias("code"))
    return (
        blocks.select("source", F.md5("code").alias("code_hash"), X.url_base64("code").alias("code_base64"))
        .groupBy("code_hash")
        .agg(F.max("code_base64").alias("code_base64"), F.count(F.lit(1)).alias("uses"), F.count_distinct("source").alias("sources"))
    )


@query(
    "fence_strip",
    r"""
    SELECT conv_id, turn, CASE WHEN role = 'system' THEN regexp_replace('```json' || chr(10) || text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')
           ELSE regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') END AS body FROM conversations
    """,
)
def fence_strip(spark, sf_dir):
    # Answers come fenced, system turns with a fence left open, user turns bare.
    fenced = (
        F.when(F.col("role") == "assistant", F.concat(F.lit("  ```json\n"), "text", F.lit("\n```  ")))
        .when(F.col("role") == "system", F.concat(F.lit("```json\n"), "text"))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.strip_fence(fenced).alias("body"))


@query(
    "json_validate",
    """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type IN ('view', 'click') AS valid,
           CASE event_type WHEN 'signup' THEN 'missing name' WHEN 'error' THEN 'not json' WHEN 'purchase' THEN 'missing k' END AS problem
    FROM events WHERE event_type NOT IN ('error', 'purchase')
    UNION ALL SELECT event_id, NULL, false, CASE event_type WHEN 'error' THEN 'not json' ELSE 'missing k' END
    FROM events WHERE event_type IN ('error', 'purchase')
    """,
)
def json_validate(spark, sf_dir):
    kind = F.col("event_type")
    body = F.regexp_extract("props", r"(\d+)", 1)
    full = F.concat(F.lit('{"k": '), body, F.lit(', "name": "'), kind, F.lit('"}'))
    answer = (
        F.when(kind == "view", full)
        .when(kind == "click", F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(kind == "signup", F.col("props"))
        .when(kind == "error", F.concat(F.lit("no answer: "), "props"))
        .otherwise(F.concat(F.lit('{"name": "'), body, F.lit('"}')))
    )
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType())])
    rows = table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))
    return validate_records(rows, "answer", schema, ["k", "name"]).select("event_id", F.col("record.k").alias("k"), "valid", "problem")


@query(
    "normalize_names",
    r"""
    WITH a AS (SELECT doc_id, regexp_replace(replace(lower(text), '&', 'and'), '[^a-z0-9\s\x0b\x1c-\x1f\x{85}\p{Z}\-]', '', 'g') AS x FROM documents)
    SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(x, '[\s\x0b\x1c-\x1f\x{85}\p{Z}\-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'concept') AS name FROM a
    """,
)
def normalize_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_name("text").alias("name"))


@query(
    "local_names",
    """
    SELECT page_id, list_last(string_split(list_last(string_split(url, '/')), '#')) AS local_name FROM pages
    """.replace("list_last(", "list_extract(").replace(", '/'))", ", '/'), -1)").replace(", '#'))", ", '#'), -1)"),
)
def local_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.local_name("url").alias("local_name"))


@query(
    "table_names",
    r"""
    WITH a AS (SELECT page_id, list_extract(string_split(url, '/'), -1) AS base FROM pages)
    SELECT page_id, lower(translate(regexp_replace(base || '.v1-final.CSV', '^(\.*[^.].*)\.[^.]*$', '\1'), '-.', '__')) AS table_name FROM a
    """,
)
def table_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", X.table_name(F.concat("url", F.lit(".v1-final.CSV"))).alias("table_name")
    )


@query(
    "list_codec",
    r"""
    WITH a AS (SELECT conv_id, turn, role, list_filter([regexp_replace(z, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') for z in string_split(text, ',')], lambda z: z <> '') AS cells FROM conversations)
    SELECT conv_id, turn, CAST(CASE WHEN role = 'system' THEN 0 ELSE len(cells) END AS BIGINT) AS n,
           CASE WHEN role = 'system' THEN '' ELSE array_to_string(cells, '|') END AS cells FROM a
    """,
)
def list_codec(spark, sf_dir):
    # Cells of a header-like row go through JSON and back; a broken text decodes to no cells.
    cells = X.clean_header(F.split("text", ",", -1))
    stored = F.when(F.col("role") == "system", F.concat(F.lit("broken "), X.encode_list(cells))).otherwise(X.encode_list(cells))
    back = X.decode_list(stored)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.size(back).cast("bigint").alias("n"), F.array_join(back, "|").alias("cells")
    )


_FUNCS = (
    "read_csv|read_csv_auto|read_parquet|read_json|read_json_auto|read_ndjson|read_ndjson_auto|read_blob|read_text|"
    "parquet_scan|scan_parquet|glob|getenv|system|query_directory|write_csv"
)
_LOCS = r"\.(csv|parquet|json|ndjson|db|sqlite|txt|tsv)|https?://|s3://"


@query(
    "sql_lint",
    rf"""
    WITH q AS (
      SELECT 'turn ' || conv_id || '-' || turn AS query_id, CASE turn
        WHEN 0 THEN 'SELECT * FROM docs WHERE body = ''' || text || ''''
        WHEN 1 THEN 'SELECT 1 /* ' || text || ' */ -- tail'
        WHEN 2 THEN 'SELECT 1; DROP TABLE docs -- ' || text
        WHEN 3 THEN 'WITH a AS (SELECT ''' || text || ''') SELECT * FROM a;'
        WHEN 4 THEN 'UPDATE docs SET body = ''' || text || ''''
        WHEN 5 THEN 'SELECT * FROM read_csv(''' || text || ''')'
        WHEN 6 THEN 'SELECT ''' || text || ' s3://bucket/x'' FROM pg_catalog.t'
        ELSE '/* ' || text || ' */' END AS sql FROM conversations
      UNION ALL SELECT 'page ' || page_id, 'SELECT * FROM t WHERE u = ''' || url || '''' FROM pages),
    c AS (SELECT query_id, sql, trim(regexp_replace(sql, '(''[^'']*''|"[^"]*"|`[^`]*`)|--[^\n]*|/\*[\s\S]*?\*/', '\1', 'g'), chr(10) || ' ') AS x FROM q),
    m AS (SELECT *, list_filter([trim(z) for z in string_split(regexp_replace(regexp_replace(x, '''[^'']*''', '''''', 'g'),
          '"[^"]*"', '""', 'g'), ';')], lambda z: z <> '') AS parts FROM c),
    r AS (SELECT query_id, CASE WHEN trim(sql) = '' THEN 'empty'
        WHEN regexp_matches(x, '\b({_FUNCS})\b', 'i') THEN 'function'
        WHEN regexp_matches(x, '\b(information_schema|sqlite_master|duckdb_[a-zA-Z0-9_]+|pg_[a-zA-Z0-9_]+)\b', 'i') THEN 'catalog'
        WHEN regexp_matches(x, '''[^''\n]*({_LOCS})[^''\n]*''|"[^"\n]*({_LOCS})[^"\n]*"', 'i') THEN 'location'
        WHEN len(parts) = 0 THEN 'no statement' WHEN len(parts) > 1 THEN 'many statements'
        WHEN NOT regexp_matches(parts[1], '^[\s(]*(select|with|from|values)\b', 'i')
          OR regexp_matches(parts[1], '^\s*with\b.*\)\s*(insert|update|delete|merge)\b', 'is') THEN 'not a select'
        ELSE 'ok' END AS reason FROM m)
    SELECT query_id, reason = 'ok' AS accepted, reason FROM r
    """,
)
def sql_lint(spark, sf_dir):
    text, turn = F.col("text"), F.col("turn")
    sql = (
        F.when(turn == 0, F.concat(F.lit("SELECT * FROM docs WHERE body = '"), text, F.lit("'")))
        .when(turn == 1, F.concat(F.lit("SELECT 1 /* "), text, F.lit(" */ -- tail")))
        .when(turn == 2, F.concat(F.lit("SELECT 1; DROP TABLE docs -- "), text))
        .when(turn == 3, F.concat(F.lit("WITH a AS (SELECT '"), text, F.lit("') SELECT * FROM a;")))
        .when(turn == 4, F.concat(F.lit("UPDATE docs SET body = '"), text, F.lit("'")))
        .when(turn == 5, F.concat(F.lit("SELECT * FROM read_csv('"), text, F.lit("')")))
        .when(turn == 6, F.concat(F.lit("SELECT '"), text, F.lit(" s3://bucket/x' FROM pg_catalog.t")))
        .otherwise(F.concat(F.lit("/* "), text, F.lit(" */")))
    )
    name = F.concat(F.lit("turn "), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    asked = table(spark, sf_dir, "conversations").select(name.alias("query_id"), sql.alias("sql"))
    urls = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("query_id"),
        F.concat(F.lit("SELECT * FROM t WHERE u = '"), "url", F.lit("'")).alias("sql"),
    )
    return lint(asked.unionByName(urls), "query_id", "sql")


def _condense_round(source: str, to: str) -> str:
    """One round over ``source`` (doc_id, ls): texts from 12 lines on, in chunks of 10 lines, with a share of 300 words."""
    return rf"""
    {to}z AS (SELECT doc_id, pos, (pos - 1) // 10 AS ch, ceil(n / 10.0) AS chunks, regexp_replace(line, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS line
              FROM (SELECT doc_id, len(ls) AS n, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM {source} WHERE len(ls) >= 12)),
    {to}y AS (SELECT doc_id, ch, chunks, line, min(pos) AS pos, len(regexp_extract_all(line, '[\p{{L}}\p{{N}}_]+')) AS n FROM {to}z GROUP BY ALL),
    {to}w AS (SELECT *, greatest(50, floor(300 / chunks)) AS share, sum(n) OVER o AS total, row_number() OVER o AS k, count(*) OVER (PARTITION BY doc_id, ch) AS c
              FROM {to}y WINDOW o AS (PARTITION BY doc_id, ch ORDER BY n, pos ROWS UNBOUNDED PRECEDING)),
    {to}p AS (SELECT doc_id, ch, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE total <= share AND k <= ceil(c / 2.0)),
                       max(array_to_string(string_split(line, ' ')[1:CAST(share AS BIGINT)], ' ')) FILTER (WHERE k = 1)) AS part FROM {to}w GROUP BY 1, 2),
    {to}j AS (SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY ch) AS x FROM {to}p GROUP BY 1),
    {to} AS MATERIALIZED (SELECT doc_id, ls FROM {source} WHERE len(ls) < 12
            UNION ALL SELECT doc_id, string_split(CASE WHEN ends_with(x, chr(10)) THEN x[:-2] ELSE x END, chr(10)) FROM {to}j)"""


_ROUNDS = 12
_CONDENSE = r"""
    WITH r0 AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(CASE WHEN ends_with(x, chr(10)) THEN x[:-2] ELSE x END, chr(10)) END AS ls
                FROM (SELECT doc_id, text, regexp_replace(text, '\r\n?', chr(10), 'g') AS x FROM documents)),
""" + ",".join(_condense_round(f"r{i}", f"r{i + 1}") for i in range(_ROUNDS)) + f"""
    SELECT d.doc_id, CASE WHEN len(r0.ls) < 12 THEN d.text ELSE array_to_string(r.ls, chr(10)) END AS text
    FROM documents d JOIN r0 USING (doc_id) JOIN r{_ROUNDS} r USING (doc_id)
"""


@query("condense_lines", _CONDENSE)
def condense_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return context.condense(docs, "text", threshold=12, words=300, chunk_lines=10)


# One round; each step of a chunk takes the line with most new weight per word that still fits.
_COVERED = r"""
    WITH RECURSIVE r0 AS (SELECT doc_id, text, string_split(CASE WHEN ends_with(x, chr(10)) THEN x[:-2] ELSE x END, chr(10)) AS ls
                FROM (SELECT doc_id, text, regexp_replace(text, '\r\n?', chr(10), 'g') AS x FROM documents) WHERE x <> ''),
    z AS (SELECT doc_id, pos, (pos - 1) // 10 AS ch, ceil(n / 10.0) AS chunks, regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS line
          FROM (SELECT doc_id, len(ls) AS n, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM r0 WHERE len(ls) >= 12)),
    y AS (SELECT doc_id, ch, chunks, line, min(pos) AS pos, regexp_extract_all(lower(line), '[\p{L}\p{N}_]+') AS ws FROM z GROUP BY ALL),
    k AS (SELECT doc_id, ch, chunks, line, pos, len(ws) AS n, list_distinct(list_filter(ws, lambda w: length(w) >= 4)) AS ts FROM y),
    wt AS (SELECT doc_id, ch, t, count(*) AS w FROM (SELECT doc_id, ch, unnest(ts) AS t FROM k) GROUP BY ALL),
    kt AS (SELECT doc_id, ch, pos, list({'t': t, 'w': w}) AS tw FROM (SELECT doc_id, ch, pos, unnest(ts) AS t FROM k) JOIN wt USING (doc_id, ch, t) GROUP BY ALL),
    cs AS MATERIALIZED (SELECT doc_id, ch, any_value(chunks) AS chunks, count(*) AS c, list({'pos': pos, 'n': n, 'tw': coalesce(tw, [])} ORDER BY pos) AS cs
           FROM k LEFT JOIN kt USING (doc_id, ch, pos) GROUP BY 1, 2),
    g(doc_id, ch, step, covered, picked, room, most) AS (
        SELECT doc_id, ch, 0, CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), CAST(greatest(50, floor(120 / chunks)) AS BIGINT), CAST(ceil(c / 2.0) AS BIGINT) FROM cs
        UNION ALL
        SELECT doc_id, ch, step + 1, list_concat(covered, list_transform(best.tw, lambda x: x.t)), list_append(picked, best.pos), room - best.n, most
        FROM (SELECT g.*, list_sort(list_transform(list_filter(cs.cs, lambda x: x.n <= g.room AND NOT list_contains(g.picked, x.pos)), lambda x: {
                'score': -(coalesce(list_sum(list_transform(list_filter(x.tw, lambda y: NOT list_contains(g.covered, y.t)), lambda y: y.w)), 0) * 1000 // greatest(x.n, 1)),
                'pos': x.pos, 'n': x.n, 'tw': x.tw}))[1] AS best
              FROM g JOIN cs USING (doc_id, ch) WHERE len(g.picked) < g.most)
        WHERE best.score < 0),
    e AS (SELECT doc_id, ch, picked, room FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, ch ORDER BY step DESC) = 1),
    few AS (SELECT doc_id, ch, line AS line, CAST(greatest(50, floor(120 / chunks)) AS BIGINT) AS share FROM k
            QUALIFY row_number() OVER (PARTITION BY doc_id, ch ORDER BY n, pos) = 1),
    part AS (SELECT e.doc_id, e.ch, CASE WHEN len(picked) > 0 THEN string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE list_contains(picked, k.pos))
                    ELSE any_value(array_to_string(string_split(few.line, ' ')[1:share], ' ')) END AS part
             FROM e JOIN k USING (doc_id, ch) JOIN few USING (doc_id, ch) GROUP BY e.doc_id, e.ch, picked),
    j AS (SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY ch) AS x FROM part GROUP BY 1)
    SELECT doc_id, coalesce(x, text) AS text FROM documents LEFT JOIN j USING (doc_id)
"""


@query("condense_by_weight", _COVERED)
def condense_by_weight(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return context.condense_by_weight(docs, "text", threshold=12, words=120, chunk_lines=10, rounds=1)
