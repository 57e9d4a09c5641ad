"""Attribute mappings derived from parts, conversations and benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.registry import query, table
from auditlake.functions.text import tokens
from auditlake.operators import mapping

_PARTS_OF = r"list_sort(list_distinct(regexp_extract_all(lower(regexp_replace({x}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g')), '[\p{{L}}\p{{N}}]+')))"


@query(
    "schema_match",
    f"""
    WITH a AS (SELECT p_partkey, 'has' || replace(initcap_, ' ', '') || CASE WHEN p_size > 40 THEN 'Code' ELSE '' END AS attribute_name FROM
                 (SELECT *, array_to_string([upper(z[1]) || z[2:] for z in string_split(p_name, ' ')], ' ') AS initcap_ FROM part)),
    c AS (SELECT DISTINCT replace(p_name, ' ', '.') || '.' || CASE WHEN p_size < 20 THEN lower(p_type) ELSE 'a.b.c.d.e.f' END AS column_name FROM part),
    ls AS (SELECT DISTINCT {_PARTS_OF.format(x="attribute_name")} AS ws FROM a),
    rs AS (SELECT DISTINCT {_PARTS_OF.format(x="column_name")} AS ws FROM c),
    pr AS (SELECT ls.ws AS l, rs.ws AS r, len(list_intersect(ls.ws, rs.ws)) AS sh FROM ls, rs),
    sc AS (SELECT l, r, sh / (len(l) + len(r) - sh) AS sim,
                  levenshtein(array_to_string(l, ' '), array_to_string(r, ' ')) AS dist FROM pr),
    b AS (SELECT * FROM sc WHERE sim >= 0.5 QUALIFY row_number() OVER (PARTITION BY l ORDER BY sim DESC, dist, array_to_string(r, ' ')) = 1),
    n AS (SELECT {_PARTS_OF.format(x="column_name")} AS r, min(column_name) AS mapped_column FROM c GROUP BY 1)
    SELECT p_partkey, attribute_name, mapped_column, round(sim, 4) AS similarity, mapped_column IS NULL AS not_enough_information
    FROM a LEFT JOIN b ON {_PARTS_OF.format(x="attribute_name")} = b.l LEFT JOIN n ON b.r = n.r
    """,
)
def schema_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    code = F.when(F.col("p_size") > 40, F.lit("Code")).otherwise(F.lit(""))
    attributes = part.select(
        "p_partkey", F.concat(F.lit("has"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), code).alias("attribute_name")
    )
    # Names with many further words are too far from any attribute.
    ending = F.when(F.col("p_size") < 20, F.lower("p_type")).otherwise("a.b.c.d.e.f")
    columns = part.select(F.concat_ws(".", F.replace("p_name", F.lit(" "), F.lit(".")), ending).alias("column_name")).distinct()
    return mapping.schema_match(attributes, "attribute_name", columns, "column_name")


CATALOG_TABLES = ["part", "customer", "lineitem"]


def _rows(spark, sf_dir):
    """Mapping rows of very different quality, one per part."""
    kind = F.col("p_type")
    formula = (
        F.when(kind == "ECONOMY", "P_SIZE * p_retailprice")
        .when(kind == "SMALL", "part.p_size + 1")
        .when(kind == "PROMO", "ROUND(p_size)")
        .when(kind == "MEDIUM", "coalesce(p_name, 'x y z')")
        .when(kind == "LARGE", "customer.p_nope + p_size")
        .otherwise("")
    )
    columns = F.array(F.concat(F.lit("p_"), F.substring_index("p_name", " ", -1)), F.lit("P_Size"), F.lit("p_retailprice"))
    kept = F.when(F.col("p_size") > 40, F.slice(columns, 1, 1)).otherwise(columns)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        kind.alias("class_name"),
        F.col("p_name").alias("attribute_name"),
        kept.alias("mapped_columns"),
        formula.alias("sql_formula"),
        F.lit(False).alias("not_enough_information"),
        F.col("p_brand").alias("explanation"),
    )


@query(
    "sanitize_mapping",
    """
    SELECT p_partkey, p_type AS class_name, p_name AS attribute_name,
           CASE WHEN p_size > 40 THEN '' ELSE 'P_Size|p_retailprice' END AS mapped_columns,
           CASE WHEN p_size > 40 THEN NULL ELSE CASE p_type WHEN 'ECONOMY' THEN 'P_SIZE * p_retailprice' WHEN 'SMALL' THEN 'part.p_size + 1'
             WHEN 'MEDIUM' THEN 'coalesce(p_name, ''x y z'')' WHEN 'STANDARD' THEN '' END END AS sql_formula,
           p_size > 40 AS not_enough_information FROM part
    """,
)
def sanitize_mapping(spark, sf_dir):
    catalog = mapping.Catalog.of({t: table(spark, sf_dir, t).columns for t in CATALOG_TABLES})
    rows = mapping.sanitize(_rows(spark, sf_dir), catalog)
    return rows.withColumn("mapped_columns", F.array_join("mapped_columns", "|"))


# Turns map their words; the words of the benchmark are the columns that exist.
_WORDS = r"""
    w AS (SELECT conv_id * 1000 + turn AS turn_id, role, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS a FROM conversations),
    v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS column_name FROM benchmark)
"""


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"),
        tokens("text").alias("mapped_columns"),
        (F.col("role") == "system").alias("not_enough_information"),
    )


def _vocabulary(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(tokens("text")).alias("column_name"))


@query(
    "existing_columns",
    f"""
    WITH {_WORDS}, x AS (SELECT turn_id, a[i] AS t, i FROM (SELECT turn_id, a, unnest(range(1, len(a) + 1)) AS i FROM w)),
    k AS (SELECT turn_id, string_agg(t, ' ' ORDER BY i) AS mapped_columns FROM x WHERE t IN (SELECT column_name FROM v) GROUP BY 1)
    SELECT turn_id, coalesce(mapped_columns, '') AS mapped_columns FROM w LEFT JOIN k USING (turn_id)
    """,
)
def existing_columns(spark, sf_dir):
    rows = mapping.existing_columns_join(_turns(spark, sf_dir), "turn_id", "mapped_columns", _vocabulary(spark, sf_dir))
    return rows.withColumn("mapped_columns", F.array_join("mapped_columns", " "))


@query(
    "column_coverage",
    f"""
    WITH {_WORDS}, u AS (SELECT DISTINCT unnest(a) AS column_name FROM w WHERE role <> 'system'),
    n AS (SELECT count(*) FILTER (WHERE column_name IN (SELECT column_name FROM u)) AS m, count(*) AS t FROM v)
    SELECT m AS mapped_columns, t AS total_columns, round(m * 100.0 / t, 4) AS coverage_pct,
           printf('Coverage: %.2f%% (%d out of %d CSV columns successfully mapped)', m / t * 100.0, m, t) AS coverage_text FROM n
    """,
)
def column_coverage(spark, sf_dir):
    used = mapping.mapped_only(_turns(spark, sf_dir))
    return mapping.column_coverage(used, _vocabulary(spark, sf_dir)).withColumn("coverage_pct", F.round("coverage_pct", 4))


def _stored(spark, sf_dir):
    """Stored rows: files by type, classes by brand; later parts overwrite attributes of the same name."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("/data/onto/"), F.lower("p_type"), F.lit(".ttl")).alias("source_ttl_file"),
        F.replace("p_brand", F.lit("#"), F.lit("")).alias("class_name"),
        F.col("p_name").alias("attribute_name"),
        F.when(size > 35, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), size.cast("string")))).alias("mapped_columns"),
        F.when(size > 20, F.concat(F.lit("c * "), size.cast("string"))).alias("sql_formula"),
        (size < 6).alias("not_enough_information"),
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("explanation"),
        F.col("p_partkey").alias("seq"),
    )


_STORED = """
    st AS (SELECT lower(p_type) || '.ttl' AS f, replace(p_brand, '#', '') AS c, p_name AS a, p_size, p_partkey FROM part),
    la AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY f, c, a ORDER BY p_partkey DESC) = 1)
"""


@query(
    "mapping_tree",
    f"""
    WITH {_STORED}, o AS (SELECT *, row_number() OVER (PARTITION BY f, c ORDER BY a) - 1 AS pos FROM la)
    SELECT '/data/onto/' || f AS source_ttl_file, c AS class_name, pos // 8 AS part_no,
           string_agg(a || '=' || CASE WHEN p_size > 35 THEN '' ELSE 'c' || p_size END || ' ' || CASE WHEN p_size > 20 THEN 'c * ' || p_size ELSE '-' END
                      || ' part ' || p_partkey || ' ' || CASE WHEN p_size < 6 THEN 'true' ELSE 'false' END, '; ' ORDER BY a) AS attributes FROM o GROUP BY 1, 2, 3
    """,
)
def mapping_tree(spark, sf_dir):
    tree = mapping.mapping_tree(_stored(spark, sf_dir), "seq", part_size=8)
    shown = F.transform(
        F.map_entries("attributes"),
        lambda e: F.concat(
            e["key"], F.lit("="), F.array_join(e["value"]["mapped_columns"], ","), F.lit(" "),
            F.coalesce(e["value"]["sql_formula"], F.lit("-")), F.lit(" "), e["value"]["explanation"], F.lit(" "),
            e["value"]["not_enough_information"].cast("string"),
        ),
    )
    return tree.select("source_ttl_file", "class_name", "part_no", F.array_join(shown, "; ").alias("attributes"))


def _sizes(spark, sf_dir):
    """Dataset columns of the stored mappings: one per part size, those from 30 under a name no mapping has, and one per region."""
    size = F.col("p_size").cast("string")
    part = table(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_size") < 30, "c").otherwise("other"), size).alias("column_name"))
    return part.unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("column_name")))


@query(
    "mapping_export",
    f"""
    WITH {_STORED}, us AS (SELECT * FROM la WHERE p_size <= 35 AND p_size >= 6),
    co AS (SELECT DISTINCT CASE WHEN p_size < 30 THEN 'c' ELSE 'other' END || p_size AS n FROM part UNION SELECT r_name FROM region),
    cv AS (SELECT count(*) FILTER (WHERE n IN (SELECT 'c' || p_size FROM us)) AS m, count(*) AS t FROM co),
    o AS (SELECT *, row_number() OVER (PARTITION BY f, c ORDER BY a) - 1 AS pos FROM us)
    SELECT '' AS source_file, '' AS class_name, 0 AS part_no,
           printf('# Coverage: %.2f%% (%d out of %d CSV columns successfully mapped)', m / t * 100.0, m, t) AS line FROM cv
    UNION ALL SELECT 'onto/' || f, c, pos // 8, '{{"source_file":"onto/' || f || '","class_name":"' || c || '","attributes":{{' ||
           string_agg('"' || a || '":{{"mapped_columns":["c' || p_size || '"],"sql_formula":' ||
                      CASE WHEN p_size > 20 THEN '"c * ' || p_size || '"' ELSE 'null' END || ',"explanation":"part ' || p_partkey || '"}}', ',' ORDER BY a) || '}}}}'
    FROM o GROUP BY f, c, pos // 8
    """,
)
def mapping_export(spark, sf_dir):
    return mapping.mapping_export(_stored(spark, sf_dir), "seq", _sizes(spark, sf_dir), "/data", part_size=8)


@query(
    "mapping_json_read",
    """
    SELECT p_type AS source_ttl_file, p_brand AS class_name, p_name AS attribute_name, 'c' || p_size || '|x' AS mapped_columns,
           CASE WHEN p_size > 20 THEN 'c' || p_size || ' * 2' END AS sql_formula, 'part ' || p_partkey AS explanation,
           CASE WHEN p_size < 10 THEN true END AS not_enough_information FROM part
    """,
)
def mapping_json_read(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.lit('{"'), "p_type", F.lit('": {"'), "p_brand", F.lit('": {"attributes": {"'), "p_name",
        F.lit('": {"mapped_columns": ["c'), size, F.lit('", "x"], "sql_formula": '),
        F.when(F.col("p_size") > 20, F.concat(F.lit('"c'), size, F.lit(' * 2"'))).otherwise(F.lit("null")),
        F.lit(', "explanation": "part '), F.col("p_partkey").cast("string"), F.lit('"'),
        F.when(F.col("p_size") < 10, F.lit(', "not_enough_information": true')).otherwise(F.lit("")),
        F.lit("}}}}}"),
    )
    rows = mapping.read_mapping_json(table(spark, sf_dir, "part").select(text.alias("body")), "body")
    return rows.withColumn("mapped_columns", F.array_join("mapped_columns", "|"))
