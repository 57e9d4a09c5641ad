"""Attributes mapped to several columns, over the names of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.mapping import _PARTS_OF
from auditlake.catalog.registry import query, table
from auditlake.operators import cover

_ADJ, _NOUN = "upper(p_name[1]) || split_part(p_name, ' ', 1)[2:]", "upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]"
_SQL = rf"""
    WITH a AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'has' || {_ADJ} || {_NOUN}
                 WHEN 1 THEN 'has' || {_ADJ} || ({_NOUN})[1:2] || split_part(p_name, ' ', 2)[2:] WHEN 2 THEN 'has' || {_ADJ} || {_NOUN} || 'AndBlueBolt'
                 WHEN 3 THEN 'hasAnnual' || {_NOUN} || 'Volume' ELSE 'has' || {_NOUN} || 'OfUnheardStuff' END AS attribute_name FROM part),
    c AS (SELECT DISTINCT p_type AS tab, CASE WHEN p_size < 25 THEN replace(p_name, ' ', '_')
                 WHEN p_size % 3 = 0 THEN 'monthly.' || split_part(p_name, ' ', 2) || '.volume'
                 ELSE split_part(p_name, ' ', 2) || ' of size ' || p_size END AS column_name FROM part),
    ls AS (SELECT DISTINCT {_PARTS_OF.format(x="attribute_name")} AS a FROM a),
    le AS (SELECT a, unnest(a) AS word FROM ls),
    v AS (SELECT word, round(ln(1 + (SELECT count(*) FROM ls) / count(*)), 6) AS weight FROM le GROUP BY 1),
    e AS (SELECT tab, column_name, len(ws) AS size, unnest(ws) AS other FROM (SELECT *, {_PARTS_OF.format(x="column_name")} AS ws FROM c)),
    o AS (SELECT DISTINCT other FROM e),
    per AS (SELECT unnest(['{"', '".join(cover.PERIODS)}']) AS p),
    lim AS (SELECT word, other, CASE WHEN least(length(word), length(other)) < 4 THEN 0 WHEN least(length(word), length(other)) < 8 THEN 1 ELSE 2 END AS most
            FROM v, o),
    q AS (SELECT * FROM (SELECT word, other, CASE WHEN word = other THEN 1.0::DOUBLE
              WHEN word IN (SELECT p FROM per) AND other IN (SELECT p FROM per) THEN {cover.PERIOD}::DOUBLE
              WHEN NOT regexp_matches(word || other, '[0-9]') AND levenshtein(word, other) <= most THEN {cover.NEAR}::DOUBLE END AS quality FROM lim)
          WHERE quality IS NOT NULL),
    p AS (SELECT a, tab, column_name, size, other, word, quality FROM e JOIN q USING (other) JOIN le USING (word)
          QUALIFY row_number() OVER (PARTITION BY a, tab, column_name, other ORDER BY quality DESC, word) = 1),
    k AS (SELECT a, tab, column_name, size - count(*) AS extra FROM p GROUP BY a, tab, column_name, size HAVING count(*) * 2 >= size),
    kx AS MATERIALIZED (SELECT a, tab, column_name, extra, word, weight * max(quality) AS worth FROM k JOIN p USING (a, tab, column_name) JOIN v USING (word)
                        GROUP BY a, tab, column_name, extra, word, weight),
    s1 AS MATERIALIZED (SELECT a, tab, column_name, round(sum(worth ORDER BY word), 6) AS gain FROM kx GROUP BY a, tab, column_name, extra
           QUALIFY row_number() OVER (PARTITION BY a, tab ORDER BY gain DESC, extra, column_name) = 1),
    c1 AS MATERIALIZED (SELECT DISTINCT a, tab, word FROM kx JOIN s1 USING (a, tab, column_name)),
    s2 AS MATERIALIZED (SELECT a, tab, column_name, round(sum(worth ORDER BY word), 6) AS gain FROM kx ANTI JOIN c1 USING (a, tab, word)
           GROUP BY a, tab, column_name, extra QUALIFY row_number() OVER (PARTITION BY a, tab ORDER BY gain DESC, extra, column_name) = 1),
    c2 AS MATERIALIZED (SELECT * FROM c1 UNION SELECT a, tab, word FROM kx JOIN s2 USING (a, tab, column_name)),
    s3 AS (SELECT a, tab, column_name, round(sum(worth ORDER BY word), 6) AS gain FROM kx ANTI JOIN c2 USING (a, tab, word)
           GROUP BY a, tab, column_name, extra QUALIFY row_number() OVER (PARTITION BY a, tab ORDER BY gain DESC, extra, column_name) = 1),
    picks AS (SELECT *, 1 AS i FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3),
    whole AS (SELECT a, sum(weight) AS w FROM le JOIN v USING (word) GROUP BY 1),
    r AS (SELECT a, tab, list(column_name ORDER BY i) AS cols, round(sum(gain ORDER BY i) / any_value(w), 4) AS similarity FROM picks JOIN whole USING (a) GROUP BY a, tab),
    b AS MATERIALIZED (SELECT * FROM r WHERE similarity >= {cover.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, len(cols), tab) = 1),
    bw AS (SELECT b.a, count(*) AS shared FROM (SELECT b.a, word, len(cols) AS n, count(DISTINCT column_name) AS m
             FROM b JOIN kx ON kx.a = b.a AND kx.tab = b.tab AND list_contains(cols, column_name) GROUP BY ALL HAVING n = m) b GROUP BY 1),
    f AS (SELECT b.*, coalesce(shared, 0) AS shared, [CASE WHEN regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_.]*') THEN x ELSE '"' || x || '"' END
            || CASE WHEN x LIKE 'monthly.%' AND list_contains(b.a, 'annual') THEN ' * 12' ELSE '' END for x in cols] AS terms FROM b LEFT JOIN bw USING (a))
    SELECT p_partkey, attribute_name, coalesce(array_to_string(cols, '|'), '') AS mapped_columns,
           CASE WHEN len(cols) > 1 AND shared > 0 THEN array_to_string(terms, ' + ') WHEN len(cols) > 1 THEN array_to_string(terms, ' || '' '' || ') WHEN terms[1] LIKE '% * 12' THEN terms[1] END AS sql_formula,
           similarity, cols IS NULL AS not_enough_information,
           CASE WHEN cols IS NULL THEN 'too few words covered' ELSE printf('words covered %.4f by %d columns', similarity, len(cols)) END AS explanation
    FROM a LEFT JOIN f ON {_PARTS_OF.format(x="attribute_name")} = f.a
"""


@query("mapping_cover", _SQL)
def mapping_cover(spark, sf_dir):
    """Attributes of parts, some misspelt, of two parts or of another period, over the columns of six tables."""
    part = table(spark, sf_dir, "part")
    adj, noun = F.initcap(F.substring_index("p_name", " ", 1)), F.initcap(F.substring_index("p_name", " ", -1))
    kind = F.col("p_partkey") % 5
    name = (
        F.when(kind == 0, F.concat(F.lit("has"), adj, noun))
        .when(kind == 1, F.concat(F.lit("has"), adj, F.substring(noun, 1, 2), F.substring(noun, 2, 100)))
        .when(kind == 2, F.concat(F.lit("has"), adj, noun, F.lit("AndBlueBolt")))
        .when(kind == 3, F.concat(F.lit("hasAnnual"), noun, F.lit("Volume")))
        .otherwise(F.concat(F.lit("has"), noun, F.lit("OfUnheardStuff")))
    )
    thing = F.substring_index("p_name", " ", -1)
    column = (
        F.when(F.col("p_size") < 25, F.replace("p_name", F.lit(" "), F.lit("_")))
        .when(F.col("p_size") % 3 == 0, F.concat(F.lit("monthly."), thing, F.lit(".volume")))
        .otherwise(F.concat(thing, F.lit(" of size "), F.col("p_size").cast("string")))
    )
    columns = part.select("p_type", column.alias("column_name"))
    found = cover.cover_match(part.select("p_partkey", name.alias("attribute_name")), "attribute_name", columns, "column_name", within="p_type")
    return found.withColumn("mapped_columns", F.array_join("mapped_columns", "|"))
