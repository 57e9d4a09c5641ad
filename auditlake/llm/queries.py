"""Registered queries of the operators, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import (
    decontaminate, fill_middle, line_dedup, lm_score, pii, piece_counts, quality, resample, secret_scan, sentencepiece_codec, simhash,
    suffix_dedup, warc,
)
from auditlake.llm.settle import settled
from auditlake.session import fresh_path
from auditlake.sources.text import BLOCK_TAGS, entity_names, html_text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_FORMS)
OP3_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper,
             len(list_distinct(list_filter(ws, lambda x: x IN ({_STOPS})))) AS n_stop,
             length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS n_letter,
             len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullets,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_cut
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars / n_words < 2.5 OR word_chars / n_words > 12 OR n_symbols / n_words > 0.1
            OR n_upper / greatest(word_chars, 1) > 0.3 OR n_letter / greatest(word_chars, 1) < 0.6 OR n_stop < 2
            OR n_dup_lines / greatest(n_lines, 1) > 0.5 OR n_bullets / greatest(n_lines, 1) > 0.9
            OR n_cut / greatest(n_lines, 1) > 0.3) AS kept
FROM v
"""


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept")


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.secret_spans(docs)
    return found.select("doc_id", *secret_scan.span_digests("secret_spans", "base_spans", secret_scan.KINDS[:3]))


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", *secret_scan.span_digests("pii_spans", "base_spans", pii.BASE_KINDS))


def _decoded(column: str) -> str:
    names = sorted(entity_names().items(), key=lambda n: n[0] == "amp")
    for name, char in [("#39", "'"), *names]:
        column = "replace({}, '&{};', '{}')".format(column, name, char.replace("'", "''"))
    return column


OP10_SQL = rf"""
WITH a AS (SELECT page_id, url, regexp_replace(html, '<!--.*?-->', '', 'gs') AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(x, '<(script|style)\b[^>]*>.*?</(script|style)>', '', 'gis') AS x FROM a),
c AS (SELECT page_id, url, regexp_replace(x, '</?({BLOCK_TAGS})\b[^>]*>', chr(10), 'gi') AS x FROM b),
d AS (SELECT page_id, url, regexp_replace(x, '<[^>]*>', '', 'g') AS x FROM c),
e AS (SELECT page_id, url, {_decoded('x')} AS x FROM d),
f AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '\r', chr(10), 'g'), chr(10)) AS x FROM e),
g AS (SELECT page_id, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '')) AS host,
             list_filter([regexp_replace(z, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') for z in x], lambda z: z <> '') AS ls FROM f),
n AS (SELECT host, count(*) AS pages FROM g GROUP BY host),
w AS (SELECT host, line, count(*) AS has FROM (SELECT host, unnest(list_distinct(ls)) AS line FROM g) GROUP BY host, line),
bad AS (SELECT host, list(line) AS lines FROM w JOIN n USING (host) WHERE has >= {line_dedup.MIN_PAGES} AND has > {line_dedup.RATIO} * pages GROUP BY host),
k AS (SELECT page_id, host, ls, list_filter(ls, lambda z: bad.lines IS NULL OR NOT list_contains(bad.lines, z)) AS kept FROM g LEFT JOIN bad USING (host))
SELECT page_id, host, len(ls) AS n_lines, len(ls) - len(kept) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
"""


@query("op10_line_dedup", OP10_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text("html")
    pages = _table(spark, sf_dir, "pages").select("page_id", line_dedup.url_host(F.col("url")).alias("host"), text.alias("text"))
    sized = pages.withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("bigint"))
    # Written once: the lines are read twice, for the counts and for the cut.
    left = line_dedup.drop_boilerplate(settled(sized, "page-lines"), "host", n_dropped="n_dropped")
    return left.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = sentencepiece_codec.encode(docs, outputs=("ids", "n_tokens", "n_bytes", "parity", "round_trip"), keep_text=False)
    return done.select("doc_id", "n_tokens", "n_bytes", F.xxhash64("ids").alias("ids_hash"), "parity", "round_trip")


@query("op7_piece_counts")
def op7_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_counts.piece_counts(docs).select("doc_id", "n_words", "n_pieces", "n_unknown")


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, benchmark, ["doc_id"])


@query("op1_lm_score")
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    return lm_score.lm_score(docs, ~F.col("held_out"), ["doc_id", "held_out"])


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_groups(_table(spark, sf_dir, "documents"), "doc_id")


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), "doc_id", keep_bytes=False)


_DRAW = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
OP11_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fill_middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS us, {_DRAW} FROM t),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
             CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= {fill_middle.FIM_PERCENT} THEN 'plain'
                  WHEN h4 % 100 < {fill_middle.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
         AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query("op11_fill_middle", OP11_SQL)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    again = fill_middle.restored(F.col("fim_text"), F.col("form"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256")
    )


OP12_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY d ORDER BY page_id NULLS LAST))
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= {warc.LEAST_BYTES} AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {warc.LEAST_BYTES} AND k > 1 THEN first END AS refers_to
FROM r
"""


@query("op12_warc", OP12_SQL)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.as_records(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    path = warc.write_archive(warc.deduplicated(pages), fresh_path(spark, "warc"))
    heads = settled(warc.read_archive(spark, path, payloads=False), "warc-heads")
    return warc.resolved(heads).select(
        F.col("identity").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("original").cast("bigint").alias("refers_to")
    )


# The checksum of each different word, byte by byte, and the rest as the contract says it.
OP13_SQL = rf"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
w AS MATERIALIZED (SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
       FROM documents UNION ALL
       SELECT 'b', item_id, 0,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
       FROM benchmark),
o AS MATERIALIZED (SELECT side, id, r, unnest(ws) AS word FROM w),
v AS (SELECT DISTINCT word FROM o),
bytes AS (SELECT word, hex(encode(word)) AS x FROM v),
sums AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT))),
           lambda c, y: xor(c >> 8, list_extract(tab.t, xor(c & 255, y) + 1))), 4294967295) % {resample.BUCKETS} AS bucket FROM bytes, tab),
f AS MATERIALIZED (SELECT side, id, r, bucket FROM o JOIN sums USING (word)),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM f GROUP BY bucket),
a AS (SELECT count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM f),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(n.t AS DOUBLE) + 1) * (a.s + {resample.BUCKETS}) / ((CAST(n.s AS DOUBLE) + 1) * (a.t + {resample.BUCKETS})))) AS BIGINT) AS gain
      FROM n, a),
m AS (SELECT r, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN g USING (bucket) WHERE side = 'd' GROUP BY r),
d AS (SELECT w.id AS doc_id, w.r, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             CAST('0x' || substr(sha256('{resample.SEED}:' || coalesce(CAST(w.id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
      FROM w LEFT JOIN m USING (r) WHERE side = 'd'),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS all_fit FROM e WHERE n_words >= {resample.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {resample.PERCENT} * all_fit // 100 THEN place END AS rank FROM e LEFT JOIN k USING (r)
"""


@query("op13_resample", OP13_SQL)
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, _table(spark, sf_dir, "benchmark"), "doc_id").select("doc_id", "n_features", "weight", "score", "rank")
