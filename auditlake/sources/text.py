"""Text files, HTML pages, triples and JSON records."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.text import SPACE, character, replace_each, strip, strip_fence
from auditlake.plans.sized import lookup_join
from auditlake.session import materialize


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Whole text files below a folder: ``filename, text``."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("filename"), F.col("value").alias("text"))
    )


def read_lines(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Numbered lines of all text files below a folder: ``filename, line_no, line``, as of :func:`doc_lines`.

    A file may be of any size: it is read in splits, lines are counted per split, and the sums of the splits
    before it give the number of its first line. Files are read twice and must not change meanwhile.
    """
    rows = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
        .select(
            F.col("_metadata.file_path").alias("filename"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"),
        )
    )
    # Ids rise by one along a split, whichever task reads it; a file has as many splits as blocks.
    counted = rows.groupBy("filename", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("filename").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(counted.select("filename", "split", (F.col("first") - F.coalesce(before, F.lit(0))).alias("zero")), "line-starts")
    placed = lookup_join(rows, starts, ["filename", "split"])
    return placed.select("filename", (F.col("id") - F.col("zero") + 1).alias("line_no"), "line")


# Entities of HTML text, the ampersand last so that none is decoded twice.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
# Names of further characters; letters with an accent follow a rule.
NAMED = {
    "apos": "'", "szlig": "ß", "aelig": "æ", "AElig": "Æ", "oslash": "ø", "Oslash": "Ø", "euro": "€", "pound": "£", "copy": "©", "reg": "®",
    "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«",
    "raquo": "»", "middot": "·", "bull": "•", "deg": "°", "sect": "§", "iexcl": "¡", "iquest": "¿", "times": "×",
}
ACCENTS = {"grave": "\u0300", "acute": "\u0301", "circ": "\u0302", "tilde": "\u0303", "uml": "\u0308", "ring": "\u030a", "cedil": "\u0327"}


def entity_names() -> dict[str, str]:
    """Characters by entity name."""
    names = {e[1:-1]: c for e, c in ENTITIES if not e.startswith("&#")} | NAMED
    for letter in "AEIOUYNCaeiouync":
        for accent, mark in ACCENTS.items():
            whole = unicodedata.normalize("NFC", letter + mark)
            if len(whole) == 1 and ord(whole) < 256:
                names[letter + accent] = whole
    return names


def _decode_entities(text: Column) -> Column:
    """Numeric and named entities as characters, each once; unknown names stay."""
    known = F.create_map(*[F.lit(x) for pair in entity_names().items() for x in pair])

    def one(body: Column) -> Column:
        number = F.when(body.rlike("^#[xX]"), character(F.substring(body, 3, 6), 16)).otherwise(character(F.substring(body, 2, 7), 10))
        return F.when(F.startswith(body, F.lit("#")), number).otherwise(F.coalesce(F.element_at(known, body), F.concat(F.lit("&"), body, F.lit(";"))))

    return replace_each(text, "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});", 1, one)


BLOCK_TAGS = "p|div|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|br|head|body"


def html_text(html: str | Column) -> Column:
    """Visible text of a page, one line per block element, blank lines dropped."""
    col = F.col(html) if isinstance(html, str) else html
    text = F.regexp_replace(col, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "")
    text = F.regexp_replace(text, rf"(?i)</?({BLOCK_TAGS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    text = F.regexp_replace(_decode_entities(text), r"[ \t]+", " ")
    return F.array_join(F.filter(F.transform(F.split(text, "[\r\n]"), strip), lambda l: l != ""), "\n")


_IRI = r"<([^>]*)>"
_LITERAL = r'"((?:[^"\\]|\\.)*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?'
TRIPLE = rf"^[{SPACE}]*(?:{_IRI}|(_:\S+))\s+{_IRI}\s+(?:{_IRI}|(_:\S+)|{_LITERAL})\s*\.\s*$"


# Escapes of one letter.
_ESCAPED, _PLAIN = "tbnrf", "\t\b\n\r\f"


def _unescape(text: Column) -> Column:
    """Backslash escapes of N-Triples as characters."""

    def one(body: Column) -> Column:
        return F.when(F.length(body) > 1, character(F.substring(body, 2, 8), 16)).otherwise(F.translate(body, _ESCAPED, _PLAIN))

    return replace_each(text, r"""\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[tbnrf"'\\])""", 1, one)


def rejected_triples(rows: DataFrame, line: str) -> DataFrame:
    """Lines that are neither a triple nor blank nor a comment."""
    return rows.filter(~F.col(line).rlike(TRIPLE) & ~F.col(line).rlike(rf"^[{SPACE}]*(#.*)?$"))


def parse_triples(rows: DataFrame, source: str, line: str) -> DataFrame:
    """N-Triples lines as ``source_file, subject, predicate, object, is_iri``; see :func:`rejected_triples` for the others."""

    def group(i: int) -> Column:
        return _unescape(F.nullif(F.regexp_extract(line, TRIPLE, i), F.lit("")))

    literal = _unescape(F.regexp_extract(line, TRIPLE, 6))
    return rows.filter(F.col(line).rlike(TRIPLE)).select(
        F.col(source).alias("source_file"),
        F.coalesce(group(1), group(2)).alias("subject"),
        _unescape(F.regexp_extract(line, TRIPLE, 3)).alias("predicate"),
        F.coalesce(group(4), group(5), literal).alias("object"),
        group(4).isNotNull().alias("is_iri"),
    )


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of all N-Triples files below a path, each with its file."""
    rows = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.nt").text(path)
        .select(F.col("_metadata.file_path").alias("f"), "value")
    )
    return parse_triples(rows, "f", "value")


def validate_records(rows: DataFrame, text: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """Typed records from model or tool output.

    Adds ``record``, ``valid`` and ``problem`` (the first missing field, or ``not json``).
    """
    parsed = rows.withColumn("record", F.from_json(strip_fence(text), schema))
    problem = F.when(F.try_parse_json(strip_fence(text)).isNull(), F.lit("not json"))
    for name in required:
        problem = problem.when(F.col("record")[name].isNull(), F.lit(f"missing {name}"))
    return parsed.withColumn("problem", problem).withColumn("valid", F.col("problem").isNull())
