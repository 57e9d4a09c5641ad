"""Column functions that check SQL text before it is run."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import strip

# Function names a query may not use.
BLOCKED_FUNCTIONS = [
    "read_csv", "read_csv_auto", "read_parquet", "read_json", "read_json_auto", "read_ndjson",
    "read_ndjson_auto", "read_blob", "read_text", "parquet_scan", "scan_parquet", "glob", "getenv",
    "system", "query_directory", "write_csv",
]
# System catalogs a query may not touch.
BLOCKED_CATALOGS = r"information_schema|sqlite_master|duckdb_[a-zA-Z0-9_]+|pg_[a-zA-Z0-9_]+"
# File endings and address schemes refused inside quotes.
BLOCKED_LOCATIONS = r"\.(csv|parquet|json|ndjson|db|sqlite|txt|tsv)|https?://|s3://"
# Spark functions that reach the JVM or the file layout.
BLOCKED_SPARK_FUNCTIONS = ["reflect", "java_method", "try_reflect", "input_file_name"]

# A call however it is spaced or quoted; looked for outside string literals.
_SPARK_CALLS = rf"(?i)(?<!\w)[`\"]?({'|'.join(BLOCKED_SPARK_FUNCTIONS)})[`\"]?\s*\("
_FUNCTIONS = rf"(?i)\b({'|'.join(BLOCKED_FUNCTIONS)})\b"
_CATALOGS = rf"(?i)\b({BLOCKED_CATALOGS})\b"
_LOCATIONS = rf"(?i)'[^'\n]*({BLOCKED_LOCATIONS})[^'\n]*'|\"[^\"\n]*({BLOCKED_LOCATIONS})[^\"\n]*\""
_READS = r"(?i)^[\s(]*(select|with|from|values)\b"
_WITH_WRITE = r"(?is)^\s*with\b.*\)\s*(insert|update|delete|merge)\b"


# Quoted text and names are taken first, so comment marks in them are left alone.
_COMMENTS = r"""('[^']*'|"[^"]*"|`[^`]*`)|--[^\n]*|/\*[\s\S]*?\*/"""


def strip_comments(sql: Column) -> Column:
    """SQL without ``--`` and ``/* */`` comments; what stands in quotes stays as it is."""
    return strip(F.regexp_replace(sql, _COMMENTS, "$1"))


def resolve_names(text: str, columns: list[str]) -> str:
    """SQL text with column names in double quotes, or with special characters such as dots, in back-quotes.

    String literals and names already back-quoted stay as they are. Double quotes always name a column.
    """
    special = sorted((c for c in columns if not re.fullmatch(r"[A-Za-z_]\w*", c)), key=len, reverse=True)
    bare = "|".join(re.escape(c) for c in special) or r"(?!)"
    pattern = re.compile(rf"'[^']*'|`[^`]*`|\"((?:[^\"]|\"\")*)\"|(?<![\w.])({bare})(?![\w.])", re.IGNORECASE)

    def named(m: re.Match) -> str:
        name = m.group(1).replace('""', '"') if m.group(1) is not None else m.group(2)
        return m.group(0) if name is None else "`" + name.replace("`", "``") + "`"

    return pattern.sub(named, text)


def statements(sql: Column) -> Column:
    """Non-blank statements of a text, quoted text blanked so its semicolons do not count."""
    masked = F.regexp_replace(sql, r"'[^']*'", "''")
    masked = F.regexp_replace(masked, r'"[^"]*"', '""')
    return F.filter(F.transform(F.split(masked, ";"), strip), lambda s: s != "")


def lint_reason(sql: Column) -> Column:
    """First rule a query breaks, or NULL for a single read-only SELECT."""
    clean = strip_comments(sql)
    parts = statements(clean)
    return (
        F.when(F.coalesce(strip(sql), F.lit("")) == "", F.lit("empty"))
        .when(clean.rlike(_FUNCTIONS) | F.regexp_replace(clean, r"'[^']*'", "''").rlike(_SPARK_CALLS), F.lit("function"))
        .when(clean.rlike(_CATALOGS), F.lit("catalog"))
        .when(clean.rlike(_LOCATIONS), F.lit("location"))
        .when(F.size(parts) == 0, F.lit("no statement"))
        .when(F.size(parts) > 1, F.lit("many statements"))
        .when(~F.get(parts, F.lit(0)).rlike(_READS) | F.get(parts, F.lit(0)).rlike(_WITH_WRITE), F.lit("not a select"))
    )
