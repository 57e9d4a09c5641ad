"""CSV folders: tables, headers, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.text import clean_header, table_name


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """CSV files and CSV outputs directly below a folder; raises when it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(f"Dataset folder '{folder}' not found.")
    found = [s.getPath().toString() for s in fs.listStatus(path)]
    return sorted(f for f in found if f.endswith(".csv"))


def load_csv_folder(
    spark: SparkSession,
    folder: str,
    schemas: dict[str, str] | None = None,
    replace: bool = False,
    line_breaks_in_cells: bool = False,
) -> dict[str, DataFrame]:
    """Register every CSV of a folder as a table named after its file; known tables stay.

    A schema given per table saves the pass that infers one. Files whose quoted cells hold
    line breaks cannot be split: each is then read by one task.
    """
    files = list_csv(spark, folder)
    if not files:
        return {}
    named = spark.createDataFrame([(f,) for f in files], "path string").select("path", table_name("path").alias("t"))
    tables = {}
    for row in named.collect():
        name = row["t"]
        if not replace and spark.catalog.tableExists(name):
            tables[name] = spark.table(name)
            continue
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", line_breaks_in_cells)
        schema = (schemas or {}).get(name)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        tables[name] = reader.csv(row["path"])
        tables[name].createOrReplaceTempView(name)
    return tables


#: Bytes up to which a file is read as a whole for its header, in one scan with all others of that kind.
SMALL_FILE = 16 * 1024 * 1024


def _sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """CSV files directly below a folder with their bytes; outputs, which are folders, count by their first file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(f"Dataset folder '{folder}' not found.")
    found = {}
    for status in fs.listStatus(path):
        if status.getPath().getName().endswith(".csv"):
            found[status.getPath().toString()] = SMALL_FILE + 1 if status.isDirectory() else status.getLen()
    return found


def csv_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Header columns of every CSV file: ``file, ordinal, column_name``; blank names are dropped.

    However many small files there are, one scan reads them; of a large file only the first line is read.
    """
    sizes = _sizes(spark, folder)
    kind = "file string, value string"
    large = sorted(f for f, size in sizes.items() if size > SMALL_FILE)
    heads = [(f.rstrip("/").rsplit("/", 1)[-1], r["value"]) for f in large for r in spark.read.text(f).take(1)]
    rows = spark.createDataFrame(heads, kind)
    small = sorted(f for f, size in sizes.items() if 0 < size <= SMALL_FILE)
    if small:
        # Ids rise along a file, so the smallest one of its first block is that of its first line. A scan gives names as in URLs.
        scan = spark.read.text(small).filter("_metadata.file_block_start = 0")
        first = scan.select(F.col("_metadata.file_name").alias("url"), "value", F.monotonically_increasing_id().alias("id"))
        paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in small]
        names = spark.createDataFrame([(p.toUri().getRawPath().rsplit("/", 1)[-1], p.getName()) for p in paths], "url string, file string")
        found = first.groupBy("url").agg(F.min_by("value", "id").alias("value")).join(names, "url")
        rows = rows.unionByName(found.select("file", "value"))
    return rows.select("file", F.posexplode(clean_header(_cells())).alias("p", "column_name")).select(
        "file", (F.col("p") + 1).cast("bigint").alias("ordinal"), "column_name"
    )


def _cells():
    """Cells of a CSV header line; a quoted cell may hold commas and doubled quotes."""
    text = F.regexp_replace("value", "^﻿", "")
    raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(r',(\s*"(?:[^"]|"")*"\s*|[^,]*)'), F.lit(1))
    unquoted = F.transform(raw, lambda c: F.regexp_replace(F.trim(c), r'^"((?:[^"]|"")*)"$', "$1"))
    return F.transform(unquoted, lambda c: F.replace(c, F.lit('""'), F.lit('"')))


def write_csv(df: DataFrame, path: str) -> str:
    """Write a result as CSV with a header; every file of the output carries it."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path
