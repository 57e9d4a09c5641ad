"""Table writers: rebuilt tables, kept concepts, class checkpoints, reports."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.ontology import unprocessed
from auditlake.operators.tables import update_rows
from auditlake.plans.sized import known_only
from auditlake.session import materialize

# Bookkeeping tables and their columns.
TABLES = {
    "processed_classes": "class_uri string, class_name string, processed_at timestamp",
    "attribute_mappings": "class_name string, class_uri string, source_ttl_file string, attribute_name string, "
    "mapped_columns array<string>, sql_formula string, not_enough_information boolean, explanation string, "
    "created_at timestamp",
    "file_line_sequence": "filename string, start_line_no int, end_line_no int",
    "text_segments": "segment_id string, segment_text string, filename string, "
    "segment_start_line_no_global int, segment_end_line_no_global int",
    "concepts": "concept_type string, rationale string, concept_name string, "
    "attributes_and_values map<string,string>, summary string",
    "concept_segment_mapping": "segment_id string, concept_name string",
}
REBUILT = ["file_line_sequence", "text_segments", "concept_segment_mapping"]


class Conflict(RuntimeError):
    """Another save became visible since this one began."""


class DuplicateClass(ValueError):
    """A class that a save names twice, or that is stored already."""


#: Folders of a table after which an append writes the table anew, as one.
MOST_PARTS = 32


class Store:
    """Bookkeeping tables below one root, saved together or not at all.

    A save writes new folders, then one small file that lists the folders of every table. That file
    has the next number and is created only if absent, so of two saves that began together one fails.
    Readers take the tables of the newest file that is whole: a save that is lost on the way, even
    while it writes that file, changes nothing. Folders are never written twice; a table read before
    a save keeps its rows until :meth:`vacuum`.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._hadoop(f"{self.root}/_saves")
        if not self._files.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._files.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _listed(self, number: int) -> dict[str, list[str]] | None:
        """Folders by table of one save; None where its file is not whole."""
        stream = self._files.open(self._hadoop(f"{self.root}/_saves/{number:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found["tables"] if found.get("whole") else None

    def current(self) -> tuple[int, dict[str, list[str]]]:
        """Number of the newest save that is whole, and the folders of its tables."""
        for number in reversed(self._numbers()):
            tables = self._listed(number)
            if tables is not None:
                return number, tables
        return 0, {}

    def _put(self, base: int, tables: dict[str, list[str]]) -> None:
        numbers = self._numbers()
        if self.current()[0] != base:
            raise Conflict(f"save {base} of {self.root} is no longer the newest")
        path = self._hadoop(f"{self.root}/_saves/{max([base, *numbers]) + 1:012d}.json")
        try:
            stream = self._files.create(path, False)
        except Py4JJavaError as error:
            raise Conflict(f"{path} was put by another save") from error
        stream.write(bytearray(json.dumps({"tables": tables, "whole": True}).encode()))
        stream.close()

    def transaction(self) -> Save:
        """A save that becomes visible when the ``with`` block ends without an error."""
        return Save(self)

    def _rows(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{f}" for f in folders])

    def exists(self, table: str) -> bool:
        return table in self.current()[1]

    def create(self) -> None:
        """Create missing tables; empty the ones every run rebuilds; keep the concepts."""
        with self.transaction() as save:
            save.create()

    def read(self, table: str) -> DataFrame:
        return self._rows(table, self.current()[1].get(table, []))

    def append(self, table: str, df: DataFrame) -> None:
        with self.transaction() as save:
            save.append(table, df)

    def rebuild(self, table: str, df: DataFrame) -> None:
        """Replace a table; the rows may come from the table itself."""
        with self.transaction() as save:
            save.rebuild(table, df)

    def update(self, table: str, values: dict[str, Column], condition: str = "") -> None:
        """Set columns of the stored rows for which the condition is true; of all rows without one."""
        with self.transaction() as save:
            save.update(table, values, condition)

    def save_classes(self, classes: DataFrame, mappings: DataFrame, skip_known: bool = True) -> None:
        """Append classes together with their attribute rows.

        ``classes``: class_uri, class_name; ``mappings``: attribute rows with class_uri. Two names for
        one class raise :class:`DuplicateClass`, and so does a class stored already unless ``skip_known``.
        """
        stamp = self.spark.range(1).select(F.current_timestamp().alias("t")).first()["t"]
        with self.transaction() as save:
            once = materialize(classes.select("class_uri", "class_name").distinct(), "classes")
            twice = once.groupBy("class_uri").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
            if twice:
                raise DuplicateClass(f"class {twice[0]['class_uri']} is named twice")
            done = save.read("processed_classes")
            fresh = materialize(unprocessed(once, done, "class_uri"), "classes")
            if not skip_known and fresh.count() < once.count():
                raise DuplicateClass("a class is stored already")
            rows = known_only(mappings, fresh, ["class_uri"])
            save.append("attribute_mappings", rows.withColumn("created_at", F.lit(stamp)))
            save.append("processed_classes", fresh.withColumn("processed_at", F.lit(stamp)))

    def mapped(self) -> DataFrame:
        """Attribute rows written together with a checkpoint."""
        _, tables = self.current()
        done = self._rows("processed_classes", tables.get("processed_classes", []))
        done = done.select("class_uri", F.col("processed_at").alias("created_at"))
        rows = self._rows("attribute_mappings", tables.get("attribute_mappings", []))
        return known_only(rows, done, ["class_uri", "created_at"])

    def vacuum(self, keep: int = 2, hours: float = 24) -> int:
        """Delete folders that none of the newest ``keep`` saves lists, and the files of older saves; returns their number.

        Folders younger than ``hours`` may belong to a save under way and stay.
        """
        whole = [(n, t) for n in self._numbers() if (t := self._listed(n)) is not None]
        used = {f for _, tables in whole[-keep:] for folders in tables.values() for f in folders}
        before, gone = (time.time() - hours * 3600) * 1000, 0
        for table in TABLES:
            folder = self._hadoop(f"{self.root}/{table}")
            for status in self._files.listStatus(folder) if self._files.exists(folder) else []:
                name = f"{table}/{status.getPath().getName()}"
                if name not in used and status.getModificationTime() < before:
                    gone += self._files.delete(status.getPath(), True)
        for number, _ in whole[:-keep]:
            gone += self._files.delete(self._hadoop(f"{self.root}/_saves/{number:012d}.json"), False)
        return gone


class Save:
    """Changes to a store's tables that become visible together."""

    def __init__(self, store: Store):
        self.store = store
        self.base, self.tables = store.current()

    def __enter__(self) -> Save:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.store._put(self.base, self.tables)

    def _written(self, table: str, df: DataFrame) -> str:
        fields = self.store.spark.createDataFrame([], TABLES[table]).schema.fields
        shaped = df.select(
            *[
                (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                for f in fields
            ]
        )
        folder = f"{table}/{uuid.uuid4().hex}"
        shaped.write.parquet(f"{self.store.root}/{folder}")
        return folder

    def create(self) -> None:
        """Create missing tables; empty the ones every run rebuilds; keep the concepts."""
        self.tables = {t: [] if t in REBUILT else self.tables.get(t, []) for t in TABLES}

    def read(self, table: str) -> DataFrame:
        """A table with the changes made so far."""
        return self.store._rows(table, self.tables.get(table, []))

    def append(self, table: str, df: DataFrame) -> None:
        parts = self.tables.get(table, [])
        if len(parts) >= MOST_PARTS:
            self.rebuild(table, self.read(table).unionByName(df.select(*[c for c in self.read(table).columns if c in df.columns]), allowMissingColumns=True))
        else:
            self.tables = self.tables | {table: [*parts, self._written(table, df)]}

    def update(self, table: str, values: dict[str, Column], condition: str = "") -> None:
        """Set columns of the stored rows for which the condition is true; of all rows without one."""
        self.rebuild(table, update_rows(self.read(table), values, condition))

    def rebuild(self, table: str, df: DataFrame) -> None:
        """Replace a table; the rows may come from the table itself."""
        self.tables = self.tables | {table: [self._written(table, df)]}


def write_lines(lines: DataFrame, order: list[str], path: str) -> str:
    """Write report lines as text, in order over the numbered files."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
    return path
