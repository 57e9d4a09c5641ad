"""Saves of several tables: all or nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from auditlake.operators import concepts, jobs
from auditlake.sources import sinks
from auditlake.sources.sinks import Conflict, DuplicateClass, Store


def class_rows(spark, *uris, name="C"):
    return spark.createDataFrame([(name, u, "a", ["x"]) for u in uris], "class_name string, class_uri string, attribute_name string, mapped_columns array<string>")


def uris(store):
    return sorted(r.class_uri for r in store.read("processed_classes").collect()), sorted(r.class_uri for r in store.mapped().collect())


def test_failure_between_the_writes_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    store.save_classes(class_rows(spark, "u:1"), class_rows(spark, "u:1"))
    written = sinks.Save._written

    def failing(save, table, df):
        if table == "processed_classes":
            raise OSError("lost")
        return written(save, table, df)

    monkeypatch.setattr(sinks.Save, "_written", failing)
    with pytest.raises(OSError):
        store.save_classes(class_rows(spark, "u:2"), class_rows(spark, "u:2"))
    assert uris(Store(spark, str(tmp_path / "s"))) == (["u:1"], ["u:1"]) and store.read("attribute_mappings").count() == 1
    monkeypatch.undo()
    store.save_classes(class_rows(spark, "u:2"), class_rows(spark, "u:2"))
    assert uris(store) == (["u:1", "u:2"], ["u:1", "u:2"])


def test_half_written_list_of_a_save_is_not_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    store.append("concepts", spark.createDataFrame([("T", "a")], "concept_type string, concept_name string"))
    number, tables = store.current()
    for text in ("", '{"tables": {"conc', json.dumps({"tables": {}})):
        number += 1
        (tmp_path / "s" / "_saves" / f"{number:012d}.json").write_text(text)
        for crc in (tmp_path / "s" / "_saves").glob(".*.crc"):
            os.unlink(crc) if crc.name.startswith(f".{number:012d}") else None
    assert store.current()[1] == tables and store.read("concepts").count() == 1
    store.append("concepts", spark.createDataFrame([("T", "b")], "concept_type string, concept_name string"))
    assert sorted(r.concept_name for r in store.read("concepts").collect()) == ["a", "b"] and store.current()[0] == number + 1


def test_one_of_two_saves_at_once_fails(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    row = spark.createDataFrame([("T", "a")], "concept_type string, concept_name string")
    with pytest.raises(Conflict), store.transaction() as first:
        first.append("concepts", row)
        store.append("concepts", row.withColumn("concept_name", F.lit("b")))
    assert [r.concept_name for r in store.read("concepts").collect()] == ["b"]
    # Both have looked before either puts its list: the file itself decides.
    late = store.transaction()
    stale = store.current(), store._numbers()
    store.append("concepts", row.withColumn("concept_name", F.lit("c")))
    monkeypatch.setattr(store, "current", lambda: stale[0])
    monkeypatch.setattr(store, "_numbers", lambda: stale[1])
    with pytest.raises(Conflict):
        late.__exit__(None, None, None)
    monkeypatch.undo()
    assert sorted(r.concept_name for r in store.read("concepts").collect()) == ["b", "c"]


def test_duplicate_classes_raise(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    store.save_classes(class_rows(spark, "u:1"), class_rows(spark, "u:1"))
    before = store.current()
    twice = class_rows(spark, "u:2").unionByName(class_rows(spark, "u:2", name="D"))
    with pytest.raises(DuplicateClass):
        store.save_classes(twice, twice)
    with pytest.raises(DuplicateClass):
        store.save_classes(class_rows(spark, "u:1", "u:3"), class_rows(spark, "u:1", "u:3"), skip_known=False)
    assert store.current() == before
    store.save_classes(class_rows(spark, "u:1", "u:3"), class_rows(spark, "u:1", "u:3", "u:3"))
    assert uris(store) == (["u:1", "u:3"], ["u:1", "u:3", "u:3"])


def test_rebuild_from_itself_parts_and_vacuum(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_PARTS", 3)
    store = Store(spark, str(tmp_path / "s"))
    assert not store.exists("concepts") and store.read("concepts").count() == 0
    store.create()
    row = spark.createDataFrame([("T", "a")], "concept_type string, concept_name string")
    for i in range(6):
        store.append("concepts", row.withColumn("concept_name", F.lit(f"n{i}")).withColumn("other", F.lit(1)))
    assert len(store.current()[1]["concepts"]) <= 3 and store.read("concepts").count() == 6
    old = store.read("concepts")
    store.rebuild("concepts", store.read("concepts").filter("concept_name > 'n3'"))
    assert old.count() == 6 and store.read("concepts").count() == 2
    assert store.vacuum(keep=1) > 0 and store.read("concepts").count() == 2  # young folders stay
    assert old.count() == 6
    assert store.vacuum(keep=1, hours=-1) > 0 and store.read("concepts").count() == 2
    assert len(os.listdir(tmp_path / "s" / "concepts")) == 1


def test_update_of_stored_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    rows = spark.createDataFrame([("T", "a", "old"), ("T", "b", "old"), (None, "c", "old")], "concept_type string, concept_name string, summary string")
    store.append("concepts", rows)
    before = store.read("concepts")
    store.update("concepts", {"summary": F.concat("concept_name", F.lit("!"))}, "concept_type = 'T' AND concept_name > 'a'")
    assert {r.concept_name: r.summary for r in store.read("concepts").collect()} == {"a": "old", "b": "b!", "c": "old"}
    assert {r.summary for r in before.collect()} == {"old"}
    store.update("concepts", {"summary": F.lit("all")})
    assert {r.summary for r in store.read("concepts").collect()} == {"all"}
    at = store.current()
    with pytest.raises(ValueError):
        store.update("concepts", {"nothing": F.lit(1)})
    assert store.current() == at


def test_failed_ingest_keeps_the_tables_of_the_run_before(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "Loan terms\nmore\n\nRate rules\nmore\n"), (2, "terms loan\n")], "filename bigint, text string")
    classes = spark.createDataFrame([("Loan", "loan terms"), ("Rate", "rate rules")], "n string, d string")
    store = Store(spark, str(tmp_path / "w"))
    jobs.ingest_documents(docs, classes, "n", ["d"], store, 10, 10)
    before = {t: store.read(t).count() for t in sinks.TABLES}

    def lost(*_):
        raise ValueError("orphans")

    monkeypatch.setattr(concepts, "verify_mapping", lost)
    with pytest.raises(ValueError):
        jobs.ingest_documents(docs.limit(1), classes, "n", ["d"], store, 10, 10)
    assert {t: store.read(t).count() for t in sinks.TABLES} == before and before["concepts"] == 2
