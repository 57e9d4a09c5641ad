"""CSV folders, text files, stores, streams and jobs on disk."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.operators import documents, jobs
from auditlake.operators.decide import decided_records
from auditlake.operators import ontology as O
from auditlake.sources import csv as C
from auditlake.sources import text as S
from auditlake.sources.sinks import Store, write_lines
from auditlake.streaming import runs as R


def test_csv_folder(spark, tmp_path):
    (tmp_path / "Loan-Test.v2.csv").write_text("loan_id,amount,status\nLP101,150000,Approved\nLP102,250000,\"a, \"\"b\"\"\"\n")
    (tmp_path / "note.txt").write_text("x")
    got = C.load_csv_folder(spark, str(tmp_path))
    assert list(got) == ["loan_test_v2"]
    assert dict(got["loan_test_v2"].dtypes)["amount"] in ("int", "bigint")
    assert spark.table("loan_test_v2").orderBy("loan_id").collect()[1].status == 'a, "b"'
    (tmp_path / "Loan-Test.v2.csv").write_text("other\n1\n")
    assert C.load_csv_folder(spark, str(tmp_path))["loan_test_v2"].columns == ["loan_id", "amount", "status"]
    spark.catalog.dropTempView("loan_test_v2")
    with pytest.raises(FileNotFoundError):
        C.load_csv_folder(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert C.load_csv_folder(spark, str(tmp_path / "empty")) == {}


def test_csv_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffid, name ,,\"x, y\"\n1,2,3,4\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("col1\n")
    (tmp_path / "empty.csv").write_text("")
    got = [tuple(r) for r in C.csv_columns(spark, str(tmp_path)).orderBy("file", "ordinal").collect()]
    assert got == [("a.csv", 1, "id"), ("a.csv", 2, "name"), ("a.csv", 3, "x, y"), ("b.csv", 1, "col1")]


def test_many_headers_in_one_job(spark, tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"t {k:03d}.csv").write_text(f"id,name {k}\n" + "1,2\n" * (k % 7))
    (tmp_path / "big.csv").write_text("a,b\n" + "1,2\n" * 40_000)
    spark.range(1).selectExpr("1 AS x", "2 AS y").write.option("header", True).csv(str(tmp_path / "out.csv"))
    monkeypatch.setattr(C, "SMALL_FILE", 100_000)
    group = "headers"
    spark.sparkContext.setJobGroup(group, "")
    rows = C.csv_columns(spark, str(tmp_path)).collect()
    jobs_run = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "")
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.ordinal)):
        got.setdefault(r.file, []).append(r.column_name)
    assert got == {f"t {k:03d}.csv": ["id", f"name {k}"] for k in range(300)} | {"big.csv": ["a", "b"], "out.csv": ["x", "y"]}
    assert jobs_run <= 8


def test_documents_and_triples_from_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("one\ntwo\n")
    (tmp_path / "sub" / "b.md").write_text("")
    (tmp_path / "sub" / "t.nt").write_text(f"<http://x/C> <{O.RDF_TYPE}> <{O.OWL_CLASS}> .\n")
    docs = {r.filename.rsplit("/", 1)[1]: r.text for r in S.read_documents(spark, str(tmp_path)).collect()}
    assert docs["a.md"] == "one\ntwo\n" and docs.get("b.md", "") == ""
    found = O.classes(S.read_triples(spark, str(tmp_path))).collect()
    assert [(r.class_name, r.source_file.endswith("t.nt")) for r in found] == [("C", True)]


def test_html_text(spark):
    html = "<head><title>T &amp;lt; x</title><script>var a = '<p>';</script></head><body><!-- <p>no</p> --><p>a <b>b</b>\n c</p><br/>d</body>"
    assert spark.range(1).select(S.html_text(F.lit(html))).first()[0] == "T &lt; x\na b\nc\nd"


def test_validate_records(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.ArrayType(T.StringType()))])
    texts = ['{"a": 1, "b": ["x"]}', '```json\n{"a": 1, "b": []}\n```', '{"a": 1}', "no json", '{"b": ["x"]}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.problem for r in S.validate_records(rows, "t", schema, ["a", "b"]).orderBy("i").collect()]
    assert got == [None, None, "missing b", "not json", "missing a"]


def test_decider_hook(spark):
    schema = T.StructType([T.StructField("n", T.LongType())])
    rows = spark.createDataFrame([(1, "abc"), (2, "x")], "k bigint, t string")
    answer = lambda s: pd.Series(['{"n": %d}' % len(v) if len(v) > 1 else "?" for v in s])
    got = {r.key: (r.valid, r.record.n if r.valid else None) for r in decided_records(rows, "k", "t", answer, schema, ["n"]).collect()}
    assert got == {1: (True, 3), 2: (False, None)}


def test_store_saves_a_class_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    rows = spark.createDataFrame([("C", "u:C", "a1", ["x"], "one"), ("C", "u:C", "a2", [], "one")], "class_name string, class_uri string, attribute_name string, mapped_columns array<string>, explanation string")
    store.save_classes(rows.select("class_uri", "class_name"), rows)
    # An attempt that failed before its checkpoint leaves rows nobody sees.
    store.append("attribute_mappings", rows.withColumn("explanation", F.lit("lost")).withColumn("created_at", F.lit("2001-01-01").cast("timestamp")))
    store.save_classes(rows.select("class_uri", "class_name"), rows.withColumn("explanation", F.lit("two")))
    store.create()
    assert sorted((r.attribute_name, r.explanation) for r in store.mapped().collect()) == [("a1", "one"), ("a2", "one")]
    assert store.read("processed_classes").count() == 1


def test_mapping_job_resumes(spark, tmp_path):
    h = "http://x.org/"
    rows = [(f"f{i}", f"{h}C{i}", O.RDF_TYPE, O.OWL_CLASS) for i in range(2)] + [(f"f{i}", f"{h}loan{w}", O.RDFS_DOMAIN, f"{h}C{i}") for i in range(2) for w in ("Amt", "Zzz")]
    triples = spark.createDataFrame(rows, "source_file string, subject string, predicate string, object string")
    columns = spark.createDataFrame([("d.csv", 1, "loan_amt"), ("d.csv", 2, "term")], "file string, ordinal int, column_name string")
    store = Store(spark, str(tmp_path / "s"))
    jobs.create_mapping(triples.filter("source_file = 'f0'"), columns, store)
    assert store.read("processed_classes").count() == 1
    lines = [r.line for r in jobs.create_mapping(triples, columns, store).orderBy("source_file").collect()]
    assert lines[0] == "# Coverage: 50.00% (1 out of 2 CSV columns successfully mapped)"
    assert len(lines) == 3 and '"loanAmt":{"mapped_columns":["loan_amt"]' in lines[1]
    assert store.read("processed_classes").count() == 2


def test_ingest_keeps_concepts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Loan terms\nmore\n\nRate rules\nmore\n"), (2, "terms loan\n")], "filename bigint, text string")
    classes = spark.createDataFrame([("Loan", "loan terms"), ("Rate", "rate rules")], "n string, d string")
    store = Store(spark, str(tmp_path / "w"))
    for _ in range(2):
        lines = [r.line for r in jobs.ingest_documents(docs, classes, "n", ["d"], store, 10, 10).orderBy("section", "item").collect()]
    assert sorted(r.concept_name for r in store.read("concepts").collect()) == ["loan-terms", "rate-rules"]
    assert store.read("concept_segment_mapping").count() == store.read("text_segments").count()
    assert [x for x in lines if x.startswith("File")][0] == "File: 1\n  Total Lines: 5\n  Lines Covered: 5\n  Coverage: 100.00%"
    path = write_lines(jobs.ingest_documents(docs, classes, "n", ["d"], store, 10, 10), ["section", "item"], str(tmp_path / "report"))
    assert spark.read.text(path).count() > 4


def test_streams_take_only_what_is_new(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    calls = []

    def run(keys):
        spark.createDataFrame([(k, f"text {k}") for k in keys], "k int, t string").coalesce(1).write.mode("append").parquet(source)
        R.process_new(R.stream_parquet(spark, source), "k", lambda rows: calls.append(1) or rows.withColumn("n", F.length("t")), out, mark)
        return sorted(r.k for r in spark.read.parquet(out).collect())

    assert run([1, 2, 2]) == [1, 2]
    assert run([2, 3]) == [1, 2, 3]
    R.process_new(R.stream_parquet(spark, source), "k", lambda rows: calls.append(1) or rows, out, mark)
    assert len(calls) == 2


def test_delta_stream_keeps_state_between_batches(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for rows in ([("a", 1, "x"), ("a", 2, "xy")], [("a", 3, "xyz"), ("a", 4, "q"), ("b", 1, "n")]):
        spark.createDataFrame(rows, "k string, i bigint, t string").coalesce(1).write.mode("append").parquet(source)
        deltas = R.text_delta_stream(R.stream_parquet(spark, source), "k", "i", "t")
        got = R.write_stream(deltas, out, mark)
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("a", 4, "q"), ("b", 1, "n")]


def test_deltas_of_snapshots_out_of_order(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    batches = [[("a", 3, "xyz"), ("b", 2, "mn")], [("a", 1, "x"), ("a", 4, "q")], [("b", 1, "m"), ("a", 2, "xy")], [("c", 90, "")], [("a", 5, "xyzqé")], [("c", 200, "end")]]
    seen = []
    for rows in batches:
        df = spark.createDataFrame(rows, "k string, i bigint, t string").withColumn("ts", F.timestamp_seconds("i"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = R.ordered_delta_stream(R.stream_parquet(spark, source), "k", "i", "t", "ts", "30 seconds")
        seen.append(sorted(map(tuple, R.write_stream(stream, out, mark).collect())))
    first = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("a", 4, "q"), ("b", 1, "m"), ("b", 2, "n")]
    assert seen[0] == seen[1] == seen[2] == [] and seen[3] == first
    assert seen[5] == first  # what comes behind the watermark is dropped


def test_event_counts_over_two_runs(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for day, values in (("2024-01-01 10:00:00", [1.0, 2.0]), ("2024-01-01 11:00:00", [3.0])):
        df = spark.createDataFrame([("r", "score", day, v) for v in values], "run string, e string, ts string, score double")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(source)
        got = R.event_counts(R.stream_parquet(spark, source), "run", "e", "ts", out, mark).collect()
    assert [(r.run_id, r.event, r.n, r.last_score) for r in got] == [("r", "score", 3, 3.0)]


def test_late_events_count(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for day in ("2024-03-01", "2024-01-01", "2024-02-01"):
        df = spark.createDataFrame([("r", "e", f"{day} 10:00:00", 1.0)], "run string, e string, ts string, score double")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(source)
        got = R.event_counts(R.stream_parquet(spark, source), "run", "e", "ts", out, mark).collect()
    assert sorted(r.n for r in got) == [1, 1, 1]


def test_a_new_checkpoint_knows_what_is_done(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for mark, keys in (("m1", [1, 2]), ("m2", [3])):
        spark.createDataFrame([(k,) for k in keys], "k int").coalesce(1).write.mode("append").parquet(source)
        R.process_new(R.stream_parquet(spark, source), "k", lambda rows: rows.withColumn("n", F.lit(1)), out, str(tmp_path / mark))
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_second_batch_reads_the_index_not_the_results(spark, tmp_path, monkeypatch):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    plans = []

    def run(keys, checkpoint=mark):
        spark.createDataFrame([(k, f"text {k}") for k in keys], "k int, t string").coalesce(1).write.mode("append").parquet(source)

        def work(rows):
            plans.append(sorted(f.rsplit("/", 1)[0] for f in rows.inputFiles()))
            return rows.withColumn("n", F.length("t"))

        R.process_new(R.stream_parquet(spark, source), "k", work, out, checkpoint)
        return sorted(r.k for r in spark.read.parquet(out).collect())

    assert run(range(300)) == list(range(300)) and run([7, 300]) == list(range(301))
    read = [p for p in plans[1] if str(tmp_path / "out") in p]
    buckets = {p.rsplit("=", 1)[1] for p in read}
    assert read and all("/out_keys/" in p for p in read) and len(buckets) <= R.KEY_BUCKETS
    # A batch run again after its results were written, but not its keys, writes the same anew.
    name = next(n for n in R._batches(spark, out) if n.endswith("-1"))
    done = R.processed_keys(spark, out, "k", list(range(R.KEY_BUCKETS)), name)
    assert sorted(r.k for r in done.collect()) == list(range(300))
    for path in sorted((tmp_path / "out_keys" / f"batch={name}").rglob("*"), reverse=True):
        path.unlink() if path.is_file() else path.rmdir()
    (tmp_path / "out_keys" / f"batch={name}").rmdir()
    assert run([300, 301], str(tmp_path / "other")) == list(range(302))


def test_late_events_need_no_state(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    days = [("2024-03-01 09:00:00", 5.0), ("2024-01-01 10:00:00", 1.0), ("2024-03-01 08:00:00", 9.0), ("2024-01-01 12:00:00", 3.0), ("2024-01-01 12:00:00", 2.0)]
    for day, value in days:
        df = spark.createDataFrame([("r", "e", day, value)], "run string, e string, ts string, score double")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(source)
        got = R.event_counts(R.stream_parquet(spark, source), "run", "e", "ts", out, mark)
    assert sorted((str(r.window_start)[:10], r.n, r.last_score) for r in got.collect()) == [("2024-01-01", 3, 3.0), ("2024-03-01", 2, 5.0)]
    assert not (tmp_path / "mark" / "state").exists()


@pytest.mark.parametrize("size", ["40", "1000000"])
def test_lines_of_files_in_splits(spark, tmp_path, size):
    texts = {"a.md": "one\ntwo\r\nthree\rfour\n", "b.md": "", "c.md": "\n\nx", "d.md": "".join(f"line {k} é\n" for k in range(400)) + "end", "e.md": "\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = S.read_lines(spark, str(tmp_path))
        got = sorted((r.filename.rsplit("/", 1)[1], r.line_no, r.line) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    assert got == sorted((r.name, r.line_no, r.line) for r in documents.doc_lines(df, "name", "text").collect())


def test_entities_of_all_kinds(spark):
    page = "<p>caf&eacute; &#8217;x&#x1F642; &Uuml;ber &amp;lt; &nope; &#0; &lt;b&gt; &ntilde;&ccedil;</p>"
    got = spark.createDataFrame([(page,)], "html string").select(S.html_text("html")).first()[0]
    assert got == "café ’x\U0001f642 Über &lt; &nope; \ufffd <b> ñç"


def test_triple_escapes_and_rejects(spark):
    lines = [r'<a:s> <a:p> "caf\u00e9 \U0001F642 \t\"q\" \\n" .', "# note", "", "<a:s> <a:p> .", r"<a:\u00e9> <a:p> <a:o> ."]
    rows = spark.createDataFrame([("f", x) for x in lines], "f string, line string")
    got = [(r.subject, r.object) for r in S.parse_triples(rows, "f", "line").collect()]
    assert got == [("a:s", 'café \U0001f642 \t"q" \\n'), ("a:é", "a:o")]
    assert [r.line for r in S.rejected_triples(rows, "line").collect()] == ["<a:s> <a:p> ."]


def test_ingest_of_text_files_and_context(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name, text in (("b-file-2.md", "Loan terms\nmore\n\nRate rules\n"), ("a-1.md", "Loan terms\nfirst\n")):
        (tmp_path / "docs" / name).write_text(text)
    docs = S.read_documents(spark, str(tmp_path / "docs"))
    classes = spark.createDataFrame([("Loan", "loan terms"), ("Rate", "rate rules")], "n string, d string")
    store = Store(spark, str(tmp_path / "w"))
    jobs.ingest_documents(docs, classes, "n", ["d"], store, 10, 10).collect()
    mapping = {r.segment_id.rsplit("/", 1)[-1]: r.concept_name for r in store.read("concept_segment_mapping").collect()}
    assert mapping == {"a-1.md-0-0": "loan-terms", "b-file-2.md-0-0": "loan-terms", "b-file-2.md-0-1": "rate-rules"}
    asked = spark.createDataFrame([(1, "loan", "terms")], "query_id int, concept_type string, sub_query_string string")
    found = jobs.document_context(asked, store.read("concepts"), store.read("concept_segment_mapping"), store.read("text_segments"), 5).collect()
    # The first file by name is the older one.
    assert [(r.concept_name, r.segment_text) for r in found] == [("loan-terms", "Loan terms\nfirst\n---\nLoan terms\nmore\n")] or [
        r.segment_text.split("\n---\n")[0].strip() for r in found
    ] == ["Loan terms\nfirst"]


def test_keys_that_wait_send_no_frame():
    class State:
        exists = hasTimedOut = False

        def __init__(self, watermark):
            self.watermark = watermark

        def getCurrentWatermarkMs(self):
            return self.watermark

        def update(self, value):
            self.held = value

        def setTimeoutTimestamp(self, at):
            self.wakes = at

    batch = pd.DataFrame({"key": ["a", "a"], "seq": [2, 1], "at": [20, 10], "text": ["xy", "x"]})
    waits, ready = State(5), State(30)
    assert list(R._deltas_in_order(("a",), iter([batch]), waits)) == [] and waits.wakes == 10
    assert [tuple(r) for f in R._deltas_in_order(("a",), iter([batch]), ready) for r in f.itertuples(index=False)] == [("a", 1, "x"), ("a", 2, "y")]
