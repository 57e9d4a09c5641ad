"""Chunks, segments and intervals against plain loops."""

import random

from auditlake.operators import documents as D
from auditlake.operators import intervals as I


def loop_ranges(total, size):
    step = size - int(size * 0.1) or size
    if total == 0:
        return [(1, 1)]
    out, start = [], 1
    while True:
        end = min(start + size - 1, total)
        out.append((start, end))
        if end >= total:
            return out
        start += step


def test_chunk_ranges_match_the_loop(spark):
    totals = [0, 1, 4, 17, 18, 19, 20, 21, 99, 100, 101, 191, 1296]
    files = spark.createDataFrame([(t, t) for t in totals], "f int, total int")
    for size in (1, 2, 10, 20, 100):
        got = {}
        for r in D.chunk_ranges(files, "f", "total", size).orderBy("f", "chunk_no").collect():
            got.setdefault(r.f, []).append((r.start_line_no, r.end_line_no))
        assert got == {t: loop_ranges(t, size) for t in totals}
    assert len(loop_ranges(1296, 100)) == 15


def test_lines_of_chunks(spark):
    text = "".join(f"l{i}\n" for i in range(1, 48))
    docs = spark.createDataFrame([("a", text), ("b", ""), ("c", "one")], "f string, text string")
    numbered = D.doc_lines(docs, "f", "text")
    by_number = D.chunk_lines(numbered, 20)
    totals = numbered.select("f", "total_lines").distinct()
    by_join = D.lines_in_ranges(numbered, D.chunk_ranges(totals, "f", "total_lines", 20), "f", block=7)
    columns = ["f", "chunk_no", "line_no"]
    expected = {("c", 0, 1)} | {("a", k, n) for k, (s, e) in enumerate(loop_ranges(47, 20)) for n in range(s, e + 1)}
    assert {tuple(r) for r in by_number.select(*columns).collect()} == expected
    assert {tuple(r) for r in by_join.select(*columns).collect()} == expected
    first = by_number.filter("chunk_no = 1 AND f = 'a'").orderBy("line_no").first()
    assert (first.line_no, first.numbered_line) == (19, "0: l19")


def test_segments_cover_every_line(spark):
    text = "# T\na\nb\n\nc\nd\ne\nf\ng\n## U\nh\n\n\ni"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "\n\n")], "f bigint, text string")
    rows = D.segments(docs, "f", "text", 100, 3).orderBy("filename", "segment_start_line_no_global").collect()
    spans = [(r.segment_start_line_no_global, r.segment_end_line_no_global) for r in rows if r.filename == 1]
    assert spans == [(1, 3), (4, 4), (5, 7), (8, 9), (10, 12), (13, 13), (14, 14)]
    assert [r.segment_text for r in rows if r.filename == 1][0] == "# T\na\nb"
    assert [r.segment_id for r in rows if r.filename == 1][:2] == ["1-0-0", "1-0-1"]
    assert [(r.segment_start_line_no_global, r.segment_end_line_no_global) for r in rows if r.filename == 3] == [(1, 2)]


def test_four_lines_in_chunks_of_two(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\n")], "f bigint, text string")
    rows = D.segments(docs, "f", "text", 2, 1).collect()
    assert sorted((r.segment_start_line_no_global, r.segment_text) for r in rows) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def merge(spans):
    out = []
    for s, e in sorted(x for x in spans if x[0] <= x[1]):
        if out and out[-1][1] >= s:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_interval_union(spark):
    known = {"a": ([(1, 5), (10, 15)], 11), "b": ([(1, 10), (5, 15)], 15), "c": ([(20, 25), (1, 10), (5, 12)], 18), "d": ([(5, 1)], 0)}
    rnd = random.Random(3)
    files = {k: v for k, (v, _) in known.items()}
    for i in range(30):
        files[f"r{i}"] = [(s, s + rnd.randint(-2, 9)) for s in (rnd.randint(-20, 120) for _ in range(rnd.randint(1, 40)))]
    rows = spark.createDataFrame([(f, s, e) for f, v in files.items() for s, e in v], "f string, s bigint, e bigint")
    expected = {f: merge(v) for f, v in files.items() if merge(v)}
    for width in (1, 4, 1000):
        got = {}
        for r in I.merged_intervals(rows, "f", "s", "e", width).orderBy("f", "start_line").collect():
            got.setdefault(r.f, []).append((r.start_line, r.end_line))
        assert got == expected
        lengths = {r.f: r.lines_covered for r in I.covered_lines(rows, "f", "s", "e", width).collect()}
        assert lengths == {f: sum(e - s + 1 for s, e in v) for f, v in expected.items()}
    assert all(lengths.get(f, 0) == n for f, (_, n) in known.items())


def test_line_coverage_of_a_missing_or_empty_file(spark):
    segs = spark.createDataFrame([("a", 1, 2), ("a", 2, 4), ("b", 1, 1)], "f string, segment_start_line_no_global int, segment_end_line_no_global int")
    totals = spark.createDataFrame([("a", 8), ("z", 5)], "f string, total bigint")
    got = {r.f: (r.total_lines, r.lines_covered, r.coverage_pct) for r in I.line_coverage(segs, totals, "f", "total").collect()}
    assert got == {"a": (8, 4, 50.0), "b": (1, 1, 100.0)}
