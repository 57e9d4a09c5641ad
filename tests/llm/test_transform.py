"""Fill-in-middle, WARC archives and importance resampling against plain versions."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import fill_middle, resample, warc
from auditlake.session import fresh_path, materialize


def random_text(rnd, size):
    return "".join(rnd.choice(["a", "b", "\n", "é", "\U0001f642", " the same passage again \n", "<"]) for _ in range(size))


# Fill-in-middle


def plain_fim(identity, text, seed=7, fim=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if identity is None else identity}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim:
        return identity, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return identity, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return identity, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("seed", range(5))
def test_chunks_make_up_the_text(seed):
    rnd = random.Random(seed)
    data = [random_text(rnd, 40_000).encode(), b"#" * 100_000, bytes(rnd.randrange(256) for _ in range(50_000)), b"", b"x"][seed]
    found = list(fill_middle.chunks(data))
    assert b"".join(found) == data and all(0 < len(c) <= fill_middle.MOST for c in found)


def test_chunks_follow_the_content(monkeypatch):
    rnd = random.Random(5)
    passage = bytes(rnd.randrange(256) for _ in range(20_000))
    memo = fill_middle.Memo()
    for front in (b"", b"another beginning"):
        for c in fill_middle.chunks(front + passage):
            memo.summary(c)
    assert memo.hits > 15  # only the chunks at the front differ
    whole = list(fill_middle.chunks(passage))
    monkeypatch.setattr(fill_middle, "SLICE", 1000)
    assert list(fill_middle.chunks(passage)) == whole


def test_equal_hashes_do_not_mix_chunks(monkeypatch):
    monkeypatch.setattr(fill_middle.xxhash, "xxh3_64_intdigest", lambda c: 1)
    memo, rnd = fill_middle.Memo(), random.Random(2)
    for _ in range(20):
        text = random_text(rnd, rnd.randrange(300))
        n, _, p, m = fill_middle.cut(text.encode(), 10, 3, memo)
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        a, b = sorted((10 % (len(units) + 1), 3 % (len(units) + 1)))
        assert (n, p, m) == (len(units), len("".join(units[:a])), len("".join(units[a:b])))


def test_sentinel_across_chunks_is_seen(monkeypatch):
    for cut_at in range(1, 6):
        text = b"ab<M>cd"
        monkeypatch.setattr(fill_middle, "chunks", lambda d, k=cut_at: [d[:k], d[k : k + 1], d[k + 1 :]])
        assert fill_middle.cut(text, 0, 0, fill_middle.Memo())[1]
    monkeypatch.setattr(fill_middle, "chunks", lambda d: [d[:3], d[3:]])
    assert not fill_middle.cut(b"ab<Mx>d", 0, 0, fill_middle.Memo())[1]


@pytest.mark.parametrize("fim,spm", [(100, 50), (40, 0), (0, 100), (100, 100)])
def test_fill_in_middle(spark, docs, rows, fim, spm):
    rnd = random.Random(8)
    more = [(100 + i, random_text(rnd, rnd.randrange(2000))) for i in range(40)]
    more += [(200, "has <P> inside\n"), (201, "\n"), (202, "\n\nx"), (203, "<<S\nP>"), (204, "a\n" * 40_000)]
    df = docs.withColumn("FORM", F.lit("x")).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    done = fill_middle.fill_in_middle(df, "doc_id", fim_percent=fim, spm_percent=spm)
    assert done.columns == [*docs.columns, "n", "form", "prefix_chars", "middle_chars", "fim_text"]
    done = done.withColumn("again", fill_middle.restored(F.col("fim_text"), F.col("form"))).collect()
    got = sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text) for r in done)))
    assert got == sorted(repr(plain_fim(i, t, 7, fim, spm)) for i, t in [*rows, *more])
    assert all(r.again == (r.text or "") for r in done)
    assert fill_middle.fill_in_middle(docs.limit(0), "doc_id").count() == 0


# WARC

FAKE = "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (5, "http://a/", "p" * 100), (3, "http://b/", "p" * 100), (9, None, "p" * 100), (4, "http://c/", "p" * 99), (2, "http://d/", "p" * 99),
    (7, "http://e/\r\nWARC-Type: revisit", FAKE), (8, "http://f/é", FAKE), (1, "http://g/", None), (6, "http://h/", ""), (10, "http://i/", "é" * 60),
    (11, "http://j/", "é" * 60), (11, "http://j/", "é" * 60), (None, "http://k/", "q" * 200), (12, "http://l/", "q" * 200), (None, "http://m/", "r" * 200),
    (13, "http://n/", "long\n" * 300_000),
]


def page_records(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("x"))
    return warc.as_records(df, "page_id", "url", "html")


def plain_warc(rows):
    groups, out = {}, []
    for k, (i, _, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((i is None, i or 0, k))
    for body, members in groups.items():
        first = min(members)
        for m in members:
            i, again = rows[m[2]][0], len(body) >= 100 and m != first
            out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", rows[first[2]][0] if again else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("small", [True, False])
def test_archive_round_trip(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(warc, "is_small", lambda df: False)
        monkeypatch.setattr(warc, "HOT_ROWS", 1)
        monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    path = warc.write_archive(warc.deduplicated(page_records(spark)), fresh_path(spark, "warc"))
    read = materialize(warc.read_archive(spark, path), "read")
    done = warc.resolved(read).collect()
    got = sorted(
        repr((r.identity and int(r.identity), r.payload_bytes, r.payload_digest, r.record_type, r.original and int(r.original))) for r in done
    )
    assert got == plain_warc(PAGES)
    assert all(r.digest_ok if r.record_type == "response" else r.original_ok and r.payload is None for r in done)
    bodies = Counter(bytes(r.payload) for r in done if r.record_type == "response")
    assert bodies[FAKE.encode()] == 1 and bodies[b""] == 2 and bodies[b"p" * 99] == 2 and bodies[PAGES[-1][2].encode()] == 1
    assert len({r.record_id for r in done}) == len(PAGES)


def test_revisits_of_an_archive_are_resolved_anew(spark):
    """A second crawl joined to the first one's archive: revisits read from it keep or change what they name."""
    path = warc.write_archive(warc.deduplicated(page_records(spark)), fresh_path(spark, "warc"))
    first = warc.read_archive(spark, path).drop("digest_ok").withColumn("identity", F.col("identity").cast("long"))
    lost = first.filter("record_type = 'revisit'").limit(1).selectExpr(
        "'urn:x' record_id", "99L identity", "record_type", "target_uri", "date", "repeat('0', 64) payload_digest", "500L payload_bytes",
        "'urn:gone' refers_to", "payload",
    )
    second = page_records(spark, [(0, "http://z/", "p" * 100), (50, "http://z/2", "q" * 200)])
    both = materialize(first.unionByName(second.withColumn("payload", F.col("payload").cast("binary"))).unionByName(lost), "both")
    path = warc.write_archive(warc.deduplicated(both), fresh_path(spark, "warc"))
    heads = materialize(warc.read_archive(spark, path, payloads=False), "heads")
    found = {(r.identity, r.record_id): r for r in warc.resolved(heads).collect()}
    told = {}
    for (i, _), r in found.items():
        told.setdefault(i, set()).add((r.record_type, r.original, r.original_ok))
    assert told["0"] == {("response", None, None)} and told["3"] == told["5"] == told["9"] == {("revisit", "0", True)}
    assert told["50"] == {("revisit", "12", True)} and told["12"] == {("response", None, None)}
    assert told["99"] == {("revisit", None, False)}


def test_broken_archives_raise():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <u>\r\nContent-Length: 7\r\n\r\nH\r\n\r\nab\r\n\r\n"
    other = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    found = list(warc.parse_archive(gzip.compress(good) + gzip.compress(other) + gzip.compress(good)))
    assert [(r[0], r[6], r[8]) for r in found] == [("u", 2, b"ab")] * 2
    for bad in (b"hello\r\n", good[:-6], good.replace(b"Length: 7", b"Length: 6")):
        with pytest.raises(ValueError):
            list(warc.parse_archive(bad))


def test_empty_archive(spark):
    path = warc.write_archive(warc.deduplicated(page_records(spark, PAGES[:1]).limit(0)), fresh_path(spark, "warc"))
    assert warc.resolved(warc.read_archive(spark, path)).count() == 0


# Resampling


def plain_features(text, order):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return ws, [" ".join(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1)]


def plain_resample(docs, target, order, buckets, least, percent, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, t in docs for f in plain_features(t, order)[1])
    t = Counter(bucket(f) for x in target for f in plain_features(x, order)[1])
    all_s, all_t, out = sum(s.values()), sum(t.values()), []
    for i, text in docs:
        ws, fs = plain_features(text, order)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(ws), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("order,buckets,least,percent", [(1, 10_000, 20, 10), (3, 97, 1, 50), (2, 1000, 0, 100), (1, 50, 20, 0)])
def test_resample(spark, docs, rows, monkeypatch, order, buckets, least, percent):
    rnd = random.Random(3)
    more = [(1000 + i // 3, brute.sha(str(i)) + " " + " ".join(rnd.choices(["River", "stone", "x9", "é", "a-b", "\x00"], k=rnd.randrange(60)))) for i in range(60)]
    target = ["river stone again", None, "", "x9 x9 stone É"]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    monkeypatch.setattr(resample, "BATCH_BYTES", 300)
    monkeypatch.setattr(resample.features, "__defaults__", (300,))
    done = resample.resample(df, bench, "doc_id", order=order, buckets=buckets, least_words=least, percent=percent)
    assert sorted(done.columns) == sorted(["doc_id", "source", "n_words", "n_features", "weight", "score", "rank"])
    got = done.collect()
    want = plain_resample([*rows, *more], target, order, buckets, least, percent)
    # Repeated rows share a score: ranks among them are interchangeable, so their places are compared as a set.
    assert sorted(repr((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank)) for r in got) == sorted(repr(tuple(r)) for r in want)


@pytest.mark.parametrize("order", [1, 2, 4])
@pytest.mark.parametrize("limit", [5, 40, 100_000])
def test_features_of_any_batch(order, limit):
    rnd = random.Random(order)
    texts = [" ".join(rnd.choices(["a", "bb", "CCC", "é", "0", "-"], k=rnd.randrange(30))) for _ in range(30)] + [None, "", "w" * 200, "a b " * 50]
    got = Counter()
    for _, owner, found in resample.features([None if t is None else t.encode() for t in texts], order, 1 << 32, limit):
        got.update(zip(owner.tolist(), found.tolist(), strict=True))
    want = Counter((k, zlib.crc32(f.encode())) for k, t in enumerate(texts) for f in plain_features(t, order)[1])
    assert got == want


def test_resample_draws_what_is_like_the_target(spark):
    rnd = random.Random(6)
    near, far = "river stone cloud maple table window".split(), "tax form audit bank rate loan".split()
    rows = [(i, " ".join(rnd.choices(near if i % 4 == 0 else far, k=40))) for i in range(400)]
    df, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(" ".join(near * 100),)], "text string")
    drawn = [r.doc_id for r in resample.resample(df, target, "doc_id", percent=20).filter("rank is not null").collect()]
    assert len(drawn) == 80 and np.mean([i % 4 == 0 for i in drawn]) > 0.9
    assert resample.resample(df.limit(0), target, "doc_id").count() == 0
    assert resample.resample(df, target.limit(0), "doc_id").filter("rank is not null").count() == 40
