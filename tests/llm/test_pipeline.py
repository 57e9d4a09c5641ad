"""The pipeline against a plain version of its stages, and the registered queries."""

import re
from collections import Counter

import brute
import pytest
from conftest import prose

import __spark_entry__ as entry
import corpus_pipeline
from auditlake.llm import line_dedup, quality
from auditlake.llm import sentencepiece_codec as codec


def passes(text):
    """All quality rules, one by one."""
    text = text or ""
    ws = brute.WORD.findall(text)
    if len(ws) < 50:
        return False
    windows = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    chars = sum(map(len, ws))
    return (
        100 * len(covered) <= 50 * len(ws)
        and 2.5 <= chars / len(ws) <= 12
        and sum(c in "#*$%&|<>" for c in text) / len(ws) <= 0.1
        and sum(c.isupper() for c in text) / chars <= 0.3
        and sum(c.isalpha() for c in text) / chars >= 0.6
        and len(set(ws) & set(quality.STOP_FORMS)) >= 2
        and (len(lines) - len(set(lines))) / len(lines) <= 0.5
        and sum(bool(re.match(r"\s*[-*•]", x)) for x in lines) / len(lines) <= 0.9
        and sum(x.rstrip(" \t\r\f").endswith(("...", "…")) for x in lines) / len(lines) <= 0.3
    )


def without_boilerplate(docs):
    pages = Counter(s for _, _, s in docs if s is not None)
    has = Counter((s, x) for _, t, s in docs if s is not None for x in set((t or "").split("\n")) if brute.WORD.search(x))
    drop = {k for k, n in has.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    out = []
    for i, t, s in docs:
        left = [x for x in (t or "").split("\n") if (s, x) not in drop]
        out.append((i, "\n".join(left) if t and any(map(brute.WORD.search, left)) else t, s))
    return out


def one_of_each(docs):
    fps = [brute.simhash(t, 3) for _, t, _ in docs]
    group = brute.groups(range(len(docs)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    best = {}
    for k, (i, _, _) in enumerate(docs):
        rank = (i is None, i or 0, k)
        best[group[k]] = min(best.get(group[k], rank), rank)
    return [docs[k] for *_, k in best.values()]


def clean(docs, items):
    def words(t):
        return re.findall(r"\w+", t.lower())

    def holds(text, item):
        seen = words(text or "")
        grams = {tuple(seen[k : k + 4]) for k in range(len(seen) - 3)}
        under = {k + j for k in range(len(item) - 3) if tuple(item[k : k + 4]) in grams for j in range(4)}
        return len(under) >= 0.6 * len(item)

    return [d for d in docs if not any(holds(d[1], words(t)) for t in items)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [prose(900 + k, 20) for k in range(3)]
    rows = []
    for k in range(24):
        text = f"{prose(k, 90)}\nthis menu line is on all of the pages\n{prose(100 + k, 60)}"
        rows.append((len(rows), text, "site" if k % 3 else "other"))
    base = rows[4][1]
    near = base.replace(base.split()[20], "changed", 1)
    rows += [(100, base, "s1"), (101, near, "s2"), (102, base, None), (None, base, "s3")]
    rows += [(130 + k, prose(60, 70) + f"\n{prose(61, 70)}", "copies") for k in range(4)]
    rows += [(110, prose(50, 40) + " " + items[1] + " " + prose(51, 60), "other"), (111, prose(52, 70) + " " + items[2][:60], "other")]
    rows += [(120, None, "site"), (121, "", None), (122, prose(53, 20), "site"), (123, ("same few words here " * 40).strip(), "site")]
    rows += [(124, prose(54, 80).upper(), "site"), (125, "the of " + "### $$$ " * 60, "site"), (126, prose(55, 5000), "other")]
    docs = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages_have_the_given_order_and_columns(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near duplicates", "benchmark", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_rows_are_those_of_the_plain_version(spark, corpus):
    folder, rows, items = corpus
    want = clean(one_of_each(without_boilerplate([d for d in rows if passes(d[1])])), items)
    data = codec.read_model()
    reference = codec._loaded(data)[2]
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str((r.doc_id, list(r.ids))) for r in got) == sorted(str((i, reference.encode(t))) for i, t, _ in want)
    assert all(r.parity and r.round_trip and r.n_tokens == len(r.ids) for r in got)
    kept = {r.doc_id for r in got}
    assert set(range(24)) | {130} <= kept and not kept & {131, 132, 133}
    assert 100 in kept and sorted(map(str, kept & {None, 102, 110, 120, 121, 122, 123, 124, 125})) == []


def test_queries_are_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
