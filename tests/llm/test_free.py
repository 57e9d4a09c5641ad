"""Language model, codec, SimHash, tiling, piece counts and suffix sorting against plain versions."""

import random
import zlib

import brute
import numpy as np
import pandas as pd
import pytest
from conftest import prose
from pyspark.sql import functions as F

from auditlake.llm import decontaminate, lm_score, piece_counts, simhash, suffix_dedup
from auditlake.llm import sentencepiece_codec as codec
from auditlake.llm.groups import components


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(docs, rows, order):
    train = [i is None or i % 3 != 0 for i, _ in rows]
    want = sorted((i is None, i or 0, t or "", *s) for (i, t), s in zip(rows, brute.lm_scores([t for _, t in rows], train, order, 7.0), strict=True))
    learn = F.col("doc_id").isNull() | (F.col("doc_id") % 3 != 0)
    found = lm_score.lm_score(docs, learn, ["doc_id", "text", "source"], order=order, mu=7.0, block_bytes=3000).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert [g[6:] for g in got] == [pytest.approx(w[6:], abs=1e-6) for w in want]


@pytest.mark.parametrize("order", [2, 3])
def test_long_texts_go_on_alone(monkeypatch, order):
    texts = [prose(1, 50), prose(2, 3000), "", prose(3, 900), prose(2, 2000), None, "one"]
    train = [k % 3 != 1 for k in range(len(texts))]
    want = [x[-1] for x in brute.lm_scores(texts, train, order, 7.0)]
    block = lm_score._Block(texts, order)
    counts = block.counts(np.array(train))
    automaton = lm_score.Automaton(block, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), 7.0)
    for few in (0, 2, 4, 100):
        monkeypatch.setattr(lm_score, "FEW", few)
        assert automaton.score(block) == pytest.approx(want)


def test_words_of_one_hash_keep_their_order(monkeypatch):
    monkeypatch.setattr(lm_score.xxhash, "xxh64_intdigest", lambda w: len(w))
    names = [b"\t", b"bb", b"a", b"aa", b"c", b"ddd"]
    hashes = np.array([len(n) for n in names], dtype=np.uint64)
    assert [names[i] for i in lm_score._by_hash(hashes, names)] == [b"a", b"c", b"aa", b"bb", b"ddd"]


def test_lm_without_training_rows(docs):
    found = lm_score.lm_score(docs, F.lit(False), ["doc_id"]).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score == 0 for r in found)
    assert lm_score.lm_score(docs.limit(0), F.lit(True), ["doc_id"]).count() == 0


def test_lm_sums_to_one():
    """Over the words of the block, and one unknown, the probabilities after any history add up to one."""
    texts = [prose(k, 30) for k in range(6)]
    words = sorted({w for t in texts for w in t.split()})
    for history in (["of"], ["of", "the"], ["zzz"]):
        block = lm_score._Block([*texts, *[" ".join([*history, w]) for w in words], " ".join([*history, "unseen"]), " ".join(history)], 3)
        counts = block.counts(np.arange(len(block.sizes)) < len(texts))
        n, v = int(counts[0].sum()), int((counts[0] > 0).sum())
        scores = lm_score.Automaton(block, counts, n, v, 2.0).score(block)[len(texts) :]
        # Each scored text ends, so take the parts: P(history, w, end) summed needs only w's share; compare with the recursion instead.
        want = brute.lm_scores([*texts, *[" ".join([*history, w]) for w in words], " ".join([*history, "unseen"]), " ".join(history)], [True] * len(texts) + [False] * (len(words) + 2), 3, 2.0)
        assert scores == pytest.approx([w[4] for w in want[len(texts) :]], abs=1e-9)


def test_held_out_text_like_the_training_scores_above_the_base(spark):
    df = spark.createDataFrame([(i, " ".join(["the river of stone and table"] * (3 + i % 5))) for i in range(40)], "doc_id long, text string")
    found = lm_score.lm_score(df, F.col("doc_id") < 30, ["doc_id"], mu=5.0).filter("doc_id >= 30").collect()
    assert all(r.score > r.base_score for r in found)


TEXTS = ["", " ", "  a  b ", "tab\there\nline\r\n", "日本語 текст \U0001f642", "<s> <unk> <0x0A>", "\x00x", "a" * 3000, "x y " * 5000, "1234567 8.9"]


def test_codec_parity_and_round_trip(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, n_tokens long")
    found = codec.encode(df).collect()
    data = codec.read_model()
    reference = codec._loaded(data)[2]
    for r in found:
        t = r.text or ""
        assert r.ids == reference.encode(t) and r.decoded == t and r.parity and r.round_trip and r.n_tokens == len(r.ids)
    assert {r.doc_id: r.back for r in codec.decode(codec.encode(df, outputs=("ids",)), out="back").collect()} == {i: t for i, t in enumerate([*TEXTS, ""])}
    assert codec.encode(df.limit(0)).count() == 0


def test_ids_are_the_tokenizers_own(monkeypatch):
    """Where the libraries differ, the ids stay those of the tokenizer and the text is marked."""
    data = codec.read_model()
    tokenizer, _, reference = codec._loaded(data)
    rnd = random.Random(4)
    parts = ["river", "Stone", " ", "  ", "\n", "\t", "▁", "é", "e\u0301", "\U0001f642", "ﬁ", "\x00", "\u00a0", "don't", "123", "日本"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(400)]
    monkeypatch.setattr(codec, "BATCH_CHARS", 500)
    got = [(x, same) for ids, agree in codec.encode_batch(data, texts) for x, same in zip(ids, agree, strict=True)]
    assert [x for x, _ in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [same for _, same in got] == [x == reference.encode(t) for (x, _), t in zip(got, texts, strict=True)]


def greedy_bpe(word, model):
    """Ids of a word by the merge rule alone: the best-scored pair of neighbours first, the leftmost of equals."""
    rank = {p: (-s, i) for i, (p, s) in enumerate(zip(model.pieces, model.scores, strict=True))}
    pieces = list(word)
    while True:
        offers = [(rank[a + b][0], k) for k, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False)) if a + b in rank]
        if not offers:
            break
        k = min(offers)[1]
        pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]
    ids = {p: i for i, p in enumerate(model.pieces)}
    return [i for p in pieces for i in ([ids[p]] if p in ids else [ids[f"<0x{b:02X}>"] for b in p.encode()])]


def test_ids_are_those_of_the_merge_rule():
    data = codec.read_model()
    model, rnd = codec.parse_model(data), random.Random(6)
    for _ in range(300):
        word = "".join(rnd.choices("abcdeinorstuvé日", k=rnd.randint(1, 9)))
        assert next(codec.encode_batch(data, [word]))[0][0] == greedy_bpe(codec.MARK + word, model), word


def test_marker_reads_as_space_and_bad_bytes_decode():
    data = codec.read_model()
    ids = next(codec.encode_batch(data, ["a▁b"]))[0][0]
    assert codec.decode_batch(data, [ids]) == ["a b"]
    assert "�" in codec.decode_batch(data, [[3 + 0xC3]])[0]


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(fields):
    import struct

    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
        elif isinstance(value, float):
            out += _varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += _varint(number << 3) + _varint(value)
    return out


def test_unigram_model_with_scores_and_byte_fallback():
    """A small unigram model written by hand: both libraries agree."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -2.0), ("▁the", -1.5), ("▁r", -3.0), ("iver", -2.5), ("er", -2.2), ("i", -4.0), ("v", -4.1), ("t", -4.2), ("h", -4.3), ("e", -3.9), ("r", -4.4))]
    data = b"".join(_message([(1, _message([(1, p.encode()), (2, s), (3, t)]))]) for p, s, t in pieces)
    data += _message([(2, _message([(3, 1), (35, 1)])), (3, _message([(1, b"identity"), (3, 1), (4, 0), (5, 1)]))])
    model = codec.parse_model(data)
    assert model.kind == codec.UNIGRAM and model.byte_fallback and not model.collapse_spaces
    texts = ["the river", "river the  the", "rie é", "", "tthhee"]
    for ids, agree in codec.encode_batch(data, texts):
        assert all(agree) and codec.decode_batch(data, ids) == texts


def test_piece_counts(spark, docs, rows):
    first, rest = piece_counts.vocabulary(codec.read_model())
    want = []
    for i, t in rows:
        n = [brute.greedy_pieces(w, first, rest) for w in brute.WORD.findall(t or "")]
        want.append(str((i, len(n), sum(map(abs, n)), sum(x < 0 for x in n))))
    found = piece_counts.piece_counts(docs)
    assert found.columns == ["doc_id", "text", "source", "n_words", "n_pieces", "n_unknown"]
    assert sorted(str((r.doc_id, r.n_words, r.n_pieces, r.n_unknown)) for r in found.collect()) == sorted(want)
    assert piece_counts.piece_counts(docs.limit(0)).count() == 0


def test_automaton_is_greedy():
    rnd = random.Random(5)
    for _ in range(400):
        first = {"".join(rnd.choices("abc", k=rnd.randint(1, 4))) for _ in range(6)}
        rest = {"".join(rnd.choices("abc", k=rnd.randint(1, 4))) for _ in range(8)}
        automaton = piece_counts.LongestMatch(first, rest)
        for _ in range(10):
            word = "".join(rnd.choices("abcd", k=rnd.randint(1, 9)))
            assert automaton.count(word) == brute.greedy_pieces(word, first, rest)


def test_simhash_groups(docs, rows):
    prints = [brute.simhash(t, 3) for _, t in rows]
    group = brute.groups(range(len(rows)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    want = sorted(str((i, f"{p:016x}", least.get(group[k]))) for k, ((i, _), p) in enumerate(zip(rows, prints, strict=True)))
    assert sorted(str(tuple(r)) for r in simhash.link_groups(docs, "doc_id").collect()) == want
    assert simhash.link_groups(docs.limit(0), "doc_id").count() == 0


@pytest.mark.parametrize(("tile", "bands"), [(4096, 4), (4096, 5), (512, 4)])
def test_links_span_all_components(spark, tile, bands):
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-(2**62), 2**62, 60)
    values = {int(c) for c in centres}
    for c in centres[:20].tolist():
        for _ in range(30):
            c ^= 1 << int(rnd.integers(0, 63))
            values.add(c)
    values |= set(range(600))
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    links = [(r.a, r.b) for r in simhash.fingerprint_links(fps, 3, bands, tile).collect()]

    def near(a, b):
        return ((a ^ b) & (2**64 - 1)).bit_count() <= 3

    assert all(near(a, b) for a, b in links)
    beside = {v: set() for v in values}
    for a, b in links:
        beside[a].add(b)
        beside[b].add(a)
    ordered = np.array(sorted(values), dtype=np.int64).view(np.uint64)
    close = np.bitwise_count(ordered[:, None] ^ ordered[None, :]) <= 3
    names = sorted(values)
    of = {v: k for k, v in enumerate(names)}
    want = brute.groups(range(len(names)), lambda a, b: close[a, b])
    got = brute.groups(range(len(names)), lambda a, b: names[b] in beside[names[a]])
    assert {v: want[of[v]] for v in names} == {v: got[of[v]] for v in names}


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (100, 102), (200, 200)] + [(300, 300 + k) for k in range(1, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, **{300 + k: 300 for k in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def one_of_each(rows):
    """(no id, id) of the row that stays of each group of fingerprints within three bits."""
    fps = [brute.simhash(t, 3) for _, t in rows]
    group = brute.groups(range(len(rows)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    least = {}
    for k, (i, _) in enumerate(rows):
        rank = (i is None, i or 0)
        least[group[k]] = min(least.get(group[k], rank), rank)
    return sorted(least.values())


def test_near_dedup(spark, docs, rows):
    named = docs.withColumns({n: F.lit(1) for n in ("_fp", "_least", "_often", "fp", "root")})
    kept = simhash.near_dedup(named, "doc_id")
    assert kept.columns == named.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == one_of_each(rows)
    assert simhash.near_dedup(docs.limit(0), "doc_id").count() == 0


def test_near_dedup_keeps_one_of_many_copies(spark):
    """Copies under many ids, under one id, and under none; texts of one id that differ; rows of a chain of near copies."""
    base = prose(1, 300)
    rows = [(k, base) for k in range(40)] + [(7, base)] * 20 + [(None, base)] * 5 + [(50, prose(2, 200))] * 12 + [(None, prose(3, 200))] * 4
    rows += [(60, prose(4, 150)), (60, prose(5, 150)), (60, prose(5, 150))]
    words = prose(6, 900).split()
    for k in range(6):
        words[100 * k + 50] = f"changed{k}"
        rows.append((100 - k, " ".join(words)))
    rnd = random.Random(3)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.near_dedup(df, "doc_id").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == one_of_each(rows)
    assert {(r.doc_id, r.text) for r in kept} >= {(0, base), (50, prose(2, 200)), (None, prose(3, 200)), (60, prose(4, 150)), (60, prose(5, 150))}
    groups = {r.doc_id: r.component_id for r in simhash.link_groups(df, "doc_id").collect()}
    assert {groups[r.doc_id] for r in kept if r.doc_id is not None} == {r.doc_id for r in kept if r.doc_id is not None}


def item(seed, n):
    return " ".join(f"w{(seed * 37 + k * 11) % 997}" for k in range(n))


def test_long_items_and_repeated_words():
    words = [f"u{k}" for k in range(3000)]
    changed = [f"z{k}" if k % 40 == 0 else w for k, w in enumerate(words)]
    found = decontaminate.Index([(7, " ".join(words))], 4, 0.6).matches("x " * 500 + " ".join(changed))
    assert found == [(7, 0.975, 75, 39)]
    repeated = decontaminate.Index([(0, "a " * 4000), (1, "a b " * 2000)], 4, 0.6)
    assert repeated.matches("a " * 40_000) == [(0, 1.0, 1, 4000)]
    assert repeated.matches("b a " * 30_000)[0][:2] == (1, 1.0) and repeated.matches("a b b " * 9000) == []


def test_window_hashes_are_those_of_equal_words():
    rnd = random.Random(3)
    ids = np.array([rnd.randrange(3) for _ in range(200)], dtype=np.int64)
    for size in (1, 2, 5, 17, 200, 201):
        got = decontaminate._Rolling(ids).windows(size)
        windows = [tuple(ids[k : k + size]) for k in range(max(0, 201 - size))]
        assert len(got) == len(windows)
        assert len(set(got.tolist())) == len(set(windows)) == len(set(zip(got.tolist(), windows, strict=True)))


def test_decontamination(spark):
    bench = spark.createDataFrame([(0, item(0, 30)), (1, item(3, 16)), (2, "too short"), (3, None), (4, item(3, 16))], "item_id long, text string")
    w = item(0, 30).split()
    rows = [
        (0, "so " + item(0, 30) + " end"), (1, " ".join(w[15:]) + " and " + " ".join(w[:15])), (2, " ".join(w[:10])), (3, prose(1, 200)), (4, None),
        (5, ""), (6, item(3, 16).upper().replace(" ", ", ")), (7, "too short"), (8, "x " * 9000 + item(0, 30)), (9, " ".join(reversed(w))),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chars in (decontaminate.BLOCK_CHARS, 10):
        found = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles) for r in decontaminate.contaminated(docs, bench, ["doc_id"], block_chars=chars).collect()}
        assert found == {(0, 0): (1.0, 1), (1, 0): (1.0, 2), (6, 1): (1.0, 1), (6, 4): (1.0, 1), (8, 0): (1.0, 1)}
        clean = decontaminate.drop_contaminated(docs, bench, block_chars=chars)
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5, 7, 9]
    assert decontaminate.contaminated(docs, bench.limit(0), ["doc_id"]).count() == 0
    assert decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


def greedy_tiles(doc, item, least):
    """The definition: all longest matches first, from the left."""
    used_d, used_i, out = set(), set(), []
    for size in range(min(len(doc), len(item)), least - 1, -1):
        for a in range(len(doc) - size + 1):
            for b in range(len(item) - size + 1):
                cells_d, cells_i = set(range(a, a + size)), set(range(b, b + size))
                if not (cells_d & used_d or cells_i & used_i) and all(doc[a + k] == item[b + k] >= 0 for k in range(size)):
                    used_d |= cells_d
                    used_i |= cells_i
                    out.append((a, b, size))
    return out


def test_greedy_tiles():
    rnd = np.random.default_rng(4)
    for _ in range(60):
        doc, item_ = rnd.integers(-1, 4, rnd.integers(0, 30)), rnd.integers(0, 4, rnd.integers(0, 14))
        assert decontaminate.greedy_tiles(doc, item_, 2) == greedy_tiles(doc, item_, 2)


def as_rows(df):
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect())


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_repeats(spark, docs, rows, hot):
    found = suffix_dedup.remove_repeats(docs, "doc_id", hot=hot, keep_bytes=False)
    assert as_rows(found) == sorted(map(str, brute.repeats(rows, 50)))
    rnd = random.Random(3)
    texts = []
    for _ in range(80):
        t = rnd.choice([None, "", "".join(rnd.choices("ab\0é", k=rnd.randint(0, 200))), "ab" * rnd.randint(1, 90), "a" * rnd.randint(1, 300)])
        texts.append((rnd.choice([None, -2, 1, 2, 3, 4, 5, 6, 7]), t))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = suffix_dedup.remove_repeats(df, "doc_id", match=12, anchor=5, hot=hot)
    assert as_rows(found) == sorted(map(str, brute.repeats(texts, 12)))
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in found.collect())
    assert suffix_dedup.remove_repeats(df.limit(0), "doc_id").count() == 0


def test_suffix_order_is_the_order_of_bytes():
    rnd = np.random.default_rng(6)
    for _ in range(20):
        n = int(rnd.integers(0, 60))
        rows = rnd.integers(0, 3, (n, 7)).astype(np.uint8)
        group = np.sort(rnd.integers(0, 5, n))
        order, common = suffix_dedup.suffix_order(rows, group)
        assert [(int(group[k]), bytes(rows[k])) for k in order] == sorted((int(g), bytes(r)) for g, r in zip(group, rows, strict=True))
        for k in range(1, n):
            a, b = order[k - 1], order[k]
            same = next((x for x in range(7) if rows[a][x] != rows[b][x]), 7)
            assert common[k] == (same if group[a] == group[b] else -1)


def test_a_collision_is_mended(monkeypatch):
    """Hashes that take all rows for equal must not change the order."""
    monkeypatch.setattr(suffix_dedup, "_prefix_hashes", lambda rows: np.zeros((len(rows), rows.shape[1] + 1), dtype=np.uint64))
    rows = np.array([[2, 1], [1, 1], [1, 0]], dtype=np.uint8)
    order, common = suffix_dedup.suffix_order(rows, np.zeros(3, dtype=np.int64))
    assert order.tolist() == [2, 1, 0] and common.tolist() == [-1, 1, 0]


def test_hashes_and_minima_step_by_step(monkeypatch):
    """Steps smaller than the data give what one step gives: equal pieces equal hashes, and every window its smallest."""
    monkeypatch.setattr(suffix_dedup, "_STEP", 7)
    rnd = np.random.default_rng(8)
    for size in (0, 1, 6, 7, 8, 14, 40):
        data = rnd.integers(0, 2, size).astype(np.uint8)
        rolling = suffix_dedup.Rolling(data, suffix_dedup._BASES[0])
        for width in range(1, min(size, 9) + 1):
            hashes = np.concatenate([part for _, part in rolling.pieces(width)])
            pieces = [bytes(data[k : k + width]) for k in range(size - width + 1)]
            assert len(set(zip(pieces, hashes.tolist(), strict=True))) == len(set(pieces)) == len(set(hashes.tolist()))
            assert rolling.at(np.arange(len(pieces)), np.full(len(pieces), width)).tolist() == hashes.tolist()
            assert suffix_dedup._sliding(data, width, np.minimum).tolist() == [min(piece) for piece in pieces]


def test_equal_entries_are_told_by_bytes_where_hashes_lie():
    full = np.array([[2, 1, 1, 1], [1, 1, 1, 1], [2, 1, 1, 1], [3, 1, 1, 1]], dtype=np.uint8)
    keys = np.array([5, 5, 5, 4], dtype=np.uint64)
    for hashes in (np.array([9, 8, 9, 9], dtype=np.uint64), np.zeros(4, dtype=np.uint64)):
        first, entry = suffix_dedup._entries(keys, full, hashes)
        assert len(first) == 3 and keys[first].tolist() == [4, 5, 5]
        assert (full[first][entry] == full).all() and (keys[first][entry] == keys).all()


def test_entries_alone_at_their_anchor_are_not_sorted(monkeypatch):
    sorted_rows = []
    real = suffix_dedup.earlier_strings
    monkeypatch.setattr(suffix_dedup, "earlier_strings", lambda rows, *rest: sorted_rows.append(len(rows)) or real(rows, *rest))
    rows = np.zeros((4, 4 + 2 + 2), dtype=np.uint8)
    rows[:, -2], rows[:, -1] = 4, 2
    keys, ids = np.array([3, 5, 5, 9], dtype=np.uint64), np.array([1, 1, 2, 2], dtype=np.uint64)
    frame = pd.DataFrame(
        [(0, 0, 1, zlib.compress(rows.tobytes()), suffix_dedup.pack(ids) + suffix_dedup.pack_sorted(keys))], columns=["block", "shard", "kind", "data", "numbers"]
    )
    found = suffix_dedup._answer_strings(4, 2)((0,), frame)
    assert sorted_rows == [2] and suffix_dedup.unpack(found["data"][0]).tolist() == [0, 0, 0b111, 0]


def test_merges_take_whole_texts_and_not_word_by_word():
    data = codec.read_model()
    assert codec.build_tokenizer(codec.parse_model(data)).pre_tokenizer is None
    rnd = random.Random(11)
    parts = ["the", "bank", " ", "   ", "▁", "▁▁", "\n", "é", "漢字", "😀", "\x00", "aaaa", "Ünïcode", "1234", "\t"]
    texts = ["", " ", "▁", *("".join(rnd.choices(parts, k=rnd.randint(1, 60))) for _ in range(300)), "the bank " * 5_000, "a" * 20_000]
    reference = codec._loaded(data)[2]
    for ids, agree in codec.encode_batch(data, texts):
        assert all(agree)
        texts, block = texts[len(ids) :], texts[: len(ids)]
        assert ids == reference.encode(block)
    assert not texts
