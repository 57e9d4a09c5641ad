"""Topic segments and condensing by weight against plain loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from auditlake.operators import cohesion, context, documents


def plain_starts(body, window, least_depth, letters=4):
    sets = [{w for w in re.findall(r"\w+", x.lower()) if len(w) >= letters} for x in body]
    values = []
    for g in range(len(body) - 1):
        a, b = set().union(*sets[max(0, g + 1 - window) : g + 1]), set().union(*sets[g + 1 : g + 1 + window])
        values.append(math.floor(1000 * len(a & b) / math.sqrt(len(a) * len(b)) + 1e-9) if a & b else 0)
    depths = []
    for g, v in enumerate(values):
        left = right = g
        while left > 0 and values[left - 1] >= values[left]:
            left -= 1
        while right < len(values) - 1 and values[right + 1] >= values[right]:
            right += 1
        depths.append(values[left] + values[right] - 2 * v)
    cuts = [0] if body else []
    for i in range(1, len(body)):
        g = i - 1
        deep = depths[g] >= least_depth and depths[g] * len(depths) > sum(depths)
        after = next((v for v in values[g + 1 :] if v != values[g]), 0)
        if re.match(r"#{1,6}\s", body[i]) or (g > 0 and values[g - 1] > values[g] and after > values[g] and deep):
            cuts.append(i)
    return cuts


@pytest.mark.parametrize("window,least", [(1, 0), (3, 150), (5, 400)])
def test_topic_starts(spark, window, least):
    rnd = random.Random(window)
    topics = [["loan", "credit", "rate", "bank"], ["river", "stone", "cloud"], ["Größe", "weiß", "straße"], ["a", "of"]]
    bodies = [[], [""], ["one line"], ["# Head", "# Head"]]
    for _ in range(60):
        body = []
        for _ in range(rnd.randint(1, 5)):
            topic = rnd.choice(topics)
            body += [" ".join(rnd.choices(topic, k=rnd.randint(0, 6))) for _ in range(rnd.randint(1, 7))]
        bodies.append(body + rnd.choice([[], ["## Title here", "loan"]]))
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body array<string>")
    got = {r.k: list(r.s) for r in df.select("k", cohesion.cohesive_starts(window, least)(F.col("body")).alias("s")).collect()}
    assert got == {k: plain_starts(b, window, least) for k, b in enumerate(bodies)}


def test_topic_segments_cover_each_line_once(spark):
    loan = [f"the loan of the borrower has interest rate {k}" for k in range(6)]
    river = [f"stones along that river under clouds {k}" for k in range(6)]
    docs = spark.createDataFrame([(1, "\n".join(loan + river)), (2, ""), (3, "x\n" * 50)], "id long, text string")
    rows = documents.segments(docs, "id", "text", 100, 20, cohesion.cohesive_starts()).collect()
    spans = sorted((r.filename, r.segment_start_line_no_global, r.segment_end_line_no_global) for r in rows)
    assert spans[:2] == [(1, 1, 6), (1, 7, 12)]
    assert [n for f, a, b in spans if f == 3 for n in range(a, b + 1)] == list(range(1, 51))


def plain_covering(body, limit):
    spoken = [re.findall(r"\w+", x.lower()) for x in body]
    held = [{w for w in s if len(w) >= 4} for s in spoken]
    weight = {w: sum(w in h for h in held) for h in held for w in h}
    covered, taken = set(), []
    while len(taken) < math.ceil(len(body) / 2):
        offers = [(-(sum(weight[w] for w in held[k] - covered) * 1000 // max(1, len(spoken[k]))), k) for k in range(len(body)) if k not in taken and len(spoken[k]) <= limit]
        if not offers or min(offers)[0] == 0:
            break
        k = min(offers)[1]
        taken.append(k)
        covered |= held[k]
        limit -= len(spoken[k])
    return sorted(taken), sum(weight[w] for w in covered)


def weight_of(body, kept):
    held = [{w for w in re.findall(r"\w+", x.lower()) if len(w) >= 4} for x in body]
    return sum(sum(w in h for h in held) for w in set().union(*[held[k] for k in kept]))


def shortest_first(body, limit):
    sized = sorted((len(re.findall(r"\w+", x)), k) for k, x in enumerate(body))
    kept, total = [], 0
    for n, k in sized[: math.ceil(len(body) / 2)]:
        total += n
        if total > limit:
            break
        kept.append(k)
    return kept


def some_lines(seed, n):
    rnd = random.Random(seed)
    words = [f"word{k}" for k in range(40)] + ["a", "of", "the", "Größe"]
    return [" ".join(rnd.choices(words, k=rnd.randint(0, 14))) for _ in range(n)]


def test_lazy_gains_take_the_lines_of_the_plain_loop():
    better = 0
    for seed in range(60):
        body, limit = some_lines(seed, 40), 20 + seed * 3
        kept = context.covering_lines(body, limit)
        want, weight = plain_covering(body, limit)
        assert kept == want and weight_of(body, kept) == weight
        assert sum(len(re.findall(r"\w+", body[k])) for k in kept) <= limit
        better += weight >= weight_of(body, shortest_first(body, limit))
    assert better == 60
    assert context.covering_lines([], 9) == [] and context.covering_lines(["", "a of"], 9) == []


@pytest.mark.parametrize("rounds", [1, None])
def test_condense_by_weight(spark, rounds):
    texts = ["\n".join(some_lines(s, 5 + 17 * s)) for s in range(12)] + [None, "", "x\n" * 300, " ".join(["long"] * 900) + "\n" * 40, "a\r\nb\rc" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.text for r in context.condense_by_weight(df, "text", 30, 200, 20, rounds).collect()}
    for k, text in enumerate(texts):
        body = [] if not text else text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n")
        if len(body) < 30:
            assert got[k] == text
            continue
        done = 0
        while len(body) >= 30 and (rounds is None or done < rounds):
            limit, out = max(50, 200 // math.ceil(len(body) / 20)), []
            for at in range(0, len(body), 20):
                part = list(dict.fromkeys(x.strip() for x in body[at : at + 20]))
                kept = [part[i] for i in plain_covering(part, limit)[0]]
                kept = kept or [" ".join(min(part, key=lambda x: len(re.findall(r"\w+", x))).split(" ")[:limit])]
                out += ([""] if out else []) + kept
            body, done = out, done + 1
        assert got[k] == "\n".join(body)
    with pytest.raises(ValueError):
        context.condense_by_weight(df, "text", 1)
