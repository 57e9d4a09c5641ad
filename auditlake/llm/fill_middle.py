"""Fill-in-middle transformation: cuts between lines, found from remembered chunks.

A rolling hash of the last 32 bytes cuts each text into chunks, so equal passages of any texts
give equal chunks. What a chunk tells of its lines (code points, ends of lines, first and last
bytes) is remembered under its hash and used again once the bytes prove equal. Summing the
counts of a text's chunks shows in which chunk a cut lies; no text is split into lines.

The draws come from a digest of seed and identity, so every run cuts alike. Rows never meet:
there is no shuffle, and texts stay in Spark, which puts the output together; the worker
only returns positions.

Defined cases: a null or empty text is ``plain``, with 0 lines; a text that holds a sentinel is
``plain``; a null identity draws as the empty string; texts of any length are cut whole, in
chunks of bounded size; repeated rows give equal results; an empty table gives an empty table;
other columns pass through and result names replace columns of the same name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.columns import bind, free_name

# What marks prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50
OUT = ["n", "form", "prefix_chars", "middle_chars", "fim_text"]

#: Bytes the rolling hash sees, and bits that must be zero where a chunk ends (one place in 512).
WINDOW, BITS = 32, 9
#: Bytes of a chunk: at least (but for what a cut at the most leaves, and the last one), at most.
LEAST, MOST = 64, 16_384
#: Bytes hashed at a time, and bytes of chunks remembered by a worker.
SLICE, REMEMBERED = 1 << 20, 1 << 25

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_INSIDE = bytes(range(0x80, 0xC0))
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_REACH = max(map(len, _MARKS)) - 1


def _hits(data: bytes) -> Iterator[int]:
    """Ends of chunks by content: places where the hash of the bytes before them starts with zeros."""
    for at in range(0, len(data), SLICE):
        before = min(at, WINDOW - 1)
        hashed = _GEAR[np.frombuffer(data, np.uint8, min(SLICE, len(data) - at) + before, at - before)]
        step = 1
        while step < WINDOW:
            hashed[step:] = hashed[step:] + (hashed[:-step] << np.uint32(step))
            step *= 2
        yield from (np.flatnonzero(hashed[before:] >> np.uint32(32 - BITS) == 0) + (at + 1)).tolist()


def chunks(data: bytes) -> Iterator[bytes]:
    """Content-defined chunks that together are the bytes."""
    last = 0
    for end in (*_hits(data), len(data)):
        if end - last < LEAST and end < len(data):
            continue
        while end - last > MOST:
            yield data[last : last + MOST]
            last += MOST
        if end > last:
            yield data[last:end]
            last = end


class Summary(NamedTuple):
    """What a chunk tells of the text around its ends."""

    chars: int
    line_ends: tuple[int, ...]
    marked: bool
    head: bytes
    tail: bytes


def summarize(chunk: bytes) -> Summary:
    """Code points, those at the ends of its lines, whether it holds a sentinel, and its outermost bytes.

    A chunk may begin or end inside a character; the character counts where its first byte is.
    """
    firsts = chunk.translate(None, _INSIDE)
    ends = tuple(accumulate(len(p) + 1 for p in firsts.split(b"\n")[:-1]))
    return Summary(len(firsts), ends, any(m in chunk for m in _MARKS), chunk[:_REACH], chunk[-_REACH:])


class Memo:
    """Summaries by the hash of a chunk; a hit counts only if the bytes are the same."""

    def __init__(self, limit: int = REMEMBERED):
        self.limit, self.bytes, self.hits, self.held = limit, 0, 0, {}

    def summary(self, chunk: bytes) -> Summary:
        key = xxhash.xxh3_64_intdigest(chunk)
        found = self.held.get(key)
        if found is not None and found[0] == chunk:
            self.hits += 1
            return found[1]
        made = summarize(chunk)
        if found is None:
            if self.bytes > self.limit:
                self.held.clear()
                self.bytes = 0
            self.held[key] = (chunk, made)
            self.bytes += len(chunk)
        return made


def cut(data: bytes, first: int, second: int, memo: Memo) -> tuple[int, bool, int, int]:
    """``lines, marked, prefix_chars, middle_chars`` of a text; the draws are taken modulo lines + 1."""
    parts = [memo.summary(c) for c in chunks(data)]
    marked, tail = False, b""
    for p in parts:
        marked = marked or p.marked or any(m in tail + p.head for m in _MARKS)
        tail = (tail + p.tail)[-_REACH:]
    chars = list(accumulate((p.chars for p in parts), initial=0))
    breaks = list(accumulate((len(p.line_ends) for p in parts), initial=0))
    n = breaks[-1] + bool(data and not data.endswith(b"\n"))

    def place(line: int) -> int:
        if line == 0:
            return 0
        if line > breaks[-1]:
            return chars[-1]
        at = bisect_left(breaks, line) - 1
        return chars[at] + parts[at].line_ends[line - breaks[at] - 1]

    low, high = sorted((first % (n + 1), second % (n + 1)))
    start = place(low)
    return n, marked, start, place(high) - start


def _draws(identity: Column, seed: int) -> Column:
    """The first four groups of eight hexadecimal digits of the digest of seed and identity, as an array of longs."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))), 256)
    return bind(digest, lambda d: F.array(*[F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]))


def _cut(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    memo = Memo()
    for texts, firsts, seconds in rows:
        found = [cut(t, a, b, memo) for t, a, b in zip(texts, firsts, seconds, strict=True)]
        yield pd.DataFrame(found, columns=["n", "marked", "prefix", "middle"])


def fill_in_middle(
    df: DataFrame, identity: str, text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """Add ``n`` (lines), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``fim_text``.

    ``fim_percent`` of the texts are cut, ``spm_percent`` of those give the suffix first. ``fim_text``
    replaces a column of that name; :func:`restored` undoes it.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in OUT]
    body, draws, found = (free_name(df, name) for name in ("_body", "_draws", "_found"))
    ready = df.withColumns({body: F.coalesce(F.col(f"`{text}`"), F.lit("")), draws: _draws(F.col(f"`{identity}`"), seed)})
    cut_udf = F.pandas_udf(_cut, "n bigint, marked boolean, prefix bigint, middle bigint")
    ready = ready.withColumn(found, cut_udf(F.col(body).cast("binary"), F.col(draws)[0], F.col(draws)[1]))
    whole, at = F.col(body), F.col(found)
    plain = (whole == "") | at["marked"] | (F.col(draws)[2] % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col(draws)[3] % 100 < spm_percent, "spm").otherwise("psm")
    one = F.lit(1).cast("bigint")
    prefix = F.substring(whole, F.lit(1), at["prefix"].cast("int"))
    middle = F.substring(whole, (at["prefix"] + one).cast("int"), at["middle"].cast("int"))
    suffix = F.substring(whole, (at["prefix"] + at["middle"] + one).cast("int"), F.lit(2**31 - 1))
    output = (
        F.when(form == "plain", whole)
        .when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    return ready.select(
        *rest,
        at["n"].alias("n"),
        form.alias("form"),
        F.when(~plain, at["prefix"]).alias("prefix_chars"),
        F.when(~plain, at["middle"]).alias("middle_chars"),
        output.alias("fim_text"),
    )


def restored(fim_text: Column, form: Column) -> Column:
    """The text before the transformation, from its output and form alone.

    A text that is not plain holds no sentinel, and no sentinel can arise where one meets a text, so each stands once.
    """

    def parts(t: Column, head: str, mid: str) -> tuple[Column, Column, Column]:
        front = F.substring_index(t, MIDDLE, 1)
        a = F.substring(F.substring_index(front, mid, 1), F.lit(len(head) + 1), F.lit(2**31 - 1))
        return a, F.substring_index(front, mid, -1), F.substring_index(t, MIDDLE, -1)

    def undone(t: Column) -> Column:
        p, s, m = parts(t, PREFIX, SUFFIX)
        s2, p2, m2 = parts(t, SUFFIX, PREFIX)
        return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(t)

    return bind(fim_text, undone)
