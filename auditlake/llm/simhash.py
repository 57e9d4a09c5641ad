"""SimHash near duplicates by tiled exact comparison of fingerprints.

A fingerprint has a bit for each bit of a 64-bit hash: it is set if over half of the text's
shingles, repeats included, have it set. Fingerprints are compared exactly, by exclusive-or and bit
counts over numpy tiles. Tiles are sorted by population count; what differs in it beyond the radius
is skipped.

Two fingerprints within r bits agree on at least b - r of b bands, so tiles are made per choice of
b - r bands and their value; no pair is lost. Only distinct fingerprints meet, so copies cost
nothing. Tiles over ``TILE`` rows are cut by population count and hash, and their pieces are compared
pair by pair. No pairs within a group are written: a tile gives at most a tree for each component,
and components join trees.

Defined cases: a text with fewer words than a shingle is one shingle; one without words, or null,
has the fingerprint zero, linked like any other; repeated rows are copies; ids may be null or
repeated: the smallest known id of a component names it; empty tables give empty results; texts
are read whole, in slices.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import partial
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.columns import free_name
from auditlake.llm.groups import components
from auditlake.llm.settle import settled

SEED = 42
SLICE = 65_536
TILE = 4_096
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingles(text: str | None, size: int) -> Iterator[bytes]:
    """Shingles of lower-cased (A-Z) words, repeats included."""
    found = [] if text is None else text.encode("utf-8").lower().split()
    if 0 < len(found) < size:
        yield b" ".join(found)
    else:
        yield from map(b" ".join, zip(*[islice(found, k, None) for k in range(size)], strict=False))


def fingerprint(text: str | None, size: int) -> int:
    """Fingerprint of a text as a signed long."""
    ones, total, source = np.zeros(64, dtype=np.int64), 0, shingles(text, size)
    while part := list(islice(source, SLICE)):
        h = np.fromiter(map(_hash, part), dtype="<u8", count=len(part))
        total += len(part)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, name: str, text: str = "text", size: int = 3) -> DataFrame:
    """Add the fingerprint as a signed long; all columns stay in Spark but the text, which is lent to the worker."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return df.withColumn(name, F.pandas_udf(run, T.LongType())(F.col(f"`{text}`")))


def hexadecimal(fp: Column) -> Column:
    """16 lower-case digits of a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- links within a small radius


def _bands(radius: int, bands: int) -> list[list[tuple[int, int]]]:
    """For each choice of ``bands - radius`` bands: their (shift, width)."""
    edges = [64 * k // bands for k in range(bands + 1)]
    spans = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(spans, bands - radius)]


def _band_value(fp: Column, choice: list[tuple[int, int]]) -> Column:
    value, at = F.lit(0).cast("bigint"), 0
    for shift, width in choice:
        part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        value, at = value.bitwiseOR(F.shiftleft(part, at)), at + width
    return value


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = int(parent[x])
    return x


def _flat(parent: np.ndarray) -> np.ndarray:
    """Every position's root."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return up
        parent = up


def tile_links(keys: np.ndarray, counts: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning tree's links (positions) of each component, of rows sorted by tile and population count.

    Step s compares each row with the s-th row after it. A row is done once that is in another
    tile or differs in population count beyond the radius: so will all that follow.
    """
    n = len(fps)
    parent = np.arange(n)
    out: list[tuple[int, int]] = []

    rows, step = np.arange(n - 1), 1
    while len(rows):
        rows = rows[rows + step < n]
        other = rows + step
        open_ = (keys[rows] == keys[other]) & (counts[other] - counts[rows] <= radius)
        rows, other = rows[open_], other[open_]
        near = np.bitwise_count(fps[rows] ^ fps[other]) <= radius
        a, b = rows[near], other[near]
        if len(a):
            apart = parent[a] != parent[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                p, q = _root(parent, x), _root(parent, y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((x, y))
            parent = _flat(parent)
        step += 1
    return out


def _compare(radius: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            new = (held["tile"] != held["tile"].shift()).to_numpy()
            last = int(np.flatnonzero(new)[-1]) if len(held) else 0
            if last:  # the last tile may go on in the next batch
                yield linked(held.iloc[:last])
                held = held.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield linked(held)

    def linked(part: pd.DataFrame) -> pd.DataFrame:
        keys = pd.factorize(part["tile"])[0]
        fps = part["fp"].to_numpy()
        found = tile_links(keys, part["pop"].to_numpy(), fps.view(np.uint64), radius)
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fps[pairs[:, 0]], "b": fps[pairs[:, 1]]})

    return run


def tile_count(distinct: int, radius: int) -> int:
    """Bands for a number of fingerprints: more, and so longer keys, keep tiles small as it grows."""
    bands = radius + 1
    while bands < radius + 4 and distinct >> (64 * (bands - radius) // bands) > TILE // 4:
        bands += 1
    return bands


def fingerprint_links(fps: DataFrame, radius: int, bands: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints ``fp`` within the radius, tile by tile."""
    choices = _bands(radius, bands)
    rows = fps.select(
        "fp",
        F.bit_count("fp").alias("pop"),
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _band_value(F.col("fp"), c).alias("v")) for t, c in enumerate(choices)])).alias("k"),
    ).select("fp", "pop", "k.t", "k.v")
    cells = rows.groupBy("t", "v", "pop").agg(F.count(F.lit(1)).alias("n"))
    large = cells.groupBy("t", "v").agg(F.sum("n").alias("n"), F.collect_list(F.struct("pop", "n")).alias("cells")).filter(F.col("n") > tile)
    large = settled(large, "large-tiles")  # at most rows / TILE of them, of at most 65 cells
    pieces = (
        large.select("t", "v", F.explode("cells").alias("c"))
        .select("t", "v", F.col("c.pop").alias("pop"), F.ceil(F.col("c.n") / F.lit(tile // 2)).cast("bigint").alias("subs"))
    )
    piece = pieces.select("t", "v", "pop", "subs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("subs") - 1)).alias("sub"))
    left, right = piece.alias("l"), piece.alias("r")
    meets = left.join(
        right,
        (F.col("l.t") == F.col("r.t")) & (F.col("l.v") == F.col("r.v"))
        & (F.col("r.pop") - F.col("l.pop")).between(0, radius)
        & ((F.col("l.pop") < F.col("r.pop")) | (F.col("l.sub") <= F.col("r.sub"))),
    ).select(
        F.col("l.t").alias("t"), F.col("l.v").alias("v"),
        F.concat_ws(",", "l.t", "l.v", "l.pop", "l.sub", "r.pop", "r.sub").alias("tile"),
        F.explode(F.array_distinct(F.array(F.struct(F.col("l.pop").alias("pop"), F.col("l.sub").alias("sub")), F.struct(F.col("r.pop").alias("pop"), F.col("r.sub").alias("sub"))))).alias("p"),
    ).select("t", "v", "tile", "p.pop", "p.sub")
    names = large.select("t", "v", F.lit(True).alias("is_large"))
    marked = rows.join(names, ["t", "v"], "left")
    whole = marked.filter(F.col("is_large").isNull()).select(F.concat_ws(",", "t", "v").alias("tile"), "pop", "fp")
    cut = (
        marked.filter(F.col("is_large")).drop("is_large").join(pieces, ["t", "v", "pop"])
        .withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")))
        .join(meets, ["t", "v", "pop", "sub"])
        .select("tile", "pop", "fp")
    )
    placed = whole.unionAll(cut)
    placed = placed.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile").sortWithinPartitions("tile", "pop")
    return placed.mapInPandas(_compare(radius), "a bigint, b bigint")


def _members(docs: DataFrame, radius: int) -> DataFrame:
    """``fp, least, root`` of the distinct fingerprints of ``docs`` (id, fp): its smallest id, and the component."""
    order = F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"))
    distinct = settled(docs.groupBy("fp").agg(F.min(order).alias("least")), "distinct-fingerprints")
    links = fingerprint_links(distinct.select("fp"), radius, tile_count(distinct.count(), radius))
    roots = components(links)
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return settled(member, "members")


def link_groups(df: DataFrame, identity: str, text: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """``identity, fingerprint, component_id``: the smallest id reachable over fingerprints within the radius."""
    docs = df.select(F.col(f"`{identity}`").alias("id"), F.col(f"`{text}`").alias("text"))
    docs = settled(fingerprints(docs, "fp", "text", size).select("id", "fp"), "fingerprints")
    member = _members(docs, radius)
    named = member.join(member.groupBy("root").agg(F.min("least")["id"].alias("component_id")), "root").select("fp", "component_id")
    return docs.join(named, "fp").select(F.col("id").alias(identity), hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def near_dedup(df: DataFrame, identity: str, text: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """One row of each group of :func:`link_groups`, with all columns: the one with the smallest id.

    A null id is the largest. Where several rows of a group have the smallest id, one of them stays.
    """
    fp, least, often = (free_name(df, n) for n in ("_fp", "_least", "_often"))
    # Whole rows are written once, with their fingerprints; they move once more, by fingerprint and id, and few share both.
    marked = settled(fingerprints(df, fp, text, size), "marked")
    member = _members(marked.select(F.col(f"`{identity}`").alias("id"), F.col(fp).alias("fp")), radius)
    best = member.groupBy("root").agg(F.min(F.struct("least", "fp")).alias("b")).select(
        F.col("b.fp").alias(fp), F.col("b.least.id").alias(least)
    )
    again = marked.groupBy(fp, F.col(f"`{identity}`").alias(least)).agg((F.count(F.lit(1)) > 1).alias(often)).filter(F.col(often))
    best = best.join(again, (best[fp] == again[fp]) & best[least].eqNullSafe(again[least]), "left").select(
        best[fp], best[least], F.coalesce(F.col(often), F.lit(False)).alias(often)
    )
    best = settled(best, "kept")
    kept = marked.join(best, (marked[fp] == best[fp]) & marked[identity].eqNullSafe(best[least])).drop(best[fp], best[least])
    columns = [F.col(f"`{c}`") for c in df.columns]
    once = kept.filter(~F.col(often)).select(*columns)
    return once.unionAll(kept.filter(F.col(often)).dropDuplicates([fp]).select(*columns))
