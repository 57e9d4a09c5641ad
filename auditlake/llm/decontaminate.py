"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased words (runs of letters, digits and underscores). Windows of
``min_tile`` words that a document shares with a benchmark item are the seeds; where seeds
could cover enough of an item, the longest common matches are marked first, by comparing
rolling hashes of windows (Karp-Rabin) and then the words, again and again for shorter
lengths, and no word is marked twice. The share of the item under tiles decides, so a
passage whose parts were put in another order is caught as well.

The benchmark is taken in blocks of bounded size; each block goes to the tasks with the
code and meets every document in one pass, without a shuffle. More items are more passes.

Defined cases: null and empty texts match nothing and stay; an item with fewer than
``min_tile`` words, a null one too, can't be told from chance and matches nothing; texts
are read whole; equal items each match; repeated rows are judged one by one; empty tables
give empty results or keep all documents.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.columns import free_name

MIN_TILE = 4
COVERAGE = 0.6
#: Characters of benchmark text that go to the tasks at a time.
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of an odd number, modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Rolling:
    """Polynomial hashes, modulo 2**64, of the windows of any size, from sums over the words before a place (Karp-Rabin)."""

    def __init__(self, ids: np.ndarray):
        terms = (ids.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(ids))
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)))
        self.back = _powers(_INVERSE, len(ids))

    def windows(self, size: int) -> np.ndarray:
        n = max(0, len(self.back) - size + 1)
        return (self.sums[size : size + n] - self.sums[:n]) * self.back[:n]


def greedy_tiles(doc: np.ndarray, item: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (start in document, start in item, length), longest first, none overlapping another.

    Negative ids match nothing, not even each other. Where a window is common so are all inside it, so the
    longest common length left is found by halving; only lengths that some tile has are gone through.
    """
    free_doc, free_item = doc >= 0, item >= 0
    in_doc, in_item = _Rolling(doc), _Rolling(item)
    tiles: list[tuple[int, int, int]] = []

    def common(size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of the item without a marked word, and places in the document that have one of them."""
        ours = in_item.windows(size)[_free_windows(free_item, size)]
        at = _free_windows(free_doc, size)
        return ours, at[np.isin(in_doc.windows(size)[at], ours)] if len(ours) else at[:0]

    low, high = min_tile, min(len(doc), len(item))
    while high >= min_tile:
        while low <= high:  # the longest length with a common window is at most ``high``
            middle = (low + high + 1) // 2
            if len(common(middle)[1]):
                low = middle
                if low == high:
                    break
            else:
                high = middle - 1
        if high < min_tile:
            break
        size = high
        _, hits = common(size)
        hashes, doc_hashes = in_item.windows(size), in_doc.windows(size)
        starts = defaultdict(deque)
        for at in _free_windows(free_item, size).tolist():
            starts[int(hashes[at])].append(at)
        for d in hits.tolist():
            if not free_doc[d : d + size].all():
                continue
            queue = starts[int(doc_hashes[d])]
            while queue and not free_item[queue[0] : queue[0] + size].all():
                queue.popleft()  # what is marked stays so
            for i in queue:
                if free_item[i : i + size].all() and np.array_equal(doc[d : d + size], item[i : i + size]):
                    free_doc[d : d + size] = False
                    free_item[i : i + size] = False
                    tiles.append((d, i, size))
                    break
        low, high = min_tile, size - 1
    return tiles


def _free_windows(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a marked word."""
    if len(free) < size:
        return np.empty(0, dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(total[size:] - total[:-size] == size)


def _covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` places are in a window of ``size`` from one of the starts."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:-1]) > 0


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: Sequence[tuple[object, str]], min_tile: int, coverage: float):
        self.min_tile, self.coverage = min_tile, coverage
        self.vocabulary: dict[str, int] = {}
        self.keys: list[object] = []
        self.items: list[np.ndarray] = []
        seeds: list[np.ndarray] = []
        for key, text in items:
            words = tokens(text)
            if len(words) >= min_tile:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int64)
                self.keys.append(key)
                self.items.append(ids)
                seeds.append(_Rolling(ids).windows(min_tile))
        hashes = np.concatenate(seeds) if seeds else np.empty(0, dtype=np.uint64)
        owner = np.concatenate([np.full(len(s), i) for i, s in enumerate(seeds)]) if seeds else np.empty(0, dtype=np.int64)
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.empty(0, dtype=np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]

    def matches(self, text: str | None) -> list[tuple[object, float, int, int]]:
        """(key, share of the item under tiles, tiles, longest tile) of the items that reach the threshold."""
        known = self.vocabulary.get
        doc = np.array([known(w, -1) for w in tokens(text)], dtype=np.int64)
        size = self.min_tile
        if len(doc) < size or not len(self.hashes):
            return []
        at = _free_windows(doc >= 0, size)
        if not len(at):
            return []
        window = _Rolling(doc).windows(size)[at]
        distinct = np.unique(window)
        low, high = np.searchsorted(self.hashes, distinct, "left"), np.searchsorted(self.hashes, distinct, "right")
        n = high - low
        if not n.any():
            return []
        # All seeds of the index that the document has, each once however often it is there.
        seeds = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        order = np.argsort(self.owner[seeds], kind="stable")
        seeds = seeds[order]
        owners, first = np.unique(self.owner[seeds], return_index=True)
        found = []
        for i, of_item in zip(owners.tolist(), np.split(seeds, first[1:]), strict=True):
            item = self.items[i]
            under = _covered(self.place[of_item], size, len(item))
            if under.sum() < self.coverage * len(item):
                continue  # no tiling covers more than the seeds do
            near = _covered(at[np.isin(window, self.hashes[of_item])], size, len(doc))
            # Only words under seeds can be in a tile; a gap parts what is not adjacent.
            spots = np.flatnonzero(near)
            gaps = np.flatnonzero(np.diff(spots) > 1) + 1
            tiles = greedy_tiles(np.insert(doc[spots], gaps, -1), item, size)
            share = sum(n for *_, n in tiles) / len(item)
            if share >= self.coverage:
                found.append((self.keys[i], share, len(tiles), tiles[0][2]))
        return found


def _blocks(benchmark: DataFrame, key: str, text: str, chars: int) -> Iterator[list[tuple[object, str]]]:
    block: list[tuple[object, str]] = []
    size = 0
    for row in benchmark.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        if row["t"]:
            if block and size + len(row["t"]) > chars:
                yield block
                block, size = [], 0
            block.append((row["k"], row["t"]))
            size += len(row["t"])
    if block:
        yield block


def contaminated(
    df: DataFrame, benchmark: DataFrame, carry: Sequence[str], text: str = "text", item: str = "item_id", item_text: str = "text",
    min_tile: int = MIN_TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """A row for each document and item that reaches the threshold: ``carry`` columns, item, ``coverage``, ``n_tiles``, ``longest_tile``."""
    source, key = free_name(df, "_tiled_text"), item if item not in carry else free_name(df, f"_{item}")
    fields = [f for c in carry for f in df.schema.fields if f.name == c]
    schema = T.StructType(
        [*fields, T.StructField(key, benchmark.schema[item].dataType)]
        + [T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.LongType()), T.StructField("longest_tile", T.LongType())]
    )
    inner = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias(source))

    def pass_over(index: Index) -> DataFrame:
        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows, found = [], []
                for r, t in enumerate(frame.pop(source)):
                    for match in index.matches(t):
                        rows.append(r)
                        found.append(match)
                part = frame.iloc[rows].reset_index(drop=True)
                made = pd.DataFrame(found, columns=[key, "coverage", "n_tiles", "longest_tile"])
                yield pd.concat([part, made], axis=1)

        return inner.mapInPandas(run, schema)

    result = None
    for block in _blocks(benchmark, item, item_text, block_chars):
        more = pass_over(Index(block, min_tile, coverage))
        result = more if result is None else result.unionAll(more)
    return result if result is not None else df.sparkSession.createDataFrame([], schema)


def drop_contaminated(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    min_tile: int = MIN_TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents that reach the threshold for no item, with their columns as they were."""
    left = df
    for block in _blocks(benchmark, item, item_text, block_chars):
        left = left.mapInPandas(_keeper(Index(block, min_tile, coverage), text), df.schema)
    return left


def _keeper(index: Index, text: str):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[not index.matches(t) for t in frame[text]]]

    return run
