"""Token counts: greedy longest-match word pieces, counted in one pass over a word's characters.

The vocabulary becomes two tries, one for the pieces that start a word and one for those that
go on. Each node has a failure link and the number of pieces popped on the way along it, both
computed beforehand (Song et al., Fast WordPiece, 2021). A word walks the tries character by
character; where no child fits, it adds the popped count and follows the link. No piece is built.

Defined cases: words are runs without the white space of the result's contract; null, empty and
blank texts have none; a word that the vocabulary can't spell is one unknown piece; words of any
length are walked whole; other columns pass through and result names replace columns of the same
name; repeated rows give equal results; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.columns import free_name
from auditlake.llm.sentencepiece_codec import MARK, MODEL, NORMAL, USER_DEFINED, parse_model, read_model

#: Distinct words whose counts a worker remembers at a time.
REMEMBERED = 300_000
_UNKNOWN = 1 << 40


def vocabulary(data: bytes) -> tuple[frozenset[str], frozenset[str]]:
    """Pieces that start a word, and pieces that go on, of a model file: the marker tells them apart."""
    model = parse_model(data)
    whole = [p for p, t in zip(model.pieces, model.types, strict=True) if t in (NORMAL, USER_DEFINED)]
    first = frozenset(p[len(MARK) :] for p in whole if p.startswith(MARK) and p.strip(MARK))
    return first, frozenset(p for p in whole if MARK not in p)


class LongestMatch:
    """Tries of word-starting and continuing pieces with failure links and popped counts."""

    def __init__(self, first: Iterable[str], rest: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        ends = set()
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for ch in piece:
                    node = self._child(node, ch)
                if piece:
                    ends.add(node)
        queue = deque((node, parent, ch) for parent in (0, 1) for ch, node in self.children[parent].items())
        while queue:
            node, parent, ch = queue.popleft()
            if node in ends:
                self.fail[node], self.popped[node] = 1, 1
            else:
                count, at = self.popped[parent], self.fail[parent]
                while at >= 0 and ch not in self.children[at]:
                    count, at = count + self.popped[at], self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.children[at][ch], count
            queue.extend((child, node, c) for c, child in self.children[node].items())

    def _child(self, node: int, ch: str) -> int:
        found = self.children[node].get(ch)
        if found is None:
            found = len(self.children)
            self.children[node][ch] = found
            self.children.append({})
            self.fail.append(-1)
            self.popped.append(0)
        return found

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if it can't be spelled."""
        children, fail, popped = self.children, self.fail, self.popped
        node = total = 0
        for ch in word:
            following = children[node].get(ch)
            while following is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
                following = children[node].get(ch)
            node = following
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return total


class _Remembered(dict):
    """Counts of words seen so far, unknown ones in the high bits."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode("utf-8"))
        value = self[word] = n if n >= 0 else 1 + _UNKNOWN
        return value


@lru_cache(maxsize=2)
def _automaton(data: bytes) -> LongestMatch:
    return LongestMatch(*vocabulary(data))


def piece_counts(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """Add ``n_words``, ``n_pieces`` (unknown words count one each) and ``n_unknown``."""
    data = read_model(model)
    out = ["n_words", "n_pieces", "n_unknown"]
    rest = [c for c in df.columns if c.lower() not in out]
    source = free_name(df, "_counted_text")
    schema = T.StructType([f for f in df.schema.fields if f.name in rest] + [T.StructField(o, T.LongType()) for o in out])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Remembered(_automaton(data))
        for frame in frames:
            sizes, sums = [], []
            for t in frame.pop(source):
                words = [] if t is None else t.encode("utf-8").split()
                sizes.append(len(words))
                sums.append(sum(map(memo.__getitem__, words)))
                if len(memo) > REMEMBERED:
                    memo.clear()
            yield frame.assign(n_words=sizes, n_pieces=[s % _UNKNOWN for s in sums], n_unknown=[s // _UNKNOWN for s in sums])

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias(source)).mapInPandas(run, schema)
