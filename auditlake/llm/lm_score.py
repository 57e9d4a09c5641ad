"""Language-model scores from a weighted backoff automaton of smoothed n-grams.

The model: P(w) = (c(w) + 1) / (N + V + 1), and for a history h of one word up to ``order - 1``
words, P(w | h) = (c(hw) + mu P(w | h')) / (c(h) + mu), where h' is h without its first word
(Dirichlet smoothing; it sums to one). Only counts of training tokens enter, and where hw is
unseen the probability is a backoff weight mu / (c(h) + mu) times that of h'.

As an automaton: seen histories are states, seen n-grams are arcs, and each state has a failure
arc that carries the backoff weight to the state of the shorter history. A text is read once
from left to right; the state is carried on and log10 probabilities add up.

The model of a large corpus fits no memory, so it is cut by what each block of documents
can meet. A block (``BLOCK_BYTES`` of text) sends its distinct words and n-gram hashes, with their
counts in training documents, to shards by hash; a shard adds up and answers each block
with the corpus counts in the order asked; from these the block builds the part of the automaton
that its texts can reach, which scores them as the whole would. Counts are added before they
travel: a hot word is one number per block. Words are compared whole; longer n-grams by
64-bit hashes.

Defined cases: a null or empty text is just its end token; a null id counts as the empty text for
choosing training rows; repeated rows count and score as often as they occur; texts are scored
whole; an empty table gives an empty table; without training rows every token is unknown
with P = 1 / 1. Only the ``carry`` columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.packing import cuts, pack, pack_sorted, unpack, unpack_sorted
from auditlake.llm.settle import settled

ORDER = 2
MU = 500.0
BLOCK_BYTES = 4_000_000
#: Blocks whose requests meet in one shard, about.
BLOCKS_PER_SHARD = 8
#: Texts of a block below which each goes on alone: the rest of the longest ones.
FEW = 8
# Tokens that no word can be: words hold no white space.
START, END = b"\t", b"\n"
_PACKED = "block int, shard int, kind int, keys binary, counts binary"
_ANSWER = "block int, shard int, kind int, counts binary, n_types bigint, n_tokens bigint"


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _by_hash(hashes: np.ndarray, names: list[bytes]) -> np.ndarray:
    """Positions from the second on in the order of hash and name, whatever the order they came in."""
    ranked = np.argsort(hashes[1:], kind="stable") + 1
    same = np.flatnonzero(hashes[ranked[1:]] == hashes[ranked[:-1]])
    if len(same):  # words of one hash; hardly ever
        ranked = np.array(sorted(range(1, len(names)), key=lambda i: (int(hashes[i]), names[i])), dtype=np.int64)
    return ranked


class _Block:
    """Token ids of a block of texts and the distinct n-grams in them."""

    def __init__(self, texts: Iterable[str | None], order: int):
        ids = _Ids({START: 0, END: 1})
        rows = []
        for t in texts:
            words = [] if t is None else t.encode("utf-8").lower().split()
            rows.append(np.fromiter(map(ids.__getitem__, [START, *words, END]), dtype=np.int32, count=len(words) + 2))
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), dtype=np.uint64, count=len(ids))
        # Words in the order of their hash; the start is no token and comes first.
        names = list(ids)
        ranked = _by_hash(hashes, names)
        self.words = [names[i] for i in ranked.tolist()]
        self.word_hashes = hashes[ranked]
        place = np.zeros(len(ids), dtype=np.int32)
        place[ranked] = np.arange(1, len(ids))
        # 0 is the start, i + 1 the i-th word.
        self.stream = place[np.concatenate(rows)] if rows else np.empty(0, dtype=np.int64)
        del rows, names
        self.end = self.words.index(END) + 1
        by_place = np.concatenate((hashes[:1], self.word_hashes))
        within = np.arange(len(self.stream)) - np.repeat(self.starts, self.sizes)
        #: For each n from 2: ascending hashes, the number at each position (-1: none ends there), a position of each.
        self.grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rolling = by_place[self.stream]
        for n in range(2, order + 1):
            rolling = _joined(np.concatenate((rolling[:1], rolling[:-1])), by_place[self.stream])
            whole = within >= n - 1
            values, first, number = np.unique(rolling[whole], return_index=True, return_inverse=True)
            at = np.full(len(self.stream), -1, dtype=np.int32)
            spots = np.flatnonzero(whole)
            at[spots] = number
            self.grams.append((values, at, spots[first]))

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        """Counts in the rows marked for training: of words, then of each longer n-gram."""
        marked = np.repeat(train, self.sizes)
        out = [np.bincount(self.stream[marked], minlength=len(self.words) + 1)[1:]]
        for values, at, _ in self.grams:
            picked = at[marked]
            out.append(np.bincount(picked[picked >= 0], minlength=len(values)))
        return out


def _joined(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a history's hash and a word's, modulo 2**64."""
    x = history * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Automaton:
    """States, arcs and failure arcs over the ids of a block; ``counts`` as :meth:`_Block.counts` gives them, of the corpus."""

    def __init__(self, block: _Block, counts: Sequence[np.ndarray], n_tokens: int, n_types: int, mu: float):
        words = counts[0].astype(np.float64)
        unigram = np.concatenate(([0.0], (words + 1) / (n_tokens + n_types + 1)))
        self.root_log = np.log10(np.maximum(unigram, 1e-300))
        starts = float(counts[0][block.end - 1])  # every training text has one start and one end
        # State 0 is the empty history; states of single words follow, then of longer histories.
        sizes = np.concatenate(([starts], words))
        offset = [1]
        history, lower, node = sizes, unigram, block.stream
        state_sizes = [np.ones(1)]
        fails = [np.zeros(1, dtype=np.int64)]
        self.root_next = np.where(sizes > 0, np.arange(len(sizes)) + 1, 0) if block.grams else np.zeros(len(sizes), dtype=np.int64)
        suffix_state = np.zeros(len(sizes), dtype=np.int64)
        keys, logs, nexts = [], [], []
        for level, (values, at, spot) in enumerate(block.grams):
            state_sizes.append(history)
            fails.append(suffix_state)
            total = counts[level + 1].astype(np.float64)
            before, last = node[spot - 1], node[spot]
            chance = (total + mu * lower[last]) / (history[before] + mu)
            seen = total > 0
            last_level = level + 1 == len(block.grams)
            own = np.arange(len(values)) + offset[-1] + len(history)
            follow = last + offset[-1] if last_level else own
            keys.append(((before + offset[-1]).astype(np.int64) << 32 | block.stream[spot])[seen])
            logs.append(np.log10(np.maximum(chance, 1e-300))[seen])
            nexts.append(follow[seen])
            suffix_state = last + offset[-1]
            offset.append(offset[-1] + len(history))
            history, lower, node = total, chance, at
        order = np.argsort(np.concatenate(keys)) if keys else np.empty(0, dtype=np.int64)
        self.arc_key = np.concatenate(keys)[order] if keys else np.empty(0, dtype=np.int64)
        self.arc_log = np.concatenate(logs)[order] if keys else np.empty(0)
        self.arc_next = np.concatenate(nexts)[order] if keys else np.empty(0, dtype=np.int64)
        self.fail_log = np.log10(mu / (np.concatenate(state_sizes) + mu))
        self.fail_to = np.concatenate(fails)
        self.start = 1 if starts > 0 and block.grams else 0

    def _walk(self, state: int, tokens: Sequence[int]) -> float:
        """log10 probability of further tokens of one text."""
        total, known = 0.0, {}
        for token in tokens:
            while True:
                key = state << 32 | token
                arc = known.get(key)
                if arc is None:
                    at = int(np.searchsorted(self.arc_key, key))
                    if at < len(self.arc_key) and self.arc_key[at] == key:
                        arc = (float(self.arc_log[at]), int(self.arc_next[at]), True)
                    elif state == 0:
                        arc = (float(self.root_log[token]), int(self.root_next[token]), True)
                    else:
                        arc = (float(self.fail_log[state]), int(self.fail_to[state]), False)
                    known[key] = arc
                total += arc[0]
                state = arc[1]
                if arc[2]:
                    break
        return total

    def score(self, block: _Block) -> np.ndarray:
        """log10 probability of each text of the block: all texts take their next token together, each in its own state."""
        state = np.full(len(block.sizes), self.start, dtype=np.int64)
        total = np.zeros(len(block.sizes))
        order = np.argsort(-block.sizes, kind="stable")
        sizes, starts = block.sizes[order], block.starts[order]
        active = len(order)
        for step in range(1, int(sizes[0]) if active else 0):
            while sizes[active - 1] <= step:
                active -= 1
            if active < FEW:
                for k in range(active):
                    at = starts[k] + step
                    total[k] += self._walk(int(state[k]), block.stream[at : starts[k] + sizes[k]].tolist())
                break
            word = block.stream[starts[:active] + step]
            open_ = np.arange(active)
            while len(open_):
                now, token = state[open_], word[open_]
                key = now << 32 | token
                at = np.searchsorted(self.arc_key, key)
                at[at == len(self.arc_key)] = 0
                arc = self.arc_key[at] == key if len(self.arc_key) else np.zeros(len(key), dtype=bool)
                root = ~arc & (now == 0)
                total[open_] += np.where(arc, self.arc_log[at] if len(self.arc_key) else 0.0, np.where(root, self.root_log[token], self.fail_log[now]))
                state[open_] = np.where(arc, self.arc_next[at] if len(self.arc_key) else 0, np.where(root, self.root_next[token], self.fail_to[now]))
                open_ = open_[~arc & ~root]
        result = np.empty(len(order))
        result[order] = total
        return result


def _requests(order: int, shards: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        block = _Block(frame["text"], order)
        counts = block.counts(frame["train"].to_numpy(dtype=bool))
        rows = [
            (key[0], shard, 1, b" ".join(block.words[a:b]), pack(counts[0][a:b])) for shard, a, b in cuts(block.word_hashes, shards)
        ]
        for level, (values, _, _) in enumerate(block.grams):
            rows += [
                (key[0], shard, level + 2, pack_sorted(values[a:b]), pack(counts[level + 1][a:b])) for shard, a, b in cuts(values, shards)
            ]
        return pd.DataFrame(rows, columns=["block", "shard", "kind", "keys", "counts"])

    return run


def _answers(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts for all requests of a shard, row by row in the order asked."""
    out = []
    for kind, rows in frame.groupby("kind", sort=True):
        if kind == 1:
            parts = [np.array(k.split(b" "), dtype=object) for k in rows["keys"]]
            number, distinct = pd.factorize(np.concatenate(parts))
            size = len(distinct)
        else:
            parts = [unpack_sorted(k) for k in rows["keys"]]
            distinct, number = np.unique(np.concatenate(parts), return_inverse=True)
            size = len(distinct)
        sums = np.zeros(size, dtype=np.int64)
        np.add.at(sums, number, np.concatenate([unpack(c) for c in rows["counts"]]).astype(np.int64))
        types, tokens_ = (int((sums > 0).sum()), int(sums.sum())) if kind == 1 else (0, 0)
        at = 0
        for block, part in zip(rows["block"], parts, strict=True):
            out.append((block, key[0], kind, pack(sums[number[at : at + len(part)]]), types, tokens_))
            types = tokens_ = 0
            at += len(part)
    return pd.DataFrame(out, columns=["block", "shard", "kind", "counts", "n_types", "n_tokens"])


def _scores(order: int, mu: float, n_tokens: int, n_types: int, carry: list[str]):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = _Block(docs["text"], order)
        answers = answers.sort_values(["kind", "shard"])
        counts = [
            np.concatenate([unpack(c) for c in answers.loc[answers["kind"] == kind, "counts"]] or [np.empty(0, dtype=np.uint64)]).astype(np.int64)
            for kind in range(1, order + 1)
        ]
        known = np.concatenate(([0], counts[0]))[block.stream]
        real = block.stream > 0
        row = np.repeat(np.arange(len(docs)), block.sizes)[real]
        sums = np.bincount(row, weights=np.log10(known[real] + 1.0), minlength=len(docs))
        size = block.sizes - 1
        return docs[carry].assign(
            n_tokens=size,
            n_known=np.bincount(row, weights=known[real] > 0, minlength=len(docs)).astype(np.int64),
            train_tokens=n_tokens,
            base_score=sums - size * np.log10(n_tokens + n_types + 1),
            score=Automaton(block, counts, n_tokens, n_types, mu).score(block),
        )

    return run


def _number_of_blocks(df: DataFrame, text: str, block_bytes: int) -> tuple[int, int]:
    """Blocks and shards for a measured amount of text."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`")) + 1), F.lit(0)).alias("n")).first()["n"]
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, -(-size // block_bytes))
    return blocks, max(least, -(-blocks // BLOCKS_PER_SHARD))


def lm_score(
    df: DataFrame, train: Column, carry: Sequence[str], text: str = "text", order: int = ORDER, mu: float = MU, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The ``carry`` columns with ``n_tokens, n_known, train_tokens, base_score, score`` of each text.

    Rows for which ``train`` is true teach the model; all rows are scored.
    """
    out = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    carry = [c for c in carry if c.lower() not in out]
    blocks, shards = _number_of_blocks(df, text, block_bytes)
    inside = {c: f"c{i}" for i, c in enumerate(carry)}
    body = F.col(f"`{text}`")
    docs = df.select(
        *[F.col(f"`{c}`").alias(i) for c, i in inside.items()],
        body.alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in carry], body), F.lit(blocks)).cast("int").alias("block"),
    )
    asked = docs.select("block", "text", "train").groupBy("block").applyInPandas(_requests(order, shards), _PACKED)
    answered = settled(asked.groupBy("shard").applyInPandas(_answers, _ANSWER), "lm-counts")
    total = answered.agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_types"), F.lit(0)).alias("types")
    ).first()
    fields = [T.StructField(inside[c], df.schema[c].dataType) for c in carry]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*fields, *[T.StructField(o, k) for o, k in zip(out, kinds, strict=True)]])
    scored = (
        docs.drop("train")
        .groupBy("block")
        .cogroup(answered.select("block", "shard", "kind", "counts").groupBy("block"))
        .applyInPandas(_scores(order, mu, total["tokens"], total["types"], list(inside.values())), schema)
    )
    return scored.select(*[F.col(i).alias(c) for c, i in inside.items()], *out)
