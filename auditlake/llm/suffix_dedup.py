"""Removal of byte strings that an earlier document holds, by hash-compared suffix sorting.

A byte goes if a string of ``match`` bytes over it also starts in a document with a smaller id.
Strings lie within a document and are judged on the input.

Sorting every suffix of a corpus is not needed: each string of ``match`` bytes has an anchor,
the ``anchor``-byte piece in it whose hash is smallest, and equal strings have equal anchors
at the same place. So

1. blocks of documents send the distinct hashes of their anchors, with their number, to shards by
   hash, which answer whether an anchor occurs elsewhere too;
2. of shared anchors, blocks send the bytes that a string around them can have, equal ones once with
   the smallest id. A shard sorts, per anchor, the suffixes that start there and, reversed,
   those that end there: a mergesort whose comparisons find the common extension by binary search
   over prefix polynomial hashes. Neighbours' extensions are then verified byte by byte. Two
   strings around an anchor are equal if both extensions reach far enough, so runs in
   both orders give the classes of equal strings and the smallest id of each;
3. blocks mark the strings whose class has a smaller id than the document.

An anchor with more than ``HOT`` occurrences gathers nowhere: its strings travel one by one, as
128-bit hashes that each block sends once, and are spread over all shards.

Defined cases: null and empty texts have no bytes; a null id is neither earlier nor later than
any other, so such rows stay whole and remove nothing; rows with the same id do not remove from
each other; repeated texts lose all bytes in all but the smallest id; texts are taken whole; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.packing import cuts, pack, pack_sorted, unpack, unpack_sorted
from auditlake.llm.settle import settled

MATCH = 50
ANCHOR = 24
BLOCK_BYTES = 2_000_000
BLOCKS_PER_SHARD = 4
#: Occurrences of an anchor above which its strings are spread.
HOT = 10_000
#: Entries sorted at a time.
CHUNK = 16_384
#: Numbers worked on at a time, so that they stay in the processor's cache.
_STEP = 32_768
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_ASKED = "block int, shard int, kind int, data binary, numbers binary"
_ANSWER = "block int, shard int, kind int, data binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """Mixed bits of ``x``, which is overwritten."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, count: int) -> np.ndarray:
    """The first powers of ``base``, modulo 2**64."""
    power = np.full(count, base, dtype=np.uint64)
    power[:1] = 1
    return np.cumprod(power, out=power)


class Rolling:
    """Prefix polynomial hashes of a byte buffer, modulo 2**64, for the hash of any piece of it."""

    def __init__(self, data: np.ndarray, base: int):
        n, inverse = len(data), pow(base, -1, 1 << 64)
        steps = n // _STEP + 1
        power, far = _powers(base, _STEP), _powers(pow(base, _STEP, 1 << 64), steps)
        #: A place's power of the inverse is the product of that of its step and that within the step.
        self.back, self.far_back = _powers(inverse, _STEP), _powers(pow(inverse, _STEP, 1 << 64), steps)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        for a in range(0, n, _STEP):
            part = data[a : a + _STEP].astype(np.uint64)
            part += np.uint64(1)
            part *= power[: len(part)]
            part *= far[a // _STEP]
            to = self.prefix[a + 1 : a + 1 + len(part)]
            np.cumsum(part, out=to)
            to += self.prefix[a]

    def pieces(self, size: int) -> Iterator[tuple[int, np.ndarray]]:
        """Hash of every piece of ``size`` bytes, some at a time with the place of the first."""
        n = len(self.prefix) - size
        for a in range(0, n, _STEP):
            b = min(a + _STEP, n)
            part = self.prefix[a + size : b + size] - self.prefix[a:b]
            part *= self.back[: b - a]
            part *= self.far_back[a // _STEP]
            yield a, _mix(part)

    def at(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        out = self.prefix[starts + size] - self.prefix[starts]
        out *= self.back[starts % _STEP]
        out *= self.far_back[starts // _STEP]
        return _mix(out)


def _sliding(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours."""
    out = np.empty(len(x) - width + 1, dtype=x.dtype)
    for a in range(0, len(out), _STEP):
        to, span = out[a : a + _STEP], 1
        part = x[a : a + len(to) + width - 1]
        while span * 2 <= width:
            part = pick(part[:-span], part[span:])
            span *= 2
        pick(part[: len(to)], part[width - span :], out=to)
    return out


class _Block:
    """Bytes of a block's documents and their anchors."""

    def __init__(self, texts: list[str | None], ids: np.ndarray, known: np.ndarray, match: int, anchor: int):
        parts = [b"" if t is None else t.encode("utf-8") for t in texts]
        self.match, self.anchor, self.ids = match, anchor, ids
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        n, width = len(self.data), match - anchor + 1
        self.rolling = Rolling(self.data, _BASES[0])
        self.at = np.empty(0, dtype=np.int64)
        self.hashes = np.empty(0, dtype=np.uint64)
        if n >= match:
            # A smaller order of pieces than their whole hash is enough to choose anchors; equal ones are all taken.
            order = np.empty(n - anchor + 1, dtype=np.uint32)
            for a, part in self.rolling.pieces(anchor):
                order[a : a + len(part)] = part >> np.uint64(33)
            order += np.uint32(1)
            padded = np.zeros(len(order) + width - 1, dtype=np.uint32)
            least = padded[width - 1 : len(order)]
            least[:] = _sliding(order, width, np.minimum)
            # Strings that a document does not hold whole, and all of documents without an id, choose no anchor.
            whole = np.where(known, np.maximum(self.ends - match + 1, self.starts), self.starts)
            for a, b in zip(whole.tolist(), self.ends.tolist(), strict=True):
                least[a:b] = 0
            self.at = np.flatnonzero(_sliding(padded, width, np.maximum) == order)
            self.hashes = self.rolling.at(self.at, anchor)
        self.doc = np.searchsorted(self.ends, self.at, "right")
        #: Ascending distinct anchor hashes, the number of each anchor, occurrences of each.
        self.distinct, self.number, self.count = np.unique(self.hashes, return_inverse=True, return_counts=True)

    def around(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of anchors: bytes from the anchor on, bytes before it read backwards, as rows padded with zeros, and the lengths of both."""
        at, doc = self.at[picked], self.doc[picked]
        reach = self.match - self.anchor
        right = np.minimum(self.ends[doc] - at, self.match)
        left = np.minimum(at - self.starts[doc], reach)
        padded = np.concatenate((np.zeros(reach, dtype=np.uint8), self.data, np.zeros(self.match, dtype=np.uint8)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, reach + self.match)[at]
        rows = np.concatenate((windows[:, reach:], windows[:, :reach][:, ::-1]), axis=1)
        edge = np.flatnonzero((right < self.match) | (left < reach))
        rows[edge, : self.match] *= np.arange(self.match) < right[edge, None]
        rows[edge, self.match :] *= np.arange(reach) < left[edge, None]
        return rows, right, left


class _Shared:
    """What a block asks about its shared anchors: entries of equal surroundings, and strings of hot anchors."""

    def __init__(self, block: _Block, shared: np.ndarray, hot: np.ndarray):
        reach = block.match - block.anchor
        self.picked = np.flatnonzero((shared & ~hot)[block.number]) if len(block.at) else np.empty(0, dtype=np.int64)
        rows, right, left = block.around(self.picked)
        full = np.concatenate((rows, right[:, None].astype(np.uint8), left[:, None].astype(np.uint8)), axis=1)
        keys = block.hashes[self.picked]
        first, self.entry = _entries(keys, full, block.rolling.at(block.at[self.picked] - left, left + right))
        self.rows, self.keys = full[first], keys[first]
        self.right, self.left = right, left
        self.least = _least(self.entry, block.ids[block.doc[self.picked]], len(first))
        # Starts of all strings with a hot anchor.
        hot_at = block.at[hot[block.number]] if len(block.at) else np.empty(0, dtype=np.int64)
        doc = np.searchsorted(block.ends, hot_at, "right")
        starts = (hot_at[:, None] - np.arange(reach + 1)).ravel()
        fits = (starts >= np.repeat(block.starts[doc], reach + 1)) & (starts + block.match <= np.repeat(block.ends[doc], reach + 1))
        self.starts = np.unique(starts[fits])
        self.string = np.empty(0, dtype=np.int64)
        self.strings = np.empty((0, 2), dtype=np.uint64)
        self.string_doc = np.searchsorted(block.ends, self.starts, "right")
        if len(self.starts):
            both = np.stack([Rolling(block.data, b).at(self.starts, block.match) for b in _BASES], axis=1)
            order = np.lexsort((both[:, 1], both[:, 0]))
            new = np.r_[True, (np.diff(both[order, 0]) != 0) | (np.diff(both[order, 1]) != 0)]
            self.strings = both[order][new]
            self.string = np.empty(len(order), dtype=np.int64)
            self.string[order] = np.cumsum(new) - 1
        self.string_least = _least(self.string, block.ids[self.string_doc], len(self.strings))


def _entries(keys: np.ndarray, full: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each kind, and the number of each row's kind; an order that only the anchors' hashes (first) and the bytes decide."""
    if not len(keys):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    hashes = _mix(hashes ^ (full[:, -2].astype(np.uint64) << np.uint64(8) | full[:, -1].astype(np.uint64)))
    order = np.lexsort((hashes, keys))
    new = np.r_[True, (np.diff(keys[order]) != 0) | (np.diff(hashes[order]) != 0)]
    same = np.flatnonzero(~new)
    if not np.array_equal(full[order[same]], full[order[same - 1]]):
        # Hashes that lied: the bytes decide.
        tagged = np.concatenate((keys.astype(">u8").view(np.uint8).reshape(-1, 8), full), axis=1)
        line = np.ascontiguousarray(tagged).view(np.dtype((np.void, tagged.shape[1]))).ravel()
        return np.unique(line, return_index=True, return_inverse=True)[1:]
    entry = np.empty(len(order), dtype=np.int64)
    entry[order] = np.cumsum(new) - 1
    return order[new], entry


def _least(number: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.full(size, np.iinfo(np.int64).max, dtype=np.int64)
    np.minimum.at(out, number, values)
    return out


# --- sorting suffixes


def _prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """Hash of every prefix of every row, the empty one first."""
    powers = np.array([pow(_BASES[0], k, 1 << 64) for k in range(rows.shape[1])], dtype=np.uint64)
    out = np.zeros((len(rows), rows.shape[1] + 1), dtype=np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=out[:, 1:])
    return out


def _common(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows, by binary search for the last equal prefix hash."""
    low = np.zeros(len(a), dtype=np.int64)
    high = np.full(len(a), hashes.shape[1] - 1, dtype=np.int64)
    for _ in range(int(hashes.shape[1]).bit_length()):
        middle = (low + high + 1) >> 1
        same = hashes[a, middle] == hashes[b, middle]
        low = np.where(same, middle, low)
        high = np.where(same, high, middle - 1)
    return low


def suffix_order(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each group (ascending numbers) in order, and the verified common prefix with the row before (-1 at a group's first).

    All groups are merged level by level: each element looks up its rank in the run beside its own.
    """
    n, width = rows.shape
    hashes = _prefix_hashes(rows)
    order = np.arange(n)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, dtype=np.int64)
    size = np.diff(np.append(first, n))
    begin, end = np.repeat(first, size), np.repeat(first + size, size)
    spot = np.arange(n) - begin

    def before(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _common(hashes, x, y)
        whole = at == width
        at = np.minimum(at, width - 1)
        return ~whole & (rows[x, at] < rows[y, at]), whole

    run = 1
    while n and run < size.max():
        todo = np.flatnonzero(end - begin > run)
        pair = spot[todo] // (2 * run) * (2 * run) + begin[todo]
        in_left = spot[todo] // run % 2 == 0
        other = pair + np.where(in_left, run, 0)
        low = np.minimum(other, end[todo])
        high = np.minimum(other + run, end[todo])
        low_start = low.copy()
        mine = order[todo]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            less, equal = before(order[middle], mine[open_])
            # Equal rows keep their order: those of the left run come first.
            less |= equal & ~in_left[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        rank = low - low_start
        own = spot[todo] + begin[todo] - pair - np.where(in_left, 0, run)
        place = pair + own + rank
        order[place] = mine
        run *= 2
    common = np.full(n, -1, dtype=np.int64)
    inner = np.flatnonzero(np.r_[False, group[1:] == group[:-1]]) if n else np.empty(0, dtype=np.int64)
    x, y = order[inner], order[inner - 1]
    common[inner] = _common(hashes, x, y)
    # Verification: the bytes decide. A hash that lied has put rows out of order; then they are sorted by bytes.
    differ = rows[x] != rows[y]
    exact = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    if not np.array_equal(exact, common[inner]):
        order = np.lexsort((*rows.T[::-1], group))
        x, y = order[inner], order[inner - 1]
        differ = rows[x] != rows[y]
        common[inner] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


def earlier_strings(rows: np.ndarray, group: np.ndarray, ids: np.ndarray, match: int, anchor: int) -> np.ndarray:
    """For each entry, a bit for each number of bytes before the anchor: set if an entry with a smaller id has that string."""
    reach = match - anchor
    after, before = rows[:, :match], rows[:, match : match + reach]
    right, left = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    by_right, common_right = suffix_order(after, group)
    by_left, common_left = suffix_order(before, group)
    # What an entry has in common with its neighbour in the order is the most that it has in common with any.
    most_right, most_left = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
    most_right[by_right] = np.minimum(np.maximum(common_right, np.append(common_right[1:], -1)), right[by_right])
    most_left[by_left] = np.minimum(np.maximum(common_left, np.append(common_left[1:], -1)), left[by_left])
    bits = np.zeros(len(rows), dtype=np.uint64)
    some = np.flatnonzero(most_right + most_left >= match)
    most_right, most_left = most_right[some], most_left[some]
    class_right, class_left = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
    for taken in range(reach + 1):
        at = some[(most_left >= taken) & (most_right >= match - taken)]
        if not len(at):
            continue
        class_right[by_right] = np.cumsum(common_right < match - taken)
        class_left[by_left] = np.cumsum(common_left < taken)
        both = class_right[at] * (len(rows) + 1) + class_left[at]
        order = np.argsort(both)
        new = np.r_[True, np.diff(both[order]) != 0]
        mine = ids[at[order]]
        least = np.minimum.reduceat(mine, np.flatnonzero(new))[np.cumsum(new) - 1]
        bits[at[order[mine > least]]] |= np.uint64(1 << taken)
    return bits


# --- the three passes


def _docs(frame: pd.DataFrame, match: int, anchor: int) -> _Block:
    known = frame["known"].to_numpy(dtype=bool)
    return _Block(list(frame["text"]), frame["number"].to_numpy(dtype=np.int64), known, match, anchor)


def _ask_anchors(match: int, anchor: int, shards: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        block = _docs(frame, match, anchor)
        rows = [
            (key[0], shard, 0, pack_sorted(block.distinct[a:b]), pack(block.count[a:b].astype(np.uint64)))
            for shard, a, b in cuts(block.distinct, shards)
        ]
        return pd.DataFrame(rows, columns=["block", "shard", "kind", "data", "numbers"])

    return run


def _answer_anchors(hot: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_sorted(d) for d in frame["data"]]
        _, number = np.unique(np.concatenate(parts), return_inverse=True)
        count = np.bincount(number, weights=np.concatenate([unpack(c) for c in frame["numbers"]]).astype(np.float64))
        state = (count > 1).astype(np.uint8) + (count > hot)
        out, at = [], 0
        for block, part in zip(frame["block"], parts, strict=True):
            mine = state[number[at : at + len(part)]]
            out.append((block, key[0], 0, np.packbits(np.concatenate((mine > 0, mine > 1))).tobytes() + len(part).to_bytes(8, "little")))
            at += len(part)
        return pd.DataFrame(out, columns=["block", "shard", "kind", "data"])

    return run


def _states(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shared and hot marks of a block's distinct anchors."""
    shared, hot = [np.empty(0, dtype=bool)], [np.empty(0, dtype=bool)]
    mine = answers[answers["kind"] == 0].sort_values("shard")
    for data in mine["data"]:
        n = int.from_bytes(data[-8:], "little")
        bits = np.unpackbits(np.frombuffer(data[:-8], dtype=np.uint8), count=2 * n).astype(bool)
        shared.append(bits[:n])
        hot.append(bits[n:])
    return np.concatenate(shared), np.concatenate(hot)


def _ask_strings(match: int, anchor: int, shards: int):
    def run(key: tuple, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "shard", "kind", "data", "numbers"]
        if not len(frame):
            return pd.DataFrame(columns=columns)
        asked = _Shared(_docs(frame, match, anchor), *_states(answers))
        rows = [
            (key[0], shard, 1, zlib.compress(asked.rows[a:b].tobytes(), 1), pack(asked.least[a:b].view(np.uint64)) + pack_sorted(asked.keys[a:b]))
            for shard, a, b in cuts(asked.keys, shards)
        ]
        rows += [
            (key[0], shard, 2, asked.strings[a:b].tobytes(), pack(asked.string_least[a:b].view(np.uint64)))
            for shard, a, b in cuts(asked.strings[:, 0], shards)
        ]
        return pd.DataFrame(rows, columns=columns)

    return run


def _answer_strings(match: int, anchor: int):
    width = match + (match - anchor) + 2

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        entries = frame[frame["kind"] == 1]
        if len(entries):
            halves = [(n[: len(n) // 2], n[len(n) // 2 :]) for n in entries["numbers"]]
            ids = np.concatenate([unpack(a) for a, _ in halves]).view(np.int64)
            keys = np.concatenate([unpack_sorted(b) for _, b in halves])
            rows = np.concatenate([np.frombuffer(zlib.decompress(d), dtype=np.uint8).reshape(-1, width) for d in entries["data"]])
            order = np.argsort(keys, kind="stable")
            # An anchor with one entry has nothing to compare; what its block knows is enough.
            differ = np.diff(keys[order]) != 0
            order = order[~(np.r_[True, differ] & np.r_[differ, True])]
            bits = np.zeros(len(keys), dtype=np.uint64)
            for part in _chunks(keys[order]):
                mine = order[part]
                group = np.cumsum(np.r_[0, np.diff(keys[mine]) != 0])
                bits[mine] = earlier_strings(rows[mine], group, ids[mine], match, anchor)
            at = 0
            for block, (a, _) in zip(entries["block"], halves, strict=True):
                n = len(a) // 8
                out.append((block, key[0], 1, pack(bits[at : at + n])))
                at += n
        strings = frame[frame["kind"] == 2]
        if len(strings):
            parts = [np.frombuffer(d, dtype=np.uint64).reshape(-1, 2) for d in strings["data"]]
            both = np.concatenate(parts)
            ids = np.concatenate([unpack(n) for n in strings["numbers"]]).view(np.int64)
            order = np.lexsort((ids, both[:, 1], both[:, 0]))
            new = np.r_[True, (np.diff(both[order, 0]) != 0) | (np.diff(both[order, 1]) != 0)]
            least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            late = np.empty(len(ids), dtype=np.uint64)
            late[order] = ids[order] > least
            at = 0
            for block, part in zip(strings["block"], parts, strict=True):
                out.append((block, key[0], 2, pack(late[at : at + len(part)])))
                at += len(part)
        return pd.DataFrame(out, columns=["block", "shard", "kind", "data"])

    return run


def _chunks(keys: np.ndarray) -> Iterator[slice]:
    """Slices of about ``CHUNK`` sorted keys that part no key."""
    at = 0
    while at < len(keys):
        end = min(at + CHUNK, len(keys))
        end = int(np.searchsorted(keys, keys[end - 1], "right"))
        yield slice(at, end)
        at = end


def _remove(match: int, anchor: int, carry: list[str]):
    def run(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = _docs(frame, match, anchor)
        asked = _Shared(block, *_states(answers))
        answers = answers.sort_values(["kind", "shard"])

        def answered(kind: int) -> np.ndarray:
            return np.concatenate([np.empty(0, dtype=np.uint64), *[unpack(d) for d in answers.loc[answers["kind"] == kind, "data"]]])

        reach = match - anchor
        own = block.ids[block.doc[asked.picked]] > asked.least[asked.entry]
        bits = np.where(own, np.uint64((1 << (reach + 1)) - 1), answered(1)[asked.entry])
        some = np.flatnonzero(bits)
        bits, at, left, right = bits[some], block.at[asked.picked[some]], asked.left[some], asked.right[some]
        # A byte goes if one of the ``match`` places up to its own starts a string that goes.
        marked = np.zeros(len(block.data) + match - 1, dtype=np.uint8)
        begins = marked[match - 1 :]
        for taken in range(reach + 1):
            hit = (bits >> np.uint64(taken) & np.uint64(1)).astype(bool) & (left >= taken) & (right >= match - taken)
            begins[at[hit] - taken] = 1
        late = (block.ids[asked.string_doc] > asked.string_least[asked.string]) | answered(2)[asked.string].astype(bool)
        begins[asked.starts[late]] = 1
        gone = _sliding(marked, match, np.maximum).view(bool)
        removed, spans, digests, texts = [], [], [], []
        for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
            mask = gone[a:b]
            removed.append(int(np.count_nonzero(mask)))
            kept = (block.data[a:b][~mask] if removed[-1] else block.data[a:b]).tobytes()
            spans.append(int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept)
        return frame[carry].assign(n_bytes=block.sizes, n_removed=removed, n_spans=spans, kept_sha256=digests, kept=texts)

    return run


def remove_repeats(
    df: DataFrame, identity: str, text: str = "text", match: int = MATCH, anchor: int = ANCHOR,
    block_bytes: int = BLOCK_BYTES, hot: int = HOT, keep_bytes: bool = True,
) -> DataFrame:
    """``identity, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, ``kept`` (the remaining bytes; they may cut a character)."""
    if not 0 < anchor <= match or match - anchor >= 63 or match > 255:
        raise ValueError("anchors must be at most 62 bytes shorter than the match, and that at most 255 bytes")
    body, number = F.col(f"`{text}`"), F.col(f"`{identity}`")
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("n")).first()["n"]
    blocks = max(least, -(-size // block_bytes))
    shards = max(least, -(-blocks // BLOCKS_PER_SHARD))
    docs = df.select(
        number.alias("id"),
        F.coalesce(number.cast("bigint"), F.lit(0)).alias("number"),
        number.isNotNull().alias("known"),
        body.alias("text"),
        F.pmod(F.xxhash64(number, body), F.lit(blocks)).cast("int").alias("block"),
    )
    slim = docs.drop("id")
    asked = slim.groupBy("block").applyInPandas(_ask_anchors(match, anchor, shards), _ASKED)
    states = settled(asked.groupBy("shard").applyInPandas(_answer_anchors(hot), _ANSWER), "anchor-states")
    wanted = slim.groupBy("block").cogroup(states.groupBy("block")).applyInPandas(_ask_strings(match, anchor, shards), _ASKED)
    strings = settled(wanted.groupBy("shard").applyInPandas(_answer_strings(match, anchor), _ANSWER), "string-states")
    fields = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.BinaryType())]
    schema = T.StructType([T.StructField("id", df.schema[identity].dataType), *[T.StructField(*f) for f in fields]])
    run = _remove(match, anchor, ["id"])
    done = docs.groupBy("block").cogroup(states.unionAll(strings).groupBy("block"))
    if keep_bytes:
        out = done.applyInPandas(run, schema)
    else:
        out = done.applyInPandas(lambda a, b: run(a, b).drop(columns="kept"), T.StructType(schema.fields[:-1]))
    return out.withColumnRenamed("id", identity)
