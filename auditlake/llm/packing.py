"""Numbers as bytes that compress well: one plane for each byte of a number."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> bytes:
    """Unsigned longs as byte planes; planes of zeros shrink to nothing in a compressed shuffle."""
    data = np.ascontiguousarray(values, dtype="<u8")
    return np.ascontiguousarray(data.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned longs by their differences."""
    return pack(np.diff(values, prepend=np.zeros(1, dtype=np.uint64)).astype(np.uint64))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each hash; ascending hashes have ascending shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def cuts(hashes: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, start, end) of the non-empty shards of ascending hashes."""
    if not len(hashes):
        return []
    owner = shard_of(hashes, shards).astype(np.int64)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    ends = np.append(starts[1:], len(owner))
    return [(int(owner[a]), int(a), int(b)) for a, b in zip(starts, ends, strict=True)]
