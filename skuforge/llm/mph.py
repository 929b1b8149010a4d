"""A minimal perfect hash over distinct 32-byte digests, as bitmaps by level, with numpy."""

from __future__ import annotations

import numpy as np

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(digests: np.ndarray, level: int, bits: int) -> np.ndarray:
    """digests: n x 4 words. Each level mixes all 256 bits anew."""
    seed = np.uint64((level * 0x2545F4914F6CDD1D + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = np.full(len(digests), seed, dtype=np.uint64)
    for w in range(4):
        x = _mix(x ^ (digests[:, w] * _ODD[w]))
    return (x % np.uint64(bits)).astype(np.int64)


def words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def build(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each level, and all bitmaps joined. A key rests on the first level where no other key shares its bit;
    its slot is the number of set bits before its own, so n keys fill slots 0 to n-1."""
    sizes, maps, left, level = [], [], digests, 0
    while len(left):
        bits = max(64, 2 * len(left))
        at = _positions(left, level, bits)
        hits = np.bincount(at, minlength=bits)
        sizes.append(bits)
        maps.append(hits == 1)
        left, level = left[hits[at] > 1], level + 1
    return np.array(sizes, dtype=np.int64), np.concatenate(maps) if maps else np.zeros(0, dtype=bool)


def slots(sizes: np.ndarray, bitmap: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 where no level holds it. A nonmember can get a member's slot: compare the digest there."""
    rank = np.cumsum(bitmap) - 1
    out, open_, start = np.full(len(digests), -1, dtype=np.int64), np.arange(len(digests)), 0
    for level, bits in enumerate(sizes):
        if not len(open_):
            break
        at = _positions(digests[open_], level, int(bits)) + start
        found = bitmap[at]
        out[open_[found]] = rank[at[found]]
        open_, start = open_[~found], start + int(bits)
    return out
