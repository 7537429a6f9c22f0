"""Static binary-fuse filters over 64-bit keys: three cells a key, built by peeling."""

from __future__ import annotations

import numpy as np

ATTEMPTS = 64


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _cells(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three cell numbers of each key, in three consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    base = first * np.uint64(segment)
    step = np.uint64(segment)
    low = (h & mask, (h >> np.uint64(16)) & mask, (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & mask)
    return np.stack([base + low[0], base + step + low[1], base + step * np.uint64(2) + low[2]]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(8)) ^ (h >> np.uint64(40))).astype(np.uint8)


def _shape(n: int) -> tuple[int, int]:
    """Length and number of the starting segments for n keys."""
    segment = 1 << min(16, max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return segment, max(1, -(-int(n * factor) // segment) - 2)


def _peeled(cells: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the cell each key owns), or None where peeling gets stuck."""
    n = cells.shape[1]
    left = np.ones(n, dtype=bool)
    rounds: list[tuple[np.ndarray, np.ndarray]] = []
    while left.any():
        live = np.flatnonzero(left)
        spots = cells[:, live].ravel()
        count = np.bincount(spots, minlength=size)
        owner = np.zeros(size, dtype=np.int64)
        owner[spots] = np.tile(live, 3)
        lone = np.flatnonzero(count == 1)
        if not len(lone):
            return None
        keys, at = np.unique(owner[lone], return_index=True)
        rounds.append((keys, lone[at]))
        left[keys] = False
    return rounds


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment, segments, cells) of a filter that holds every key."""
    keys = np.unique(keys.astype(np.uint64))
    segment, segments = _shape(len(keys))
    for seed in range(ATTEMPTS):
        h = _mixed(keys, seed)
        cells = _cells(h, segment, segments)
        size = (segments + 2) * segment
        rounds = _peeled(cells, size)
        if rounds is not None:
            table, prints = np.zeros(size, dtype=np.uint8), _prints(h)
            for members, own in reversed(rounds):
                a, b, c = cells[:, members]
                # the owned cell is still zero, so the three together leave the other two
                table[own] = prints[members] ^ table[a] ^ table[b] ^ table[c]
            return seed, segment, segments, table.tobytes()
        if seed % 4 == 3:
            segments += max(1, segments // 8)
    raise ValueError(f"no filter for {len(keys)} keys")


def contains(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    """Whether each key may be in the filter: always for its own, else once in 256."""
    h = _mixed(keys.astype(np.uint64), seed)
    a, b, c = _cells(h, segment, segments)
    cells = np.frombuffer(table, dtype=np.uint8)
    return (cells[a] ^ cells[b] ^ cells[c]) == _prints(h)
