"""Content-defined anchors of byte strings.

An anchor is the position of the least k-gram hash in some window of ``span`` consecutive k-gram
starts (ties: the first).  Which position a window selects depends on the window's bytes alone, so
two equal strings of ``k + span - 1`` bytes hold an anchor at the same place.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[:n]


def gram_hashes(data: bytes, k: int) -> np.ndarray:
    """A mixed rolling hash of each k-gram of data."""
    n = len(data)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * _table("up", _BASE, n), out=sums[1:])
        h = (sums[k:] - sums[: n - k + 1]) * _table("down", _BASE_INV, n - k + 1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each window of span values, by doubling."""
    out, width = values, 1
    while width * 2 <= span:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = span - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: bytes, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first window, last window) of each anchor; windows are named by their start."""
    h = gram_hashes(data, k)
    if len(h) < span:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    low = sliding_min(h, span)
    turns = np.flatnonzero(low[1:] != low[:-1]) + 1
    firsts = np.concatenate(([0], turns))
    lasts = np.concatenate((turns - 1, [len(low) - 1]))
    place, where, start, end = [], [], [], []
    for i, j in zip(firsts.tolist(), lasts.tolist()):
        # Windows i..j share a least value; equal values inside them make it several anchors.
        hits = np.flatnonzero(h[i : j + span] == low[i]) + i
        at = i
        for p in hits.tolist():
            if at > j:
                break
            if p < at:
                continue
            stop = min(p, j)
            place.append(p)
            start.append(at)
            end.append(stop)
            at = stop + 1
    place = np.array(place, np.int64)
    return place, h[place], np.array(start, np.int64), np.array(end, np.int64)
