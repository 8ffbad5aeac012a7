"""Static binary-fuse filter (three segments, 16-bit fingerprints) in numpy.

A filter is built once for an immutable set of 64-bit keys and never changed.
It answers "maybe present" for every key of the set and for about one other
key in 65,536.  Construction is by peeling; each round peels all slots that
hold a single key at once, so it is a handful of array passes.
"""

from __future__ import annotations

import math

import numpy as np

U = np.uint64
ARITY = 3
MAX_TRIES = 64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser over keys and a seed."""
    with np.errstate(over="ignore"):
        h = x + U(seed)
        h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U(33))


def layout(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for n keys."""
    if n < 2:
        return 4, 3
    seg = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n))
    return seg, max(ARITY, -(-int(n * factor) // seg) + ARITY - 1)


def slots(h: np.ndarray, seg: int, count: int) -> np.ndarray:
    """The three slots of each hash, in three consecutive segments: shape (3, n)."""
    span, mask = U((count - ARITY + 1) * seg), U(seg - 1)
    with np.errstate(over="ignore"):
        first = (h >> U(32)) * span >> U(32)
    second = (first + U(seg)) ^ (h >> U(18) & mask)
    third = (first + U(2 * seg)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> U(16)) ^ (h >> U(48))) & U(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> dict:
    """Filter over the distinct values of ``keys`` (uint64). Empty sets give a
    filter that holds nothing."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    seg, count = layout(n)
    if n == 0:
        return {"seed": 0, "seg": seg, "count": 0, "table": b""}
    for attempt in range(MAX_TRIES):
        seed = (0x9E3779B97F4A7C15 * (attempt + 1)) & 0xFFFFFFFFFFFFFFFF
        if attempt and attempt % 4 == 0:
            count += max(1, count // 8)
        order = _peel(mix(keys, seed), seg, count)
        if order is not None:
            break
    else:
        raise RuntimeError("binary-fuse construction failed")
    h = mix(keys, seed)
    s, table = slots(h, seg, count), np.zeros(seg * count, dtype=np.uint16)
    fp = fingerprint(h)
    for which, at in reversed(order):       # a round's keys own distinct slots
        x = s[:, which]
        table[at] = 0
        table[at] = fp[which] ^ table[x[0]] ^ table[x[1]] ^ table[x[2]]
    return {"seed": seed, "seg": seg, "count": count, "table": table.tobytes()}


def _peel(h: np.ndarray, seg: int, count: int):
    """Rounds of (keys, their slots), or None when a core remains."""
    s = slots(h, seg, count)
    m = seg * count
    held = np.bincount(s.ravel(), minlength=m)
    acc = np.zeros(m, dtype=np.int64)       # xor of the key numbers in a slot
    for row in s:
        np.bitwise_xor.at(acc, row, np.arange(len(h)))
    rounds, left = [], len(h)
    front = np.flatnonzero(held == 1)
    while len(front):
        which, first = np.unique(acc[front], return_index=True)
        at = front[first]
        rounds.append((which, at))
        left -= len(which)
        x = s[:, which]
        touched = x.ravel()
        np.subtract.at(held, touched, 1)
        np.bitwise_xor.at(acc, touched, np.tile(which, ARITY))
        touched = np.unique(touched)
        front = touched[held[touched] == 1]
    return rounds if left == 0 else None


def contains(f: dict, keys: np.ndarray) -> np.ndarray:
    """Maybe-present flags; never False for a key of the set."""
    if f["count"] == 0:
        return np.zeros(len(keys), dtype=bool)
    table = np.frombuffer(f["table"], dtype=np.uint16)
    h = mix(keys.astype(np.uint64), int(f["seed"]))
    a, b, c = slots(h, int(f["seg"]), int(f["count"]))
    return (table[a] ^ table[b] ^ table[c]) == fingerprint(h)
