"""Content-defined anchors of fixed-length windows, in numpy.

A sequence of 64-bit symbols (words or bytes) is cut into windows of ``length``
symbols, one per start. Each window selects the smallest-hashed gram of ``gram``
symbols inside it (the leftmost of equals). Equal windows select the same gram
at the same offset wherever they stand, so they always share an anchor, and
consecutive windows mostly share theirs: a run is an anchor with the starts of
the windows that selected it. A gram selected at m positions bounds the count of
any window that selects it by m.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
#: odd multipliers of the two polynomial hashes
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(max(n, 1 << 16) + 1, b, dtype=np.uint64)
            step[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.cumprod(step, dtype=np.uint64))
        have = _POWERS[base] = (out[0], out[1])
    return have


class Spans:
    """Hashes of any span of a symbol sequence, from prefix sums."""

    def __init__(self, x: np.ndarray, base: int):
        up, self.down = _powers(base, len(x))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * up[:len(x)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.down[start]


@dataclass
class Symbols:
    """The symbols of several rows, one after another; row i has [bounds[i], bounds[i + 1])."""

    x: np.ndarray
    bounds: np.ndarray


def byte_symbols(raws: list[bytes]) -> Symbols:
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    table = mix(np.arange(1, 257, dtype=np.uint64) * U(BASES[0]))
    return Symbols(table[data], np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_symbols(raws: list[bytes]) -> Symbols:
    """A 64-bit hash per blank-separated word (blanks: space and bytes 9 to 13)."""
    data = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_BLANK[data].view(np.int8)))
    starts, ends = edge[0::2] + 1, edge[1::2] + 1
    spans = Spans(data.astype(np.uint64) + U(1), BASES[1])
    x = mix(mix(spans(starts, ends)) + (ends - starts).astype(np.uint64))
    row_at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]) + 1
    return Symbols(x, np.searchsorted(starts, row_at).astype(np.int64))


@dataclass
class Runs:
    """Per run: its row, the first window's start (in the whole sequence), the
    number of windows, the anchor gram's hash."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    gram: np.ndarray


def _sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    n = len(key)
    pad = -n % w
    top = np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks = np.concatenate([key, top]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def find_runs(s: Symbols, length: int, gram: int) -> Runs:
    n = len(s.x)
    empty = np.zeros(0, dtype=np.int64)
    if n < length:
        return Runs(empty, empty, empty, empty.astype(np.uint64))
    at = np.arange(n - gram + 1)
    g = mix(Spans(s.x, BASES[0])(at, at + gram))
    # 32 hash bits above the position: the leftmost of the smallest
    key = (g & U(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    anchor = (_sliding_min(key, length - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(s.bounds, np.arange(len(anchor)), side="right") - 1
    fits = np.arange(len(anchor)) + length <= s.bounds[row + 1]
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~fits[:-1]
    first = np.flatnonzero(new & fits)
    stops = np.append(np.flatnonzero(new | ~fits), len(anchor))
    last = stops[np.searchsorted(stops, first, side="right")]
    return Runs(row[first], first, last - first, g[anchor[first]])
