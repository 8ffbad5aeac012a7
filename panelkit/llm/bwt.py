"""Repeated strings of a minimum length by interval expansion on a Burrows-Wheeler transform.

The suffixes of some texts, each closed by its own end mark, are sorted; the
transform's backward step leads from a suffix to the one a character longer.
Starting from the intervals of the strings as long as the sort's first key (the
keys tell the shorter common prefixes), breadth-first backward extension
visits the intervals of all strings by increasing length; the first interval
that ends before a border between neighbouring suffixes gives that border's
common-prefix length, and only then is it extended further. The expansion stops
at the minimum length: borders without a value have common prefixes at least
that long, and the suffixes beside them start repeated strings.
"""

from __future__ import annotations

import numpy as np

KEY_BITS = 63                   # of the first sort key


def _sorted_by(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(``key`` sorted, the order that sorts it); ``size`` bounds the key."""
    bits = int(len(key)).bit_length()
    if size.bit_length() + bits > KEY_BITS:
        by = np.argsort(key, kind="stable")
        return key[by], by
    # key and position as one number: values sort several times faster than indices
    packed = key << bits
    packed |= np.arange(len(key), dtype=np.int64)
    packed.sort()
    by = packed & ((1 << bits) - 1)
    packed >>= bits
    return packed, by


def dense_symbols(text: np.ndarray) -> tuple[np.ndarray, int]:
    """``text`` with its symbols numbered without gaps in their order (0 stays 0), and the bits of one."""
    there = np.bincount(text, minlength=1) > 0
    there[0] = True
    return (np.cumsum(there) - 1)[text], max(1, int(there.sum() - 1).bit_length())


def suffix_order(text: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, tuple[int, np.ndarray, np.ndarray]]:
    """(order, rank) of the suffixes of ``text`` (0 for an end mark, else byte + 1);
    ``ends`` are the positions of the marks, ordered by position among themselves.
    The third value tells the common prefixes shorter than the first sort key:
    its length (at most ``least``), whether the border after a slot has at least
    that length, and whether it has one character less."""
    n = len(text)
    symbols, bits = dense_symbols(text)
    pack = min(least, KEY_BITS // bits)                      # characters in the first sort key
    key, have = symbols, 1
    while have < pack:
        more = min(have, pack - have)
        ahead = np.zeros(n, dtype=np.int64)
        ahead[:max(0, n - have)] = key[have:]
        key = (key << (more * bits)) | (ahead >> ((have - more) * bits))
        have += more
    # the few suffixes that reach their end mark within the key end there, and are told apart by the mark
    sizes = np.diff(ends, prepend=-1) - 1
    far = np.tile(np.arange(pack), len(ends))
    which = np.repeat(np.arange(len(ends)), pack)
    inside = far <= sizes[which]
    far, which = far[inside], which[inside]
    near = ends[which] - far
    cut = (pack - 1 - far) * bits
    key[near] = (key[near] >> cut) << cut
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    # a zero at the end of a key or of its head: an end mark stands within, and no two marks are equal
    symbol = (1 << bits) - 1
    longer = np.append(~fresh[1:] & ((sorted_key[1:] & symbol) > 0), False)
    head = sorted_key >> bits
    just = np.append((head[1:] == head[:-1]) & ((head[1:] & symbol > 0) if pack > 1 else True), False) & ~longer
    rank = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    mark = np.full(n, -1, dtype=np.int64)
    mark[near] = which
    _split(order, rank, fresh, mark)
    depth = pack
    open_ = np.flatnonzero(~fresh | np.append(~fresh[1:], False)).astype(rank.dtype)
    at = order[open_].astype(rank.dtype)
    group = rank[at]
    while len(open_):
        # slots of one rank are neighbours: (rank, rank further on) as one number
        pair = group.astype(np.int64)
        pair *= n
        pair += rank[at + depth]
        pair, sub = _sorted_by(pair, n * n)
        at = at[sub]
        start = np.ones(len(at) + 1, dtype=bool)
        np.not_equal(pair[1:], pair[:-1], out=start[1:-1])
        group = open_[np.maximum.accumulate(np.where(start[:-1], np.arange(len(at), dtype=rank.dtype), 0))]
        rank[at] = group
        alone = start[:-1] & start[1:]
        order[open_[alone]] = at[alone]
        more = ~alone
        open_, at, group = open_[more], at[more], group[more]
        depth *= 2
    return order, rank, (pack, longer, just)


def _split(order: np.ndarray, rank: np.ndarray, fresh: np.ndarray, mark: np.ndarray) -> None:
    """Within equal keys that hold an end mark, order by the mark; each is then alone in its rank."""
    slots = np.flatnonzero(mark[order] >= 0)
    at = order[slots]
    sub = np.lexsort((mark[at], rank[at]))
    order[slots] = at[sub]
    rank[order[slots]] = slots
    fresh[slots] = True
    after = slots + 1
    fresh[after[after < len(order)]] = True


def long_borders(text: np.ndarray, order: np.ndarray, rank: np.ndarray, known: tuple[int, np.ndarray, np.ndarray], least: int) -> np.ndarray:
    """For each border between suffixes i - 1 and i in order (0 and n are outer
    borders): whether their common prefix has at least ``least`` characters.

    The sort by the first ``pack`` characters has given the borders of shorter
    common prefixes and the intervals of the strings of that length; those that
    end before a border of ``pack - 1`` are where the expansion stands then."""
    pack, longer, just = known
    before = order - 1
    char = np.where(before >= 0, text[before], 0).astype(np.int16)      # the transform; 0 at a text's start
    back = rank[before]                                                  # its backward step
    open_ = np.concatenate([[False], longer])                            # borders without a value
    hi = np.flatnonzero(just).astype(back.dtype)
    ends = np.flatnonzero(~longer)                                       # the last slots of the intervals
    lo = np.concatenate([[-1], ends])[np.searchsorted(ends, hi)].astype(back.dtype) + back.dtype.type(1)
    for _ in range(pack, least):
        if not len(lo):
            break
        one = lo == hi
        i = lo[one]
        i = i[char[i] > 0]
        new_lo = new_hi = back[i]
        lo, hi = lo[~one], hi[~one]
        if len(lo):
            size = hi - lo + 1
            which = np.repeat(np.arange(len(lo)), size)
            member = np.arange(len(which)) + np.repeat(lo - (np.cumsum(size) - size), size)
            c = char[member]
            ok = c > 0
            which, member = which[ok], member[ok]
            # one character's members of an interval lead to neighbouring suffixes
            key = which * 257 + c[ok]
            key, by = _sorted_by(key, len(lo) * 257)
            step = back[member[by]]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
            last = np.append(first[1:], len(key)) - 1 if len(first) else first
            new_lo = np.concatenate([new_lo, step[first]])
            new_hi = np.concatenate([new_hi, step[last]])
        grown = open_[new_hi + 1]
        lo, hi = new_lo[grown], new_hi[grown]
        open_[hi + 1] = False
    return open_


def repeated_starts(texts: list[bytes], least: int) -> list[np.ndarray]:
    """Per text, for each start of ``least`` bytes: whether that string starts anywhere else in ``texts``."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not len(sizes) or sizes.max() < least:
        return [np.zeros(max(0, n - least + 1), dtype=bool) for n in sizes.tolist()]
    ends = np.cumsum(sizes + 1) - 1
    joined = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int64) + 1
    joined[ends] = 0
    order, rank, known = suffix_order(joined, ends, least)
    border = long_borders(joined, order, rank, known, least)
    twice = np.zeros(len(joined), dtype=bool)
    twice[order] = border[:-1] | border[1:]
    starts = ends - sizes
    return [twice[a:a + max(0, n - least + 1)] for a, n in zip(starts.tolist(), sizes.tolist())]
