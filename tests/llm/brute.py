"""Plain Python versions of the operators' results, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return BLANK.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        seen = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            out.append((i, keep, len(ids), i == keep and not seen, sha(t)))
            seen = seen or i == keep
    return sorted(out, key=str)


def simhash(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(rows, bits=2):
    fps = [(i, simhash(t)) for i, t in rows]
    nodes = sorted({f for _, f in fps})
    parent = {f: f for f in nodes}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in range(len(nodes)):
        for b in range(a):
            if (nodes[a] ^ nodes[b]).bit_count() <= bits:
                parent[find(nodes[a])] = find(nodes[b])
    first = {}
    for i, f in fps:
        r = find(f)
        if i is not None:
            first[r] = min(first.get(r, i), i)
    return sorted([(i, f"{f:016x}", first.get(find(f))) for i, f in fps], key=str)


def targets(sizes):
    """{source: target} from {source: words}; shares are re-dealt until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed, free = sum(sizes.values()), {}, set(order)
    while True:
        rest = total - sum(fixed.values())
        wsum = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / wsum > 3 * sizes[s]} if wsum else set()
        if not over:
            return {**fixed, **{s: rest * weight[s] / wsum for s in free}}
        for s in over:
            fixed[s] = 3 * sizes[s]
        free -= over


def windows_removed(texts, n=35):
    """Per text: flags of the words covered by a window of n words that starts elsewhere too."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i:i + n])] > 1:
                gone[i:i + n] = [True] * n
        out.append((w, gone))
    return out


def bytes_removed(texts, n=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - n + 1):
            if seen[r[i:i + n]] > 1:
                gone[i:i + n] = [True] * n
        out.append((r, gone))
    return out
