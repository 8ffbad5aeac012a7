"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds (leftmost, non-overlapping within a kind; a proposal that fails its
check is dropped, not retried): email; ip (no part over 255); card (14 to 19
digits that pass Luhn); phone (+, 10 to 15 digits). They are always reported.

Added kinds: iban (mod 97 of the rearranged digits is 1), ssn (area, group and
serial in range) and local_phone (ten grouped digits). They are reported when
their score reaches ``THRESHOLD`` and they do not overlap a base span. A score
is the kind's own value plus ``CONTEXT_BONUS`` if one of the kind's words stands
nearby; without a checksum only the context lifts a proposal over the threshold.

Offsets are code points, end exclusive. Every whole text is scanned, row by row,
without a shuffle. Defined results: null and empty texts have no spans, counts 0,
empty strings and the hash of the empty string. Repeated rows repeat; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")
KINDS = BASE + ADDED
KIND_RANK = {k: i for i, k in enumerate(KINDS)}

THRESHOLD = 0.6
CONTEXT_BONUS = 0.3
CONTEXT_BEFORE, CONTEXT_AFTER = 48, 24
OWN_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.65, "iban": 0.7, "ssn": 0.35, "local_phone": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write to", "address"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell", "contact"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security", "tax id"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "cell"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: begins only where a run of digits does and never gives digits back, so a run is read once
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]*[0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, str]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from their @: the local part is the run before it, so each
    character is looked at once however long the runs are."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [(s, e, "email") for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group()) if m.end() - m.start() <= 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def added_proposals(text: str) -> Iterator[Span]:
    for m in _IBAN.finditer(text):
        compact = m.group().replace(" ", "")
        if 15 <= len(compact) <= 34 and mod97(compact):
            yield m.start(), m.end(), "iban"
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.start(), m.end(), "ssn"
    for m in _LOCAL_PHONE.finditer(text):
        yield m.start(), m.end(), "local_phone"


def score(text: str, span: Span) -> float:
    start, end, kind = span
    near = (text[max(0, start - CONTEXT_BEFORE):start] + " " + text[end:end + CONTEXT_AFTER]).lower()
    bonus = CONTEXT_BONUS if any(re.search(rf"(?<![a-z]){re.escape(w)}", near) for w in CONTEXT[kind]) else 0.0
    return round(min(1.0, OWN_SCORE[kind] + bonus), 2)


def find_spans(text: str | None) -> tuple[list[Span], list[tuple[Span, float]]]:
    """(base spans, all spans with scores), each by start, then kind."""
    if not text:
        return [], []
    order = lambda s: (s[0], KIND_RANK[s[2]], s[1])
    base = sorted(base_spans(text), key=order)
    every = [(s, score(text, s)) for s in base]
    starts, reach = [s[0] for s in base], list(accumulate((s[1] for s in base), max))
    for span in added_proposals(text):
        before = bisect_left(starts, span[1])            # base spans that begin before this one ends
        if not (before and reach[before - 1] > span[0]) and (value := score(text, span)) >= THRESHOLD:
            every.append((span, value))
    return base, sorted(every, key=lambda x: order(x[0]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count per kind, base_sha256, spans, scores (joined like spans)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [find_spans(t.as_py()) for t in part.column(1)]
                spans = [[s for s, _ in every] for _, every in found]
                counts = [pa.array([sum(s[2] == k for s in x) for x in spans], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts,
                     pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()),
                     pa.array([joined(x) for x in spans], pa.string()),
                     pa.array([",".join(f"{v:.2f}" for _, v in every) for _, every in found], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "scores"])

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")).mapInArrow(
        run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, scores string")
