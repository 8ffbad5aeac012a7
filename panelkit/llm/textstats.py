"""Shape statistics of a text, the inputs of the quality score."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

# classes of a UTF-8 byte
LOWER, UPPER, DIGIT, SPACE, NEWLINE, STOP, SHOUT, DASH, BRACKET, SYMBOL, CONTROL, HIGH = range(12)
N_CLASSES = 12


def _byte_classes() -> np.ndarray:
    t = np.full(256, HIGH, dtype=np.uint8)
    t[:32] = CONTROL
    t[127] = CONTROL
    t[32:127] = SYMBOL
    for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER),
                     (b"0123456789", DIGIT), (b" \t", SPACE), (b"\n\r", NEWLINE), (b".,;:'\"", STOP),
                     (b"!?", SHOUT), (b"-_/", DASH), (b"()[]{}<>", BRACKET)):
        t[list(chars)] = k
    return t


BYTE_CLASS = _byte_classes()

NAMES = ("lower", "upper", "digit", "space", "newline", "stop", "shout", "dash", "bracket", "symbol", "control", "high",
         "log_words", "word_len", "word_len_sd", "distinct_words", "top_word", "log_distinct", "long_words", "caps_words",
         "symbol_ends", "title_words", "short_lines", "distinct_lines", "log_lines", "stop_line_ends", "one_char_words")

#: byte classes that rarely end a word of prose, and those that follow a word
_ODD_END = np.isin(np.arange(N_CLASSES), (SYMBOL, SHOUT, BRACKET))[BYTE_CLASS]
_BLANK = np.isin(np.arange(N_CLASSES), (SPACE, NEWLINE))[BYTE_CLASS]


def text_stats(text: str | None) -> list[float]:
    """One finite number per name of ``NAMES``; zeros where a share has nothing to count."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    m = len(words)
    if not m:
        return [0.0] * len(NAMES)
    data = np.frombuffer(raw, dtype=np.uint8)
    shares = np.bincount(BYTE_CLASS[data], minlength=N_CLASSES) / len(raw)
    odd_ends = np.count_nonzero(_ODD_END[data[:-1]] & _BLANK[data[1:]]) + bool(_ODD_END[data[-1]])
    lens = np.fromiter(map(len, words), dtype=np.int64, count=m)
    tally = Counter(words)
    lines = [x for x in map(bytes.strip, raw.split(b"\n")) if x]
    k = len(lines)
    return [*shares.tolist(), math.log1p(m), float(lens.mean()) / 10, float(lens.std()) / 10, len(tally) / m,
            max(tally.values()) / m, math.log1p(len(tally)) / math.log1p(m), float(np.count_nonzero(lens > 15)) / m,
            sum(map(bytes.isupper, words)) / m, int(odd_ends) / m, sum(map(bytes.istitle, words)) / m,
            sum(map((30).__gt__, map(len, lines))) / k, len(set(lines)) / k, math.log1p(k),
            sum(x.endswith((b".", b"!", b"?")) for x in lines) / k, float(np.count_nonzero(lens == 1)) / m]
