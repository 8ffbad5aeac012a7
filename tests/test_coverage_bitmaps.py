"""Coverage from day bitmaps against sets of days."""

import datetime as dt
import random

import pytest

from panelkit.operators import panel as P

WINDOWS = {"full": (None, None), "late": ("1970-03-05", None), "early": (None, "1970-01-31"), "inner": ("1969-12-20", "1970-02-10"),
           "one": ("1970-01-01", "1970-01-01"), "none": ("1999-01-01", "1999-02-01")}
THRESHOLDS = [0.0, 50.0, 90.0, 100.0]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    first = dt.date(1969, 10, 3)                     # day numbers on both sides of 0
    out = [(f"e{k}", first + dt.timedelta(days=rng.randrange(220))) for k in range(30) for _ in range(rng.randrange(1, 200) * (k % 3 + 1))]
    return out + [("e1", None), ("silent", None)] + out[:50]


def brute(rows):
    out = []
    for name, (start, end) in WINDOWS.items():
        lo, hi = (dt.date.fromisoformat(x) if x else None for x in (start, end))
        held = {}
        for e, d in rows:
            if d is not None and (lo is None or d >= lo) and (hi is None or d <= hi):
                held.setdefault(e, set()).add(d)
            elif start is None and end is None:
                held.setdefault(e, set())
        every = sorted(d for s in held.values() for d in s)
        days = ((hi or every[-1]) - (lo or every[0])).days + 1 if every or (lo and hi) else None
        for t in THRESHOLDS:
            out.append((name, days, len(held), t, sum(len(s) * 100.0 / days >= t for s in held.values())))
    return sorted(out)


def test_windows_and_thresholds(spark, rows):
    df = spark.createDataFrame(rows, "who string, day date").repartition(5)
    got = P.coverage_matrix(df, "who", "day", WINDOWS, THRESHOLDS)
    assert got.columns == ["window", "days_in_window", "n_entities", "threshold_pct", "n_reaching"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_bitmaps_hold_each_day_once(spark, rows):
    df = spark.createDataFrame(rows, "who string, day date")
    days = {}
    for r in P.day_bitmaps(df, "who", "day").collect():
        held = [64 * r.word + b for b in range(64) if r.bits >> b & 1] if r.word is not None else []
        days.setdefault(r.who, set()).update(held)
    want = {}
    for e, d in rows:
        want.setdefault(e, set()).update([(d - dt.date(1970, 1, 1)).days] if d else [])
    assert days == want


def test_empty_panel(spark):
    got = P.coverage_matrix(spark.createDataFrame([], "who string, day date"), "who", "day", WINDOWS, [90.0]).collect()
    assert len(got) == len(WINDOWS) and all(r.n_entities == 0 and r.n_reaching == 0 for r in got)
