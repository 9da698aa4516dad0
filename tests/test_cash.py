"""The daily panel against a plain loop over days, and where its days are made."""

import datetime as dt

import pytest

from florin.operators import cash as K

ANCHOR = dt.date(2001, 8, 1)
#: Days (from 2000-01-01) with net, outflow, known volume and hole volume: far apart, next to each other, past, on and around the anchor day, one day alone.
MOVED = {
    "a": {0: (5.0, 1.0, 5.0, 0.0), 1: (-2.5, 2.5, 2.5, 0.0), 180: (1.0, 0.0, 1.0, 0.0), 181: (1.5, 0.0, 1.5, 0.0), 700: (-3.0, 3.0, 3.0, 0.0)},
    "b": {600: (1.0, 0.0, 1.0, 0.0), 640: (-4.0, 4.0, 4.0, 2.0)},
    "c": {10: (-4.0, 4.0, 4.0, 0.0), 400: (2.0, 0.0, 2.0, 3.0), 500: (2.0, 0.0, 2.0, 0.0)},
    "d": {578: (-7.0, 7.0, 7.0, 0.0)},
    "e": {577: (-7.0, 7.0, 7.0, 0.0)},
}
BALANCE = {"a": 100.0, "b": -50.0, "c": 3.0, "d": None}


def day_of(n):
    return dt.date(2000, 1, 1) + dt.timedelta(n)


def plain(company, moved):
    moved = {day_of(n): v for n, v in moved.items()}
    first, last = min(moved), max(moved)
    days = sorted({first + dt.timedelta(k) for k in range((last - first).days + 1)} | {ANCHOR})
    anchor, lowest, out = BALANCE.get(company), None, []
    for day in days:
        later = [v for d, v in moved.items() if d > day]
        holes, known = sum(v[3] for v in later), sum(v[2] for v in later)
        balance = None if holes or anchor is None else anchor - sum(v[0] for v in later)
        if balance is not None:
            lowest = balance if lowest is None else min(lowest, balance)
        spent = sum(v[1] for d, v in moved.items() if 0 <= (day - d).days < 180)
        mean = spent / max(1.0, min(6.0, ((day - first).days + 1) / 30.0))
        part = holes / (known + holes) if known + holes else 0.0
        confidence = "none" if anchor is None or part > 0.5 else "high" if part == 0 else "medium" if part <= 0.25 else "low"
        reason = "no_anchor" if anchor is None else "holes_in_span" if holes else "no_known_outflow" if mean <= 0 else None
        cushion = None if balance is None else balance - lowest
        out.append((company, day, moved.get(day, (0.0,))[0], balance, cushion, mean if mean > 0 else None, None if cushion is None or mean <= 0 else cushion / mean, confidence, reason))
    return out


@pytest.fixture
def panel(spark):
    daily = [(c, day_of(n), *v) for c, moved in MOVED.items() for n, v in moved.items()]
    daily = spark.createDataFrame(daily, "company_id string, date_ok date, net double, outflow double, known_volume double, hole_volume double")
    anchor = spark.createDataFrame(list(BALANCE.items()), "company_id string, anchor double")
    return K.daily_panel(daily, anchor, str(ANCHOR))


def test_daily_panel_by_plain_loop(panel):
    columns = ["company_id", "day", "net", "balance", "cushion", "mean_monthly_out", "months_of_cover", "confidence", "reason"]
    rounded = lambda rows: sorted(str([round(x, 9) + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)
    assert rounded(panel.select(*columns).collect()) == rounded(r for c, moved in MOVED.items() for r in plain(c, moved))


def test_dense_days_are_neither_shuffled_nor_sorted(panel):
    """The days of a panel are many times its movements: what makes them stands above every shuffle, sort and window."""
    plan = panel._jdf.queryExecution().executedPlan().toString().split("\n")
    made = next(k for k, line in enumerate(plan) if "Generate explode(sequence(" in line)
    assert not any(name in line for line in plan[:made] for name in ("Exchange", "Sort ", "Window", "Join"))
