import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators.regular_grid import cells, regular_grid
from tidewright.operators.trailing import trailing_totals

DAY0 = dt.date(2023, 1, 1)


@pytest.mark.parametrize("shard", [8, 1024])
def test_trailing_against_brute_force(spark, shard):
    r = random.Random(5)
    data = []
    for s in ("A", "B", None):
        for d in range(0, 120):
            if r.random() < 0.5 or (s == "B" and 30 < d < 75):
                continue
            x = r.choice([None, float("nan"), r.random()])
            at = dt.datetime(2023, 1, 1) + dt.timedelta(days=d)
            data += [(s, DAY0 + dt.timedelta(days=d), x, at)] * r.choice([1, 1, 2])
    df = spark.createDataFrame(data, "symbol string, obs_date date, x double, loaded_at timestamp_ntz")
    windows = [1, 2, 7, 13, 30]
    out = {(q["symbol"], q["obs_date"]): q for q in trailing_totals(df, "symbol", "obs_date", ["x"], windows, F.col("loaded_at"), shard).collect()}
    vals = {(s, d): x for s, d, x, _ in data if s}
    for s in ("A", "B"):
        days = sorted(d for k, d in vals if k == s)
        n = (days[-1] - days[0]).days + 1
        assert sum(k[0] == s for k in out) == n
        for i in range(n):
            d = days[0] + dt.timedelta(days=i)
            for w in windows:
                xs = [vals.get((s, d - dt.timedelta(days=j))) for j in range(w)]
                xs = [x for x in xs if x is not None and x == x]
                q = out[s, d]
                assert q[f"x_n_{w}"] == len(xs)
                if xs:
                    assert math.isclose(q[f"x_sum_{w}"], sum(xs), abs_tol=1e-9) and math.isclose(q[f"x_avg_{w}"], sum(xs) / len(xs), abs_tol=1e-9)
                else:
                    assert q[f"x_sum_{w}"] is None and q[f"x_avg_{w}"] is None


def test_trailing_empty_and_null_days(spark):
    df = spark.createDataFrame([], "symbol string, obs_date date, x double")
    assert trailing_totals(df, "symbol", "obs_date", ["x"], [7]).count() == 0
    df = spark.createDataFrame([("A", None, 1.0), ("A", DAY0, None)], "symbol string, obs_date date, x double")
    assert [(q["x_n_7"], q["x_sum_7"]) for q in trailing_totals(df, "symbol", "obs_date", ["x"], [7]).collect()] == [(0, None)]


def pchip(xs, ys, x):
    """Monotone cubic through readings, written from the definition."""
    h, d = np.diff(xs), np.diff(ys) / np.diff(xs)
    m = np.zeros(len(xs))
    if len(xs) == 2:
        m[:] = d[0]
    else:
        for k in range(1, len(xs) - 1):
            if d[k - 1] * d[k] > 0:
                w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
                m[k] = (w1 + w2) / (w1 / d[k - 1] + w2 / d[k])
        for k, a, b in ((0, 0, 1), (-1, -1, -2)):
            s = ((2 * h[a] + h[b]) * d[a] - h[a] * d[b]) / (h[a] + h[b])
            m[k] = 0 if s * d[a] <= 0 else 3 * d[a] if d[a] * d[b] <= 0 and abs(s) > 3 * abs(d[a]) else s
    k = int(np.searchsorted(xs, x, side="right")) - 1
    t = (x - xs[k]) / h[k]
    return (1 + 2 * t) * (1 - t) ** 2 * ys[k] + t * (1 - t) ** 2 * h[k] * m[k] + t * t * (3 - 2 * t) * ys[k + 1] + t * t * (t - 1) * h[k] * m[k + 1]


@pytest.mark.parametrize("shard", [5, 288])
def test_grid_against_definition(spark, shard):
    r = random.Random(2)
    knots, c = [], 1000
    for _ in range(80):
        knots.append((c, r.random() * 10))
        c += r.choice([1, 1, 2, 3, 5, 12, 13, 40])
    df = spark.createDataFrame([("s", a, v, 1.0, 1) for a, v in knots], "source string, cell bigint, value double, amount double, readings bigint")
    out = {x["cell"]: x for x in regular_grid(df, 300, 12, shard).collect()}
    assert sorted(out) == list(range(knots[0][0], knots[-1][0] + 1))
    segments, cur = [], [knots[0]]
    for a, b in zip(knots, knots[1:]):
        if b[0] - a[0] > 12:
            segments.append(cur)
            cur = []
        cur.append(b)
    segments.append(cur)
    filled = 0
    for seg in segments:
        xs, ys = np.array([a for a, _ in seg], float), np.array([v for _, v in seg])
        for c in range(seg[0][0], seg[-1][0] + 1):
            q = out[c]
            if c in xs:
                assert q["status"] == "observed" and q["value"] == ys[list(xs).index(c)]
            else:
                filled += 1
                assert q["status"] == "filled" and math.isclose(q["value"], pchip(xs, ys, c), rel_tol=1e-9, abs_tol=1e-9) and q["amount"] == 0
                k = int(np.searchsorted(xs, c)) - 1
                assert min(ys[k], ys[k + 1]) - 1e-9 <= q["value"] <= max(ys[k], ys[k + 1]) + 1e-9
    assert filled > 50
    assert all(q["value"] is None for q in out.values() if q["status"] == "gap") and any(q["status"] == "gap" for q in out.values())


def test_cells_leave_out_what_is_no_reading(spark):
    t = dt.datetime(2024, 1, 1, 0, 5)
    nan = float("nan")
    data = [("a", t, 1.0, 2.0, 1), ("a", t, 3.0, 2.0, 2), ("a", t, 0.0, 1.0, 3), ("a", t, 1.0, -1.0, 4), ("a", t, nan, 1.0, 5), ("a", t, 1.0, nan, 6), (None, t, 1.0, 1.0, 7), ("a", None, 1.0, 1.0, 8), ("a", t, None, 1.0, 9), ("a", t - dt.timedelta(microseconds=1), 9.0, 1.0, 10)]
    df = spark.createDataFrame(data, "s string, t timestamp_ntz, p double, q double, i bigint")
    out = sorted(tuple(x) for x in cells(df, F.col("s"), "t", "p", "q", ["i"], 300).collect())
    assert [(v, a, n) for _, _, v, a, n in out] == [(9.0, 1.0, 1), (3.0, 4.0, 2)]
    assert regular_grid(cells(df.limit(0), F.col("s"), "t", "p", "q", ["i"], 300)).count() == 0
