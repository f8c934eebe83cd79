import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.bars import bars, day_range, duration_steps, fill_gaps, variance_increment
from tidewright.operators.frames import full, greedy_debounce, runs, with_frames, with_row_numbers, with_running
from tidewright.operators.ranks import average_ranks, dense_ranks, grouped_quantiles
from tidewright.operators.windows import sliding_windows

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(3)
    rows, t = [], {"a": 0, "b": 0}
    for i in range(400):
        s = r.choice(["a", "a", "b"])
        t[s] += r.choice([1, 5, 60, 5000])
        rows.append((s, T0 + dt.timedelta(minutes=t[s]), i, r.choice([None, r.random()])))
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, i bigint, x double").cache()


@pytest.mark.parametrize("shard", [3600, 86_400, 10**9])
def test_frames_equal_plain_windows(series, shard):
    exprs = lambda w: {"l": F.lag("x", 2).over(w), "s": F.sum("x").over(w.rowsBetween(-3, 2)), "m": full(F.col("x"), w, 3, F.avg), "n": F.lead("i", 2).over(w)}
    own = with_frames(series, ["series"], "ts", ["ts", "i"], 3, 2, exprs, shard)
    plain = series.withColumns(exprs(W.partitionBy("series").orderBy("ts", "i")))
    key = lambda df: sorted((tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df.select("i", "l", "s", "m", "n").collect()))
    assert key(own) == key(plain)


@pytest.mark.parametrize("shard", [3600, 10**9])
def test_running_and_numbers(series, shard):
    own = with_running(series, ["series"], "ts", ["ts", "i"], {"c": F.col("x")}, {"top": F.col("x")}, shard)
    own = with_row_numbers(own, ["series"], "ts", ["ts", "i"], shard_s=shard)
    w = W.partitionBy("series").orderBy("ts", "i")
    plain = {r.i: r for r in series.select("i", F.coalesce(F.sum("x").over(w), F.lit(0.0)).alias("c"), F.max("x").over(w).alias("top"), (F.row_number().over(w) - 1).alias("rn"), F.count("*").over(W.partitionBy("series")).alias("n")).collect()}
    rows = own.collect()
    assert len(rows) == len(plain)
    for r in rows:
        p = plain[r.i]
        assert (r.rn, r.rn_of, r.top) == (p.rn, p.n, p.top) and r.c == pytest.approx(p.c)


def test_runs_over_shards(spark, series):
    out = runs(series, ["series"], "ts", ["ts", "i"], F.col("i") % 3 == 0, 3600)
    want = {}
    for s in ("a", "b"):
        last, n = None, 0
        for r in series.where(F.col("series") == s).orderBy("ts", "i").collect():
            v = r.i % 3 == 0
            n += v != last
            last = v
        want[s] = n
    assert dict(out.groupBy("series").count().collect()) == want and out.agg(F.sum("length")).first()[0] == series.count()


def test_debounce_against_loop(series):
    got = {}
    for r in greedy_debounce(series, ["series"], "ts", 7200).collect():
        got.setdefault(r.series, []).append(r.ts)
    for s in ("a", "b"):
        keep = []
        for r in series.where(F.col("series") == s).select("ts").distinct().orderBy("ts").collect():
            if not keep or r.ts - keep[-1] >= dt.timedelta(seconds=7200):
                keep.append(r.ts)
        assert sorted(got[s]) == keep


@pytest.mark.parametrize("n,w,s", [(11, 12, 4), (12, 12, 4), (13, 12, 4), (103, 12, 4), (10, 1, 1), (5, 5, 9)])
def test_window_counts(spark, n, w, s):
    df = spark.range(n).select(F.lit("a").alias("series"), F.timestamp_micros(F.col("id") * 60_000_000).cast("timestamp_ntz").alias("ts"), F.col("id").alias("i"))
    out = sliding_windows(df, ["series"], "ts", ["ts"], w, s).collect()
    assert len({r.window_id for r in out}) == (0 if n < w else (n - w) // s + 1)
    assert all(r.i == r.window_id * s + r.pos for r in out) and len(out) == (0 if n < w else ((n - w) // s + 1) * w)


def test_empty_frames(spark):
    df = spark.createDataFrame([], "series string, ts timestamp_ntz, x double")
    assert with_frames(df, ["series"], "ts", ["ts"], 2, 2, lambda w: {"l": F.lag("x").over(w)}).count() == 0
    assert with_row_numbers(df, ["series"], "ts", ["ts"]).count() == 0
    assert sliding_windows(df, ["series"], "ts", ["ts"], 3, 1).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6).filter(lambda v: v == 0 or abs(v) > 1e-9), st.sampled_from([0.0, 1.5, -2.0])), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    q = grouped_quantiles(df, [], "x", [0.0, 0.25, 0.5, 0.66, 1.0]).first()
    own = [x for x in xs if x is not None]
    if not own:
        assert q.q0 is None
    else:
        assert [q[i] for i in range(5)] == pytest.approx(np.quantile(own, [0.0, 0.25, 0.5, 0.66, 1.0]).tolist(), rel=1e-9, abs=1e-12)


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", -1.0), (None, 2.0)], "k string, v double")
    r = {(x.k, x.v): (x["rank"], x.rank_of) for x in average_ranks(df, ["k"], "v").collect()}
    assert r == {("a", 1.0): (1.5, 3), ("a", 3.0): (3.0, 3), ("a", None): (None, None), ("b", -1.0): (1.0, 1), (None, 2.0): (1.0, 1)}
    assert {(x.k, x.v): x.dense_rank for x in dense_ranks(df, ["k"], "v").collect()}[("a", 3.0)] == 2


def test_bars_and_gaps(spark):
    t = [("s", 1, T0, 2.0, 1.0, 1.0), ("s", 2, T0, 3.0, 1.0, -1.0), ("s", 3, T0 + dt.timedelta(minutes=12), 5.0, 2.0, 1.0)]
    ticks = spark.createDataFrame(t, "series string, tick_id bigint, ts timestamp_ntz, price double, qty double, sign double").withColumns({"notional": F.col("price") * F.col("qty"), "signed_notional": F.col("price") * F.col("qty") * F.col("sign")})
    b = {r.ts: r for r in fill_gaps(bars(ticks, 300), 300).collect()}
    assert len(b) == 3 and b[T0].open == 2.0 and b[T0].close == 3.0 and b[T0].signed_flow == -1.0
    gap = b[T0 + dt.timedelta(minutes=5)]
    assert (gap.open, gap.close, gap.volume, gap.filled) == (3.0, 3.0, 0.0, True)
    with pytest.raises(ValueError):
        variance_increment(ticks, "x")
    with pytest.raises(ValueError):
        day_range("2024-01-02", "2024-01-01")
    with pytest.raises(ValueError):
        duration_steps(10, 60)
    assert len(day_range("2024-02-28", "2024-03-01")) == 3
