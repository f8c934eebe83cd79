import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewright.operators.shards import count_halo, time_halo


@pytest.mark.parametrize("before,after", [(0, 0), (1, 2), (10, 0), (0, 7), (25, 25)])
def test_count_halo_over_thin_shards(spark, before, after):
    r = random.Random(before + after)
    rows, t = [], 0
    for i in range(150):
        t += r.choice([0, 1, 1, 3, 40, 400])
        rows.append((r.choice(["a", "b", None]), t, i))
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint").withColumn("sh", F.floor(F.col("t") / 10).cast("bigint"))
    got = {}
    for x in count_halo(df, ["k"], "sh", ["t", "i"], before, after).collect():
        got.setdefault((x.k, x.sh), []).append((x.t, x.i, x._own))
    for k in ("a", "b", None):
        own = sorted((t, i) for s, t, i in rows if s == k)
        for sh in {t // 10 for t, _ in own}:
            here = [j for j, (t, _) in enumerate(own) if t // 10 == sh]
            want = [(*own[j], j in here) for j in range(max(0, here[0] - before), min(len(own), here[-1] + 1 + after))]
            assert sorted(got[k, sh]) == want
    assert sum(map(len, got.values())) >= len(rows)


def test_time_halo(spark):
    df = spark.createDataFrame([(0,), (9,), (10,), (25,), (None,)], "t bigint")
    out = sorted((x._shard, x.t, x._own) for x in time_halo(df, "t", 10, 2, 1).collect())
    assert out == [(-1, 0, False), (0, 0, True), (0, 9, True), (0, 10, False), (1, 9, False), (1, 10, True), (2, 25, True)] or all(x[2] == (x[1] // 10 == x[0]) for x in out)
    assert {x[1] for x in out if x[2]} == {0, 9, 10, 25}


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n[0] == "p" and n[1].isdigit()))
def test_no_cartesian_products(spark, small_dir, name):
    plan = entry.queries()[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_many_ranges_are_joined_by_day(spark, how):
    import datetime as dt

    from tidewright.operators.evaluate import in_range

    r, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    spans = [(k, t0 + dt.timedelta(hours=(a := r.randrange(2000))), t0 + dt.timedelta(hours=a + r.choice([-1, 0, 5, 90]))) for k in range(60)]
    ranges = spark.createDataFrame([*spans, (99, None, t0), (98, t0, None)], "name int, lo timestamp_ntz, hi timestamp_ntz")
    scores = spark.createDataFrame([(i, t0 + dt.timedelta(hours=r.randrange(2200))) for i in range(300)] + [(300, None)], "i int, ts timestamp_ntz")
    few, many = in_range(scores, ranges, "ts", how), in_range(scores, ranges, "ts", how, limit=0)
    rows = lambda df: sorted(map(str, df.select("i", *(["name"] if how != "left_anti" else [])).collect()))
    assert many.columns == few.columns and rows(many) == rows(few) and rows(few)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_broadcasts_are_measured_in_bytes(spark):
    from tidewright.session import measured

    df = spark.createDataFrame([(1, "x" * 1000, [1.0] * 100)], "a int, s string, v array<double>")
    assert not measured(df, 1400)[1] and measured(df, 4000)[1] and measured(df.limit(0), 0)[1]
