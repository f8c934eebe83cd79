import datetime as dt
import random

from tidewright.llm.nearest import nearest_in_time

T0 = dt.datetime(2024, 3, 1)
LEFT, RIGHT = "q bigint, s string, t timestamp_ntz, flag string", "id bigint, s string, t timestamp_ntz, v double, flag int"


def test_nearest_against_brute_force(spark):
    r = random.Random(9)
    at = lambda: None if r.random() < 0.05 else T0 + dt.timedelta(milliseconds=r.randrange(0, 4_000_000))
    sym = lambda: "hot" if r.random() < 0.4 else r.choice(["a", "b", None])
    left = [(i, sym(), at(), "x") for i in range(1500)]
    right = [(i, sym(), at(), r.choice([None, 1.0]), 1) for i in range(900)]
    right += [(i + 1000, s, t, v, f) for i, s, t, v, f in right[:200]]  # an instant twice
    right += [(2000 + i, s, t + dt.timedelta(seconds=300 if i % 2 else -300), 1.0, 0) for i, s, t, _ in left[:50] if t]  # at the very tolerance
    got = nearest_in_time(spark.createDataFrame(left + left[:30], LEFT), spark.createDataFrame(right + right[:40], RIGHT), "s", "t", "t", "q", "id", ["v", "flag"], 300)
    own = {x["q"]: (x["id"], x["flag"]) for x in got.collect()}
    by = {}
    for i, s, t, v, f in right:
        if s and t:
            by.setdefault(s, []).append((t, i, f))
    n = 0
    for q, s, t, _ in left:
        if s is None or t is None:
            assert q not in own
            continue
        n += 1
        best = min(((abs(x - t), x, i, f) for x, i, f in by.get(s, []) if abs(x - t) <= dt.timedelta(seconds=300)), default=None)
        assert own[q] == ((best[2], best[3]) if best else (None, None))
    assert len(own) == n


def test_nearest_same_instant_and_empty(spark):
    left = spark.createDataFrame([(1, "a", T0, "x")], LEFT)
    right = spark.createDataFrame([(9, "a", T0, 1.0, 1), (8, "a", T0, 1.0, 1)], RIGHT)
    assert nearest_in_time(left, right, "s", "t", "t", "q", "id", [], 0).first()["id"] == 8
    assert nearest_in_time(left, right.limit(0), "s", "t", "t", "q", "id", [], 300).first()["id"] is None
    assert nearest_in_time(left.limit(0), right, "s", "t", "t", "q", "id", [], 300).count() == 0
