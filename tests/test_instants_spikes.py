import datetime as dt
import random

import numpy as np
import pytest
from brute import flagged_bars
from pyspark.sql import functions as F

from tidewright.operators.instants import to_instants
from tidewright.operators.spikes import exact_median, flag_bars

NY, BERLIN, TOKYO = "America/New_York", "Europe/Berlin", "Asia/Tokyo"


def us(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1_000_000)


CASES = [
    ("2024-01-22", NY, "mdy", us(2024, 1, 22, 5)), ("  2024-01-22T10:00:00Z\n", NY, "mdy", us(2024, 1, 22, 10)), ("2024-01-22 10:00", BERLIN, "dmy", us(2024, 1, 22, 9)),
    ("2024-01-22T10:00:00.123456789z", NY, "mdy", us(2024, 1, 22, 10) + 123456), ("2024-01-22 10:00:00,5", "UTC", "ymd", us(2024, 1, 22, 10) + 500000), ("2024-01-22T10:00:00 +0545", NY, "mdy", us(2024, 1, 22, 4, 15)),
    ("2024-01-22 10:00:00-02:30", NY, "mdy", us(2024, 1, 22, 12, 30)), ("2024-01-22 10:00:00 EST", TOKYO, "ymd", us(2024, 1, 22, 15)), ("2024-07-22 10:00:00 EST", TOKYO, "ymd", us(2024, 7, 22, 15)), ("2024-07-22 10:00:00 CEST", TOKYO, "ymd", us(2024, 7, 22, 8)),
    ("2024-07-22 10:00:00[Europe/London]", TOKYO, "ymd", us(2024, 7, 22, 9)), ("2024-07-22 10:00:00 Asia/Tokyo", NY, "ymd", us(2024, 7, 22, 1)), ("03/04/2024", NY, "mdy", us(2024, 3, 4, 5)), ("03/04/2024", BERLIN, "dmy", us(2024, 4, 2, 22)),
    ("3/4/24 1:02:03 pm", NY, "mdy", us(2024, 3, 4, 18, 2, 3)), ("12/31/2023 12:00:00 AM", NY, "mdy", us(2023, 12, 31, 5)), ("2024/05/06 12:30:00 pm", TOKYO, "ymd", us(2024, 5, 6, 3, 30)), ("05.06.2024 01:02:03", NY, "mdy", us(2024, 6, 5, 5, 2, 3)),
    ("Feb 8, 2023", NY, "mdy", us(2023, 2, 8, 5)), ("6-Nov-2022", BERLIN, "dmy", us(2022, 11, 5, 23)), ("Mon, 22 Jan 2024 18:06:25 +0900", NY, "mdy", us(2024, 1, 22, 9, 6, 25)), ("20210912T205259Z", NY, "mdy", us(2021, 9, 12, 20, 52, 59)), ("2022-044T03:59:15Z", NY, "mdy", us(2022, 2, 13, 3, 59, 15)),
    ("1684320978", NY, "mdy", 1684320978 * 10**6), ("1716105844116", NY, "mdy", 1716105844116 * 1000), ("1730950274848663", NY, "mdy", 1730950274848663), ("1726913823630538350", NY, "mdy", 1726913823630538), ("20240911", "UTC", "ymd", us(2024, 9, 11)), ("20231112073845", NY, "mdy", us(2023, 11, 12, 12, 38, 45)),
    # a wall time that occurs twice means the first, a skipped one is read with the offset before the jump
    ("2024-11-03 01:30:00", NY, "mdy", us(2024, 11, 3, 5, 30)), ("2024-03-10 02:30:00", NY, "mdy", us(2024, 3, 10, 7, 30)), ("2024-10-27 02:30:00", BERLIN, "dmy", us(2024, 10, 27, 0, 30)), ("2024-02-29", "UTC", "ymd", us(2024, 2, 29)), ("2024-366T00:00:00Z", NY, "mdy", us(2024, 12, 31)),
    ("2023-02-29", "UTC", "ymd", None), ("2022-13-01T00:00:00Z", NY, "mdy", None), ("31/11/2022 10:10:00", BERLIN, "dmy", None), ("30/11/2022 25:10:00", BERLIN, "dmy", None), ("13/25/2022", NY, "mdy", None), ("0000-00-00 00:00:00", NY, "mdy", None), ("2023-366T00:00:00Z", NY, "mdy", None),
    ("Marble 3, 2022", NY, "mdy", None), ("3 Junk 2022", NY, "mdy", None), ("Sept 5, 2022", "UTC", "mdy", us(2022, 9, 5)), ("Monkey, 22 Jan 2024 18:06:25 +0900", NY, "mdy", None), ("25/13/2022", NY, "mdy", None), ("13/05/2022", NY, "mdy", None),
    ("pending", NY, "mdy", None), ("", NY, "mdy", None), ("   ", NY, "mdy", None), (None, NY, "mdy", None), ("n/a", NY, "mdy", None), ("12345", NY, "mdy", None), ("9" * 25, NY, "mdy", None), ("2024-01-22 10:00:00 Mars/Base", NY, "mdy", None), ("2024-01-22 10:00:00", "Mars/Base", "mdy", None), ("x" * 100_000, NY, "mdy", None),
]


def test_texts_to_instants(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, raw string, tz string, ord string, want bigint")
    out = to_instants(df, "raw", F.concat("tz", "ord"), F.col("tz"), F.col("ord")).collect()
    wrong = [(r.raw, r.utc_us, r.want) for r in out if r.utc_us != r.want]
    assert not wrong and len(out) == len(CASES)
    assert all((r.status == "unusable") == (r.want is None) for r in out)


def test_order_is_learned_and_doubt_is_marked(spark):
    rows = [(1, f"{d:02}/{m:02}/2023") for d in range(13, 28) for m in range(1, 10)] + [(1, "05/06/2023")] + [(2, "05/06/2023"), (2, "07/07/2023")]
    df = spark.createDataFrame(rows, "v int, raw string")
    out = {(r.v, r.raw): r for r in to_instants(df, "raw", F.col("v"), F.lit("UTC"), None).collect()}
    assert out[1, "05/06/2023"].utc_us == us(2023, 6, 5) and out[1, "05/06/2023"].status == "ok"
    assert out[2, "05/06/2023"].status == "ambiguous" and out[2, "07/07/2023"].status == "ok"


def test_values_decide_between_orders(spark):
    """Texts that can be read in both orders, in a source whose certain texts say nothing about orders: the reading that falls among the source's other instants is taken."""
    rows = [(1, f"2023-{m:02}-{d:02}") for m in (3, 4, 5, 6) for d in range(1, 28)] + [(1, "05/11/2023"), (1, "11/05/2023")]
    rows += [(2, f"2023-{m:02}-{d:02}") for m in range(1, 13) for d in range(1, 28)] + [(2, "05/11/2023"), (2, "11/05/2023")]
    df = spark.createDataFrame(rows, "v int, raw string")
    out = {(r.v, r.raw): r for r in to_instants(df, "raw", F.col("v"), F.lit("UTC"), None).collect()}
    may = us(2023, 5, 11)
    assert (out[1, "05/11/2023"].utc_us, out[1, "05/11/2023"].format) == (may, "mdy") and (out[1, "11/05/2023"].utc_us, out[1, "11/05/2023"].format) == (may, "dmy")
    assert {out[2, t].status for t in ("05/11/2023", "11/05/2023")} == {"ambiguous"}


def test_a_declared_order_holds_at_any_number_of_rows():
    """However many texts of a source can be read in another order only, they stay unusable, and the rarest text in the declared order is read."""
    import pandas as pd

    from tidewright.operators.instants import FORMATS, _mixture

    dmy, mdy = FORMATS.index("dmy"), FORMATS.index("mdy")
    sets = [([16 * 9 + dmy], 2, 10**12), ([16 * 9 + 0], 2, 10**12), ([16 * 900 + mdy], 3, 1), ([16 * 9 + dmy, 16 * 900 + mdy], 1, 1)]
    pdf = pd.DataFrame({"_source": "s", "_order": "mdy", "_key": [k for k, _, _ in sets], "_prec": [p for _, p, _ in sets], "n": [n for _, _, n in sets]})
    assert _mixture(pdf)["_best"].tolist() == [-1, 16 * 9, 16 * 900 + mdy, 16 * 900 + mdy]
    pdf["_order"] = None
    assert _mixture(pdf)["_best"].tolist() == [16 * 9 + dmy, 16 * 9, 16 * 900 + mdy, 16 * 9 + dmy]


def test_instants_of_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "old", "x", "y", 3)], "raw string, status string, _t string, _source string, _cands int")
    r = to_instants(df, "raw", F.lit(1), F.lit("UTC"), None).first()
    assert (r.utc_us, r.status, r._t, r._source, r._cands) == (us(2024, 1, 1), "ok", "x", "y", 3)
    assert to_instants(df.limit(0), "raw", F.lit(1), F.lit("UTC"), None).count() == 0


def test_p5_found_reads_slashed_dates_as_declared_only(spark, tmp_path):
    """A venue that declares no order, or none that is known, names no instant by a slashed date, however sure a mixture would be; all else it is read as anywhere. Nothing is fitted."""
    import duckdb

    from tidewright.queries.readings import SQL, p5_found

    venues = [(1, "UTC", "dmy"), (2, NY, "mdy"), (3, TOKYO, "ymd"), (4, "UTC", None), (5, BERLIN, "DMY"), (6, None, "dmy")]
    texts = ["05/06/2023", "25/06/2023", "06/25/2023", "23/06/05", "31/31/2023", "05/06/2023 10:00 UTC", "2023-06-05", "5.6.2023 10:00:00 EST", "1686000000", "20230605", "none", None]
    texts += [f"{d}/{m}/2023" for d in range(13, 28) for m in range(1, 10)]
    rows = [(1000 * (v or 9) + i, v, t) for v in (1, 2, 3, 4, 5, 6, 7, None) for i, t in enumerate(texts)]
    half = len(rows) // 2
    spark.createDataFrame(venues, "venue_id int, tz_name string, date_order string").write.parquet(f"{tmp_path}/venues.parquet")
    spark.createDataFrame(rows[:half] + rows[:5], "rec_id bigint, venue_id int, ts_raw string").write.parquet(f"{tmp_path}/tick_feed.parquet")
    spark.createDataFrame(rows[half:], "rec_id bigint, venue_id int, date_raw string").write.parquet(f"{tmp_path}/score_log.parquet")
    duck = duckdb.connect()
    duck.execute("set TimeZone = 'UTC'")
    for name in ("venues", "tick_feed", "score_log"):
        duck.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = p5_found(spark, str(tmp_path))
    own = sorted(tuple(r) for r in found.collect())
    assert own == sorted(duck.execute(SQL["p5_found"]).fetchall())
    assert (1000, us(2023, 6, 5)) in own and (2000, us(2023, 5, 6, 4)) in own and (3003, us(2023, 6, 4, 15)) in own and not {4000, 4001, 4005, 5000, 7005, 9005} & {i for i, _ in own}
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()


BARS = "bar_id bigint, symbol string, bar_start timestamp_ntz, open_px double, high_px double, low_px double, close_px double"


def market(seed=4, n=700):
    r = random.Random(seed)
    rows, k = [], 0
    for s in ("hot", "a", "still", None):
        p, t = 100.0, dt.datetime(2024, 1, 1)
        for i in range(n if s == "hot" else n // 3):
            t += dt.timedelta(minutes=15 * r.choice([1, 1, 1, 1, 2, 700 if r.random() < 0.02 else 1]))
            o = p
            if s != "still" or r.random() < 0.2:
                p *= float(np.exp(r.gauss(0, 0.001)))
            if r.random() < 0.01:
                p *= 1.2
            bar = [o, max(o, p) * 1.0001, min(o, p) * 0.9999, p]
            if r.random() < 0.02:
                bar = [x * r.choice([0.5, 2, 1.1]) for x in bar]
                bar = [bar[0], max(bar), min(bar), bar[3]]
            if r.random() < 0.02:
                bar[r.randrange(4)] = r.choice([None, 0.0, -1.0, 1e6])
            k += 1
            rows.append((k, s, None if r.random() < 0.01 else t, *bar))
        for j in range(len(rows) - 30, len(rows) - 22):
            rows[j] = (*rows[j][:3], 50.0, 50.0, 50.0, 50.0)
    return rows


@pytest.mark.parametrize("seed", [4, 5])
def test_bars_against_brute_force(spark, seed):
    data = market(seed)
    df = spark.createDataFrame(data + data[:40], BARS)
    out = flag_bars(df, "symbol", "bar_start", "bar_id")
    got = out.collect()
    assert len(got) == len(data)
    assert {r.bar_id for r in got if r.impossible or r.spike or r.stuck} == flagged_bars(data)
    assert any(r.spike for r in got) and any(r.stuck for r in got) and any(r.tail for r in got)
    assert all(r.tail for r in got if r.spike and r.cutoff is not None)


def test_the_fitted_tail_decides(spark):
    """Swings that an instrument makes all the time are cut away by the fit, though the rule alone would name them; at a smaller risk fewer bars are left."""
    r, rows, t = random.Random(8), [], dt.datetime(2024, 1, 1)
    for i in range(96 * 20):
        p = 100.0 * float(np.exp(r.gauss(0, 0.0005) + (r.choice([-1, 1]) * r.gauss(0.02, 0.01) if r.random() < 0.2 else 0)))
        rows.append((i, "a", t, p, p, p, p))
        t += dt.timedelta(minutes=15)
    rows[96 * 10 + 3] = (*rows[96 * 10 + 3][:3], 150.0, 150.0, 150.0, 150.0)
    df = spark.createDataFrame(rows, BARS)
    spikes = lambda **k: {x.bar_id for x in flag_bars(df, "symbol", "bar_start", "bar_id", **k).where("spike").collect()}
    by_rule, found = flagged_bars(rows, None), spikes()
    assert found == flagged_bars(rows) and found < by_rule and 96 * 10 + 3 in found
    assert spikes(risk=1e-12) < found | {96 * 10 + 3}


def test_sound_neighbours_of_a_dip(spark):
    """A dip of two bars after a lasting move: judged together with the dip its neighbours would pass the rule too; the dip, the most extreme, is settled first."""
    closes = [195.75, 197.57, 199.89, 200.91, 200.43, 179.54, 180.41, 201.3, 200.41, 202.8, 202.2, 201.9]
    r, p, lead = random.Random(2), 195.0, []
    for _ in range(300):
        p *= float(np.exp(r.gauss(0, 0.0016)))
        lead.append(p)
    lead = [x * 195.7 / lead[-1] for x in lead]
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "a", t0 + dt.timedelta(minutes=15 * i), c, c, c, c) for i, c in enumerate(lead + closes)]
    got = {x.bar_id for x in flag_bars(spark.createDataFrame(rows, BARS), "symbol", "bar_start", "bar_id").where("spike").collect()}
    assert {305, 306} <= got and got == flagged_bars(rows) and not got & {302, 303, 304}


def test_settling_across_shards_equals_one_pass(spark, monkeypatch):
    """Chains of candidates that reach over many shards and halos settle as in one pass."""
    from tidewright.operators import spikes as S

    r = np.random.default_rng(3)
    n = 400
    lc = r.choice([0.0, 0.3, 0.5, 1.0], n) + r.normal(0, 0.01, n)
    level, sure = np.full(n, 0.2), np.ones(n, bool)
    want, still = S.settle_dense(lc + 0.01, lc - 0.01, lc, level, np.ones(n, bool), sure, 5)
    assert want.sum() > 40 and not still.any()
    rows = [("a", i, float(lc[i]), float(lc[i] + 0.01), float(lc[i] - 0.01), True, 0.2, True) for i in range(n)]
    df = spark.createDataFrame(rows, "_s string, pos bigint, lc double, hi double, lo double, sound boolean, level double, open boolean")
    monkeypatch.setattr(S, "SHARD_BARS", 16)
    monkeypatch.setattr(S, "SETTLE_REACH", 8)
    assert sorted(x.pos for x in S.settled(df, 5).collect()) == np.flatnonzero(want).tolist()


def test_bars_empty_and_all_null(spark):
    assert flag_bars(spark.createDataFrame([], BARS), "symbol", "bar_start", "bar_id").count() == 0
    df = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "a", None, -1.0, None, None, None), (3, "a", dt.datetime(2024, 1, 1), None, None, None, None)], BARS)
    assert sorted((r.bar_id, r.impossible) for r in flag_bars(df, "symbol", "bar_start", "bar_id").collect()) == [(1, False), (2, True), (3, False)]


def test_exact_median(spark):
    r = random.Random(1)
    data = [(k, r.choice([0.5, 0.25, r.random() * 10 ** r.randrange(-6, 6)])) for k in ("a", "b") for _ in range(501 if k == "a" else 500)]
    out = dict(exact_median(spark.createDataFrame(data, "k string, v double"), "k", "v").collect())
    for k in ("a", "b"):
        assert out[k] == pytest.approx(float(np.median([v for q, v in data if q == k])), rel=1e-15)
