"""Window functions, joins, regimes, splits and strategy arithmetic: queries w*, j*, x*."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import bars as B
from tidewright.operators import evaluate as E
from tidewright.operators import splits as S
from tidewright.operators import strategy as T
from tidewright.operators.frames import DAY_S, ahead, changed, full, greedy_debounce, held, turnover, with_frames, with_row_numbers, with_running
from tidewright.operators.ranks import average_ranks, dense_ranks
from tidewright.queries.base import DAILY, DAY, HOUR, daily, r, sql_bars, tick_bars
from tidewright.queries.market import SQL_RV, SQL_WINDOWS, hourly_windows, periods
from tidewright.session import checkpointed, micros, small, table

QUERIES, SQL = {}, {}
SHARD = 5 * DAY
YEAR = 365 * DAY_S
HOURLY = sql_bars("1 hour")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"with {SQL_WINDOWS} select window_id, pos, ts from wp")
def w1_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return hourly_windows(spark, d).select("window_id", "pos", "ts")


SQL_PER = "p as (select * from (values (0, timestamp '2024-01-05', timestamp '2024-01-08'), (1, timestamp '2024-01-15', timestamp '2024-01-17'), (2, timestamp '2024-01-25', timestamp '2024-01-28')) v(period, lo, hi))"


def in_periods(spark: SparkSession, d: str) -> DataFrame:
    p = small(periods(spark))
    b = tick_bars(spark, d)
    return b.join(p, (b["ts"] >= p["lo"]) & (b["ts"] < p["hi"])).drop("lo", "hi")


@query(f"""with {HOURLY}, {SQL_PER}, i as (select b.ts, period, row_number() over (partition by period order by ts) - 1 as i, count(*) over (partition by period) as n from b join p on ts >= lo and ts < hi),
  w as (select *, unnest(generate_series(greatest(0, (i - 12 + 4) // 4), least(i // 4, (n - 12) // 4))) as window_id from i where n >= 12) select period, window_id, i - window_id * 4 as pos, ts from w where i - window_id * 4 between 0 and 11""")
def w2_windows_by_period(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.operators.windows import sliding_windows

    return sliding_windows(in_periods(spark, d), ["series", "period"], "ts", ["ts"], 12, 4).select("period", "window_id", "pos", "ts")


@query(f"with {HOURLY}, i as (select ts, row_number() over (order by ts) - 1 as i, count(*) over () as n, sum(volume) over (order by ts rows between 23 preceding and current row) as v from b) select ts, round(v, 8) as lookback_volume from i where i >= 24 and (i - 24) % 6 = 0 and i + 3 < n")
def w3_anchors(spark: SparkSession, d: str) -> DataFrame:
    rows = with_frames(tick_bars(spark, d), ["series"], "ts", ["ts"], 23, 0, lambda w: {"v": F.sum("volume").over(w.rowsBetween(-23, 0))}, SHARD)
    rows = S.anchors(with_row_numbers(rows, ["series"], "ts", ["ts"], shard_s=SHARD), 24, 6, 3)
    return rows.select("ts", r("v").alias("lookback_volume"))


@query(f"with {HOURLY}, i as (select ts, row_number() over (order by ts) - 1 as i, count(*) over () as n, avg(close) over f as m, stddev_pop(close) over f as s from b window f as (order by ts rows between 9 preceding and current row)) select ts, round(m, 8) as m, round(s, 8) as s from i where i >= 9 and i < n - 1")
def w4_trailing_rows(spark: SparkSession, d: str) -> DataFrame:
    f = lambda w: {"m": F.avg("close").over(w.rowsBetween(-9, 0)), "s": F.stddev_pop("close").over(w.rowsBetween(-9, 0))}
    rows = with_row_numbers(with_frames(tick_bars(spark, d), ["series"], "ts", ["ts"], 9, 0, f, SHARD), ["series"], "ts", ["ts"], shard_s=SHARD)
    return rows.where("rn >= 9 and rn < rn_of - 1").select("ts", r("m").alias("m"), r("s").alias("s"))


@query(f"with {DAILY} select ts, round(case when count(*) over f = 50 then avg(close) over f end, 6) as ma, round(case when count(*) over f = 50 then stddev_samp(close) over f end, 6) as sd from d window f as (order by ts rows between 49 preceding and current row)")
def w5_w6_rolling(spark: SparkSession, d: str) -> DataFrame:
    f = lambda w: {"ma": full(F.col("close"), w, 50, F.avg), "sd": full(F.col("close"), w, 50, F.stddev_samp)}
    return with_frames(daily(spark, d), ["series"], "ts", ["ts"], 49, 0, f, YEAR).select("ts", r("ma", 6).alias("ma"), r("sd", 6).alias("sd"))


@query(f"""with {HOURLY}, c as (select ts, close / lag(close) over (order by ts) - 1 as x from b), s as (select *, case when count(x) over f = 20 then avg(x) over f end as m, case when count(x) over f = 20 then stddev_samp(x) over f end as sd from c window f as (order by ts rows between 19 preceding and current row))
  select ts, round(x, 8) as change, coalesce(abs(x - m) > 2 * sd, false) as flagged from s""")
def w7_two_sigma(spark: SparkSession, d: str) -> DataFrame:
    return T.two_sigma(tick_bars(spark, d), "series", "ts", "close", 20, SHARD).select("ts", r("change").alias("change"), "flagged")


@query(f"with {HOURLY} select ts, lag(close) over (order by ts) as before, lead(close, 3) over (order by ts) as after3 from b")
def w8_shifts(spark: SparkSession, d: str) -> DataFrame:
    f = lambda w: {"before": F.lag("close").over(w), "after3": F.lead("close", 3).over(w)}
    return with_frames(tick_bars(spark, d), ["series"], "ts", ["ts"], 1, 3, f, SHARD).select("ts", "before", "after3")


@query(f"with {DAILY} select ts, round(ln(close) - lag(ln(close)) over (order by ts), 8) as ret, round(ln(close) - lag(ln(close), 20) over (order by ts), 8) as mom from d")
def w9_returns(spark: SparkSession, d: str) -> DataFrame:
    f = lambda w: {"ret": r(F.log("close") - F.lag(F.log("close")).over(w)), "mom": r(F.log("close") - F.lag(F.log("close"), 20).over(w))}
    return with_frames(daily(spark, d), ["series"], "ts", ["ts"], 20, 0, f, YEAR).select("ts", "ret", "mom")


@query(f"""with {HOURLY} select ts, round(abs(lead(close, 5) over (order by ts) / close - 1), 8) as ret_5, round(case when count(*) over f = 5 then greatest(max(high) over f / close - 1, 1 - min(low) over f / close) end, 8) as exc_5
  from b window f as (order by ts rows between 1 following and 5 following)""")
def w10_excursions(spark: SparkSession, d: str) -> DataFrame:
    return E.forward_excursions(tick_bars(spark, d), "series", "ts", [1, 5]).select("ts", r("ret_5").alias("ret_5"), r("exc_5").alias("exc_5"))


@query(f"""with {DAILY}, v as (select ts, power(coalesce(ln(close) - lag(ln(close)) over (order by ts), 0), 2) as var from d) select ts, round(case when count(*) over f = 7 then sqrt(sum(var) over f) end, 8) as target, round(case when count(*) over f = 7 then ln(avg(var) over f) end, 6) as log_target
  from v window f as (order by ts rows between 1 following and 7 following)""")
def w11_targets(spark: SparkSession, d: str) -> DataFrame:
    v = B.variance_increment(daily(spark, d))
    f = lambda w: {"target": r(F.sqrt(ahead(F.col("var"), w, 7, F.sum))), "log_target": r(F.log(ahead(F.col("var"), w, 7, F.avg)), 6)}
    return with_frames(v, ["series"], "ts", ["ts"], 0, 7, f, YEAR).select("ts", "target", "log_target")


@query(f"""with {DAILY}, v as (select ts, coalesce(ln(close) - lag(ln(close)) over (order by ts), 0) as ret from d), w as (select ts, ret, avg(ret * ret) over (order by ts rows between 4 preceding and current row) as v5, avg(ret * ret) over (order by ts rows between 21 preceding and current row) as v22,
  row_number() over (order by ts) as i from v) select ts, round(ln(ret * ret), 6) as h1, round(ln(v5), 6) as h5, round(ln(v22), 6) as h22, round(least(ret, 0), 8) as leverage from w where i >= 22 and ret <> 0""")
def w12_har_features(spark: SparkSession, d: str) -> DataFrame:
    h = T.har_features(B.variance_increment(daily(spark, d)), "series", "ts", [1, 5, 22], YEAR)
    return h.where("ret <> 0 and h22 is not null").select("ts", r("h1", 6).alias("h1"), r("h5", 6).alias("h5"), r("h22", 6).alias("h22"), r("leverage").alias("leverage"))


@query(f"""with {DAILY}, v as (select ts, coalesce(ln(close) - lag(ln(close)) over (order by ts), 0) as ret from d), c as (select ts, sum(ret) over (order by ts) as cum from v) select ts, round(cum, 8) as cum, round(cum - max(cum) over (order by ts), 8) as drawdown from c""")
def w13_drawdown(spark: SparkSession, d: str) -> DataFrame:
    v = with_running(B.variance_increment(daily(spark, d)), ["series"], "ts", ["ts"], {"cum": F.col("ret")}, shard_s=YEAR)
    v = with_running(v, ["series"], "ts", ["ts"], {}, {"top": F.col("cum")}, shard_s=YEAR)
    return v.select("ts", r("cum").alias("cum"), r(F.col("cum") - F.col("top")).alias("drawdown"))


@query(f"with {HOURLY}, u as (select ts, close > open as up from b) select ts, up from (select *, lag(up) over (order by ts) as p, row_number() over (order by ts) as i from u) where i = 1 or up is distinct from p")
def w14_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = tick_bars(spark, d).withColumn("up", F.col("close") > F.col("open"))
    return with_frames(rows, ["series"], "ts", ["ts"], 1, 0, lambda w: {"new": changed(F.col("up"), w)}, SHARD).where("new").select("ts", "up")


@query("select event_id, round((rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0) / count(*) over (partition by event_type), 8) as pct from events")
def w15_percent_ranks(spark: SparkSession, d: str) -> DataFrame:
    x = average_ranks(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return x.select("event_id", r(F.col("rank") / F.col("rank_of")).alias("pct"))


@query("select event_id, dense_rank() over (partition by event_type order by value) as rk from events")
def w16_dense_ranks(spark: SparkSession, d: str) -> DataFrame:
    return dense_ranks(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value", "rk").select("event_id", "rk")


@query(f"with {DAILY}, i as (select ts, row_number() over (order by close, ts) - 1 as i, count(*) over () as n from d) select ts, case when i + 1 <= 1 + (n - 1) / 3.0 then 0 when i + 1 <= 1 + 2 * (n - 1) / 3.0 then 1 else 2 end as tercile from i")
def w17_terciles(spark: SparkSession, d: str) -> DataFrame:
    return T.rank_terciles(daily(spark, d), [], "close", ["ts"]).select("ts", "tercile")


@query(f"with {DAILY}, q as (select quantile_cont(close, 1.0 / 3) as a, quantile_cont(close, 2.0 / 3) as b from d where ts < timestamp '1998-01-01') select ts, (close >= a)::int + (close >= b)::int as bin from d, q")
def w18_digitize(spark: SparkSession, d: str) -> DataFrame:
    b = daily(spark, d)
    return T.tercile_bins(b, b.where(F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz")), "close", "bin").select("ts", "bin")


@query(f"with {HOURLY}, f as (select ts, (trades >= 20)::int as flag from b) select ts, max(flag) over (order by ts rows between 6 preceding and current row) as held from f")
def w19_hold(spark: SparkSession, d: str) -> DataFrame:
    rows = tick_bars(spark, d).withColumn("flag", F.col("trades") >= 20)
    return with_frames(rows, ["series"], "ts", ["ts"], 6, 0, lambda w: {"held": held(F.col("flag"), w, 7)}, SHARD).select("ts", "held")


@query("""with recursive e as (select user_id, ts, row_number() over (partition by user_id order by ts) as i from (select distinct user_id, ts from events)),
  k as (select user_id, ts, ts as kept from e where i = 1 union all select n.user_id, n.ts, n.ts from k, lateral (select user_id, min(ts) as ts from e where e.user_id = k.user_id and e.ts >= k.kept + interval 1 day group by user_id) n)
  select user_id, ts from k""")
def w20_debounce(spark: SparkSession, d: str) -> DataFrame:
    return greedy_debounce(table(spark, d, "events"), ["user_id"], "ts", DAY)


@query(f"with {HOURLY}, w as (select ts, case when close > open then 1.0 else -1.0 end as w from b) select ts, abs(w - lag(w, 1, 0.0) over (order by ts)) as turnover from w")
def w21_turnover(spark: SparkSession, d: str) -> DataFrame:
    rows = tick_bars(spark, d).withColumn("w", F.when(F.col("close") > F.col("open"), 1.0).otherwise(-1.0))
    return with_frames(rows, ["series"], "ts", ["ts"], 1, 0, lambda w: {"turnover": turnover(F.col("w"), w)}, SHARD).select("ts", "turnover")


# joins
FLAGS = "f as (select cast(ts as date) as day, max((value > 90)::int) as flag from events group by 1)"


def daily_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.max((F.col("value") > 90).cast("int")).alias("flag"))


@query(f"with {HOURLY}, {FLAGS} select ts, close, coalesce(flag, 0) as flag from b left join f on f.day = cast(ts as date)")
def j1_left_join(spark: SparkSession, d: str) -> DataFrame:
    b = tick_bars(spark, d).withColumn("day", F.col("ts").cast("date"))
    return b.join(daily_flags(spark, d), "day", "left").select("ts", "close", F.coalesce("flag", F.lit(0)).alias("flag"))


@query(f"with {HOURLY}, {FLAGS}, v as (select cast(ts as date) as day, max(volume) as vmax from b group by 1) select ts, close, vmax, coalesce(flag, 0) as flag from b left join v on v.day = cast(ts as date) left join f on f.day = cast(ts as date)")
def j2_two_joins(spark: SparkSession, d: str) -> DataFrame:
    b = tick_bars(spark, d).withColumn("day", F.col("ts").cast("date"))
    v = b.groupBy("day").agg(F.max("volume").alias("vmax"))
    return b.join(v, "day", "left").join(daily_flags(spark, d), "day", "left").select("ts", "close", "vmax", F.coalesce("flag", F.lit(0)).alias("flag"))


@query(f"""with {sql_bars('5 minutes')}, h as (select time_bucket(interval 1 hour, ts) as hour, arg_max(price, (ts, tick_id)) as hclose from ticks group by 1), s as (select hour, lag(power(hclose / 100, 2) / 8760) over (order by hour) as strike from h)
  select ts, close, round(strike, 10) as strike from b join s on s.hour = date_trunc('hour', ts) where strike is not null""")
def j3_coarse_to_fine(spark: SparkSession, d: str) -> DataFrame:
    fine, coarse = tick_bars(spark, d, 300), tick_bars(spark, d)
    strikes = with_frames(coarse, ["series"], "ts", ["ts"], 1, 0, lambda w: {"strike": F.lag(B.implied_variance(F.col("close"), 8760)).over(w)}, SHARD).select(F.col("ts").alias("hour"), "strike").where("strike is not null")
    return fine.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")).join(strikes, "hour").select("ts", "close", r("strike", 10).alias("strike"))


SQL_EVENTS = "v as (select * from (values ('a', timestamp '2024-01-05', timestamp '2024-01-07'), ('b', timestamp '2024-01-15', timestamp '2024-01-16'), ('c', timestamp '2024-01-25', timestamp '2024-01-27'), ('none', timestamp '2025-01-01', timestamp '2025-01-02')) t(name, lo, hi))"


def events(spark: SparkSession) -> DataFrame:
    rows = [("a", "2024-01-05", "2024-01-07"), ("b", "2024-01-15", "2024-01-16"), ("c", "2024-01-25", "2024-01-27"), ("none", "2025-01-01", "2025-01-02")]
    return spark.createDataFrame(rows, "name string, lo string, hi string").select("name", F.col("lo").cast("timestamp_ntz").alias("lo"), F.col("hi").cast("timestamp_ntz").alias("hi"))


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return tick_bars(spark, d)


@query(f"with {HOURLY}, {SQL_EVENTS}, h as (select name, min(ts) filter (trades >= 20) as first_crossing, avg((trades >= 20)::int) as flag_rate, count(*) as n from b join v on ts between lo and hi group by 1) select v.name, first_crossing is not null as detected, first_crossing, epoch(first_crossing) - epoch(lo) as lag_s, round(flag_rate, 8) as flag_rate, coalesce(n, 0) as n from v left join h using (name)")
def j4_event_detection(spark: SparkSession, d: str) -> DataFrame:
    out = E.detect_events(flagged(spark, d), events(spark), "ts", E.crosses(F.col("trades").cast("double"), 19.5))
    return out.select("name", "detected", "first_crossing", "lag_s", r("flag_rate").alias("flag_rate"), "n")


@query(f"with {HOURLY}, {SQL_EVENTS} select round(avg((trades >= 20)::int), 8) as false_positive_rate, count(*) as n from b where not exists (select 1 from v where ts between lo and hi)")
def j5_outside_events(spark: SparkSession, d: str) -> DataFrame:
    out = E.false_positive_rate(flagged(spark, d), events(spark), "ts", E.crosses(F.col("trades").cast("double"), 19.5))
    return out.select(r("false_positive_rate").alias("false_positive_rate"), "n")


SQL_TRANS = f"""{HOURLY}, u as (select ts, close > open as up, lag(close > open) over (order by ts) as p, row_number() over (order by ts) as i from b), t as (select ts from u where i = 1 or up is distinct from p), c as (select ts from b where trades >= 20)"""


def transitions_of(spark: SparkSession, d: str) -> DataFrame:
    return E.transitions(tick_bars(spark, d).withColumn("label", F.col("close") > F.col("open")), "series", "ts")


@query(f"with {SQL_TRANS} select round(avg((exists (select 1 from c where c.ts between t.ts - interval 2 hours and t.ts + interval 2 hours))::int), 8) as hit_rate, count(*) as n from t")
def j6_transition_hits(spark: SparkSession, d: str) -> DataFrame:
    out = E.transition_hit_rate(transitions_of(spark, d), tick_bars(spark, d).where("trades >= 20"), "ts", 2 * HOUR)
    return out.select(r("hit_rate").alias("hit_rate"), "n")


@query(f"with {SQL_TRANS} select ts from c where exists (select 1 from t where t.ts between c.ts - interval 1 hour and c.ts + interval 3 hours)")
def j8_confirmation(spark: SparkSession, d: str) -> DataFrame:
    return E.near_instants(tick_bars(spark, d).where("trades >= 20").select("ts"), transitions_of(spark, d), "ts", HOUR, 3 * HOUR).select("ts")


@query(f"with {SQL_TRANS}, {SQL_EVENTS} select name, min(ts) as first_hit, epoch(min(ts)) - epoch(min(lo)) as lag_s from v join t on ts between lo - interval 1 day and hi + interval 1 day group by name")
def j9_near_events(spark: SparkSession, d: str) -> DataFrame:
    day = F.expr("interval 1 day")
    wide = events(spark).select("name", F.col("lo").alias("start"), (F.col("lo") - day).alias("lo"), (F.col("hi") + day).alias("hi"))
    hits = E.in_range(transitions_of(spark, d).select("ts"), wide, "ts", "inner").groupBy("name").agg(F.min("ts").alias("first_hit"), F.min("start").alias("start"))
    return hits.select("name", "first_hit", ((micros("first_hit") - micros("start")) / 1e6).alias("lag_s"))


@query(f"with {SQL_TRANS} select b.ts, b.close from b semi join t using (ts)")
def j10_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tick_bars(spark, d).join(transitions_of(spark, d).select("ts"), "ts", "left_semi").select("ts", "close")


@query("with m as (select o_orderpriority as fold, o_orderstatus as model, sqrt(avg(o_totalprice * o_totalprice)) as rmse from orders group by 1, 2) select a.fold, a.model, round(a.rmse / c.rmse - 1, 8) as change from m a join m c on c.fold = a.fold and c.model = 'F' where a.model <> 'F'")
def j11_against_control(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("fold"), F.col("o_orderstatus").alias("model")).agg(F.sqrt(F.avg(F.col("o_totalprice") * F.col("o_totalprice"))).alias("rmse"))
    return T.against_control(m, ["fold"], "model", "F", "rmse").select("fold", "model", r("change").alias("change"))


@query(f"with {SQL_RV} select h.ts, round(rv, 8) as rv from (select unnest(generate_series(timestamp '2024-01-02', timestamp '2024-01-03', interval 30 minutes)) as ts) h left join rv using (ts)")
def j12_anchor_times(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.queries.base import ticks

    a = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-03").cast("timestamp_ntz"), F.expr("interval 30 minutes"))).alias("ts"))
    return a.join(B.realized_variance(ticks(spark, d)), "ts", "left").select("ts", r("rv").alias("rv"))


# regimes and splits
@query(f"with {DAILY} select ts, case when count(*) over f = 200 and close > avg(close) over f then 'bull' else 'bear' end as label from d window f as (order by ts rows between 199 preceding and current row)")
def x1_bull_bear(spark: SparkSession, d: str) -> DataFrame:
    return E.bull_bear(daily(spark, d), "series", "ts", "close").select("ts", "label")


SQL_VOL = f"""{DAILY}, x as (select *, ln(close) - lag(ln(close)) over (order by ts) as ret from d), y as (select ts, case when count(ret) over f = 20 then stddev_samp(ret) over f end as vol from x window f as (order by ts rows between 19 preceding and current row)),
  q as (select quantile_cont(vol, 0.66) as q from y), l as (select ts, vol, case when coalesce(vol > q, false) then 'high_vol' else 'low_vol' end as label from y, q)"""


@query(f"with {SQL_VOL} select ts, round(vol, 8) as vol, label from l")
def x2_volatility_regimes(spark: SparkSession, d: str) -> DataFrame:
    return E.volatility_regimes(daily(spark, d), "series", "ts", "close").select("ts", r("vol").alias("vol"), "label")


@query(f"""with {SQL_VOL}, n as (select *, row_number() over (order by ts) - row_number() over (partition by label order by ts) as g from l), s as (select label, g, min(ts) as start_at, max(ts) as end_at, count(*) as length from n group by 1, 2)
  select start_at, end_at, length from s where label = 'low_vol' and length >= 15 and not exists (select 1 from (values (timestamp '1996-06-01', timestamp '1996-07-01')) e(lo, hi) where start_at <= hi + interval 30 days and end_at >= lo - interval 30 days)""")
def x3_calm_stretches(spark: SparkSession, d: str) -> DataFrame:
    e = spark.createDataFrame([("1996-06-01", "1996-07-01")], "lo string, hi string").select(F.col("lo").cast("timestamp_ntz").alias("lo"), F.col("hi").cast("timestamp_ntz").alias("hi"))
    out = E.calm_stretches(daily(spark, d), "series", "ts", "close", e, 15)
    return out.select(F.col("start").alias("start_at"), F.col("end").alias("end_at"), "length")


@query(f"""with {SQL_TRANS}, {SQL_EVENTS}, h as (select name, min(b.ts) filter (trades >= 20) as fc, min(lo) as lo from v left join b on b.ts between lo and hi group by 1)
  select 'one_hour' as horizon, 'trades' as model, sum((fc is not null)::int) as events_detected, count(*) as events_total, round(avg(epoch(fc) - epoch(lo)), 6) as mean_lag_s,
  (select round(avg((trades >= 20)::int), 8) from b where not exists (select 1 from v where ts between lo and hi)) as false_positive_rate,
  (select round(avg((exists (select 1 from c where c.ts between t.ts - interval 2 hours and t.ts + interval 2 hours))::int), 8) from t) as hit_rate from h""")
def x5_summary(spark: SparkSession, d: str) -> DataFrame:
    f = E.crosses(F.col("trades").cast("double"), 19.5)
    b = tick_bars(spark, d)
    out = E.horizon_summary(E.detect_events(b, events(spark), "ts", f), E.false_positive_rate(b, events(spark), "ts", f), E.transition_hit_rate(transitions_of(spark, d), b.where(f), "ts", 2 * HOUR), "one_hour", "trades")
    return out.select("horizon", "model", "events_detected", "events_total", r("mean_lag_s", 6).alias("mean_lag_s"), r("false_positive_rate").alias("false_positive_rate"), r("hit_rate").alias("hit_rate"))


@query(f"with {HOURLY}, {SQL_PER}, i as (select b.ts, period, row_number() over (partition by period order by ts) as i, count(*) over (partition by period) as n from b join p on ts >= lo and ts < hi) select period, ts, case when i <= greatest(1, round_even(0.4 * n, 0)) then 'train' else 'calib' end as part from i")
def x6_train_calib(spark: SparkSession, d: str) -> DataFrame:
    return S.train_calib(in_periods(spark, d), ["series", "period"], "ts", ["ts"], 0.4).select("period", "ts", "part")


SQL_SAMPLES = f"{DAILY}, s as (select ts, row_number() over (order by ts) - 1 as i, count(*) over () as n, lead(ts, 7) over (order by ts) as target_end from d), m as (select * from s where target_end is not null), k as (select ts, target_end, row_number() over (order by ts) - 1 as i, count(*) over () as n from m)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    return with_frames(daily(spark, d), ["series"], "ts", ["ts"], 0, 7, lambda w: {"target_end": F.lead("ts", 7).over(w)}, YEAR).where("target_end is not null").select("series", "ts", "target_end")


@query(f"with {SQL_SAMPLES}, c as (select min(ts) as t0 from k where i >= n - ceil(n * 0.2)::int) select ts, case when i >= n - ceil(n * 0.2)::int then 'test' else 'train' end as part from k, c where i >= n - ceil(n * 0.2)::int or target_end < t0")
def x7_purged_split(spark: SparkSession, d: str) -> DataFrame:
    return S.purged_split(samples(spark, d), ["series"], "ts", "target_end", 0.2).select("ts", "part")


@query(f"with {SQL_SAMPLES}, f as (select k.ts, g.fold, case when i < n - (4 - g.fold) * (n // 5) then 'train' else 'test' end as part from k, (select unnest([0, 1, 2, 3]) as fold) g where i < n - (3 - g.fold) * (n // 5)) select ts, fold, part from f")
def x8_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return S.walk_forward(samples(spark, d), ["series"], "ts", 4).select("ts", "fold", "part")


@query(f"""with {SQL_SAMPLES}, f as (select k.ts, k.target_end, g.fold, case when i < n - (4 - g.fold) * (n // 5) then 'train' else 'test' end as part from k, (select unnest([0, 1, 2, 3]) as fold) g where i < n - (3 - g.fold) * (n // 5)),
  t as (select fold, min(ts) as t0 from f where part = 'test' group by 1) select f.ts, f.fold, f.part from f join t using (fold) where part = 'test' or target_end < t0""")
def x9_purged_folds(spark: SparkSession, d: str) -> DataFrame:
    return S.purged_folds(samples(spark, d), ["series"], "ts", "target_end", 4, 50).select("ts", "fold", "part")


@query(f"with {DAILY}, i as (select ts, row_number() over (order by ts) - 1 as i, count(*) over () as n from d) select ts, case when i < floor(n * 0.7) then 'train' else 'test' end as part from i where i < floor(n * 0.7) or i >= floor(n * 0.7) + 7")
def x10_gap_split(spark: SparkSession, d: str) -> DataFrame:
    return S.gap_split(daily(spark, d), ["series"], "ts", 0.7, 7).select("ts", "part")


@query(f"with {DAILY}, i as (select ts, row_number() over (order by ts) - 1 as i, count(*) over () as n from d) select ts, case when i < floor(n * 0.65) - 20 then 'train' else 'test' end as part from i where i < floor(n * 0.65) - 20 or i >= floor(n * 0.65)")
def x11_purge_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.gap_split(daily(spark, d), ["series"], "ts", 0.65, 20, before=True).select("ts", "part")


@query(f"""with {DAILY}, x as (select ts, ln(close) - lag(ln(close)) over (order by ts) as ret from d), s as (select avg(ret) as m, stddev_samp(ret) as sd from x where ts < timestamp '1998-01-01'), y as (select ts, coalesce(abs(ret - m) > 2 * sd, false) as abnormal from x, s)
  select ts, abnormal, lead(abnormal) over (order by ts) as next_abnormal from y""")
def x12_abnormal(spark: SparkSession, d: str) -> DataFrame:
    x = with_frames(daily(spark, d), ["series"], "ts", ["ts"], 1, 0, lambda w: {"ret": F.log("close") - F.lag(F.log("close")).over(w)}, YEAR)
    return S.abnormal(x, x.where(F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz")), ["series"], "ts", "ret", 2.0).select("ts", "abnormal", "next_abnormal")


# strategy arithmetic
SQL_VS = f"""{DAILY}, a as (select ts, power(ln(high / low), 2) / (4 * ln(2)) as rvar, (volume > 8)::int as flag, close from d),
  v as (select ts, rvar, close, case when count(*) over f = 20 then avg(rvar) over f end as ma, coalesce(lag(flag) over (order by ts), 0) as flag_lag from a window f as (order by ts rows between 19 preceding and current row)),
  s as (select ts, rvar, close, lag(ma) over (order by ts) as strike, flag_lag from v)"""


def variance_rows(spark: SparkSession, d: str) -> DataFrame:
    b = daily(spark, d).withColumns({"rvar": B.parkinson(F.col("high"), F.col("low")), "flag": (F.col("volume") > 8).cast("int")})
    return T.variance_series(b, "series", "ts", "rvar", "flag", 20, YEAR)


@query(f"with {SQL_VS} select ts, round(rvar, 8) as rvar, round(strike, 8) as strike, flag_lag from s")
def x13_variance_series(spark: SparkSession, d: str) -> DataFrame:
    return variance_rows(spark, d).select("ts", r("rvar").alias("rvar"), r("strike").alias("strike"), "flag_lag")


SQL_BT = f"""{SQL_VS}, q as (select quantile_cont(strike, 1.0 / 3) as a, quantile_cont(strike, 2.0 / 3) as b from s), w as (select s.*, case when flag_lag = 1 then 1.0 when strike is null then 0.0 when strike <= a then -1.0 when strike >= b then 0.5 else 0.0 end as w from s, q),
  p as (select ts, w, abs(w - lag(w, 1, 0.0) over (order by ts)) as turn, w * (rvar - strike) as gross from w where strike is not null),
  n as (select ts, w, turn, gross, gross - 0.001 * turn as net from p)"""


def backtested(spark: SparkSession, d: str) -> DataFrame:
    v = checkpointed(variance_rows(spark, d))  # read for the quantiles and for the weights
    v = T.rule_weights(v, "strike", "flag_lag", 1.0, -1.0, 0.5)
    return T.backtest(v.where("strike is not null"), "series", "ts", F.col("rvar") - F.col("strike"), 0.001, YEAR)


@query(f"with {SQL_BT} select ts, w, turn, round(gross, 8) as gross, round(net, 8) as net from n")
def x14_x15_backtest(spark: SparkSession, d: str) -> DataFrame:
    return backtested(spark, d).select("ts", "w", "turn", r("gross").alias("gross"), r("net").alias("net"))


@query(f"""with {SQL_BT}, c as (select *, exp(sum(net) over (order by ts)) as eq from n), e as (select *, eq / greatest(1.0, max(eq) over (order by ts)) - 1 as dd from c)
  select count(*) as n, round(case when stddev_pop(net) < 1e-12 then 0 else avg(net) / stddev_pop(net) * sqrt(252) end, 6) as sharpe, round(min(dd), 6) as max_drawdown, round(exp(sum(net)) - 1, 6) as cumulative, round(avg(turn), 8) as turnover, round(avg((w <> 0)::int), 8) as active from e""")
def x16_performance(spark: SparkSession, d: str) -> DataFrame:
    p = T.performance(backtested(spark, d), "series", "ts", "net", "turn", "w", 252, YEAR)
    return p.select("n", r("sharpe", 6).alias("sharpe"), r("max_drawdown", 6).alias("max_drawdown"), r("cumulative", 6).alias("cumulative"), r("turnover").alias("turnover"), r("active").alias("active"))


SQL_MDP = f"""{DAILY}, x as (select ts, (volume > 8)::int as flag, ln(close) - lag(ln(close)) over (order by ts) as ret, ln(close) - lag(ln(close), 20) over (order by ts) as mom from d),
  y as (select *, case when count(ret) over f = 20 then stddev_samp(ret) over f end as vol from x window f as (order by ts rows between 19 preceding and current row)),
  z as (select ts, ret, lag(vol) over (order by ts) as vol_lag, lag(mom) over (order by ts) as mom_lag, coalesce(lag(flag) over (order by ts), 0) as flag_lag from y), v as (select * from z where vol_lag is not null and mom_lag is not null),
  q as (select quantile_cont(vol_lag, 1.0 / 3) as a, quantile_cont(vol_lag, 2.0 / 3) as b, median(mom_lag) as m from v where ts < timestamp '1999-01-01'),
  s as (select ts, ret, vol_lag, (flag_lag * 3 + (vol_lag >= a)::int + (vol_lag >= b)::int) * 2 + (mom_lag > m)::int as state from v, q)"""


def mdp_states(spark: SparkSession, d: str) -> DataFrame:
    b = daily(spark, d).withColumn("flag", (F.col("volume") > 8).cast("int"))
    return T.encoded_states(b, "series", "ts", "close", "flag", 20, YEAR, F.col("ts") < F.lit("1999-01-01").cast("timestamp_ntz"))


@query(f"with {SQL_MDP}, w as (select *, case when state % 2 = 1 then 1.0 else -1.0 end as w from s) select ts, state, round(w * ret - 0.0005 * abs(w - lag(w, 1, 0.0) over (order by ts)) - 0.1 * power(w * vol_lag, 2), 8) as reward from w")
def x17_states(spark: SparkSession, d: str) -> DataFrame:
    x = mdp_states(spark, d).withColumn("w", F.when(F.col("state") % 2 == 1, 1.0).otherwise(-1.0))
    return T.step_rewards(x, "series", "ts", "w", 0.0005, 0.1, YEAR).select("ts", "state", r("reward").alias("reward"))


@query()
def x18_q_policy(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.models.sequential import q_policy

    return q_policy(mdp_states(spark, d), ["series"], "ts", "state", "ret", "vol_lag")


@query(f"""with {DAILY}, x as (select ts, ln(close) - lag(ln(close)) over (order by ts) as ret, ln(close) - lag(ln(close), 20) over (order by ts) as mom from d), y as (select *, case when count(ret) over f = 20 then stddev_samp(ret) over f end as vol from x window f as (order by ts rows between 19 preceding and current row))
  select ts, round(case when lag(vol) over (order by ts) is not null then least(2.0, 0.5 / lag(vol) over (order by ts)) end, 8) as vol_target, case when lag(mom) over (order by ts) > 0 then 1.0 when lag(mom) over (order by ts) <= 0 then -1.0 end as trend from y""")
def x19_baselines(spark: SparkSession, d: str) -> DataFrame:
    return T.baseline_positions(daily(spark, d), "series", "ts", "close", 0.5, 2.0, 20, YEAR).select("ts", r("vol_target").alias("vol_target"), "trend")


@query(f"with {SQL_BT}, x as (select ts, w, lag(w, 1, 0.0) over (order by ts) as p from n) select ts, p as w_before, w as w_after from x where w <> p")
def x20_trades(spark: SparkSession, d: str) -> DataFrame:
    return T.trade_list(backtested(spark, d), "series", "ts", "w", YEAR).select("ts", "w_before", "w_after")


@query(f"with {SQL_BT}, c as (select unnest([0.0, 0.0005, 0.001, 0.002]) as cost) select cost, round(sum(gross - cost * turn), 8) as total from n, c group by 1")
def x21_cost_sweep(spark: SparkSession, d: str) -> DataFrame:
    out = T.cost_sweep(backtested(spark, d), "gross", "turn", [0.0, 0.0005, 0.001, 0.002])
    return out.select("cost", r("total").alias("total"))


@query(f"""with {DAILY}, x as (select ts, abs(ln(close) - lag(ln(close)) over (order by ts)) as y, lag(abs(ln(close) - p)) over (order by ts) as a from (select *, lag(ln(close)) over (order by ts) as p from d)),
  e as (select ts, power(y - a, 2) - power(y - 0.1, 2) as adv, y from x where a is not null) select ts, round(sum(adv) over (order by ts), 6) as cumulative from e""")
def x26_cumulative_advantage(spark: SparkSession, d: str) -> DataFrame:
    f = [lambda w: {"y": F.abs(F.log("close") - F.lag(F.log("close")).over(w))}, lambda w: {"a": F.lag("y").over(w)}]
    x = with_frames(daily(spark, d), ["series"], "ts", ["ts"], 2, 0, f, YEAR).where("a is not null")
    adv = F.pow(F.col("y") - F.col("a"), F.lit(2.0)) - F.pow(F.col("y") - 0.1, F.lit(2.0))
    return with_running(x, ["series"], "ts", ["ts"], {"cumulative": adv}, shard_s=YEAR).select("ts", r("cumulative", 6).alias("cumulative"))
