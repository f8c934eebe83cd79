"""Sources, projections, bars, aggregates, scalar functions, ordering: queries s*, proj*, a*, f*, o*."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.safe import log_ratio
from tidewright.operators import bars as B
from tidewright.operators.frames import with_frames, with_row_numbers
from tidewright.operators.ranks import grouped_quantiles
from tidewright.operators.summaries import dedup_keep, sequential_blocks, trimmed_mean
from tidewright.queries.base import DAILY, DAY, HOUR, TICKS, daily, r, sql_bars, tick_bars, ticks
from tidewright.session import micros, small, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# sources and projections
@query("select event_id, case when event_id % 2 = 0 then epoch_us(ts) else epoch_us(ts) // 1000 end as raw, case when event_id % 2 = 0 then ts else date_trunc('milliseconds', ts) end as at from events")
def s3_epoch_units(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 2 == 0, micros("ts")).otherwise(F.floor(micros("ts") / 1000))
    return table(spark, d, "events").select("event_id", raw.cast("bigint").alias("raw")).withColumn("at", B.epoch_instant(F.col("raw")).cast("timestamp_ntz"))


@query("select o_orderkey, o_orderdate from orders where o_orderdate >= date '1998-01-01' and o_orderdate < date '1998-04-01'")
def s5_until_end_of_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("date")) & B.until_end_of_day(F.col("o_orderdate"), "1998-03-31")).select("o_orderkey", "o_orderdate")


@query(f"with {DAILY} select ts, open, high, low, close, volume from d where ts between timestamp '1996-01-01' and timestamp '1997-12-31' order by ts")
def s9_daily_range(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).where(F.col("ts").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))).drop("series").orderBy("ts")


@query(f"with {TICKS} select tick_id, ts, price, qty, sign, round(price * qty, 8) as notional, round(price * qty * sign, 8) as signed_notional from ticks where qty is not null")
def s15_prepared_ticks(spark: SparkSession, d: str) -> DataFrame:
    return ticks(spark, d).select("tick_id", "ts", "price", "qty", "sign", r("notional").alias("notional"), r("signed_notional").alias("signed_notional"))


@query(f"with {DAILY} select ts, open, high, low, close, volume, round(close * volume, 8) as dollar_volume from d where close is not null")
def s20_clean_daily(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).dropna(subset=["close"]).select("ts", "open", "high", "low", "close", "volume", r(F.col("close") * F.col("volume")).alias("dollar_volume"))


@query(f"with {sql_bars('1 hour')} select ts, open, high, low, close from b where least(open, high, low, close) > 0")
def proj1_valid_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.valid_bars(tick_bars(spark, d)).select("ts", "open", "high", "low", "close")


@query("select event_id, ts from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-08' union all select event_id + 1000000000, ts from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-07'")
def proj2_inclusive_slices(spark: SparkSession, d: str) -> DataFrame:
    e, a = table(spark, d, "events").select("event_id", "ts"), F.lit("2024-01-05").cast("timestamp_ntz")
    whole_day = e.where((F.col("ts") >= a) & B.until_end_of_day(F.col("ts"), "2024-01-07"))
    instant = e.where((F.col("ts") >= a) & B.until_end_of_day(F.col("ts"), "2024-01-07 00:00:00")).withColumn("event_id", F.col("event_id") + 1_000_000_000)
    return whole_day.unionByName(instant)


PERIODS = [("2024-01-05", "2024-01-07"), ("2024-01-15", "2024-01-16"), ("2024-01-25", "2024-01-27")]
SQL_PERIODS = "p as (select * from (values " + ", ".join(f"({i}, timestamp '{a}', timestamp '{b}' + interval 1 day)" for i, (a, b) in enumerate(PERIODS)) + ") v(period, lo, hi))"


def periods(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PERIODS)], "period int, lo string, hi string")
    return rows.select("period", F.col("lo").cast("timestamp_ntz").alias("lo"), (F.col("hi").cast("timestamp_ntz") + F.expr("interval 1 day")).alias("hi"))


@query(f"with {sql_bars('1 hour')}, {SQL_PERIODS} select ts, close from b where exists (select 1 from p where ts >= lo and ts < hi)")
def proj3_in_periods(spark: SparkSession, d: str) -> DataFrame:
    p = small(periods(spark))
    return tick_bars(spark, d).join(p, (F.col("ts") >= p["lo"]) & (F.col("ts") < p["hi"]), "left_semi").select("ts", "close")


@query(f"with {sql_bars('1 hour')} select ts, trades from b where trades >= 10")
def proj5_min_trades(spark: SparkSession, d: str) -> DataFrame:
    return B.at_least(tick_bars(spark, d), 10).select("ts", "trades")


@query(f"with {sql_bars('5 minutes')}, n as (select *, lead(ts) over (order by ts) as next from b) select ts, close from n where next - ts = interval 5 minutes")
def proj6_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return B.followed_at_once(tick_bars(spark, d, 300), 300).select("ts", "close")


@query("select o_orderkey, o_orderdate from orders where o_orderdate >= date '1999-09-01'")
def proj7_lower_cut(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1999-09-01").cast("date")).select("o_orderkey", "o_orderdate")


@query(f"with {sql_bars('1 hour')} select ts, close from b order by ts desc limit 100")
def proj8_latest(spark: SparkSession, d: str) -> DataFrame:
    return tick_bars(spark, d).select("ts", "close").orderBy(F.desc("ts")).limit(100)


@query(f"with {sql_bars('1 hour')} select ts, greatest(round(ln(close / open), 8), 1e-4) as floored from b where least(open, close) > 0")
def proj9_floor(spark: SparkSession, d: str) -> DataFrame:
    return tick_bars(spark, d).where(F.least("open", "close") > 0).select("ts", F.greatest(r(log_ratio(F.col("close"), F.col("open"))), F.lit(1e-4)).alias("floored"))


# bars and aggregates
@query(f"with {sql_bars('1 hour')}, c as (select time_bucket(interval 4 hours, ts) as ts2, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, sum(volume) as volume from b group by 1) select ts2 as ts, open, high, low, close, volume from c")
def a1_resample(spark: SparkSession, d: str) -> DataFrame:
    return B.resample(tick_bars(spark, d), 4 * HOUR).drop("series")


@query(f"""with {sql_bars('5 minutes')}, g as (select unnest(generate_series(min(ts), max(ts), interval 5 minutes)) as ts from b),
  j as (select g.ts, b.open, b.high, b.low, b.close, b.volume, b.dollar_volume, b.signed_flow, last_value(b.close ignore nulls) over (order by g.ts) as c from g left join b using (ts))
  select ts, coalesce(open, c) as open, coalesce(high, c) as high, coalesce(low, c) as low, c as close, coalesce(volume, 0) as volume, round(coalesce(dollar_volume, 0), 6) as dollar_volume, round(coalesce(signed_flow, 0), 6) as signed_flow from j""")
def a2_filled_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.fill_gaps(tick_bars(spark, d, 300), 300).select("ts", "open", "high", "low", "close", "volume", r("dollar_volume", 6).alias("dollar_volume"), r("signed_flow", 6).alias("signed_flow"))


@query(f"with {sql_bars('5 minutes', per_user=True)} select series, ts, trades, round(signed_flow / dollar_volume, 8) as imbalance from b where dollar_volume > 0")
def a3_buckets(spark: SparkSession, d: str) -> DataFrame:
    return tick_bars(spark, d, 300, True).where("dollar_volume > 0").select("series", "ts", "trades", r(F.try_divide("signed_flow", "dollar_volume")).alias("imbalance"))


SQL_RV = f"""{sql_bars('1 minute', 'm')}, g1 as (select unnest(generate_series(min(ts), max(ts), interval 1 minute)) as ts from m),
  f1 as (select g1.ts, last_value(m.close ignore nulls) over (order by g1.ts) as c from g1 left join m using (ts)),
  r1 as (select ts, case when c > 0 then ln(c) end - lag(case when c > 0 then ln(c) end) over (order by ts) as x from f1),
  rv as (select to_timestamp(ceil(epoch(ts) / 300) * 300)::timestamp as ts, sum(x * x) as rv, count(*) as steps from r1 where x is not null group by 1)"""


@query(f"with {SQL_RV} select ts, round(rv, 8) as rv, steps from rv")
def a4_realized_variance(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d)
    return B.realized_variance(t).select("ts", r("rv").alias("rv"), "steps")


@query(f"""with {sql_bars('1 hour')}, x as (select ts, close > open as up, row_number() over (order by ts) as i from b), y as (select *, i - row_number() over (partition by up order by ts) as grp from x)
  select up as label, min(ts) as start_at, max(ts) as end_at, count(*) as length from y group by up, grp""")
def a5_runs(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.operators.frames import runs

    out = runs(tick_bars(spark, d), ["series"], "ts", ["ts"], F.col("close") > F.col("open"), 5 * DAY)
    return out.select("label", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "length")


SQL_WINDOWS = f"""{sql_bars('1 hour')}, i as (select *, row_number() over (order by ts) - 1 as i, count(*) over () as n from b),
  w as (select *, unnest(generate_series(greatest(0, (i - 12 + 4) // 4), least(i // 4, (n - 12) // 4))) as window_id from i where n >= 12),
  wp as (select *, i - window_id * 4 as pos from w where i - window_id * 4 between 0 and 11)"""


def hourly_windows(spark: SparkSession, d: str, window: int = 12, step: int = 4) -> DataFrame:
    from tidewright.operators.windows import sliding_windows

    return sliding_windows(tick_bars(spark, d), ["series"], "ts", ["ts"], window, step)


@query(f"""with {SQL_WINDOWS}, x as (select window_id, ln(close) - lag(ln(close)) over (partition by window_id order by pos) as dx, volume - lag(volume) over (partition by window_id order by pos) as dv from wp where close > 0)
  select 0 as channel, round(stddev_pop(dx), 8) as scale from x union all select 1, round(stddev_pop(dv), 8) from x""")
def a6_increment_scale(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.operators.windows import channels, increment_scale

    paths = channels(hourly_windows(spark, d), ["series"], "ts", ["log_price", "volume"])
    return increment_scale(paths).select("channel", r("scale").alias("scale"))


@query("select label, k as pos, round(avg(v), 8) as mean from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as k from embeddings) group by all")
def a7_mean_vector(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.operators.scores import mean_vectors

    return mean_vectors(table(spark, d, "embeddings"), "embedding", ["label"]).select("label", "pos", r("mean").alias("mean"))


@query(f"""with {SQL_WINDOWS}, x as (select *, ln(close) - lag(ln(close)) over (partition by window_id order by pos) as ret, ln(close) as lc, max(ln(close)) over (partition by window_id order by pos) as top from wp),
  m as (select window_id, avg(ret) as mu from x group by 1)
  select x.window_id, round(stddev_pop(ret), 8) as vol, round(avg(power(ret - mu, 3)) / power(stddev_pop(ret), 3), 6) as skew, round(kurtosis_pop(ret), 6) as kurt,
    round(arg_max(lc, pos) - arg_min(lc, pos), 8) as net_return, round(min(lc - top), 8) as drawdown, round(avg(volume), 8) as mean_volume, round(avg(ln(high / low)), 8) as mean_log_range
  from x join m using (window_id) group by x.window_id""")
def a8_window_features(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.operators.summaries import window_features

    f = window_features(hourly_windows(spark, d), ["series"])
    return f.select("window_id", r("vol").alias("vol"), r("skew", 6).alias("skew"), r("kurt", 6).alias("kurt"), r("net_return").alias("net_return"), r("drawdown").alias("drawdown"), r("mean_volume").alias("mean_volume"), r("mean_log_range").alias("mean_log_range"))


@query(f"""with {SQL_WINDOWS}, x as (select *, coalesce(ln(close) - lag(ln(close)) over (partition by window_id order by pos), 0) as ret, max(ln(close)) over (partition by window_id order by pos) as top from wp)
  select window_id, round(sum(ret), 8) as ret, round(sqrt(sum(ret * ret)), 8) as rv, round(max(ln(close)) - min(ln(close)), 8) as span, round(min(ln(close) - top), 8) as drawdown,
    round(case when sum(abs(ret)) > 0 then abs(sum(ret)) / sum(abs(ret)) else 0 end, 8) as efficiency, round(ln(1 + sum(volume)), 8) as log_volume, round(stddev_pop(ln(1 + volume)), 8) as log_volume_std,
    round(sum(volume) filter (pos < 6) / sum(volume), 8) as first_half, round(sum(signed_flow) / sum(dollar_volume), 8) as imbalance, round(sum(ln(high / low)), 8) as range_sum, round(stddev_pop(ln(high / low)), 8) as range_std from x group by 1""")
def a9_summary_features(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.operators.summaries import summary_features

    f = summary_features(hourly_windows(spark, d), ["series"], 12)
    return f.select("window_id", *[r(c).alias(c) for c in f.columns if c not in ("series", "window_id")])


@query(f"""with {TICKS}, x as (select time_bucket(interval 1 hour, ts) as b, price, sign * price * qty as s, price * qty as n, ln(price) - lag(ln(price)) over (partition by time_bucket(interval 1 hour, ts) order by ts, tick_id) as ret, ts, tick_id from ticks where price > 0)
  select b as ts, round(100 * (ln(arg_max(price, (ts, tick_id))) - ln(arg_min(price, (ts, tick_id)))), 8) as ret, round(100 * sqrt(sum(coalesce(ret * ret, 0))), 8) as rv, round(100 * ln(max(price) / min(price)), 8) as span, round(100 * sum(s) / sum(n), 8) as imbalance from x group by 1 having sum(n) > 0""")
def a10_tick_features(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.operators.summaries import tick_features

    f = tick_features(ticks(spark, d).where("price > 0"), HOUR).where("notional > 0")
    return f.select("ts", *[r(c).alias(c) for c in ("ret", "rv", "span", "imbalance")])


@query("select event_type, round(quantile_cont(value, 0.25), 8) as q25, round(quantile_cont(value, 0.5), 8) as q50, round(quantile_cont(value, 0.66), 8) as q66, round(quantile_cont(value, 0.99), 8) as q99 from events group by 1")
def a11_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = grouped_quantiles(table(spark, d, "events"), ["event_type"], "value", [0.25, 0.5, 0.66, 0.99])
    return q.select("event_type", *[r(f"q{i}").alias(n) for i, n in enumerate(("q25", "q50", "q66", "q99"))])


@query(f"with {SQL_WINDOWS} select pos, round(avg(close), 8) as mean, round(quantile_cont(close, 0.1), 8) as lo, round(quantile_cont(close, 0.9), 8) as hi from wp group by 1")
def a12_position_quantiles(spark: SparkSession, d: str) -> DataFrame:
    w = hourly_windows(spark, d)
    q = grouped_quantiles(w, ["pos"], "close", [0.1, 0.9])
    return w.groupBy("pos").agg(F.avg("close").alias("mean")).join(q, "pos").select("pos", r("mean").alias("mean"), r("q0").alias("lo"), r("q1").alias("hi"))


@query(f"""with {DAILY}, x as (select *, ln(close) - lag(ln(close)) over (order by ts) as ret from d), v as (select ts, volume, case when count(ret) over f = 20 then stddev_samp(ret) over f end as fwd from x window f as (order by ts rows between 1 following and 20 following)),
  t as (select quantile_cont(volume, 0.9) as q from d), y as (select fwd, volume > q as flagged from v, t where fwd is not null)
  select flagged, count(*) as n, round(median(fwd), 8) as median_fwd from y group by 1""")
def a13_forward_volatility(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.operators.evaluate import forward_volatility_study

    b = daily(spark, d)
    out = forward_volatility_study(b, "series", "ts", "close", F.col("volume"), 0.9, 20)
    return out.select("flagged", "n", r("median_fwd").alias("median_fwd"))


@query("pivot (select o_orderpriority, o_orderstatus, o_totalprice from orders) on o_orderstatus in ('F', 'O', 'P') using round(max(o_totalprice), 2) group by o_orderpriority")
def a14_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.max("o_totalprice"), 2))


@query("select o_orderpriority, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as cheapest from orders group by 1")
def a15_argmin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.min(F.struct("o_totalprice", "o_orderkey"))["o_orderkey"].alias("cheapest"))


@query("select label, round(avg(e), 8) as mean, round(stddev_samp(e), 8) as std from (select label, embedding[1]::double as e from embeddings) group by 1")
def a16_fold_spread(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("e"))
    return x.groupBy("label").agg(r(F.avg("e")).alias("mean"), r(F.stddev_samp("e")).alias("std"))


@query("select event_type, round(case when count(*) >= 3 then (sum(value) - min(value) - max(value)) / (count(*) - 2) end, 6) as trimmed from events group by 1")
def a17_trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    return trimmed_mean(table(spark, d, "events"), ["event_type"], "value").select("event_type", r("trimmed", 6).alias("trimmed"))


@query(f"with {DAILY}, i as (select close, row_number() over (order by ts) - 1 as i, count(*) over () as n from d) select least(i // (n // 4), 3) as block, count(*) as n, round(avg(close), 6) as mean from i group by 1")
def a18_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = sequential_blocks(daily(spark, d), ["series"], "ts", ["ts"], 4)
    return b.groupBy("block").agg(F.count("*").alias("n"), r(F.avg("close"), 6).alias("mean"))


@query("with c as (select symbol, obs_date, case when isnan(log_return) then null else log_return end as x, loaded_at from daily_env), m as (select median(x) as q from c) select symbol, obs_date, loaded_at, round(coalesce(x, q), 8) as filled from c, m")
def a19_median_fill(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.operators.summaries import fill_with_median

    return fill_with_median(table(spark, d, "daily_env"), "log_return", "filled").select("symbol", "obs_date", "loaded_at", r("filled").alias("filled"))


# scalar functions
@query(f"with {sql_bars('1 hour')} select ts, round(ln(close), 8) as f_ln, round(ln(1 + volume), 8) as f_log1p, round(exp(-close / 100), 8) as f_exp, round(sqrt(volume), 8) as f_sqrt, round(abs(close - open), 8) as f_abs, round(power(close, 1.5), 6) as f_pow, greatest(least(close, 50.0), 5.0) as f_clip from b where close > 0")
def f1_scalars(spark: SparkSession, d: str) -> DataFrame:
    c, v = F.col("close"), F.col("volume")
    return tick_bars(spark, d).where("close > 0").select("ts", r(F.log(c)).alias("f_ln"), r(F.log1p(v)).alias("f_log1p"), r(F.exp(-c / 100)).alias("f_exp"), r(F.sqrt(v)).alias("f_sqrt"), r(F.abs(c - F.col("open"))).alias("f_abs"), r(F.pow(c, F.lit(1.5)), 6).alias("f_pow"), F.greatest(F.least(c, F.lit(50.0)), F.lit(5.0)).alias("f_clip"))


@query(f"with {sql_bars('1 hour')} select ts, round(power(ln(high / low), 2) / (4 * ln(2)), 8) as pv from b where low > 0")
def f2_parkinson(spark: SparkSession, d: str) -> DataFrame:
    return tick_bars(spark, d).where("low > 0").select("ts", r(B.parkinson(F.col("high"), F.col("low"))).alias("pv"))


@query(f"""with {DAILY} select ts, round(power(coalesce(ln(close) - lag(ln(close)) over (order by ts), 0), 2), 8) as var_close,
  round(0.5 * power(ln(high / low), 2) - (2 * ln(2) - 1) * power(ln(close / open), 2), 8) as var_gk from d""")
def f3_variance_increments(spark: SparkSession, d: str) -> DataFrame:
    b = daily(spark, d)
    a = B.variance_increment(b).select("ts", r("var").alias("var_close"))
    return a.join(B.variance_increment(b, "gk").select("ts", r("var").alias("var_gk")), "ts")


@query(f"with {sql_bars('1 hour')} select ts, round(power(close / 100, 2) / 8760, 10) as iv from b")
def f4_implied_variance(spark: SparkSession, d: str) -> DataFrame:
    return tick_bars(spark, d).select("ts", r(B.implied_variance(F.col("close"), 8760), 10).alias("iv"))


@query(f"with {sql_bars('1 hour')} select date_trunc('day', ts) as day, strftime(max(ts), '%Y-%m-%d %H:%M') as last_bar, epoch(max(ts) - min(ts))::bigint as span_s from b group by 1")
def f7_dates(spark: SparkSession, d: str) -> DataFrame:
    g = tick_bars(spark, d).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    return g.agg(F.date_format(F.max("ts").cast("timestamp"), "yyyy-MM-dd HH:mm").alias("last_bar"), F.floor((micros(F.max("ts")) - micros(F.min("ts"))) / 1_000_000).cast("bigint").alias("span_s"))


@query("select n_nationkey, lower(n_name) as low, replace(lower(n_name), ' ', '_') as key from nation")
def f11_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("low"), F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")).alias("key"))


# ordering and set operations
@query("select event_id, ts, value from events order by ts, event_id")
def o1_total_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "value").orderBy("ts", "event_id")


@query("select event_id, value from events order by value desc, event_id limit 5")
def o2_largest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(5)


@query("select round(avg(y), 8) as precision_at_k, 50 as k from (select case when event_type = 'error' then 1.0 else 0.0 end as y from events order by value desc, event_id limit 50)")
def o3_precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.operators.scores import precision_at_k

    return precision_at_k(table(spark, d, "events"), F.col("value"), F.col("event_type") == "error", [F.col("event_id")], 50).select(r("precision_at_k").alias("precision_at_k"), "k")


@query("select c_custkey as id, 'customer' as kind from customer union all select s_suppkey, 'supplier' from supplier")
def o4_union_all(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@query("select user_id, arg_min(event_id, (ts, event_id)) as first_id, arg_max(event_id, (ts, event_id)) as last_id from events group by 1")
def o5_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    first = dedup_keep(e, ["user_id"], ["ts", "event_id"], "first").select("user_id", F.col("event_id").alias("first_id"))
    return first.join(dedup_keep(e, ["user_id"], ["ts", "event_id"], "last").select("user_id", F.col("event_id").alias("last_id")), "user_id")


@query(f"with {sql_bars('1 hour')} select ts, close from (select *, row_number() over (order by ts) - 1 as i from b) where i % 7 = 0")
def o6_stride(spark: SparkSession, d: str) -> DataFrame:
    return with_row_numbers(tick_bars(spark, d), ["series"], "ts", ["ts"], shard_s=5 * DAY).where("rn % 7 = 0").select("ts", "close")


@query(f"with {sql_bars('1 hour')} select ts, round(ln(close) - lag(ln(close)) over (order by ts), 8) as ret from b where close > 0")
def a20_hourly_returns(spark: SparkSession, d: str) -> DataFrame:
    b = tick_bars(spark, d).where("close > 0")
    return with_frames(b, ["series"], "ts", ["ts"], 1, 0, lambda w: {"ret": r(F.log("close") - F.log(F.lag("close").over(w)))}, 5 * DAY).select("ts", "ret")
