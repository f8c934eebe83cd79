"""Round trips of landed files: tables written in the files' formats and read back by the sources; queries s1 to s21, f5, x15."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import strategy as T
from tidewright.queries.base import DAILY, DAY, TICKS, daily, r, sql_bars, tick_bars, ticks
from tidewright.queries.rolling import SQL_BT, YEAR, backtested
from tidewright.session import micros, scratch, table
from tidewright.sources import market_files as S

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query(f"with {TICKS} select tick_id as trade_id, price, qty, price * qty as quote_qty, case when tick_id % 2 = 0 then date_trunc('milliseconds', ts) else ts end as ts, sign < 0 as is_buyer_maker from ticks")
def s1_s8_s11_s19_landed_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Half of the files with a header line and in microseconds, half without and in milliseconds."""
    path, even = scratch(spark, "ticks"), F.col("tick_id") % 2 == 0
    t = ticks(spark, d)
    time = F.when(even, F.floor(micros("ts") / 1000)).otherwise(micros("ts")).cast("bigint")
    rows = t.select(F.col("tick_id").alias("trade_id"), "price", "qty", (F.col("price") * F.col("qty")).alias("quote_qty"), time.alias("time"), (F.col("sign") < 0).alias("is_buyer_maker"), F.lit(True).alias("is_best_match"))
    rows.where("trade_id % 2 = 1").write.option("header", True).csv(f"{path}/a")
    rows.where("trade_id % 2 = 0").write.csv(f"{path}/b")
    return S.read(spark, "trades", [f"{path}/a", f"{path}/b"]).select("trade_id", "price", "qty", "quote_qty", "ts", "is_buyer_maker")


@query(f"with {sql_bars('1 hour')} select ts, open, high, low, close, volume, volume / 4 as taker_buy_base, volume - volume / 4 as taker_sell_base, volume / 4 - (volume - volume / 4) as imbalance from b")
def s7_landed_klines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "klines")
    b, ms = tick_bars(spark, d), (micros("ts") / 1000).cast("bigint")
    rest = [F.col("dollar_volume"), F.col("trades"), F.col("volume") / 4, F.col("dollar_volume") / 4, F.lit(0)]
    b.select(ms, "open", "high", "low", "close", "volume", ms + 3_599_999, *rest).write.csv(path)
    return S.read(spark, "klines", path)


@query(f"with {DAILY} select ts, open, high, low, close, volume::double as volume, close * volume as dollar_volume from d where ts between timestamp '1996-01-01' and timestamp '1997-12-31'")
def s9_s13_s20_s21_landed_daily(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "daily")
    S.write_csv(daily(spark, d).select(F.col("ts").cast("date").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume")), path)
    return S.read(spark, "daily", path).where(F.col("ts").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz")))


@query(f"with {sql_bars('1 hour')} select open, high, low, close, ts from b")
def s10_landed_index(spark: SparkSession, d: str) -> DataFrame:
    """Pages that overlap by one day in three."""
    path = scratch(spark, "index")
    b = tick_bars(spark, d).select((micros("ts") / 1000).cast("bigint").alias("ts_ms"), "open", "high", "low", "close")
    b.write.json(path)
    b.where(F.floor(F.col("ts_ms") / (1000 * DAY)) % 3 == 0).write.mode("append").json(path)
    return S.read(spark, "index", path)


@query("select ts, value as anomaly_score, (value > 60)::int as flag from events")
def s16_s17_landed_scores(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "scores")
    e = table(spark, d, "events")
    S.write_csv(e.select(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("date"), F.col("value").alias("anomaly_score"), (F.col("value") > 60).cast("int").alias("flag")), path)
    return S.read(spark, "scores", path)


@query("select event_id, ts from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-08'")
def s6_landed_days(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "days")
    S.write_days(table(spark, d, "events").select("event_id", "ts"), path)
    return S.read_days(spark, path, "2024-01-05", "2024-01-07").select("event_id", "ts")


@query(f"with {DAILY}, x as (select avg(power(ln(close / open), 2)) as m from d) select round(2 * sqrt(m * 365) * 0.02 / 365, 12) as cost from x")
def f5_entry_cost(spark: SparkSession, d: str) -> DataFrame:
    m = daily(spark, d).agg(F.avg(F.pow(F.log(F.col("close") / F.col("open")), F.lit(2.0)))).first()[0]
    return spark.createDataFrame([(round(T.entry_cost(m, 2.0, 365), 12),)], "cost double")


@query(f"with {SQL_BT} select ts, w, round(w * rvar, 8) + 0.0::double as gross, round(w * rvar - 0.001 * abs(rvar) * (w <> 0)::int, 8) + 0.0::double as net from w where strike is not null")
def f6_x15_spot_rebalance(spark: SparkSession, d: str) -> DataFrame:
    x, ret = backtested(spark, d), F.col("rvar")
    return x.select("ts", "w", (r(F.col("w") * ret) + 0.0).alias("gross"), (r(F.col("w") * ret - T.rebalancing_cost(ret, F.col("w"), 10.0)) + 0.0).alias("net"))  # no negative noughts
