"""Inputs of the reference queries: ticks from events, daily bars from orders; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.bars import bars, prepare_ticks
from tidewright.session import table

HOUR, DAY = 3600, 86_400


def ticks(spark: SparkSession, d: str, per_user: bool = False) -> DataFrame:
    e = table(spark, d, "events")
    qty = F.get_json_object("props", "$.k")
    maker = F.col("event_type").isin("error", "view")
    return prepare_ticks(e, F.col("value"), qty, F.col("ts"), maker, F.col("event_id"), F.col("user_id").cast("string") if per_user else F.lit("all"))


def tick_bars(spark: SparkSession, d: str, width_s: int = HOUR, per_user: bool = False) -> DataFrame:
    return bars(ticks(spark, d, per_user), width_s)


def daily(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.lit("all").alias("series"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), "o_orderkey", "o_totalprice")
    k = F.struct("o_orderkey", "o_totalprice")
    return o.groupBy("series", "ts").agg(F.min(k)["o_totalprice"].alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max(k)["o_totalprice"].alias("close"), F.count("*").alias("volume"))


def r(c: Column | str, digits: int = 8) -> Column:
    return F.round(c, digits)


TICKS = """ticks as (select event_id as tick_id, ts, value as price, cast(json_extract_string(props, '$.k') as double) as qty,
  case when event_type in ('error', 'view') then -1.0 else 1.0 end as sign, user_id from events where ts is not null and value is not null)"""


def sql_bars(width: str, name: str = "b", per_user: bool = False) -> str:
    """CTEs ticks and `name`: bars of an interval."""
    key = "cast(user_id as varchar)" if per_user else "'all'"
    return f"""{TICKS}, {name} as (select {key} as series, time_bucket(interval {width}, ts) as ts, arg_min(price, (ts, tick_id)) as open, max(price) as high, min(price) as low,
  arg_max(price, (ts, tick_id)) as close, sum(qty) as volume, sum(price * qty) as dollar_volume, sum(price * qty * sign) as signed_flow, count(*) as trades from ticks group by 1, 2)"""


DAILY = """d as (select 'all' as series, cast(o_orderdate as timestamp) as ts, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low,
  arg_max(o_totalprice, o_orderkey) as close, count(*) as volume from orders group by 2)"""
