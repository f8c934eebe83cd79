"""Ticks to bars, gap filling, order flow and variance increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.safe import log_ratio
from tidewright.operators.frames import with_frames
from tidewright.session import micros

LN2 = 0.6931471805599453


def prepare_ticks(df: DataFrame, price: Column, qty: Column, at: Column, buyer_maker: Column, tick_id: Column, series: Column) -> DataFrame:
    """(series, tick_id, ts, price, qty, sign, notional, signed_notional); values that are no numbers and nulls in price, qty or time drop the row. The
    side that made the market was the buyer: sign -1, else +1 (null counts as +1)."""
    rows = df.select(series.alias("series"), tick_id.alias("tick_id"), at.alias("ts"), price.try_cast("double").alias("price"), qty.try_cast("double").alias("qty"), F.when(buyer_maker, -1.0).otherwise(1.0).alias("sign"))
    rows = rows.where("ts is not null and price is not null and qty is not null and not isnan(price) and not isnan(qty)")
    notional = F.col("price") * F.col("qty")
    return rows.withColumns({"notional": notional, "signed_notional": notional * F.col("sign")})


def bars(ticks: DataFrame, width_s: int, key: str = "series") -> DataFrame:
    """Open, high, low, close, volume, dollar_volume, signed_flow and trades of each non-empty interval; `ts` is its start. Partial sums before the shuffle."""
    start = F.timestamp_micros(F.floor(micros("ts") / (width_s * 1_000_000)).cast("bigint") * (width_s * 1_000_000)).cast("timestamp_ntz")
    o = F.struct("ts", "tick_id", "price")
    return (
        ticks.withColumn("_b", start)
        .groupBy(key, "_b")
        .agg(
            F.min(o)["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(o)["price"].alias("close"), F.sum("qty").alias("volume"),
            F.sum("notional").alias("dollar_volume"), F.sum("signed_notional").alias("signed_flow"), F.count("*").alias("trades"),
        )
        .withColumnRenamed("_b", "ts")
    )


def resample(b: DataFrame, width_s: int, key: str = "series") -> DataFrame:
    """Bars of a coarser width from bars; empty ones are dropped."""
    start = F.timestamp_micros(F.floor(micros("ts") / (width_s * 1_000_000)).cast("bigint") * (width_s * 1_000_000)).cast("timestamp_ntz")
    return (
        b.withColumn("_b", start)
        .groupBy(key, "_b")
        .agg(F.min(F.struct("ts", "open"))["open"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max(F.struct("ts", "close"))["close"].alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("_b", "ts")
    )


def fill_gaps(b: DataFrame, width_s: int, key: str = "series", shard_s: int = 30 * 86_400) -> DataFrame:
    """Bars with every missing interval between the first and the last of a series: prices are the last close, volumes nought."""
    us = width_s * 1_000_000
    rows = with_frames(b, [key], "ts", ["ts"], 0, 1, lambda w: {"_next": micros(F.lead("ts").over(w))}, shard_s)
    rows = rows.withColumn("_t", F.explode(F.sequence(micros("ts"), F.coalesce(F.col("_next") - us, micros("ts")), F.lit(us))))
    real = F.col("_t") == micros("ts")
    cols = []
    for c in b.columns:
        if c == "ts":
            cols.append(F.timestamp_micros("_t").cast("timestamp_ntz").alias("ts"))
        elif c in ("open", "high", "low"):
            cols.append(F.when(real, F.col(c)).otherwise(F.col("close")).alias(c))
        elif c in (key, "close"):
            cols.append(F.col(c))
        else:
            cols.append(F.when(real, F.col(c)).otherwise(F.lit(0).cast(b.schema[c].dataType)).alias(c))
    return rows.select(*cols, (~real).alias("filled"))


def valid_bars(b: DataFrame) -> DataFrame:
    """Without bars that have a price that is not above zero."""
    return b.where(F.least("open", "high", "low", "close") > 0)


def at_least(b: DataFrame, trades: int = 50) -> DataFrame:
    return b.where(F.col("trades") >= trades)


def followed_at_once(b: DataFrame, width_s: int, key: str = "series") -> DataFrame:
    """Bars whose next bar starts where they end."""
    rows = with_frames(b, [key], "ts", ["ts"], 0, 1, lambda w: {"_next": micros(F.lead("ts").over(w))})
    return rows.where(F.col("_next") - micros("ts") == width_s * 1_000_000).drop("_next")


def realized_variance(ticks: DataFrame, fine_s: int = 60, coarse_s: int = 300, key: str = "series") -> DataFrame:
    """(key, ts, rv): sum of squared log changes of the last price of each fine interval (carried over empty ones), labelled by the right, closed end."""
    fine = fill_gaps(bars(ticks, fine_s, key), fine_s, key)
    step = with_frames(fine, [key], "ts", ["ts"], 1, 0, lambda w: {"_r": F.log("close") - F.lag(F.log("close")).over(w)})
    end = F.ceil(micros("ts") / (coarse_s * 1_000_000)).cast("bigint") * (coarse_s * 1_000_000)
    out = step.where("_r is not null").groupBy(key, F.timestamp_micros(end).cast("timestamp_ntz").alias("ts"))
    return out.agg(F.sum(F.col("_r") * F.col("_r")).alias("rv"), F.count("*").alias("steps"))


def parkinson(high: Column, low: Column) -> Column:
    """Variance of an interval from its range."""
    r = log_ratio(high, low)
    return r * r / (4 * LN2)


def variance_increment(b: DataFrame, method: str = "close", key: str = "series") -> DataFrame:
    """b with `ret` and `var`: the squared log return (nought in the first row), or for method `gk` half the squared log range less (2 ln 2 - 1) squared log body."""
    if method not in ("close", "gk"):
        raise ValueError(f"unknown method {method}")
    rows = with_frames(b, [key], "ts", ["ts"], 1, 0, lambda w: {"ret": F.coalesce(F.log("close") - F.log(F.lag("close").over(w)), F.lit(0.0))})
    if method == "close":
        return rows.withColumn("var", F.col("ret") * F.col("ret"))
    span, body = log_ratio(F.col("high"), F.col("low")), log_ratio(F.col("close"), F.col("open"))
    return rows.withColumn("var", 0.5 * span * span - (2 * LN2 - 1) * body * body)


def implied_variance(vol_points: Column, periods_per_year: int) -> Column:
    v = vol_points / 100
    return v * v / periods_per_year


def epoch_instant(value: Column) -> Column:
    """Each count on its own: microseconds above 1e14, else milliseconds."""
    return F.when(value > 100_000_000_000_000, F.timestamp_micros(value)).otherwise(F.timestamp_millis(value))


def day_range(start: str, end: str) -> list[str]:
    """The days of a closed range, as partition names; an end before the start is an error."""
    import datetime as dt

    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if b < a:
        raise ValueError("end before start")
    return [(a + dt.timedelta(days=i)).isoformat() for i in range((b - a).days + 1)]


def until_end_of_day(at: Column, end: str) -> Column:
    """A bare end date includes that whole day."""
    return at < F.lit(end).cast("date") + F.expr("interval 1 day") if len(end) == 10 else at <= F.lit(end).cast("timestamp_ntz")


def duration_steps(duration_s: int, bar_s: int) -> int:
    steps = duration_s // bar_s
    if steps < 1:
        raise ValueError("duration shorter than a bar")
    return steps
