"""Grouped summaries: window features, quantiles, blocks, trimmed means, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.safe import log_ratio
from tidewright.operators.frames import with_row_numbers
from tidewright.operators.ranks import grouped_quantiles
from tidewright.session import micros, real


def window_features(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each window (rows from sliding_windows): vol (population), skew and excess kurtosis (biased) of log returns, net return, deepest drawdown of the log
    price, mean volume, mean log range."""
    w = W.partitionBy(*keys, "window_id").orderBy("pos")
    lc = F.log("close")
    x = rows.withColumns({"_ret": lc - F.lag(lc).over(w), "_lc": lc, "_top": F.max(lc).over(w.rowsBetween(W.unboundedPreceding, 0))})
    return x.groupBy(*keys, "window_id").agg(
        F.stddev_pop("_ret").alias("vol"), F.skewness("_ret").alias("skew"), F.kurtosis("_ret").alias("kurt"), (F.max_by("_lc", "pos") - F.min_by("_lc", "pos")).alias("net_return"),
        F.min(F.col("_lc") - F.col("_top")).alias("drawdown"), F.avg("volume").alias("mean_volume"), F.avg(log_ratio(F.col("high"), F.col("low"))).alias("mean_log_range"),
    )


def summary_features(rows: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Eleven features of each window: return, realized volatility, span, drawdown, efficiency, log volume, spread of log volume, share of volume in the first
    half, flow imbalance, sum and spread of log ranges."""
    w = W.partitionBy(*keys, "window_id").orderBy("pos")
    lc = F.log("close")
    x = rows.withColumns({"_ret": F.coalesce(lc - F.lag(lc).over(w), F.lit(0.0)), "_lc": lc, "_top": F.max(lc).over(w.rowsBetween(W.unboundedPreceding, 0))})
    moved = F.sum(F.abs("_ret"))
    hl = log_ratio(F.col("high"), F.col("low"))
    return x.groupBy(*keys, "window_id").agg(
        F.sum("_ret").alias("ret"), F.sqrt(F.sum(F.col("_ret") * F.col("_ret"))).alias("rv"), (F.max("_lc") - F.min("_lc")).alias("span"), F.min(F.col("_lc") - F.col("_top")).alias("drawdown"),
        F.when(moved > 0, F.try_divide(F.abs(F.sum("_ret")), moved)).otherwise(0.0).alias("efficiency"), F.log1p(F.sum("volume")).alias("log_volume"), F.stddev_pop(F.log1p("volume")).alias("log_volume_std"),
        F.try_divide(F.sum(F.when(F.col("pos") < length // 2, F.col("volume"))), F.sum("volume")).alias("first_half"), F.try_divide(F.sum("signed_flow"), F.sum("dollar_volume")).alias("imbalance"),
        F.sum(hl).alias("range_sum"), F.stddev_pop(hl).alias("range_std"),
    )


def tick_features(ticks: DataFrame, width_s: int, key: str = "series") -> DataFrame:
    """Of the ticks of each interval, times 100: log return, realized volatility, log span, order imbalance; and their notional."""
    us = width_s * 1_000_000
    b = F.timestamp_micros(F.floor(micros("ts") / us).cast("bigint") * us).cast("timestamp_ntz")
    x = ticks.withColumn("_b", b)
    w = W.partitionBy(key, "_b").orderBy("ts", "tick_id")
    x = x.withColumn("_r", F.coalesce(F.log("price") - F.log(F.lag("price").over(w)), F.lit(0.0)))
    o = F.struct("ts", "tick_id", "price")
    return x.groupBy(key, F.col("_b").alias("bar")).agg(
        (100 * log_ratio(F.max(o)["price"], F.min(o)["price"])).alias("ret"), (100 * F.sqrt(F.sum(F.col("_r") * F.col("_r")))).alias("rv"), (100 * log_ratio(F.max("price"), F.min("price"))).alias("span"),
        (100 * F.try_divide(F.sum("signed_notional"), F.sum("notional"))).alias("imbalance"), F.sum("notional").alias("notional"),
    ).withColumnRenamed("bar", "ts")


def trimmed_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean without one smallest and one largest value; null for fewer than three values."""
    n, s = F.count(value), F.sum(value) - F.min(value) - F.max(value)
    return df.groupBy(*keys).agg(F.when(n >= 3, s / F.when(n > 2, n - 2)).alias("trimmed"))


def sequential_blocks(df: DataFrame, keys: list[str], at: str, order: list[str], blocks: int) -> DataFrame:
    """df with `block`: equal runs of rows in order, the last one takes the remainder."""
    rows = with_row_numbers(df, keys, at, order)
    size = F.greatest(F.floor(F.col("rn_of") / blocks), F.lit(1))
    return rows.withColumn("block", F.least(F.floor(F.col("rn") / size), F.lit(blocks - 1))).drop("rn", "rn_of")


def fill_with_median(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with nulls and NaN replaced by the median over all rows; look-ahead by nature."""
    median = grouped_quantiles(df, [], value, [0.5])
    return df.crossJoin(F.broadcast(median)).withColumn(name, F.coalesce(real(value), F.col("q0"))).drop("q0")  # one row


def dedup_keep(df: DataFrame, keys: list[str], order: list[str | Column], which: str) -> DataFrame:
    """One row per key: the first or the last by order, then by all columns, so the choice is defined; aggregated before the shuffle, so no key is too hot."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], F.struct(*rest).alias("_row"))
    best = (F.min if which == "first" else F.max)(packed)
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b._row.*")
