"""Features, weights, backtest arithmetic and performance of positions over time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.frames import full, turnover, with_frames, with_running
from tidewright.operators.ranks import grouped_quantiles, value_ranks
from tidewright.session import small


def two_sigma(df: DataFrame, series: str, at: str, value: str, window: int, shard_s: int) -> DataFrame:
    """`change` (relative) and `flagged`: further than two sample deviations from the mean of the window that ends with the row."""
    steps = [
        lambda w: {"change": F.col(value) / F.when(F.lag(value).over(w) != 0, F.lag(value).over(w)) - 1},
        lambda w: {"_m": full(F.col("change"), w, window, F.avg), "_s": full(F.col("change"), w, window, F.stddev_samp)},
    ]
    x = with_frames(df, [series], at, [at], window, 0, steps, shard_s)
    return x.withColumn("flagged", F.coalesce(F.abs(F.col("change") - F.col("_m")) > 2 * F.col("_s"), F.lit(False))).drop("_m", "_s")


def har_features(df: DataFrame, series: str, at: str, windows: list[int], shard_s: int) -> DataFrame:
    """df (with ret and var) and `h<k>`: log of the mean variance over the last k rows (null while there are fewer, or where it is nought), and `leverage`: the negative part of ret."""
    f = lambda w: {f"h{k}": (lambda m: F.log(F.when(m > 0, m)))(full(F.col("var"), w, k, F.avg)) for k in windows} | {"leverage": F.least("ret", F.lit(0.0))}
    return with_frames(df, [series], at, [at], max(windows), 0, f, shard_s)


def rank_terciles(df: DataFrame, keys: list[str], value: str, tie: list[str]) -> DataFrame:
    """`tercile` (0 to 2) by linear quantile edges on the ranks with ties in order of `tie`: edges at 1 + (n - 1) / 3 and 1 + 2 (n - 1) / 3."""
    from pyspark.sql import Window as W

    r = value_ranks(df, keys, value).select(*keys, F.col("_v"), (F.col("_upto") - F.col("_n")).alias("_below"), F.col("_total"))
    x = df.join(r, [*([df[k].eqNullSafe(r[k]) for k in keys]), df[value].cast("double") == r["_v"]])
    x = x.select(*[df[c] for c in df.columns], "_below", "_total", "_v")
    rank = F.col("_below") + F.row_number().over(W.partitionBy(*keys, "_v").orderBy(*tie))
    n = F.col("_total")
    return x.withColumn("tercile", F.when(rank <= 1 + (n - 1) / 3, 0).when(rank <= 1 + 2 * (n - 1) / 3, 1).otherwise(2)).drop("_below", "_total", "_v")


def tercile_bins(df: DataFrame, train: DataFrame, value: str, name: str) -> DataFrame:
    """`name`: 0 to 2 by tercile edges fitted on train; a value on an edge belongs above it."""
    q = grouped_quantiles(train, [], value, [1 / 3, 2 / 3])
    x = df.crossJoin(F.broadcast(q))  # one row
    return x.withColumn(name, (F.col(value) >= F.col("q0")).cast("int") + (F.col(value) >= F.col("q1")).cast("int")).drop("q0", "q1")


def variance_series(df: DataFrame, series: str, at: str, rvar: str, flag: str, window: int, shard_s: int) -> DataFrame:
    """`strike`: mean of the realized variance over the `window` rows before; `flag_lag`: the flag of the row before, nought for none."""
    steps = [
        lambda w: {"_ma": full(F.col(rvar), w, window, F.avg), "flag_lag": F.coalesce(F.lag(flag).over(w), F.lit(0))},
        lambda w: {"strike": F.lag("_ma").over(w)},
    ]
    return with_frames(df, [series], at, [at], window + 1, 0, steps, shard_s).drop("_ma")


def rule_weights(df: DataFrame, strike: str, flag: str, flagged: float, calm: float, lively: float) -> DataFrame:
    """`w`: `flagged` on a flag, else `calm` in the lowest and `lively` in the highest third of the strike, else nought."""
    q = grouped_quantiles(df, [], strike, [1 / 3, 2 / 3])
    x = df.crossJoin(F.broadcast(q))  # one row
    s = F.col(strike)
    w = F.when(F.col(flag) == 1, flagged).when(s.isNull(), 0.0).when(s <= F.col("q0"), calm).when(s >= F.col("q1"), lively).otherwise(0.0)
    return x.withColumn("w", w).drop("q0", "q1")


def backtest(df: DataFrame, series: str, at: str, unit_pnl: Column, cost: float, shard_s: int) -> DataFrame:
    """`turn`, `gross` (weight times unit_pnl) and `net` (less cost times turnover)."""
    x = with_frames(df, [series], at, [at], 1, 0, lambda w: {"turn": turnover(F.col("w"), w)}, shard_s)
    return x.withColumn("gross", F.col("w") * unit_pnl).withColumn("net", F.col("gross") - cost * F.col("turn"))


def rebalancing_cost(ret: Column, weight: Column, fee_bps: float) -> Column:
    return fee_bps * 1e-4 * F.abs(ret) * (weight != 0).cast("int")


def entry_cost(mean_variance: float, spread_points: float = 2.0, periods_per_year: int = 8760) -> float:
    """Variance per period that a spread of so many volatility points costs at the mean level: d(var) = 2 vol d(vol), from annual terms to a period's."""
    annual_vol = math.sqrt(mean_variance * periods_per_year)
    return 2 * annual_vol * (spread_points / 100) / periods_per_year


def performance(df: DataFrame, series: str, at: str, net: str, turn: str, weight: str, per_year: int, shard_s: int) -> DataFrame:
    """One row per series: n, sharpe (population deviation; nought below 1e-12), max_drawdown of the compounded equity, cumulative return, mean turnover, active share."""
    x = with_running(df, [series], at, [at], {"_cum": F.col(net)}, shard_s=shard_s).withColumn("_eq", F.exp("_cum"))
    x = with_running(x, [series], at, [at], {}, {"_top": F.col("_eq")}, shard_s=shard_s)
    sd = F.stddev_pop(net)
    return x.groupBy(series).agg(
        F.count("*").alias("n"), F.when(sd < 1e-12, 0.0).otherwise(F.try_divide(F.avg(net), sd) * F.sqrt(F.lit(float(per_year)))).alias("sharpe"),
        F.min(F.col("_eq") / F.greatest(F.lit(1.0), F.col("_top")) - 1).alias("max_drawdown"), (F.exp(F.sum(net)) - 1).alias("cumulative"), F.avg(turn).alias("turnover"), F.avg((F.col(weight) != 0).cast("int")).alias("active"),
    )


def encoded_states(df: DataFrame, series: str, at: str, close: str, flag: str, lookback: int, shard_s: int, train: Column | None = None) -> DataFrame:
    """`ret`, `vol_lag`, `state`: (flag of the row before x 3 + tercile of its volatility) x 2 + whether its momentum is above the median; edges and median are
    those of the train rows (all without one). Rows whose lagged volatility or momentum is missing are left out."""
    steps = [
        lambda w: {"ret": F.log(close) - F.lag(F.log(close)).over(w), "_mom": F.log(close) - F.lag(F.log(close), lookback).over(w)},
        lambda w: {"_vol": full(F.col("ret"), w, lookback, F.stddev_samp)},
        lambda w: {"vol_lag": F.lag("_vol").over(w), "_mom_lag": F.lag("_mom").over(w), "_flag": F.coalesce(F.lag(flag).over(w), F.lit(0))},
    ]
    x = with_frames(df, [series], at, [at], lookback + 2, 0, steps, shard_s).where("vol_lag is not null and _mom_lag is not null")
    fit = x.where(train) if train is not None else x
    median = grouped_quantiles(fit, [], "_mom_lag", [0.5]).withColumnRenamed("q0", "_median")
    x = tercile_bins(x, fit, "vol_lag", "_t").crossJoin(F.broadcast(median))  # one row
    return x.withColumn("state", (F.col("_flag") * 3 + F.col("_t")) * 2 + (F.col("_mom_lag") > F.col("_median")).cast("int")).drop("_mom", "_vol", "_mom_lag", "_flag", "_t", "_median")


def step_rewards(df: DataFrame, series: str, at: str, weight: str, cost: float, risk: float, shard_s: int) -> DataFrame:
    """`reward`: weight times ret, less cost times the change of weight, less risk times the squared product of weight and lagged volatility."""
    x = with_frames(df, [series], at, [at], 1, 0, lambda w: {"_turn": turnover(F.col(weight), w)}, shard_s)
    m = F.col(weight)
    return x.withColumn("reward", m * F.col("ret") - cost * F.col("_turn") - risk * (m * F.col("vol_lag")) * (m * F.col("vol_lag"))).drop("_turn")


def baseline_positions(df: DataFrame, series: str, at: str, close: str, target: float, most: float, lookback: int, shard_s: int) -> DataFrame:
    """`vol_target`: target over the volatility of the row before, at most `most`; `trend`: sign of the momentum of the row before."""
    steps = [
        lambda w: {"_ret": F.log(close) - F.lag(F.log(close)).over(w), "_mom": F.log(close) - F.lag(F.log(close), lookback).over(w)},
        lambda w: {"_vol": full(F.col("_ret"), w, lookback, F.stddev_samp)},
        lambda w: {"_v": F.lag("_vol").over(w), "_m": F.lag("_mom").over(w)},
    ]
    x = with_frames(df, [series], at, [at], lookback + 2, 0, steps, shard_s)
    v = F.when(F.col("_v").isNotNull(), F.least(F.lit(most), F.lit(target) / F.when(F.col("_v") > 0, F.col("_v"))))
    return x.withColumns({"vol_target": v, "trend": F.when(F.col("_m") > 0, 1.0).when(F.col("_m") <= 0, -1.0)}).drop("_ret", "_mom", "_vol", "_v", "_m")


def trade_list(df: DataFrame, series: str, at: str, weight: str, shard_s: int) -> DataFrame:
    x = with_frames(df, [series], at, [at], 1, 0, lambda w: {"w_before": F.coalesce(F.lag(weight).over(w), F.lit(0.0))}, shard_s)
    return x.where(F.col(weight) != F.col("w_before")).withColumn("w_after", F.col(weight))


def cost_sweep(df: DataFrame, gross: str, turn: str, costs: list[float]) -> DataFrame:
    """(cost, total): sums are taken once; the parameters only scale them."""
    s = df.agg(F.sum(gross).alias("g"), F.sum(turn).alias("t"))
    return s.select(F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("cost"), "g", "t").select("cost", (F.col("g") - F.col("cost") * F.col("t")).alias("total"))


def against_control(df: DataFrame, keys: list[str], model: str, control: str, metric: str) -> DataFrame:
    """(keys, model, change): relative change of the metric against the control model of the same keys."""
    c = small(df.where(F.col(model) == control).select(*keys, F.col(metric).alias("_c")))
    return df.where(F.col(model) != control).join(c, keys).withColumn("change", F.try_divide(F.col(metric), F.col("_c")) - 1).drop("_c")
