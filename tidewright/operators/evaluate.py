"""Detections against labelled events, regimes and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.safe import ratio
from tidewright.operators.frames import DAY_S, ahead, changed, full, runs, with_frames
from tidewright.operators.ranks import grouped_quantiles
from tidewright.session import measured, micros, small


def crosses(score: Column, threshold: float | Column, higher: bool = True) -> Column:
    """False for a null or NaN score."""
    hit = score > threshold if higher else score < threshold
    return F.coalesce(hit & ~F.isnan(score), F.lit(False))


def in_range(scores: DataFrame, ranges: DataFrame, at: str, how: str, limit: int = 1 << 20) -> DataFrame:
    """Scores joined to ranges (lo, hi inclusive). Ranges of at most `limit` bytes are broadcast to every row; more of them are joined by day, which needs each range spread
    over its days only. A range with a null end holds nothing."""
    ranges, fits = measured(ranges, limit)
    inside = (F.col(at) >= F.col("lo")) & (F.col(at) <= F.col("hi"))
    if fits:
        return scores.join(F.broadcast(ranges), inside, how)
    day = lambda c: F.floor(micros(c) / (DAY_S * 1_000_000)).cast("bigint")
    days = ranges.where("lo <= hi").withColumn("_day", F.explode(F.sequence(day("lo"), day("hi"))))
    return scores.withColumn("_at_day", day(at)).join(days, (F.col("_at_day") == F.col("_day")) & inside, how).drop("_day", "_at_day")


def detect_events(scores: DataFrame, events: DataFrame, at: str, flagged: Column) -> DataFrame:
    """One row per event (name, lo, hi): detected, first crossing, lag_s from the start, share of scores in it that are flagged, scores in it."""
    hits = in_range(scores.withColumn("_f", flagged), events, at, "inner").groupBy("name").agg(F.min(F.when(F.col("_f"), F.col(at))).alias("first_crossing"), F.avg(F.col("_f").cast("int")).alias("flag_rate"), F.count("*").alias("n"))
    out = events.join(hits, "name", "left")
    return out.select("name", "lo", "hi", F.col("first_crossing").isNotNull().alias("detected"), "first_crossing", ((micros("first_crossing") - micros("lo")) / 1_000_000).alias("lag_s"), "flag_rate", F.coalesce("n", F.lit(0)).alias("n"))


def false_positive_rate(scores: DataFrame, events: DataFrame, at: str, flagged: Column) -> DataFrame:
    """One row: share of flagged scores outside all events."""
    return in_range(scores.withColumn("_f", flagged), events, at, "left_anti").agg(F.avg(F.col("_f").cast("int")).alias("false_positive_rate"), F.count("*").alias("n"))


def near_instants(instants: DataFrame, others: DataFrame, at: str, before_s: int, after_s: int) -> DataFrame:
    """instants (column `at`) that have an instant of others from before_s before to after_s after. Both are put into classes of the reach and compared with the
    neighbouring classes only."""
    width = max(before_s, after_s, 1) * 1_000_000
    cls = lambda c: F.floor(micros(c) / width).cast("bigint")
    o = others.select(micros(at).alias("_o"), F.explode(F.array(cls(at) - 1, cls(at), cls(at) + 1)).alias("_c")).distinct()
    left = instants.withColumn("_c", cls(at)).withColumn("_t", micros(at))
    near = left.join(o, (left["_c"] == o["_c"]) & (o["_o"] >= left["_t"] - before_s * 1_000_000) & (o["_o"] <= left["_t"] + after_s * 1_000_000), "left_semi")
    return near.drop("_c", "_t")


def transition_hit_rate(transitions: DataFrame, crossings: DataFrame, at: str, tolerance_s: int) -> DataFrame:
    """One row: share of transitions with a crossing within the tolerance on either side."""
    hit = near_instants(transitions.select(at), crossings.select(at), at, tolerance_s, tolerance_s).agg(F.count("*").alias("hits"))
    return transitions.agg(F.count("*").alias("n")).crossJoin(F.broadcast(hit)).select(F.try_divide("hits", "n").alias("hit_rate"), "n")  # one row each


def bull_bear(bars: DataFrame, series: str, at: str, close: str, window: int = 200) -> DataFrame:
    """bars with `label`: bull above the average of the last `window` closes, else bear (also while the average is not there)."""
    return with_frames(bars, [series], at, [at], window, 0, lambda w: {"label": F.when(F.coalesce(F.col(close) > full(F.col(close), w, window, F.avg), F.lit(False)), "bull").otherwise("bear")}, 365 * DAY_S)


def volatility_regimes(bars: DataFrame, series: str, at: str, close: str, window: int = 20, q: float = 0.66) -> DataFrame:
    """bars with `vol` (sample deviation of log returns over the window) and `label`: high_vol above the series' q quantile of vol (over the whole sample,
    which looks ahead), else low_vol."""
    steps = [lambda w: {"_ret": F.log(close) - F.lag(F.log(close)).over(w)}, lambda w: {"vol": full(F.col("_ret"), w, window, F.stddev_samp)}]
    v = with_frames(bars, [series], at, [at], window + 1, 0, steps, 365 * DAY_S).drop("_ret")
    cut = grouped_quantiles(v, [series], "vol", [q])
    return v.join(small(cut), series, "left").withColumn("label", F.when(F.coalesce(F.col("vol") > F.col("q0"), F.lit(False)), "high_vol").otherwise("low_vol")).drop("q0")


def transitions(labelled: DataFrame, series: str, at: str) -> DataFrame:
    """Rows whose label differs from the one before; the first row counts."""
    return with_frames(labelled, [series], at, [at], 1, 0, lambda w: {"_new": changed(F.col("label"), w)}, 365 * DAY_S).where("_new").drop("_new")


def calm_stretches(bars: DataFrame, series: str, at: str, close: str, events: DataFrame, least_days: int = 45, buffer_days: int = 30, window: int = 20, q: float = 0.66) -> DataFrame:
    """(series, start, end, length): low-volatility runs of at least `least_days` rows that overlap no event widened by the buffer."""
    low = runs(volatility_regimes(bars, series, at, close, window, q), [series], at, [at], F.col("label"), 365 * DAY_S)
    low = low.where((F.col("label") == "low_vol") & (F.col("length") >= least_days))
    wide = events.select((F.col("lo") - F.expr(f"interval {buffer_days} days")).alias("lo"), (F.col("hi") + F.expr(f"interval {buffer_days} days")).alias("hi"))
    return low.join(small(wide), (F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")), "left_anti").drop("label")


def forward_volatility_study(bars: DataFrame, series: str, at: str, close: str, score: Column, q: float, horizon: int) -> DataFrame:
    """(flagged, n, median_fwd, ratio): median volatility over the next `horizon` returns after rows whose score is above its q quantile, and after others."""
    b = bars.withColumn("_s", score)
    steps = [lambda w: {"_ret": F.log(close) - F.lag(F.log(close)).over(w)}, lambda w: {"_fwd": ahead(F.col("_ret"), w, horizon, F.stddev_samp)}]
    x = with_frames(b, [series], at, [at], 1, horizon, steps, 365 * DAY_S)
    cut = grouped_quantiles(b, [], "_s", [q])
    x = x.crossJoin(F.broadcast(cut)).where("_fwd is not null").withColumn("flagged", F.col("_s") > F.col("q0"))  # one row
    out = grouped_quantiles(x, ["flagged"], "_fwd", [0.5]).withColumnRenamed("q0", "median_fwd")
    return x.groupBy("flagged").agg(F.count("*").alias("n")).join(out, "flagged")


def forward_excursions(bars: DataFrame, series: str, at: str, lags: list[int]) -> DataFrame:
    """bars with, for each lag k, `ret_k` (absolute relative change of the close after k rows) and `exc_k` (largest relative move up or down within the next k rows)."""

    def exprs(w):
        out = {}
        for k in lags:
            top, bottom = ahead(F.col("high"), w, k, F.max), ahead(F.col("low"), w, k, F.min)
            out[f"ret_{k}"] = F.abs(ratio(F.lead("close", k).over(w), F.col("close")) - 1)
            out[f"exc_{k}"] = F.greatest(ratio(top, F.col("close")) - 1, 1 - ratio(bottom, F.col("close")))
        return out

    return with_frames(bars, [series], at, [at], 0, max(lags), exprs)


def horizon_summary(detected: DataFrame, fpr: DataFrame, hit_rate: DataFrame, horizon: str, model: str, auroc: float | None = None) -> DataFrame:
    """One row for a horizon and model, from the event table, the false positive rate, the hit rate, and an area under the curve if there is one."""
    e = detected.agg(F.sum(F.col("detected").cast("int")).alias("events_detected"), F.count("*").alias("events_total"), F.avg("lag_s").alias("mean_lag_s"))
    out = e.crossJoin(F.broadcast(fpr.select("false_positive_rate"))).crossJoin(F.broadcast(hit_rate.select("hit_rate")))  # one row each
    return out.select(F.lit(horizon).alias("horizon"), F.lit(model).alias("model"), "events_detected", "events_total", "mean_lag_s", "false_positive_rate", "hit_rate", F.lit(auroc).cast("double").alias("auroc"))
