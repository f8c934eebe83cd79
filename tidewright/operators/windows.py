"""Sliding windows of a fixed number of rows, and the paths made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.safe import log_ratio
from tidewright.operators.frames import with_row_numbers


def sliding_windows(df: DataFrame, keys: list[str], at: str, order: list[str], window: int, step: int) -> DataFrame:
    """df's rows once for each window they lie in, with `window_id`, `pos` (0 to window - 1): window k has the rows k * step to k * step + window - 1 of its
    series; a last partial window is dropped, and a series shorter than the window has none. Keys may include a period, which no window then crosses."""
    if window < 1 or step < 1:
        raise ValueError("window and step must be at least one")
    rows = with_row_numbers(df, keys, at, order, "_i")
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - window + 1) / step)).cast("bigint")
    last = F.least(F.floor(F.col("_i") / step), F.floor((F.col("_i_of") - window) / step)).cast("bigint")
    rows = rows.where(last >= first).withColumn("window_id", F.explode(F.sequence(first, last)))
    return rows.withColumn("pos", (F.col("_i") - F.col("window_id") * step).cast("int")).drop("_i", "_i_of")


def channels(rows: DataFrame, keys: list[str], at: str, wanted: list[str]) -> DataFrame:
    """One row per window: keys, `window_id`, `start`, `end`, `path` (array of points, one double per wanted channel, in order of pos).

    rows come from sliding_windows over bars. Channels: time (wall clock over the window's span), log_price, signed_volume (running), log_return (running), volume,
    log_volume (log1p), log_volume_change (running), log_range, overnight_gap (nought in the first row). An unknown one is an error."""
    w = W.partitionBy(*keys, "window_id").orderBy("pos")
    running = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys, "window_id")
    t = F.col(at).cast("timestamp").cast("double")
    none = F.lit(0.0)
    rising = F.when(F.col("close") > F.lag("close").over(w), 1.0).when(F.col("close") < F.lag("close").over(w), -1.0).otherwise(0.0)
    made = {
        "time": lambda: (F.coalesce((t - F.min(t).over(whole)) / F.when(F.max(t).over(whole) > F.min(t).over(whole), F.max(t).over(whole) - F.min(t).over(whole)), none), False),
        "log_price": lambda: (F.log("close"), False),
        "signed_volume": lambda: (rising * F.col("volume"), True),
        "log_return": lambda: (F.coalesce(F.log("close") - F.log(F.lag("close").over(w)), none), True),
        "volume": lambda: (F.col("volume").cast("double"), False),
        "log_volume": lambda: (F.log1p("volume"), False),
        "log_volume_change": lambda: (F.coalesce(F.log1p("volume") - F.log1p(F.lag("volume").over(w)), none), True),
        "log_range": lambda: (log_ratio(F.col("high"), F.col("low")), False),
        "overnight_gap": lambda: (F.coalesce(log_ratio(F.col("open"), F.lag("close").over(w)), none), False),
    }
    unknown = [c for c in wanted if c not in made]
    if unknown:
        raise ValueError(f"unknown channels {unknown}")
    steps = {f"_c{i}": made[c]() for i, c in enumerate(wanted)}
    rows = rows.withColumns({n: c for n, (c, _) in steps.items()})
    rows = rows.withColumns({n: F.sum(n).over(running) for n, (_, cumulative) in steps.items() if cumulative})
    return collect_paths(rows, keys, at, [F.col(n) for n in steps])


def collect_paths(rows: DataFrame, keys: list[str], at: str, point: list[Column]) -> DataFrame:
    """Points of each window in order of pos; a window's rows are bounded by its length."""
    packed = F.sort_array(F.collect_list(F.struct("pos", F.array(*[p.cast("double") for p in point]).alias("x"))))
    return rows.groupBy(*keys, "window_id").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.transform(packed, lambda s: s["x"]).alias("path"))


def increment_scale(paths: DataFrame) -> DataFrame:
    """(channel, scale): population standard deviation of all windows' increments of each channel together; rows of overlapping windows count each time."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.zip_with(F.get("path", i), F.get("path", i - 1), lambda a, b: a - b))
    d = paths.where(F.size("path") > 1).select(F.explode(steps).alias("d")).select(F.posexplode("d").alias("channel", "v"))
    return d.groupBy("channel").agg(F.stddev_pop("v").alias("scale"))
