"""Forecast datasets and the walk-forward comparison of models over them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.paths import lead_lag, resampled, time_augment
from tidewright.functions.signature import with_signature
from tidewright.models.linear import gram, har, predict, ridge, solve
from tidewright.operators.bars import variance_increment
from tidewright.operators.frames import ahead, with_frames, with_row_numbers
from tidewright.operators.scores import diebold_mariano, regression_metrics
from tidewright.operators.splits import purged_folds
from tidewright.operators.strategy import har_features
from tidewright.operators.summaries import summary_features
from tidewright.operators.windows import channels, sliding_windows
from tidewright.session import checkpointed

SERIES, AT = "series", "ts"


@dataclass(frozen=True)
class ForecastSpec:
    name: str
    lookback: int
    horizon: int
    har_windows: tuple[int, ...]
    dims: tuple[str, ...] = ("log_return", "volume", "log_range")
    points: int | None = None
    stride: int = 1
    depth: int = 3
    variance: str = "gk"
    lead_lag: bool = True
    time: bool = True
    shard_s: int = field(default=365 * 86_400)


def windows_of(bars: DataFrame, spec: ForecastSpec) -> DataFrame:
    return sliding_windows(bars, [SERIES], AT, [AT], spec.lookback, spec.stride)


def signed_paths(bars: DataFrame, spec: ForecastSpec) -> DataFrame:
    """(series, window_id, start, end, path, sig) of each lookback window."""
    p = channels(windows_of(bars, spec), [SERIES], AT, list(spec.dims))
    path = F.col("path")
    if spec.points:
        path = resampled(path, spec.points)
    p = p.withColumn("path", path)
    if spec.lead_lag:
        p = p.withColumn("path", lead_lag(F.col("path"), "leads_lags"))
    if spec.time:
        p = p.withColumn("path", time_augment(F.col("path")))
    return with_signature(p, spec.depth)


def dataset(bars: DataFrame, spec: ForecastSpec) -> DataFrame:
    """One row per anchor (the end of a lookback window with a full history and horizon): ts, target_end, y, log_y, x_har, x_stats, x_sig.

    y is the root of the summed variance of the next `horizon` rows, log_y the log of their mean variance. Bars carry signed_flow and dollar_volume if the flow
    statistic is wanted; without them it is nought. HAR features and targets are frames, not copies of rows; only the windows multiply rows, by lookback / stride."""
    for c in ("signed_flow", "dollar_volume"):
        if c not in bars.columns:
            bars = bars.withColumn(c, F.lit(0.0))
    v = har_features(variance_increment(bars, spec.variance), SERIES, AT, list(spec.har_windows), spec.shard_s)
    h = spec.horizon
    targets = lambda w: {"y": F.sqrt(F.greatest(ahead(F.col("var"), w, h, F.sum), F.lit(0.0))), "log_y": F.log(F.greatest(ahead(F.col("var"), w, h, F.avg), F.lit(1e-18))), "target_end": F.lead(AT, h).over(w)}
    v = with_frames(v, [SERIES], AT, [AT], 0, h, targets, spec.shard_s)
    x_har = F.array(*[F.col(f"h{k}") for k in spec.har_windows], F.col("leverage"))
    v = v.select(SERIES, AT, "target_end", "y", "log_y", x_har.alias("x_har")).where(F.col("target_end").isNotNull() & ~F.exists("x_har", lambda x: x.isNull()))
    w = windows_of(bars, spec)
    ends = w.groupBy(SERIES, "window_id").agg(F.max(AT).alias(AT))
    stats = summary_features(w, [SERIES], spec.lookback).join(ends, [SERIES, "window_id"])
    stats = stats.select(SERIES, AT, F.array(*[F.coalesce(c, F.lit(0.0)) for c in stats.columns if c not in (SERIES, "window_id", AT)]).alias("x_stats"))
    sig = signed_paths(bars, spec).select(SERIES, F.col("end").alias(AT), F.col("sig").alias("x_sig"))
    return v.join(stats, [SERIES, AT]).join(sig, [SERIES, AT])


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_dataset(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def compare(data: DataFrame, spec: ForecastSpec, folds: int = 4, blocks: int = 5, purged: bool = True) -> DataFrame:
    """(model, fold, ts, y, prediction) out of sample: HAR with smearing, ridge on signatures, ridge on statistics, and HAR plus a ridge on its residuals.

    Folds are chronological; train rows whose target reaches into the test block are purged. Fits take sums over the executors; the loop is over folds only."""
    data = checkpointed(data)
    rows = checkpointed(purged_folds(data, [SERIES], AT, "target_end", folds, 50 if purged else 1))
    out = None
    for k in sorted(r[0] for r in rows.select("fold").distinct().collect()):
        own = with_row_numbers(rows.where(F.col("fold") == k), [SERIES], AT, [AT], shard_s=spec.shard_s)
        own = own.withColumn("block", F.least(F.floor(F.col("rn") * blocks / F.col("rn_of")), F.lit(blocks - 1)).cast("int")).drop("rn", "rn_of")
        train = F.col("part") == "train"
        own = checkpointed(own)
        predicted, _, _ = har(own, "x_har", "log_y", train, spec.horizon, AT)
        parts = {"har": predicted}
        for name, x in (("signature_ridge", "x_sig"), ("statistics_ridge", "x_stats")):
            b, _ = ridge(own.where(train), x, "y", "block")
            parts[name] = own.withColumn("prediction", F.greatest(predict(F.col(x), b), F.lit(1e-8)))
        resid = predicted.withColumn("_res", F.col("y") - F.col("prediction"))
        b, _ = ridge(resid.where(train), "x_sig", "_res", "block")
        parts["har_plus_ridge"] = predicted.withColumn("prediction", F.greatest(F.col("prediction") + predict(F.col("x_sig"), b), F.lit(1e-8)))
        for name, p in parts.items():
            p = p.where("part = 'test'").select(F.lit(name).alias("model"), "fold", SERIES, AT, "y", "prediction")
            out = p if out is None else out.unionByName(p)
    return out


def ranking(results: DataFrame, horizon: int) -> DataFrame:
    """(model, rmse, mae, r2, n, best, dm, dm_p), best first: Diebold-Mariano of each model's squared errors against those of the best, over horizon - 1 lags (losses
    of several series at an instant are averaged); null for the best itself."""
    results = checkpointed(results)
    ranked = checkpointed(regression_metrics(results, "y", "prediction", ["model"]))
    names = [r["model"] for r in ranked.orderBy("rmse", "model").select("model").collect()]  # one a model
    if not names:
        return ranked.select(*ranked.columns, F.lit(True).alias("best"), F.lit(None).cast("double").alias("dm"), F.lit(None).cast("double").alias("dm_p"))
    loss = lambda name, out: results.where(F.col("model") == name).select(SERIES, AT, F.pow(F.col("y") - F.col("prediction"), F.lit(2.0)).alias(out))
    tests = results.sparkSession.createDataFrame([(names[0], None, None)], "model string, dm double, dm_p double")
    for name in names[1:]:
        both = loss(name, "a").join(loss(names[0], "b"), [SERIES, AT]).groupBy(AT).agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
        tests = tests.unionByName(diebold_mariano(both, F.col("a"), F.col("b"), AT, horizon).select(F.lit(name).alias("model"), "dm", F.col("p").alias("dm_p")))
    return ranked.join(F.broadcast(tests), "model").select(*ranked.columns, (F.col("model") == names[0]).alias("best"), "dm", "dm_p").orderBy("rmse", "model")


def ablation(bars: DataFrame, base: ForecastSpec, variants: dict[str, dict], folds: int = 4) -> DataFrame:
    """(setting, fold, rmse, mae, r2, n) of the signature ridge for each changed spec; the loop is over settings, each a plan of its own."""
    out = None
    for name, changes in variants.items():
        spec = replace(base, **changes)
        r = compare(dataset(bars, spec), spec, folds).where("model = 'signature_ridge'")
        m = regression_metrics(r, "y", "prediction", ["fold"]).withColumn("setting", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def level_gain(data: DataFrame, d: int, depth: int, blocks: np.ndarray | None = None) -> dict[int, float]:
    """In-sample error of least squares on levels 1 to k of the signature, for each k."""
    from tidewright.functions.signature import level_slice
    from tidewright.models.linear import squared_error

    out = {}
    for k in range(1, depth + 1):
        q = gram(data.withColumn("_x", level_slice(F.col("x_sig"), d, k)), "_x", "y")[0][1]
        out[k] = (squared_error(q, solve(q, 1.0)) / q[0, 0]) ** 0.5
    return out
