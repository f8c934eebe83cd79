"""From bars to calibrated novelty scores, and the evaluation of detectors by random periods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.paths import add_basepoint, invisibility_reset, normalize, recency_weighted
from tidewright.functions.signature import with_signature
from tidewright.operators.evaluate import forward_excursions
from tidewright.operators.frames import greedy_debounce
from tidewright.operators.scores import expected_distance
from tidewright.operators.windows import channels, increment_scale, sliding_windows
from tidewright.session import checkpointed

SERIES, AT = "series", "ts"


@dataclass(frozen=True)
class HorizonConfig:
    name: str
    window: int
    step: int
    depth: int
    channels: tuple[str, ...]
    halflife: float | None = None
    reset: bool = False


def raw_paths(bars: DataFrame, cfg: HorizonConfig, keys: list[str] | None = None) -> DataFrame:
    keys = keys or [SERIES]
    return channels(sliding_windows(bars, keys, AT, [AT], cfg.window, cfg.step), keys, AT, list(cfg.channels))


def scale_of(paths: DataFrame) -> list[float]:
    """One number a channel: bounded by the number of channels."""
    return [r["scale"] or 0.0 for r in increment_scale(paths).orderBy("channel").collect()]


def signature_features(paths: DataFrame, cfg: HorizonConfig, scale: list[float]) -> DataFrame:
    """normalise, weight by recency, add the base point (and the reset), take the signature."""
    p = normalize(F.col("path"), scale)
    if cfg.halflife:
        p = recency_weighted(p, cfg.halflife)
    p = add_basepoint(p)
    if cfg.reset:
        p = invisibility_reset(p)
    return with_signature(paths.withColumn("path", p), cfg.depth)


def novelty(bars: DataFrame, reference: DataFrame, cfg: HorizonConfig) -> DataFrame:
    """(series, window_id, start, end, score): distance of each window's signature to the mean over the reference windows; reference bars carry `period`, and no
    window crosses a period."""
    ref = raw_paths(reference, cfg, [SERIES, "period"])
    scale = scale_of(ref)
    train = signature_features(ref, cfg, scale)
    return expected_distance(signature_features(raw_paths(bars, cfg), cfg, scale), train, "sig").select(SERIES, "window_id", "start", "end", "score")


def evaluate_detections(bars: DataFrame, detections: DataFrame, lags: list[int], debounce_s: int, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(lag, n, mean_ret, multiple, mean_exc, p): of the debounced detections, the mean absolute forward return, its multiple of the mean over all rows, the mean
    forward excursion, and the bootstrap p of the mean return; a lag without detections has n nought and nulls."""
    out = _by_lag(bars, detections, [], lags, debounce_s, replicates, seed)
    return out.select("lag", F.coalesce("n", F.lit(0)).alias("n"), "mean_ret", F.try_divide("mean_ret", "base").alias("multiple"), "mean_exc", "p")  # a row for each lag


def _by_lag(bars: DataFrame, detections: DataFrame, keys: list[str], lags: list[int], debounce_s: int, replicates: int, seed: int) -> DataFrame:
    """(keys, lag, base, n, mean_ret, mean_exc, p). p is the share of means of as many rows of the keys, drawn with replacement, as there are debounced detections
    that is at least the mean of the detections; null with nought replicates."""
    from tidewright.models.synthetic import bootstrap_tests

    x = checkpointed(forward_excursions(bars, SERIES, AT, lags))
    kept = greedy_debounce(detections.select(SERIES, AT), [SERIES], AT, debounce_s)
    hit = x.join(kept, [SERIES, AT], "left_semi")
    stack = lambda df: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"ret_{k}").alias("ret"), F.col(f"exc_{k}").alias("exc")) for k in lags])).alias("s")).select(*keys, "s.*")
    base = stack(x).groupBy(*keys, "lag").agg(F.avg("ret").alias("base"))
    own = stack(hit).groupBy(*keys, "lag").agg(F.count("*").alias("size"), F.count("ret").alias("n"), F.avg("ret").alias("mean_ret"), F.avg("exc").alias("mean_exc"))
    out = base.join(F.broadcast(own), [*keys, "lag"], "left").withColumn("observed", F.col("mean_ret"))  # groups are parameters
    if not replicates:
        return out.withColumn("p", F.lit(None).cast("double"))
    return bootstrap_tests(stack(x), [*keys, "lag"], "ret", out, replicates, seed)


def random_period_runs(bars: DataFrame, score: str, periods: int, length_s: int, quantiles: list[float], lags: list[int], debounce_s: int, seed: int = 0) -> DataFrame:
    """(period, lag, n, mean_ret, multiple, mean_exc, p, quantile): the evaluation over seeded random periods, for each threshold quantile of the period's scores."""
    from tidewright.models.synthetic import uniform
    from tidewright.operators.ranks import grouped_quantiles
    from tidewright.session import micros

    spark = bars.sparkSession
    span = bars.agg(F.min(micros(AT)).alias("a"), F.max(micros(AT)).alias("b"))
    runs = spark.range(periods).withColumnRenamed("id", "period").crossJoin(F.broadcast(span))  # one row
    start = F.col("a") + (uniform(seed, "period") * F.greatest(F.col("b") - F.col("a") - length_s * 1_000_000, F.lit(0))).cast("bigint")
    runs = F.broadcast(runs.select("period", start.alias("lo"), (start + length_s * 1_000_000).alias("hi")))  # periods is a parameter
    own = bars.join(runs, (micros(AT) >= F.col("lo")) & (micros(AT) < F.col("hi"))).drop("lo", "hi")
    own = own.withColumn(SERIES, F.concat_ws("|", F.col("period").cast("string"), F.col(SERIES)))
    out = None
    for i, q in enumerate(quantiles):
        cut = grouped_quantiles(own, ["period"], score, [q])
        hit = own.join(F.broadcast(cut), "period").where(F.col(score) > F.col("q0"))
        parts = evaluate_by_period(own, hit, lags, debounce_s).withColumn("quantile", F.lit(float(q)))
        out = parts if out is None else out.unionByName(parts)
    return out


def evaluate_by_period(bars: DataFrame, detections: DataFrame, lags: list[int], debounce_s: int, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(period, lag, n, mean_ret, multiple, mean_exc, p): evaluate_detections within each period that has detections, against the rows of the period."""
    out = _by_lag(bars, detections, ["period"], lags, debounce_s, replicates, seed).where("n is not null")
    return out.select("period", "lag", "n", "mean_ret", F.try_divide("mean_ret", "base").alias("multiple"), "mean_exc", "p")


def trimmed_over_runs(runs: DataFrame) -> DataFrame:
    from tidewright.operators.summaries import trimmed_mean

    return trimmed_mean(runs, ["quantile", "lag"], "mean_ret")
