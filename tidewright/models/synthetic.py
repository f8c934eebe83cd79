"""Synthetic paths and injected spikes, with seeds that make every run the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six shapes and their curves.
SHAPES = ["uptrend", "downtrend", "crash_recovery", "spike_reversal", "oscillating", "flat"]


def shape(kind: str, t: np.ndarray) -> np.ndarray:
    early = t < 0.5
    curves = {
        "uptrend": 2 * t, "downtrend": -2 * t, "crash_recovery": np.where(early, -4 * t, -2 + 4 * (t - 0.5)), "spike_reversal": np.where(early, 4 * t, 2 - 4 * (t - 0.5)),
        "oscillating": np.sin(4 * np.pi * t), "flat": 0 * t,
    }
    if kind not in curves:
        raise ValueError(f"unknown shape {kind}")
    return curves[kind]


def synthetic_paths(spark: SparkSession, per_class: int = 200, points: int = 64, noise: float = 0.08, seed: int = 42) -> DataFrame:
    """(id, label, path of time and value): per_class noisy paths of each shape; the noise of a path depends on the seed and its id only."""
    t = np.linspace(0, 1, points)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                kind = SHAPES[int(i) // per_class]
                y = shape(kind, t) + np.random.default_rng([seed, int(i)]).normal(0, noise, points)
                out.append({"id": i, "label": kind, "path": np.column_stack([t, y]).tolist()})
            yield pd.DataFrame(out, columns=["id", "label", "path"])

    return spark.range(per_class * len(SHAPES)).mapInPandas(run, "id bigint, label string, path array<array<double>>")


def uniform(seed: int, *key: Column | str) -> Column:
    """A number in [0, 1) from a hash of the key; the same in every run and on every plan."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)).cast("double") / float(1 << 40)


def spiked(path: Column, channel: int, magnitude: Column | float, onset: Column) -> Column:
    """With magnitude sqrt(t - onset) added to a channel after the onset (t from nought to one along the path), at most one magnitude."""
    m = magnitude if isinstance(magnitude, Column) else F.lit(float(magnitude))
    n = F.size(path)
    ramp = lambda i: F.least(F.sqrt(F.greatest(i / F.greatest(n - 1, F.lit(1)) - onset, F.lit(0.0))), F.lit(1.0))
    return F.transform(path, lambda p, i: F.transform(p, lambda v, c: F.when(c == channel, v + m * ramp(i)).otherwise(v)))


def spike_trials(paths: DataFrame, key: str, channel: int, magnitudes: list[float], per_class: int, seed: int = 0) -> DataFrame:
    """(magnitude, trial, positive, path): per_class paths drawn with replacement as they are, and as many with a spike, for each magnitude. A draw is the path
    whose position by hash is nearest above the draw's own; positions are kept as (key, hash) and joined by rank."""
    from tidewright.operators.ranks import value_ranks

    spark = paths.sparkSession
    placed = paths.withColumn("_h", uniform(seed, key))
    ranks = value_ranks(placed, [], "_h").select("_v", (F.col("_upto") - 1).alias("_r"), "_total")
    placed = placed.join(ranks, placed["_h"] == ranks["_v"]).select("path", "_r", "_total")
    trials = spark.range(2 * per_class).select(F.col("id").alias("trial"), (F.col("id") >= per_class).alias("positive"), F.explode(F.array(*[F.lit(float(m)) for m in magnitudes])).alias("magnitude"))
    n = paths.select(F.count("*").alias("_n"))
    trials = trials.crossJoin(F.broadcast(n)).withColumn("_r", F.floor(uniform(seed + 1, "trial", "magnitude") * F.col("_n")))  # one row
    drawn = trials.join(placed.select("path", "_r"), "_r")
    return drawn.select("magnitude", "trial", "positive", F.when(F.col("positive"), spiked(F.col("path"), channel, F.col("magnitude"), uniform(seed + 2, "trial", "magnitude"))).otherwise(F.col("path")).alias("path"))


#: Distinct values that one task draws from.
CHUNK = 65_536


def bootstrap_p(values: DataFrame, value: str, observed: float | None, size: int, replicates: int, seed: int = 0) -> DataFrame:
    """One row (p, replicates): share of (1 + replicates) at least as large as the observed mean, each replicate the mean of `size` values drawn with replacement;
    p is null without an observed mean, values or draws."""
    tests = values.sparkSession.createDataFrame([(observed, size)], "observed double, size bigint")
    return bootstrap_tests(values, [], value, tests, replicates, seed).select("p", "replicates")


def bootstrap_tests(values: DataFrame, keys: list[str], value: str, tests: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """tests (keys, observed, size; keys are unique and not null) with `p` and `replicates`: bootstrap_p of each against the values of its keys.

    Values are counted first. A replicate's draws are dealt to chunks of distinct values by a multinomial over the chunks' rows, and within a chunk by a draw of
    positions or, where there are more draws than values, by a multinomial over the values: the same law as single draws, at a cost of at most one step a distinct
    value. Seeds depend on the keys, the replicate and the chunk only."""
    from tidewright.session import checkpointed, real

    counts = checkpointed(values.select(*keys, real(F.col(value).cast("double")).alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n")))
    most = counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    chunks = -(-most // CHUNK)
    counts = counts.withColumns({"_c": F.pmod(F.xxhash64("_v"), F.lit(chunks)).cast("int"), "_key": F.xxhash64(F.lit(seed), *keys)})
    totals = counts.groupBy("_key", "_c").agg(F.sum("_n").alias("_n")).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_c", "_n"))).alias("_chunks"))
    tests = checkpointed(tests.withColumn("_key", F.xxhash64(F.lit(seed), *keys)))
    reps = tests.where("observed is not null and size > 0").select("_key", "size").join(totals, "_key").withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def rng(key: int, *parts: int) -> np.random.Generator:
        return np.random.default_rng([int(key) & (2**64 - 1), *map(int, parts)])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, rep, size, parts in zip(pdf["_key"], pdf["_rep"], pdf["size"], pdf["_chunks"]):
                n = np.array([x["_n"] for x in parts], float)
                out.extend((key, rep, x["_c"], m) for x, m in zip(parts, rng(key, 0, rep).multinomial(size, n / n.sum())) if m)
            yield pd.DataFrame(out, columns=["_key", "_rep", "_c", "_m"])

    def draw(own: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_v")
        v, n = own["_v"].to_numpy(float), own["_n"].to_numpy()
        upto, share, sums = n.cumsum(), n / n.sum(), []
        for key, rep, c, m in zip(dealt["_key"], dealt["_rep"], dealt["_c"], dealt["_m"]):
            g = rng(key, 1, rep, c)
            sums.append(v[np.searchsorted(upto, g.integers(upto[-1], size=m), side="right")].sum() if m < len(v) else g.multinomial(m, share) @ v)
        return dealt[["_key", "_rep", "_c"]].assign(_s=sums)

    dealt = reps.mapInPandas(deal, "_key bigint, _rep int, _c int, _m bigint")
    sums = counts.groupBy("_key", "_c").cogroup(dealt.groupBy("_key", "_c")).applyInPandas(draw, "_key bigint, _rep int, _c int, _s double")
    means = sums.groupBy("_key", "_rep").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("_c", "_s"))), F.lit(0.0), lambda a, x: a + x["_s"]).alias("_s"))
    means = means.join(tests.select("_key", "size", "observed"), "_key")
    p = means.groupBy("_key").agg(((1 + F.sum((F.col("_s") / F.col("size") >= F.col("observed")).cast("int"))) / (F.count("*") + 1)).alias("p"), F.count("*").alias("replicates"))
    return tests.join(p, "_key", "left").drop("_key").withColumn("replicates", F.coalesce("replicates", F.lit(0)))
