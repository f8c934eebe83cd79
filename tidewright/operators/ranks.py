"""Ranks by value of whole tables, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.session import join_on, real, small


def value_class(v: Column) -> Column:
    """Order-preserving class of a double: sign and logarithm in steps of a 64th, so at most some 90,000 classes."""
    mag = F.floor(F.log(F.abs(v)) * 64)
    return F.when(v == 0, 0).when(v > 0, mag + 100_000).otherwise(-mag - 100_000).cast("bigint")


def value_ranks(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """(keys, `_v`, `_n`, `_upto`, `_total`, and for each of sums `<s>`, `<s>_upto`, `<s>_total`): each distinct value once, with its rows, the rows up to and with
    it, and all rows of the group; the same for the sums.

    Rows are counted by value before the shuffle. Running counts run within (keys, class of values) and get the totals of the lower classes, so that
    one group, or all rows without keys, is spread over many tasks; values equal to each other shrink to one row. Null and NaN values are left out."""
    sums = sums or {}
    rows = df.select(*keys, real(F.col(value).cast("double")).alias("_v"), *[c.alias(n) for n, c in sums.items()]).where("_v is not null")
    counts = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n"), *[F.sum(n).alias(n) for n in sums]).withColumn("_c", value_class(F.col("_v")))
    per = counts.groupBy(*keys, "_c").agg(F.sum("_n").alias("_n"), *[F.sum(n).alias(n) for n in sums])
    along, whole = W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
    names = ["_n", *sums]
    per = per.select(*keys, "_c", *[F.coalesce(F.sum(n).over(along), F.lit(0)).alias(f"_b{i}") for i, n in enumerate(names)], *[F.sum(n).over(whole).alias(f"_t{i}") for i, n in enumerate(names)])
    inside = W.partitionBy(*keys, "_c").orderBy("_v")
    out = join_on(counts, per, [*keys, "_c"])
    label = lambda n: "" if n == "_n" else n
    return out.select(
        *keys, "_v", *names, *[(F.col(f"_b{i}") + F.sum(n).over(inside)).alias(f"{label(n)}_upto") for i, n in enumerate(names)], *[F.col(f"_t{i}").alias(f"{label(n)}_total") for i, n in enumerate(names)]
    )


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (q0, q1, ... in order of probs) of the non-null, non-NaN values; an empty group without keys gives nulls."""
    ranked = value_ranks(df, keys, value)
    aggs = []
    for i, p in enumerate(probs):
        at = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.floor(at) + 1, F.ceil(at) + 1
        hit = lambda k: F.max(F.when((F.col("_upto") - F.col("_n") < k) & (k <= F.col("_upto")), F.col("_v")))
        aggs.append((hit(lo) + (hit(hi) - hit(lo)) * F.max(at - F.floor(at))).alias(f"q{i}"))
    return ranked.groupBy(*keys).agg(*aggs)


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """df with the average rank of the value within keys (from one, ties share it; null for null) and `<name>_of`, the ranked rows of the group."""
    r = value_ranks(df, keys, value).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name), F.col("_total").alias(f"{name}_of"))
    on = F.col(value).cast("double") == r["_v"]
    for i, k in enumerate(keys):
        on = on & df[k].eqNullSafe(r[f"_k{i}"])
    return df.join(r, on, "left").drop("_v", *[f"_k{i}" for i in range(len(keys))])


def dense_ranks(df: DataFrame, keys: list[str], value: str, name: str = "dense_rank") -> DataFrame:
    """df with the dense rank of the value within keys."""
    distinct = value_ranks(df.select(*keys, value).distinct(), keys, value)
    r = distinct.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_v", F.col("_upto").alias(name))
    on = F.col(value).cast("double") == r["_v"]
    for i, k in enumerate(keys):
        on = on & df[k].eqNullSafe(r[f"_k{i}"])
    return df.join(small(r), on, "left").drop("_v", *[f"_k{i}" for i in range(len(keys))])
