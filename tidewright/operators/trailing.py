"""Rolling totals over trailing calendar windows by binary doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.shards import time_halo
from tidewright.session import real

#: Days of one time shard; the halo of the longest window is repeated in the next shard.
SHARD_DAYS = 1024


def trailing_totals(
    df: DataFrame, entity: str, day: str, measures: list[str], windows: list[int], newest: Column | None = None, shard_days: int = SHARD_DAYS
) -> DataFrame:
    """For each entity and each calendar day from its first to its last row: `<m>_sum_<w>`, `<m>_avg_<w>`, `<m>_n_<w>` of every measure m over the
    w days that end with that day.

    A day without a row, and a null or NaN value, add nothing: the total is over the values there are (null if there are none), the average is
    that total by their number n. Of several rows of one day the one with the greatest `newest` counts (then the greatest values), so a row
    loaded twice counts once. Rows with null entity or day are left out. An empty df gives an empty result.

    Blocks of 1, 2, 4, ... days are each the sum of two shifted blocks of half the length, and a window is the sum of the blocks of its binary
    digits: log2(w) shifts instead of w terms, with no running difference that would carry rounding on. All shifts share one sort of
    (entity, time shard); shards carry a halo of the longest window, so one entity may hold any share of the rows."""
    longest = max(windows)
    d = F.unix_date(F.col(day).cast("date")).cast("bigint")
    values = [real(F.col(m).cast("double")).alias(f"v{i}") for i, m in enumerate(measures)]
    rows = df.select(F.col(entity).alias("_e"), d.alias("_d"), F.struct((newest if newest is not None else F.lit(0)).alias("at"), *values).alias("_r"))
    rows = rows.where(F.col("_e").isNotNull() & F.col("_d").isNotNull())
    daily = rows.groupBy("_e", "_d").agg(F.max("_r").alias("_r"))
    span = daily.groupBy("_e").agg(F.min("_d").alias("lo"), F.max("_d").alias("hi"))
    shard = F.explode(F.sequence(F.floor(F.col("lo") / shard_days).cast("bigint"), F.floor(F.col("hi") / shard_days).cast("bigint")))
    spine = span.withColumn("_shard", shard)
    start = F.greatest("lo", F.col("_shard") * shard_days - (longest - 1))
    spine = spine.select("_e", "_shard", F.explode(F.sequence(start, F.least("hi", F.col("_shard") * shard_days + shard_days - 1))).alias("_d"))
    none = F.lit(None).cast(daily.schema["_r"].dataType)
    held = time_halo(daily, "_d", shard_days, 0, 0) if longest == 1 else _late_halo(daily, shard_days, longest - 1)
    both = held.select("_e", "_shard", "_d", "_r").unionByName(spine.withColumn("_r", none))
    dense = both.repartition("_e", "_shard").groupBy("_e", "_shard", "_d").agg(F.max("_r").alias("_r")).where(F.col("_d") >= F.col("_shard") * shard_days - (longest - 1))
    w = W.partitionBy("_e", "_shard").orderBy("_d")
    block = {}
    for i, m in enumerate(measures):
        v = F.col(f"_r.v{i}")
        block[m] = (F.coalesce(v, F.lit(0.0)), v.isNotNull().cast("bigint"))
    out = dense.select("_e", "_shard", "_d", *[F.struct(s.alias("s"), n.alias("n")).alias(f"b{i}_1") for i, (s, n) in enumerate(block[m] for m in measures)])
    size = 1
    while size * 2 <= longest:
        out = out.withColumns({f"b{i}_{2 * size}": _plus(F.col(f"b{i}_{size}"), F.lag(f"b{i}_{size}", size).over(w)) for i in range(len(measures))})
        size *= 2
    for width in windows:
        totals = {}
        for i in range(len(measures)):
            shift, total, size = 0, None, 1 << (width.bit_length() - 1)
            while size:
                if width & size:
                    part = F.lag(f"b{i}_{size}", shift).over(w) if shift else F.col(f"b{i}_{size}")
                    total = part if total is None else _plus(total, part)
                    shift += size
                size >>= 1
            totals[f"t{i}_{width}"] = total
        out = out.withColumns(totals)
    cols = [F.col("_e").alias(entity), F.date_from_unix_date(F.col("_d").cast("int")).alias(day)]
    for i, m in enumerate(measures):
        for width in windows:
            s, n = F.col(f"t{i}_{width}.s"), F.col(f"t{i}_{width}.n")
            cols += [F.when(n > 0, s).alias(f"{m}_sum_{width}"), F.when(n > 0, s / n).alias(f"{m}_avg_{width}"), n.alias(f"{m}_n_{width}")]
    return out.where(F.col("_d") >= F.col("_shard") * shard_days).select(*cols)


def _late_halo(daily: DataFrame, width: int, days: int) -> DataFrame:
    return time_halo(daily, "_d", width, days, 0)


def _plus(a: Column, b: Column) -> Column:
    return F.struct((a["s"] + F.coalesce(b["s"], F.lit(0.0))).alias("s"), (a["n"] + F.coalesce(b["n"], F.lit(0))).alias("n"))
