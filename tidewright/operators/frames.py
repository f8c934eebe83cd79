"""Row frames, running totals and row numbers over long series, without putting a series into one task.

Every function takes `keys` (the series), `at` (a timestamp column) and `order` (a total order that begins with `at`), and cuts each series into time
shards of `shard_s` seconds. Finite frames get their neighbouring rows as a halo of a fixed number of rows; running values get the totals of the
earlier shards. The exchange between shards has one small row a shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.shards import count_halo
from tidewright.session import join_on, micros

DAY_S = 86_400
Exprs = Callable[[WindowSpec], dict[str, Column]]


def sharded(df: DataFrame, at: str, shard_s: int) -> DataFrame:
    return df.withColumn("_shard", F.floor(micros(at) / (shard_s * 1_000_000)).cast("bigint"))


def with_frames(df: DataFrame, keys: list[str], at: str, order: list[str], before: int, after: int, exprs: Exprs | list[Exprs], shard_s: int = 90 * DAY_S) -> DataFrame:
    """df with the columns that exprs(window) names; window is ordered within a shard and its halo, so a frame may reach `before` rows back and `after`
    ahead in all steps together (a list of functions is applied one after the other, so that a later step may use an earlier one's columns). Rows with
    null `at` are left out; at the ends of a series frames are shorter, as in any window."""
    wide = count_halo(sharded(df.where(F.col(at).isNotNull()), at, shard_s), keys, "_shard", order, before, after)
    w = W.partitionBy(*keys, "_shard").orderBy(*order)
    for step in exprs if isinstance(exprs, list) else [exprs]:
        wide = wide.withColumns(step(w))
    return wide.where("_own").drop("_own", "_shard")


def with_running(
    df: DataFrame, keys: list[str], at: str, order: list[str], sums: dict[str, Column], maxima: dict[str, Column] | None = None, shard_s: int = 90 * DAY_S, rows_of: str | None = None
) -> DataFrame:
    """df with running sums and running maxima from the start of each series (null values add nothing; the sum of none is nought, the maximum null), and with
    the rows of the series if rows_of names a column for them.

    Totals of the earlier shards are joined on (keys, shard), by which the rows are partitioned for their window anyway, so the join moves nothing more."""
    maxima = maxima or {}
    rows = sharded(df.where(F.col(at).isNotNull()), at, shard_s)
    rows = rows.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()} | {f"_m_{n}": c for n, c in maxima.items()})
    totals = rows.groupBy(*keys, "_shard").agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in sums], *[F.max(f"_m_{n}").alias(f"_x_{n}") for n in maxima], F.count("*").alias("_n"))
    earlier, whole = W.partitionBy(*keys).orderBy("_shard").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
    totals = totals.select(
        *keys, "_shard", *[F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.max(f"_x_{n}").over(earlier).alias(f"_x_{n}") for n in maxima], F.sum("_n").over(whole).alias("_of")
    )
    w = W.partitionBy(*keys, "_shard").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(w) for n in sums} | {f"_y_{n}": F.max(f"_m_{n}").over(w) for n in maxima})
    out = join_on(out, totals, [*keys, "_shard"])
    of = [F.col("_of").alias(rows_of)] if rows_of else []
    return out.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums], *[F.greatest(f"_y_{n}", f"_x_{n}").alias(n) for n in maxima], *of)


def with_row_numbers(df: DataFrame, keys: list[str], at: str, order: list[str], name: str = "rn", shard_s: int = 90 * DAY_S) -> DataFrame:
    """df with `name`: 0, 1, 2, ... within each series in order, and `<name>_of`: the rows of the series."""
    return with_running(df, keys, at, order, {name: F.lit(1)}, shard_s=shard_s, rows_of=f"{name}_of").withColumn(name, F.col(name) - 1)


def full(value: Column, w: WindowSpec, n: int, agg: Callable[[Column], Column], count: Column | None = None) -> Column:
    """agg over the n rows that end here, null until n values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(count if count is not None else value).over(frame) == n, agg(value).over(frame))


def ahead(value: Column, w: WindowSpec, n: int, agg: Callable[[Column], Column]) -> Column:
    """agg over the next n rows, null where fewer than n values follow."""
    frame = w.rowsBetween(1, n)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def changed(value: Column, w: WindowSpec) -> Column:
    """True where the value differs from the row before; the first row counts as a change."""
    return ~value.eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)


def held(flag: Column, w: WindowSpec, rows: int) -> Column:
    """A flag kept up for `rows` rows from each row that sets it."""
    return F.coalesce(F.max(flag.cast("int")).over(w.rowsBetween(-(rows - 1), 0)), F.lit(0))


def turnover(weight: Column, w: WindowSpec) -> Column:
    return F.abs(weight - F.coalesce(F.lag(weight).over(w), F.lit(0.0)))


def runs(df: DataFrame, keys: list[str], at: str, order: list[str], label: Column, shard_s: int = 90 * DAY_S) -> DataFrame:
    """(keys, label, start, end, length) of the contiguous runs of equal labels."""
    rows = df.withColumn("label", label)
    rows = with_frames(rows, keys, at, order, 1, 0, lambda w: {"_new": changed(F.col("label"), w)}, shard_s)
    # with a one-row halo the first own row of a shard sees its predecessor; row_number 1 is then only the first row of the series
    rows = with_running(rows, keys, at, order, {"_run": F.col("_new").cast("bigint")}, shard_s=shard_s)
    return rows.groupBy(*keys, "_run", "label").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("length")).drop("_run")


def greedy_debounce(df: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """(keys, at) of the instants kept: the first, then each that is at least `seconds` after the last one kept.

    Sequential within a series, but any gap of `seconds` between two instants restarts the count, so a series falls into independent
    stretches, and each stretch is folded in time order, holding only the last instant kept."""
    t = micros(at)
    gap = seconds * 1_000_000
    rows = df.where(F.col(at).isNotNull()).select(*keys, at).distinct()
    rows = with_frames(rows, keys, at, [at], 1, 0, lambda w: {"_new": F.coalesce(t - micros(F.lag(at).over(w)) >= gap, F.lit(True))})
    rows = with_running(rows, keys, at, [at], {"_run": F.col("_new").cast("bigint")})
    rows = rows.select(*keys, "_run", t.alias("_t")).repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", "_t")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_run, last = None, 0
        for pdf in batches:
            keep = []
            for run, part in pdf.groupby([*keys, "_run"], sort=False, dropna=False):
                ts, i = part["_t"].to_numpy(), 0
                if run == open_run:
                    i = int(np.searchsorted(ts, last + gap))
                while i < len(ts):
                    keep.append(part.index[i])
                    last = int(ts[i])
                    i = max(i + 1, int(np.searchsorted(ts, last + gap)))
                open_run = run
            yield pdf.loc[keep]

    kept = rows.mapInPandas(fold, rows.schema)
    return kept.select(*keys, F.timestamp_micros("_t").cast("timestamp_ntz").alias(at))
