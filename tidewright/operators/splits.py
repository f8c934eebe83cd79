"""Chronological splits with purging, anchors and labels; positions come from distributed row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.frames import DAY_S, with_frames, with_row_numbers
from tidewright.session import real, small

YEAR_S = 365 * DAY_S


def anchors(numbered: DataFrame, history: int, stride: int, horizon: int) -> DataFrame:
    """Of rows with rn and rn_of: those with `history` rows before them, every `stride`-th, with more than `horizon` rows left."""
    return numbered.where((F.col("rn") >= history) & ((F.col("rn") - history) % stride == 0) & (F.col("rn") + horizon < F.col("rn_of")))


def train_calib(df: DataFrame, keys: list[str], at: str, order: list[str], share: float) -> DataFrame:
    """`part`: train for the first max(1, round-half-even(share n)) rows of each key, else calib."""
    rows = with_row_numbers(df, keys, at, order)
    return rows.withColumn("part", F.when(F.col("rn") < F.greatest(F.lit(1), F.bround(share * F.col("rn_of"))), "train").otherwise("calib")).drop("rn", "rn_of")


def _first_test(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    return small(rows.where("part = 'test'").groupBy(*keys).agg(F.min(at).alias("_t0")))


def purged_split(df: DataFrame, keys: list[str], at: str, target_end: str, test: float) -> DataFrame:
    """`part`: the last ceil(test n) rows are test; train are the earlier ones whose target ends before the first test row."""
    rows = with_row_numbers(df, keys, at, [at], shard_s=YEAR_S)
    rows = rows.withColumn("part", F.when(F.col("rn") >= F.col("rn_of") - F.ceil(F.col("rn_of") * test), "test").otherwise("train"))
    return rows.join(_first_test(rows, keys, at), keys).where((F.col("part") == "test") | (F.col(target_end) < F.col("_t0"))).drop("rn", "rn_of", "_t0")


def walk_forward(df: DataFrame, keys: list[str], at: str, folds: int) -> DataFrame:
    """Rows once for each `fold` they serve: test blocks of n // (folds + 1) rows at the end, all earlier rows train."""
    rows = with_row_numbers(df, keys, at, [at], shard_s=YEAR_S)
    size = F.floor(F.col("rn_of") / (folds + 1))
    rows = rows.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(folds)])))
    start = F.col("rn_of") - (folds - F.col("fold")) * size
    rows = rows.where(F.col("rn") < start + size)
    return rows.withColumn("part", F.when(F.col("rn") < start, "train").otherwise("test")).drop("rn", "rn_of")


def purged_folds(df: DataFrame, keys: list[str], at: str, target_end: str, folds: int, least: int) -> DataFrame:
    """walk_forward without train rows whose target reaches into the test block; folds with fewer than `least` train rows are left out."""
    rows = walk_forward(df, keys, at, folds)
    rows = rows.join(_first_test(rows, [*keys, "fold"], at), [*keys, "fold"]).where((F.col("part") == "test") | (F.col(target_end) < F.col("_t0"))).drop("_t0")
    enough = rows.where("part = 'train'").groupBy(*keys, "fold").count().where(F.col("count") >= least).drop("count")
    return rows.join(small(enough), [*keys, "fold"], "left_semi")


def gap_split(df: DataFrame, keys: list[str], at: str, share: float, gap: int, before: bool = False) -> DataFrame:
    """First floor(share n) rows train, the rest test, without `gap` rows after the cut (or before it)."""
    rows = with_row_numbers(df, keys, at, [at], shard_s=YEAR_S)
    cut = F.floor(F.col("rn_of") * share)
    low, high = (cut - gap, cut) if before else (cut, cut + gap)
    return rows.where((F.col("rn") < low) | (F.col("rn") >= high)).withColumn("part", F.when(F.col("rn") < low, "train").otherwise("test")).drop("rn", "rn_of")


def abnormal(df: DataFrame, train: DataFrame, keys: list[str], at: str, value: str, width: float) -> DataFrame:
    """`abnormal`: outside mean plus or minus `width` sample deviations of the train rows (one row, broadcast); `next_abnormal` of the following row."""
    stats = train.agg(F.avg(real(value)).alias("_m"), F.stddev_samp(real(value)).alias("_sd"))
    x = df.crossJoin(F.broadcast(stats)).withColumn("abnormal", F.coalesce(F.abs(F.col(value) - F.col("_m")) > width * F.col("_sd"), F.lit(False))).drop("_m", "_sd")
    return with_frames(x, keys, at, [at], 0, 1, lambda w: {"next_abnormal": F.lead("abnormal").over(w)}, YEAR_S)
