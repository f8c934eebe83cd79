"""Landed market files to DataFrames, and sinks. Fetching over a network is the business of whoever lands the files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.bars import day_range, epoch_instant
from tidewright.operators.summaries import dedup_keep

#: Columns of the files, in order.
TRADE_COLUMNS = ["trade_id", "price", "qty", "quote_qty", "time", "is_buyer_maker", "is_best_match"]
KLINE_COLUMNS = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume", "number_of_trades", "taker_buy_base", "taker_buy_quote", "ignore"]


def _text_rows(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """All columns as text; a header line in some or all of the files is told by its first field, which is no number, and dropped."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    return raw.where(F.col(columns[0]).try_cast("double").isNotNull())


def _zip_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All files of each zip archive; an archive is one task's work, and a broken one fails the read rather than leaving a silent gap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if not n.endswith("/")):
                        with z.open(name) as f:
                            yield from pd.read_csv(f, header=None, names=columns, dtype=str, chunksize=200_000)

    files = spark.read.format("binaryFile").load(path).select("content").repartition(max(1, spark.sparkContext.defaultParallelism))
    raw = files.mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))
    return raw.where(F.col(columns[0]).try_cast("double").isNotNull())


def _rows(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    return _zip_rows(spark, path, columns) if isinstance(path, str) and path.endswith(".zip") else _text_rows(spark, path, columns)


def _number(c: str) -> Column:
    return F.col(c).try_cast("double")


def _flag(c: str) -> Column:
    return F.lower(F.trim(F.col(c))).try_cast("boolean")


def read_trades(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Ticks from CSV or zip: trade_id, price, qty, quote_qty, ts, is_buyer_maker, is_best_match. Every time is taken in the unit of its own size (microseconds
    above 1e14, else milliseconds), so files of both units mix; values that do not parse are null."""
    t = _rows(spark, path, TRADE_COLUMNS)
    at = epoch_instant(F.col("time").try_cast("bigint")).cast("timestamp_ntz")
    return t.select(F.col("trade_id").try_cast("bigint").alias("trade_id"), *[_number(c).alias(c) for c in TRADE_COLUMNS[1:4]], at.alias("ts"), _flag("is_buyer_maker").alias("is_buyer_maker"), _flag("is_best_match").alias("is_best_match"))


def read_klines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Bars from CSV or zip: ts, open, high, low, close, volume, taker_buy_base, taker_sell_base, imbalance."""
    k = _rows(spark, path, KLINE_COLUMNS)
    k = k.select(epoch_instant(F.col("open_time").try_cast("bigint")).cast("timestamp_ntz").alias("ts"), *[_number(c).alias(c) for c in ("open", "high", "low", "close", "volume", "taker_buy_base")])
    sell = F.col("volume") - F.col("taker_buy_base")
    return k.withColumn("taker_sell_base", sell).withColumn("imbalance", F.col("taker_buy_base") - sell)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from CSV with a header in any case: ts, open, high, low, close, volume, dollar_volume; rows without a close are dropped, order is by time."""
    d = spark.read.option("header", True).csv(path)
    d = d.toDF(*[c.strip().lower().replace(" ", "_") for c in d.columns])
    at = F.coalesce(F.try_to_timestamp(F.col("date")).cast("timestamp_ntz"), F.col("date").try_cast("timestamp_ntz"))
    d = d.select(at.alias("ts"), *[_number(c).alias(c) for c in ("open", "high", "low", "close", "volume")])
    return d.withColumn("dollar_volume", F.col("close") * F.col("volume")).dropna(subset=["ts", "close"]).orderBy("ts")


def read_volatility_index(spark: SparkSession, path: str) -> DataFrame:
    """Hourly index from pages of JSON lines [ts_ms, open, high, low, close]: pages overlap, so one row of each instant is kept (the greatest)."""
    j = spark.read.schema("ts_ms bigint, open double, high double, low double, close double").json(path)
    return dedup_keep(j.where("ts_ms is not null"), ["ts_ms"], [], "last").withColumn("ts", F.timestamp_millis("ts_ms").cast("timestamp_ntz")).drop("ts_ms")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """date, anomaly_score, flag from CSV; times lose their zone after conversion to UTC."""
    s = spark.read.option("header", True).csv(path)
    return s.select(F.try_to_timestamp("date").cast("timestamp_ntz").alias("ts"), _number("anomaly_score").alias("anomaly_score"), F.col("flag").try_cast("int").alias("flag"))


def read_days(spark: SparkSession, root: str, start: str, end: str) -> DataFrame:
    """A range of days of a table partitioned by `day`: the partitions are pruned from the plan. Days that are not there are skipped."""
    days = day_range(start, end)
    return spark.read.parquet(root).where(F.col("day").cast("string").between(days[0], days[-1]))


def write_days(df: DataFrame, root: str, at: str = "ts") -> None:
    """Parquet partitioned by day; only the days that df has are replaced, so a day can be landed again."""
    out = df.withColumn("day", F.col(at).cast("date"))
    out.repartition("day", F.pmod(F.xxhash64(at), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(root)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


SOURCES = {"trades": read_trades, "klines": read_klines, "daily": read_daily, "index": read_volatility_index, "scores": read_scores}


def read(spark: SparkSession, source: str, path: str | list[str]) -> DataFrame:
    if source not in SOURCES:
        raise ValueError(f"unknown source {source}; known are {sorted(SOURCES)}")
    return SOURCES[source](spark, path)
