"""Streams of ticks: bars with late data, messages delivered more than once, and trailing scores with state. Extensions; the batch operators do not need them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.operators.redelivery import DeliveryLedger


def stream_bars(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of (series, ts timestamp, tick_id, price, qty); a bar is emitted once no tick that late can come any more."""
    o = F.struct("ts", "tick_id", "price")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("series", F.window("ts", width))
        .agg(F.min(o)["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(o)["price"].alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("trades"))
        .select("series", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "trades")
    )


def stream_once(messages: DataFrame, ledger: DeliveryLedger, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes through the ledger under its number; the sink gets the accepted rows and the number. A batch that is run again after a crash, before or after the
    ledger moved, hands the sink the same rows under the same number again, so nothing is lost and an idempotent sink has each row once."""

    def step(batch: DataFrame, number: int) -> None:
        sink(ledger.ingest(batch, number), number)

    return messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def stream_two_sigma(bars: DataFrame, window: int = 20) -> DataFrame:
    """(series, ts, change, flagged): the two-deviation flag of each new bar against the last `window` changes, kept as state of bounded size per series. Bars must come in
    order within a series; one that is not newer than the last is passed over."""

    def score(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ts, last_close, changes = state.get if state.exists else (None, None, [])
        rows = pd.concat(list(parts)).sort_values("ts")
        out = []
        for ts, close in zip(rows["ts"], rows["close"]):
            stamp = int(ts.value)
            if last_ts is not None and stamp <= last_ts:
                continue
            change = close / last_close - 1 if last_close else None
            if change is not None:
                changes = [*changes, float(change)][-window:]
            flagged = len(changes) == window and abs(changes[-1] - np.mean(changes)) > 2 * np.std(changes, ddof=1)
            out.append((key[0], ts, change, bool(flagged)))
            last_ts, last_close = stamp, float(close)
        state.update((last_ts, last_close, list(changes)))
        yield pd.DataFrame(out, columns=["series", "ts", "change", "flagged"])

    return bars.groupBy("series").applyInPandasWithState(score, "series string, ts timestamp, change double, flagged boolean", "last_ts long, last_close double, changes array<double>", "append", GroupStateTimeout.NoTimeout)
