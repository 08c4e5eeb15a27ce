"""The same operators on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.indicators import Ema, alpha_of


def tick_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars of a tick stream (symbol, ts, price, quantity, seq); late ticks beyond the watermark are dropped."""
    at = F.struct("ts", "seq")
    x = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    x = x.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"))
    return x.select("symbol", F.unix_millis("w.start").alias("open_time"), "open", "high", "low", "close", "volume")


def closed_once(bars: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Closed bars, each (symbol, open time) once.

    at, the column of the watermark, is a day after the open time: a watermark begins at the epoch, and what is not after it counts as late.
    """
    x = bars.where("closed").withColumn("at", F.timestamp_millis(F.col("open_time") + F.lit(86_400_000))).withWatermark("at", late)
    return x.dropDuplicatesWithinWatermark(["symbol", "open_time"])


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    x = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return x.select("symbol", F.unix_millis("w.start").alias("start"), F.unix_millis("w.end").alias("end"), "n")


def pair_returns(returns: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream-stream join of returns (symbol, at, r) at equal times, within the watermark."""
    a = returns.select(F.col("symbol").alias("a"), F.col("at").alias("at_a"), F.col("r").alias("x")).withWatermark("at_a", late)
    b = returns.select(F.col("symbol").alias("b"), F.col("at").alias("at_b"), F.col("r").alias("y")).withWatermark("at_b", late)
    return a.join(b, (F.col("at_a") == F.col("at_b")) & (F.col("a") < F.col("b")))


def running_ema(bars: DataFrame, period: float, step_ms: int) -> DataFrame:
    """An average for each symbol over a stream of bars; older bars are ignored, a gap starts it anew."""
    alpha = alpha_of(period)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, value = state.get if state.exists else (-1, 0.0)
        e = Ema(alpha)
        e.value = value
        rows = []
        for x in pd.concat(list(batches)).sort_values("open_time").itertuples():
            if x.open_time <= last:
                continue
            if last >= 0 and x.open_time - last > step_ms:
                e.value = 0.0
            last = x.open_time
            rows.append((key[0], last, e.step(x.close)))
        state.update((last, e.value))
        yield pd.DataFrame(rows, columns=["symbol", "open_time", "ema"])

    return bars.groupBy("symbol").applyInPandasWithState(run, "symbol string, open_time long, ema double", "last long, value double", "append", "NoTimeout")
