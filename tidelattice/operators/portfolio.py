"""Portfolio weights and their simulation over returns (symbol, open_time, r)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def everything():
    return Window.partitionBy()


def _past(returns: DataFrame) -> DataFrame:
    return returns.groupBy("symbol").agg(F.sum("r").alias("s"), F.stddev_samp("r").alias("sd"), F.exp(F.sum(F.log1p("r"))).alias("grown"), F.count("*").alias("n"))


def long_only(rows: DataFrame, raw: str) -> DataFrame:
    """Negative and missing weights are 0; if none is left, all are equal."""
    x = rows.withColumn("_w", F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)))
    t, n = F.sum("_w").over(everything()), F.count("*").over(everything())
    return x.withColumn("weight", F.when(t > 0, F.col("_w") / F.nullif(t, F.lit(0.0))).otherwise(1 / n)).drop("_w")


def equal(returns: DataFrame) -> DataFrame:
    return _past(returns).select("symbol", (1 / F.count("*").over(everything())).alias("weight"))


def inverse_volatility(returns: DataFrame) -> DataFrame:
    x = _past(returns).withColumn("raw", 1 / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    return long_only(x, "raw").select("symbol", "weight")


def winners(returns: DataFrame) -> DataFrame:
    return long_only(_past(returns), "s").select("symbol", "weight")


def guard(returns: DataFrame) -> DataFrame:
    """Equal weights of those that haven't lost; all cash if everybody has."""
    x = _past(returns).withColumn("ok", (F.col("grown") >= 1).cast("int"))
    return x.select("symbol", F.coalesce(F.col("ok") / F.nullif(F.sum("ok").over(everything()), F.lit(0)), F.lit(0.0)).alias("weight"))


def momentum(returns: DataFrame) -> DataFrame:
    """Upper half long, lower half short; an odd one out is 0."""
    x = _past(returns).withColumns({"k": F.row_number().over(Window.orderBy(F.desc("s"), "symbol")), "m": F.count("*").over(everything())})
    half = F.floor(F.col("m") / 2)
    return x.select("symbol", F.when(F.col("k") <= half, 1 / F.nullif(half, F.lit(0))).when(F.col("k") > F.col("m") - half, -1 / F.nullif(half, F.lit(0))).otherwise(0.0).alias("weight"))


def volatility_target(returns: DataFrame, target: float, gross: float) -> DataFrame:
    mean = returns.groupBy("open_time").agg(F.avg("r").alias("r"))
    sd = mean.agg(F.stddev_samp("r").alias("real"))
    scale = F.when(F.col("real") > 0, F.least(F.lit(target) / F.nullif(F.col("real"), F.lit(0.0)), F.lit(gross))).otherwise(F.lit(gross))
    return equal(returns).join(sd, F.lit(True)).select("symbol", (F.col("weight") * scale).alias("weight"))


def within_gross(weights: np.ndarray, limit: float) -> np.ndarray:
    """Scaled down to the limit, never up."""
    total = np.abs(weights).sum()
    return weights * min(1.0, limit / total) if total > 0 else weights


def simulate(returns: DataFrame, allocate: Callable[[np.ndarray], np.ndarray], every: int, cost: float, lookback: int, gross: float = 1.0) -> DataFrame:
    """Equity over common times; allocate(past returns, one column a symbol) gives the weights each `every` periods.

    One portfolio is one chain of steps: the matrix has a row for each time and goes to one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="open_time", columns="symbol", values="r").dropna().sort_index()
        r, equity, w, out = x.to_numpy(), 1.0, np.zeros(x.shape[1]), []
        for t in range(len(r)):
            if t >= lookback and (t - lookback) % every == 0:
                new = within_gross(np.asarray(allocate(r[t - lookback : t])), gross)
                equity *= 1 - cost * float(np.abs(new - w).sum())
                w = new
            equity *= 1 + float(w @ r[t])
            out.append(equity)
        return pd.DataFrame({"open_time": x.index.to_numpy(), "equity": out})

    return returns.groupBy(F.lit(0).alias("portfolio")).applyInPandas(run, "open_time long, equity double")
