"""Grouped and global measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR_MS = 365 * 86_400_000


def curve_returns(curve: DataFrame, time: str = "open_time", value: str = "close") -> DataFrame:
    """Simple returns; -1 after a value that isn't positive."""
    w = Window.partitionBy("symbol").orderBy(time)
    old = F.lag(value).over(w)
    x = curve.withColumn("old", old).where("old is not null")
    return x.select("symbol", F.col(time).alias("open_time"), F.when(F.col("old") > 0, F.try_divide(F.col(value), F.col("old")) - 1).otherwise(-1.0).alias("r"))


def sharpe(curve: DataFrame) -> DataFrame:
    """Mean over sample deviation of returns, by the root of returns a year; null under two returns."""
    x = curve_returns(curve).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
    span = curve.groupBy("symbol").agg((F.max("open_time") - F.min("open_time")).alias("span"))
    per_year = F.col("n") / F.nullif(F.col("span") / YEAR_MS, F.lit(0.0))
    return x.join(span, "symbol").select("symbol", "n", F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.col("m") / F.nullif(F.col("sd"), F.lit(0.0)) * F.sqrt(per_year)).alias("sharpe"), (F.col("sd") * F.sqrt(per_year) * 100).alias("volatility_pct"))


def drawdown(curve: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    x = curve.withColumn("peak", F.max("close").over(w))
    return x.groupBy("symbol").agg(F.max((F.col("peak") - F.col("close")) / F.col("peak") * 100).alias("max_drawdown_pct"))


def risk_adjusted(curve: DataFrame) -> DataFrame:
    ends = curve.groupBy("symbol").agg(((F.max_by("close", "open_time") / F.min_by("close", "open_time") - 1) * 100).alias("return_pct"))
    return ends.join(drawdown(curve), "symbol").withColumn("risk_adjusted", F.when(F.col("max_drawdown_pct") > 0, F.try_divide("return_pct", "max_drawdown_pct")))


def weighted_average(value: str, weight: str) -> Column:
    w = F.when(F.col(weight) > 0, F.col(weight))
    return F.try_divide(F.sum(F.col(value) * w), F.sum(w))


def weighted_quantile(rows: DataFrame, keys: list[str], value: str, weight: str, ratio: float) -> DataFrame:
    """The first value at which the cumulated weight reaches ratio of all."""
    by = Window.partitionBy(*keys)
    x = rows.where(F.col(weight) > 0).withColumns({"_c": F.sum(weight).over(by.orderBy(value)), "_t": F.sum(weight).over(by)})
    return x.where(F.col("_c") >= F.col("_t") * ratio).groupBy(*keys).agg(F.min(value).alias("quantile"))


def movement(bars: DataFrame) -> DataFrame:
    """Return, span, bias of the mean price against the middle, low, high."""
    mean = F.avg((F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
    x = bars.groupBy("symbol").agg(F.min_by("open", "open_time").alias("o"), F.max_by("close", "open_time").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"), mean.alias("mean"))
    mid = (F.col("low") + F.col("high")) / 2
    return x.select("symbol", ((F.col("c") / F.col("o") - 1) * 100).alias("return_pct"), ((F.col("high") / F.col("low") - 1) * 100).alias("span_pct"), ((F.col("mean") / mid - 1) * 100).alias("bias_pct"), "low", "high")


def zigzag(percent: float):
    """Kernel: turns so far, at a reversal of so many percent from the last extreme."""

    def run(rows):
        anchor, way, turns = None, 0, 0
        for (x,) in rows:
            # from a price that isn't positive no percentage is taken
            far = anchor is not None and anchor > 0 and abs(x / anchor - 1) * 100 >= percent
            if anchor is None:
                anchor = x
            elif way == 0:
                if far:
                    way, anchor = (1 if x > anchor else -1), x
            elif (x - anchor) * way > 0:
                anchor = x
            elif far:
                way, anchor, turns = -way, x, turns + 1
            yield (turns,)

    return run


def average_curves(curves: DataFrame, points: int) -> DataFrame:
    """Curves (symbol, open_time, close) resampled by relative place to so many points and averaged."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    x = curves.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("symbol"))})
    ks = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    want = curves.groupBy("symbol").agg(F.count("*").alias("n")).select("symbol", "n", ks.alias("k"))
    want = want.select("symbol", "k", F.floor(F.col("k") * (F.col("n") - 1) / F.lit(float(max(points - 1, 1))) + 0.5).cast("int").alias("i"))
    return want.join(x.select("symbol", "i", "close"), ["symbol", "i"]).groupBy("k").agg(F.avg("close").alias("value"), F.count("*").alias("curves"))


def group_counts(rows: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """Rows of each of the groups, 0 where there are none."""
    every = rows.sparkSession.createDataFrame([(g,) for g in groups], f"{key} string")
    return every.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def finite_average(x: str) -> Column:
    return F.avg(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.col(x)))


def floor_index_quantile(rows: DataFrame, keys: list[str], value: str, ratio: float) -> DataFrame:
    by = Window.partitionBy(*keys)
    x = rows.withColumns({"_k": F.row_number().over(by.orderBy(value)) - 1, "_n": F.count("*").over(by)})
    return x.where(F.col("_k") == F.least(F.floor(F.col("_n") * ratio), F.col("_n") - 1)).select(*keys, F.col(value).alias("scale"))


def daily_rate(pnl, duration_ms) -> Column:
    return F.col(pnl) / (F.greatest(F.col(duration_ms), F.lit(1)) / 86_400_000)


def sample_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.1)").alias("p10"), F.max(value).alias("best"), F.min(value).alias("worst"), F.count(value).alias("n"))


def objective(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(median + lower decile) / 2 over cases, ranked."""
    x = rows.groupBy(*keys).agg(F.expr(f"percentile({score}, 0.5)").alias("median"), F.expr(f"percentile({score}, 0.1)").alias("p10"))
    x = x.withColumn("objective", (F.col("median") + F.col("p10")) / 2)
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("objective"), F.desc("p10"), *keys)))


def pathologies(rows: DataFrame, least: int) -> DataFrame:
    """Rows (case, pnl, capture, ret): losers, and those of lowest capture; reasons together."""
    n = rows.count()
    first = max(least, min(10, n))
    x = rows.withColumn("k", F.row_number().over(Window.orderBy(F.asc_nulls_last("capture"), "ret", "case")))
    reasons = F.filter(F.array(F.when(F.col("pnl") < 0, F.lit("loss")), F.when(F.col("k") <= first, F.lit("capture"))), lambda r: r.isNotNull())
    return x.withColumn("reasons", reasons).where(F.size("reasons") > 0).drop("k")


def category_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two categories over the root of the product of their entropies."""
    total = rows.agg(F.count("*").alias("t"))
    ab, pa, pb = rows.groupBy(a, b).agg(F.count("*").alias("n")), rows.groupBy(a).agg(F.count("*").alias("na")), rows.groupBy(b).agg(F.count("*").alias("nb"))
    x = ab.join(pa, a).join(pb, b).join(total, F.lit(True))
    mi = x.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    ha = pa.join(total, F.lit(True)).agg((-F.sum(F.col("na") / F.col("t") * F.ln(F.col("na") / F.col("t")))).alias("ha"))
    hb = pb.join(total, F.lit(True)).agg((-F.sum(F.col("nb") / F.col("t") * F.ln(F.col("nb") / F.col("t")))).alias("hb"))
    x = mi.join(ha, F.lit(True)).join(hb, F.lit(True))  # one row each
    return x.select("mi", "ha", "hb", F.when((F.col("ha") > 0) & (F.col("hb") > 0), F.greatest(F.lit(0.0), F.col("mi")) / F.nullif(F.sqrt(F.col("ha") * F.col("hb")), F.lit(0.0))).otherwise(0.0).alias("normalised"))
