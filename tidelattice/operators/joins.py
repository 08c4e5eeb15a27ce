"""Joins on time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_returns(bars: DataFrame) -> DataFrame:
    """ln(close / previous close); gaps don't matter, prices that aren't positive go."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    x = bars.where("close > 0").withColumn("r", F.ln(F.col("close") / F.lag("close").over(w)))
    return x.where("r is not null").select("symbol", "open_time", "r")


def pair_sums(returns: DataFrame) -> DataFrame:
    """Mergeable sums for each pair of symbols over their common times."""
    a = returns.select("open_time", F.col("symbol").alias("a"), F.col("r").alias("x"))
    b = returns.select("open_time", F.col("symbol").alias("b"), F.col("r").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "open_time").where("a < b").groupBy("a", "b").agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.min("open_time").alias("first"), F.max("open_time").alias("last")
    )


def merge_pairs(one: DataFrame, two: DataFrame) -> DataFrame:
    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    return one.unionByName(two).groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in sums], F.min("first").alias("first"), F.max("last").alias("last"))


def correlation(sums: DataFrame) -> DataFrame:
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    below = (n * sxx - sx * sx) * (n * syy - sy * sy)
    value = F.when((n >= 2) & (below > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n * sxy - sx * sy) / F.sqrt(F.nullif(F.greatest(below, F.lit(0.0)), F.lit(0.0))))))
    return sums.withColumn("correlation", value)


def common_times(bars: DataFrame) -> DataFrame:
    """Times that every symbol has."""
    n = bars.agg(F.countDistinct("symbol").alias("all"))
    return bars.groupBy("open_time").agg(F.countDistinct("symbol").alias("n")).join(n, F.col("n") == F.col("all")).select("open_time")


def nearest(left: DataFrame, right: DataFrame, time: str = "event_time") -> DataFrame:
    """Each row of left (symbol, time, id) with the nearest time and price of right; ties go to the earlier one.

    Both sides are running windows, one in each direction of time, so that a symbol costs its rows and no more.
    """
    rows = left.select("symbol", time, "id", F.lit(None).cast("struct<t:bigint,p:double>").alias("e")).unionByName(
        right.select("symbol", time, F.lit(None).cast("long").alias("id"), F.struct(F.col(time).alias("t"), F.col("price").alias("p")).cast("struct<t:bigint,p:double>").alias("e"))
    )
    w = Window.partitionBy("symbol")
    before = F.last("e", ignorenulls=True).over(w.orderBy(time).rangeBetween(Window.unboundedPreceding, 0))
    after = F.last("e", ignorenulls=True).over(w.orderBy(F.desc(time)).rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"b": before, "a": after}).where("id is not null")
    later = F.col("b").isNull() | (F.col("a.t") - F.col(time) < F.col(time) - F.col("b.t"))
    near = F.when(later, F.col("a")).otherwise(F.col("b"))
    return rows.withColumn("near", near).where("near is not null").select("symbol", "id", time, F.col("near.t").alias("near_time"), F.col("near.p").alias("near_price"))


def reciprocal(candidates: DataFrame, oracle: DataFrame) -> DataFrame:
    """Full outer pairs on state where each side names the other's time; what is left over stands alone."""
    c = candidates.select(F.col("time").alias("c_time"), F.col("state").alias("c_state"), F.col("matched_time").alias("c_match"))
    o = oracle.select(F.col("time").alias("o_time"), F.col("state").alias("o_state"), F.col("matched_time").alias("o_match"))
    return c.join(o, (F.col("c_state") == F.col("o_state")) & (F.col("c_match") == F.col("o_time")) & (F.col("o_match") == F.col("c_time")), "full_outer")


def detail_merge(overview: DataFrame, detail: DataFrame) -> DataFrame:
    """Overview bars outside the range between the first and last common open times, detail bars inside."""
    both = overview.select("symbol", "open_time").join(detail.select("symbol", "open_time"), ["symbol", "open_time"], "left_semi")
    ends = both.groupBy("symbol").agg(F.min("open_time").alias("a"), F.max("open_time").alias("b"))
    inside = F.col("open_time").between(F.col("a"), F.col("b"))
    out = overview.join(ends, "symbol", "left").where(F.col("a").isNull() | ~inside)
    return out.unionByName(detail.join(ends, "symbol").where(inside)).drop("a", "b")
