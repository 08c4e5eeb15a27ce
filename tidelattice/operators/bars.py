"""Bars: building, resampling, segments, coverage, ranges, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY, align_down, align_up


def by_symbol():
    return Window.partitionBy("symbol").orderBy("open_time")


def ticks(events: DataFrame) -> DataFrame:
    """symbol, event_time, price, quantity, seq from the event table; prices must be positive."""
    return events.where("value > 0").select(
        F.col("event_type").alias("symbol"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("event_time"),
        F.col("value").alias("price"),
        F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)).alias("quantity"),
        F.col("event_id").alias("seq"),
    )


def build(tick: DataFrame, step: int) -> DataFrame:
    """Tumbling bars of a tick table; ties in time by seq."""
    at = F.struct("event_time", "seq")
    return (
        tick.groupBy("symbol", align_down("event_time", step).alias("open_time"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("quantity").alias("volume"),
        )
        .withColumn("close_time", F.col("open_time") + step - 1)
    )


def daily(lineitem: DataFrame, groups: int = 8) -> DataFrame:
    rows = lineitem.select(
        F.pmod("l_suppkey", F.lit(groups)).alias("symbol"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("event_time"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.struct("l_orderkey", "l_linenumber").alias("seq"),
    )
    return build(rows, DAY)


def _merged(rows: DataFrame, keys: list, *more: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min_by("open", "open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"),
        F.sum("volume").alias("volume"),
        *more,
    )


def resample_strict(bars: DataFrame, source: int, target: int) -> DataFrame:
    """Only buckets that have every source bar."""
    bucket = align_down("open_time", target)
    out = _merged(bars.withColumn("bucket", bucket), ["symbol", "bucket"], F.count("*").alias("n"), F.min("open_time").alias("first"))
    out = out.where((F.col("n") == target // source) & (F.col("first") == F.col("bucket")))
    return out.select("symbol", F.col("bucket").alias("open_time"), "open", "high", "low", "close", "volume", (F.col("bucket") + target - 1).alias("close_time"))


def resample_lenient(bars: DataFrame, target: int) -> DataFrame:
    """Partial buckets stay; a bar ends with its bucket or with its last member, whichever is later."""
    out = _merged(bars.withColumn("bucket", align_down("open_time", target)), ["symbol", "bucket"], F.max("close_time").alias("last"))
    return out.select("symbol", F.col("bucket").alias("open_time"), "open", "high", "low", "close", "volume", F.greatest(F.col("bucket") + target - 1, "last").alias("close_time"))


def segments(bars: DataFrame, step: int) -> DataFrame:
    """segment: number of the gap-free run of a symbol's bars, from 0."""
    new = F.when(F.col("open_time") - F.lag("open_time").over(by_symbol()) == step, 0).otherwise(1)
    return bars.withColumn("segment", F.sum(new).over(by_symbol()) - 1)


def render(bars: DataFrame, step: int, target: int) -> DataFrame:
    """Buckets inside continuous runs, with the times of their members."""
    rows = segments(bars, step).withColumn("bucket", align_down("open_time", target))
    return _merged(rows, ["symbol", "segment", "bucket"], F.min("open_time").alias("open_time"), F.max("close_time").alias("close_time")).drop("bucket")


def render_step(span_ms: int, step: int, most: int) -> int:
    """The least multiple of step that shows a span in so many bars."""
    slots = max(1, -(-span_ms // step))
    return step * max(1, -(-slots // most))


def every_n(bars: DataFrame, n: int) -> DataFrame:
    """Merges by place, not by time."""
    rows = bars.withColumn("bucket", F.floor((F.row_number().over(by_symbol()) - 1) / n))
    return _merged(rows, ["symbol", "bucket"], F.min("open_time").alias("open_time"), F.max("close_time").alias("close_time"))


def continuous_suffix(bars: DataFrame, step: int) -> DataFrame:
    rows = segments(bars, step)
    rows = rows.withColumn("_last", F.max("segment").over(Window.partitionBy("symbol")))
    return rows.where(F.col("segment") == F.col("_last")).drop("segment", "_last")


def grid(bars: DataFrame, step: int) -> DataFrame:
    """Every open time between a symbol's first and last bar."""
    ends = bars.groupBy("symbol").agg(F.min("open_time").alias("a"), F.max("open_time").alias("b"))
    return ends.select("symbol", F.explode(F.sequence("a", "b", F.lit(step))).alias("open_time"))


def missing_ranges(bars: DataFrame, step: int) -> DataFrame:
    """Runs of absent open times as (symbol, start, end, n); end is the last missing millisecond."""
    gone = grid(bars, step).join(bars.select("symbol", "open_time"), ["symbol", "open_time"], "left_anti")
    island = F.col("open_time") - F.row_number().over(by_symbol()) * step
    return gone.withColumn("island", island).groupBy("symbol", "island").agg(F.min("open_time").alias("start"), (F.max("open_time") + step - 1).alias("end"), F.count("*").alias("n")).drop("island")


def day_completeness(bars: DataFrame, step: int) -> DataFrame:
    out = bars.groupBy("symbol", align_down("open_time", DAY).alias("day")).agg(F.count("*").alias("n"), F.min("open_time").alias("first"), F.max("open_time").alias("last"))
    full = (F.col("n") == DAY // step) & (F.col("first") == F.col("day")) & (F.col("last") == F.col("day") + DAY - step)
    return out.select("symbol", "day", "n", full.alias("complete"))


def merge_ranges(ranges: DataFrame, step: int, align: bool = True) -> DataFrame:
    """(symbol, start, end) ranges, aligned outwards; those that touch or overlap become one; empty ones go."""
    if align:
        ranges = ranges.select("symbol", align_down("start", step).alias("start"), align_up("end", step).alias("end"))
    ranges = ranges.where(F.col("end") > F.col("start"))
    w = Window.partitionBy("symbol").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= before + step, 0).otherwise(1)
    rows = ranges.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return rows.groupBy("symbol", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Union of both; of rows with the same keys the one written last stays."""
    rows = old.unionByName(new)
    one = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))
    return rows.withColumn("_n", one).where("_n = 1").drop("_n")


def valid(step: int) -> Column:
    """A bar's envelope, alignment and duration."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (low > 0) & (low <= F.least(o, c)) & (h >= F.greatest(o, c)) & (F.col("volume") >= 0) & (F.col("open_time") % step == 0) & (F.col("close_time") == F.col("open_time") + step - 1)


def normalise(bars: DataFrame) -> DataFrame:
    """Bars with positive prices, re-enveloped, volume not negative."""
    rows = bars.where("open > 0 and high > 0 and low > 0 and close > 0")
    names = ["open", "high", "low", "close"]
    return rows.withColumns({"high": F.greatest(*names), "low": F.least(*names), "volume": F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0))})


def body_midpoint(bars: DataFrame) -> DataFrame:
    mid = (F.col("open") + F.col("close")) / 2
    return bars.select("symbol", "open_time", *[((F.col(x) - mid) / mid).alias(x) for x in ("open", "high", "low", "close")], "volume")


def intrabar(bars: DataFrame) -> DataFrame:
    """Four ticks a bar: open, high, low, close at 0, 33, 66 and 100 % of its time."""
    span = F.col("close_time") - F.col("open_time")
    parts = [F.struct(F.lit(i).alias("place"), (F.col("open_time") + F.floor(span * share)).cast("long").alias("event_time"), F.col(x).alias("price"), (F.col("volume") / 4).alias("quantity")) for i, (x, share) in enumerate((("open", 0.0), ("high", 0.33), ("low", 0.66), ("close", 1.0)))]
    return bars.select("symbol", "open_time", F.explode(F.array(*parts)).alias("t")).select("symbol", "open_time", "t.*")


def infer_interval(bars: DataFrame, spans: int = 32) -> DataFrame:
    """Upper median of a symbol's first spans between bars."""
    rows = bars.select("symbol", "open_time", (F.col("open_time") - F.lag("open_time").over(by_symbol())).alias("span"), F.row_number().over(by_symbol()).alias("n")).where(F.col("n").between(2, spans + 1))
    by = Window.partitionBy("symbol")
    rows = rows.withColumn("k", F.row_number().over(by.orderBy("span", "open_time"))).withColumn("m", F.count("*").over(by))
    return rows.where(F.col("k") == F.floor(F.col("m") / 2) + 1).select("symbol", F.col("span").alias("interval_ms"))


def sample_even(bars: DataFrame, limit: int) -> DataFrame:
    """At most limit bars of each symbol at even places, ends included."""
    rows = bars.withColumns({"i": F.row_number().over(by_symbol()) - 1, "n": F.count("*").over(Window.partitionBy("symbol"))})
    picks = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda k: F.floor(k * (F.col("n") - 1) / F.lit(float(max(limit - 1, 1))) + 0.5))
    return rows.where((F.col("n") <= limit) | F.array_contains(picks, F.col("i").cast("long"))).drop("i", "n")


def folds(bars: DataFrame, k: int) -> DataFrame:
    """k contiguous folds of floor(n / k) bars; the last takes what remains."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    size = F.greatest(F.floor(n / k), F.lit(1))
    return bars.withColumn("fold", F.least(F.floor((F.row_number().over(by_symbol()) - 1) / size), F.lit(k - 1)).cast("int"))


def latest(bars: DataFrame, limit: int) -> DataFrame:
    """The last bars of each symbol."""
    return bars.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("open_time")))).where(F.col("_n") <= limit).drop("_n")


def preload(bars: DataFrame, windows: DataFrame, step: int) -> DataFrame:
    """The bars of merged windows (symbol, start, end), each bar once."""
    w = merge_ranges(windows, step).withColumnRenamed("symbol", "_symbol")
    return bars.join(w, (F.col("symbol") == F.col("_symbol")) & F.col("open_time").between(F.col("start"), F.col("end") - 1)).drop("_symbol", "start", "end")


def mulberry32(seed: int):
    """Uniform numbers in [0, 1) from 32-bit multiply-and-shift steps."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        x = (state ^ state >> 15) * (state | 1) & 0xFFFFFFFF
        x ^= (x + ((x ^ x >> 7) * (x | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield ((x ^ x >> 14) & 0xFFFFFFFF) / 4294967296


def random_windows(seed: int, start: int, end: int, step: int, n: int, shortest: int, longest: int) -> list[tuple[int, int]]:
    draw = mulberry32(seed)
    out = []
    for _ in range(n):
        size = (shortest + int(next(draw) * (longest - shortest + 1))) * step
        room = max(0, (end - start - size) // step)
        begin = start + int(next(draw) * (room + 1)) * step
        out.append((begin, begin + size))
    return sorted(out)
