"""Readers, parsers and sinks of market data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import DAY

BAR = "symbol string, open_time long, open double, high double, low double, close double, volume double, close_time long, closed boolean"
DEPTH = "s string, bids array<array<string>>, asks array<array<string>>"


def read_bars(spark: SparkSession, path: str, kind: str = "parquet", start: int | None = None, end: int | None = None) -> DataFrame:
    """Bars of day folders; a time range prunes to its days before it filters rows."""
    rows = spark.read.schema(BAR + ", day date").format(kind).load(path)
    if start is not None:
        rows = rows.where((F.col("day") >= F.to_date(F.timestamp_millis(F.lit(start)))) & (F.col("open_time") >= start))
    if end is not None:
        rows = rows.where((F.col("day") <= F.to_date(F.timestamp_millis(F.lit(end)))) & (F.col("open_time") <= end))
    return rows


def write_bars(bars: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder a day; only the days that occur are replaced."""
    rows = bars.withColumn("day", F.to_date(F.timestamp_millis("open_time"))).repartition("day").sortWithinPartitions("symbol", "open_time")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").format(kind).save(path)


def warm_up(bars: DataFrame, start: int, end: int, lead: int = 3 * DAY) -> DataFrame:
    return bars.where(F.col("open_time").between(start - lead, end - 1))


def kline_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """Positional rows [open time, o, h, l, c, v, close time ...] as closed bars."""
    a = F.from_json(value, "array<string>")
    names = ["open_time", "open", "high", "low", "close", "volume", "close_time"]
    kinds = ["long", *["double"] * 5, "long"]
    return lines.select(*[F.get(a, i).try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))], F.lit(True).alias("closed")).where("open_time is not null")


def kline_messages(lines: DataFrame, value: str = "value") -> DataFrame:
    """Messages with a bar under k; names differ in case alone there, so fields are read by path."""
    k = lambda x, kind: F.get_json_object(value, f"$.k.{x}").try_cast(kind)
    prices = [k(x, "double").alias(n) for x, n in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)]
    return lines.select(k("s", "string").alias("symbol"), k("t", "long").alias("open_time"), *prices, k("T", "long").alias("close_time"), k("x", "boolean").alias("closed")).where("open_time is not null")


def trade_messages(lines: DataFrame, value: str = "value") -> DataFrame:
    m = lambda x, kind: F.get_json_object(value, f"$.{x}").try_cast(kind)
    at = F.coalesce(m("E", "long"), m("T", "long"), F.unix_millis(F.current_timestamp()))
    return lines.select(m("s", "string").alias("symbol"), at.alias("event_time"), m("p", "double").alias("price"), F.coalesce(m("q", "double"), F.lit(0.0)).alias("quantity")).where("price is not null")


def depth_messages(lines: DataFrame, value: str = "value") -> DataFrame:
    m = F.from_json(value, DEPTH)
    side = lambda a: F.transform(a, lambda x: F.struct(F.get(x, 0).try_cast("double").alias("price"), F.get(x, 1).try_cast("double").alias("quantity")))
    return lines.select(m["s"].alias("symbol"), side(m["bids"]).alias("bids"), side(m["asks"]).alias("asks")).where("size(bids) > 0 and size(asks) > 0")


def book_mid() -> Column:
    return (F.get("bids", 0)["price"] + F.get("asks", 0)["price"]) / 2


def archive_csv(spark: SparkSession, path: str, step: int) -> DataFrame:
    """Archive rows: microseconds become milliseconds, the last of equal times stays, bars that break the rules go."""
    from ..operators import bars

    rows = spark.read.schema("open_time long, open double, high double, low double, close double, volume double, close_time long").csv(path)
    ms = lambda c: F.when(F.col(c) > 10**14, F.floor(F.col(c) / 1000)).otherwise(F.col(c))
    rows = rows.withColumns({"open_time": ms("open_time"), "close_time": ms("close_time"), "_n": F.monotonically_increasing_id()})
    rows = rows.groupBy("open_time").agg(F.max_by(F.struct("open", "high", "low", "close", "volume", "close_time"), "_n").alias("x")).select("open_time", "x.*")
    return rows.where(bars.valid(step))


def tail_lines(lines: DataFrame, limit: int, order: str) -> DataFrame:
    """The last limit rows that parse (all for limit <= 0), oldest first; value is JSON text."""
    good = lines.where(F.expr("try_parse_json(value) is not null") & (F.trim("value") != ""))
    return good.orderBy(order) if limit <= 0 else good.orderBy(F.desc(order)).limit(limit).orderBy(order)


def leverage_by_symbol(rows: DataFrame, seq: str) -> DataFrame:
    """Rows (symbol, brackets array<struct<initialLeverage>>): the largest of the last row of a symbol; none under 1."""
    x = rows.groupBy("symbol").agg(F.max_by("brackets", seq).alias("b"))
    return x.select("symbol", F.array_max(F.col("b.initialLeverage")).alias("leverage")).where("leverage > 0")


def outcomes(topics: DataFrame) -> DataFrame:
    """Topics with markets with outcomes as one row an outcome."""
    m = topics.select("topic", F.explode("markets").alias("m"))
    return m.select("topic", F.col("m.name").alias("market"), F.explode("m.outcomes").alias("outcome"))


def markdown_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """Cells of the rows of a text table; rules between rows go."""
    x = lines.where(F.col(value).rlike(r"^\s*\|") & ~F.col(value).rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    inner = F.regexp_replace(F.trim(value), r"^\||\|$", "")
    return x.select(F.transform(F.split(inner, r"\|"), lambda x: F.trim(x)).alias("cells"))
