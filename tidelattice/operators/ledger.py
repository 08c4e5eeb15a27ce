"""Paper accounts, lots, grids and margin projections."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fills(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Line items as fills of the ordering account; fee = quote * tax."""
    x = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(
        F.col("o_custkey").alias("account"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("time"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("quote"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"),
    )


def lots(rows: DataFrame, fee: float = 0.001, slip: float = 0.0005) -> DataFrame:
    """Fills in order of (time, id, side, quantity, quote) make lots: a fill closes opposite lots first in, first out, and opens one with the rest.

    First in, first out means that on the axis of all quantity ever opened on a side a lot is an interval, and that what a fill closes is one too:
    running sums place both, and where they overlap the fill closes the lot.  Quantities are rounded to 8 places, amounts to 6.
    """
    time_order = Window.partitionBy("account").orderBy("time", "id", "side", "quantity", "quote")
    rows = rows.withColumn("n", F.row_number().over(time_order))
    time_order = Window.partitionBy("account").orderBy("n")
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    x = rows.withColumn("after", F.round(F.sum(signed).over(time_order.rowsBetween(Window.unboundedPreceding, 0)), 8))
    x = x.withColumn("before", F.coalesce(F.lag("after").over(time_order), F.lit(0.0)))
    x = x.withColumn("unit", (F.col("quote") + F.when(F.col("side") == "buy", F.col("fee")).otherwise(-F.col("fee"))) / F.col("quantity"))
    # what each fill opens (more of the side) and closes (less of it); a fill that turns the position does both
    moves = []
    for side, sign in (("long", 1), ("short", -1)):
        change = F.round(F.greatest(sign * F.col("after"), F.lit(0.0)) - F.greatest(sign * F.col("before"), F.lit(0.0)), 8)
        moves.append(F.struct(F.lit(side).alias("side"), change.alias("change")))
    x = x.select("account", "n", "id", "unit", F.explode(F.array(*moves)).alias("m")).select("account", "n", "id", "unit", "m.*").where(F.abs("change") > 1e-8)
    opens = F.col("change") > 0
    by = Window.partitionBy("account", "side")
    upto = by.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(opens, F.round(F.sum(F.greatest("change", F.lit(0.0))).over(upto) - F.col("change"), 8)).otherwise(F.round(F.sum(F.greatest(-F.col("change"), F.lit(0.0))).over(upto) + F.col("change"), 8))
    x = x.withColumn("start", start)
    closed = F.round(F.sum(F.when(~opens, -F.col("change")).otherwise(0.0)).over(by), 8)
    x = x.withColumn("closed", closed)
    # both kinds on one axis; from each start to the next the last opened and the last closing one hold
    axis = by.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("lot", F.last(F.when(opens, F.struct("n", "id", "unit", "change")), ignorenulls=True).over(axis))
    x = x.withColumn("closing", F.last(F.when(~opens, F.struct("id", "unit")), ignorenulls=True).over(axis))
    x = x.groupBy("account", "side", "start").agg(F.first("lot").alias("lot"), F.first("closing").alias("closing"), F.first("closed").alias("closed"))
    end = F.coalesce(F.lead("start").over(by.orderBy("start")), F.round(F.col("lot.change") + F.col("start"), 8))
    # beyond all that is closed nothing closes
    x = x.withColumn("end", end).withColumn("q", F.round(F.greatest(F.least("end", "closed") - F.col("start"), F.lit(0.0)), 8))
    matched = F.when(F.col("q") > 1e-8, F.round(F.col("q") * F.col("closing.unit"), 6)).otherwise(0.0)
    x = x.groupBy("account", "side", F.col("lot.n").alias("n"), F.col("lot.id").alias("lot"), F.col("lot.change").alias("opened"), F.col("lot.unit").alias("unit")).agg(F.sum("q").alias("gone"), F.sum(matched).alias("paid"))
    remaining = F.round(F.col("opened") - F.col("gone"), 8)
    x = x.withColumn("remaining", F.when(remaining > 1e-8, remaining).otherwise(0.0)).withColumn("money", F.round(F.round(F.col("opened") * F.col("unit"), 6) - F.col("paid"), 6))
    # a long's money is what is still to be earned back, a short's what is still to be spent
    done, up = F.col("remaining") == 0, 1 + fee + slip
    long_ = F.col("side") == "long"
    even = F.when(~done, F.col("money") / F.nullif("remaining", F.lit(0.0)) * F.when(long_, F.lit(up)).otherwise(F.lit(1 / up**2)))
    status = F.when(done, "closed").when(F.col("remaining") < F.col("opened"), "partially-closed").otherwise("open")
    return x.select("account", "lot", "side", "opened", "remaining", F.when(done, F.when(long_, -F.col("money")).otherwise(F.col("money"))).alias("profit"), even.alias("break_even"), status.alias("status"))


def closed_summary(lot_rows: DataFrame) -> DataFrame:
    closed = F.col("status") == "closed"
    return lot_rows.groupBy("account").agg(F.count("*").alias("lots"), F.count(F.when(closed, 1)).alias("closed"), F.count(F.when(closed & (F.col("profit") > 0), 1)).alias("profitable"), F.sum(F.coalesce("profit", F.lit(0.0))).alias("profit"))


class PaperAccount:
    """Orders fill against a tick's quantity (0: without limit) in the order they came; costs on both sides."""

    def __init__(self, quote: float, friction: float):
        self.quote, self.asset, self.friction, self.orders, self.filled = quote, 0.0, friction, [], []

    def place(self, side: str, quantity: float, limit: float | None = None, stop: float | None = None) -> None:
        self.orders.append({"side": side, "left": quantity, "limit": limit, "stop": stop})

    def tick(self, time: int, price: float, quantity: float = 0.0) -> None:
        room = quantity if quantity > 0 else float("inf")
        for o in list(self.orders):
            buy = o["side"] == "buy"
            if o["stop"] is not None:
                if (price < o["stop"]) if buy else (price > o["stop"]):
                    continue
                o["stop"] = None
            at = price if o["limit"] is None else o["limit"]
            if o["limit"] is not None and ((price > at) if buy else (price < at)):
                continue
            q = min(o["left"], room)
            if q <= 0:
                break
            room -= q
            o["left"] -= q
            self.quote += -q * at * (1 + self.friction) if buy else q * at * (1 - self.friction)
            self.asset += q if buy else -q
            self.filled.append((time, o["side"], q, at))
            if o["left"] <= 1e-12:
                self.orders.remove(o)

    def equity(self, price: float) -> float:
        return self.quote + self.asset * price


def replay(strategy, quote: float = 1000.0, friction: float = 0.001):
    """Kernel over (open, high, low, close, volume): the account sees the four prices of a bar, then the strategy its close.

    strategy() -> object with bar(close, account); yields equity, asset and the number of fills after each bar.
    """

    def run(rows):
        account, own = PaperAccount(quote, friction), strategy()
        for i, (o, h, low, c, v) in enumerate(rows):
            for k, p in enumerate((o, h, low, c)):
                account.tick(4 * i + k, p, v / 4)
            own.bar(c, account)
            yield account.equity(c), account.asset, len(account.filled)

    return run


class GridStrategy:
    """Buys a falling grid of limits below the last price when it is out, and offers what it holds above."""

    def __init__(self, step: float = 0.01, n: int = 4, share: float = 0.9):
        self.step, self.n, self.share = step, n, share

    def bar(self, close: float, account: PaperAccount) -> None:
        account.orders.clear()
        if account.asset > 1e-12:
            account.place("sell", account.asset, limit=close * (1 + self.step))
            return
        total = self.n * (self.n + 1) / 2
        for i in range(self.n):
            money = account.quote * self.share * (self.n - i) / total
            at = close * (1 - self.step * (i + 1))
            account.place("buy", money / (at * (1 + account.friction)), limit=at)


def margin(quote: Column, asset: Column, price: Column) -> dict[str, Column]:
    """Equity, net exposure, debt and leverage of a leveraged balance."""
    value = asset * price
    equity = quote + value
    debt = F.greatest(-quote, F.lit(0.0)) + F.greatest(-value, F.lit(0.0))
    return {"equity": equity, "exposure": F.when(equity > 0, F.try_divide(value, equity)), "debt": debt, "leverage": F.when(equity > 0, F.try_divide(F.abs(value), equity))}


def liquidation_price(quote: Column, asset: Column, proceeds: float) -> Column:
    """Price at which a position's sale (or a short's repurchase) leaves nothing."""
    p = F.when((asset > 0) & (quote < 0), -quote / F.nullif(asset * proceeds, F.lit(0.0))).when((asset < 0) & (quote > 0), -quote * proceeds / F.nullif(asset, F.lit(0.0)))
    return p


def extrema_mass(matched: DataFrame, time_ms: float = 300_000, percent: float = 0.02) -> DataFrame:
    """Rows (side, quote, lag_ms, price_pct): weighted means, joint scale, and the share of quote within it."""
    x = matched.withColumn("joint", F.greatest(F.abs("lag_ms") / time_ms, F.abs("price_pct") / percent))
    return x.groupBy("side").agg(F.sum("quote").alias("quote"), F.try_divide(F.sum(F.col("quote") * F.abs("lag_ms")), F.sum("quote")).alias("mean_lag"), (F.try_divide(F.sum(F.when(F.col("joint") <= 1, F.col("quote")).otherwise(0.0)), F.sum("quote")) * 100).alias("within_pct"))
