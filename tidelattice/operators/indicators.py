"""Indicators over bars (symbol, open_time, close, volume ...).

Rolling ones are window expressions.  Recurrences are kernels over a symbol's bars in time
order (scan); a kernel holds a few numbers of state, so a task needs the columns it
reads of one symbol's run and nothing else.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import by_symbol


def back(n: int):
    return by_symbol().rowsBetween(-n, 0)


def lookback(x: str, n: int) -> tuple[Column, Column]:
    """Value n bars back (the current one where there is none) and the change from it."""
    old = F.coalesce(F.lag(x, n).over(by_symbol()), F.col(x))
    return old, F.col(x) - old


def sma(x: str, n: int) -> Column:
    return F.avg(x).over(back(n - 1))


def full_sma(x: str, n: int) -> Column:
    return F.when(F.count(x).over(back(n - 1)) == n, sma(x, n))


def vwsma(x: str, v: str, n: int) -> Column:
    total = F.sum(v).over(back(n - 1))
    return F.when(total > 0, F.sum(F.col(x) * F.col(v)).over(back(n - 1)) / F.nullif(total, F.lit(0.0))).otherwise(sma(x, n))


def efficiency_ratio(x: str, n: int) -> Column:
    """Net change over the sum of changes; 0 until there are n changes. Needs a column d of changes (see with_changes)."""
    path = F.sum(F.abs("d")).over(back(n - 1))
    full = F.count("d").over(back(n - 1)) == n
    ratio = F.abs(F.col(x) - F.lag(x, n).over(by_symbol())) / F.nullif(path, F.lit(0.0))
    return F.when(full & (path > 0), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def with_changes(bars: DataFrame, x: str = "close") -> DataFrame:
    return bars.withColumn("d", F.col(x) - F.lag(x).over(by_symbol()))


def bollinger(x: str, n: int, k: float) -> dict[str, Column]:
    """Population deviation around the window's mean."""
    w = back(n - 1)
    mean, sd = F.avg(x).over(w), F.stddev_pop(x).over(w)
    low, high = mean - k * sd, mean + k * sd
    return {"middle": mean, "lower": low, "upper": high, "percent_b": F.when(high > low, (F.col(x) - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(0.0))}


def relative_deviation(x: str, span_ms: int) -> Column:
    """Population deviation over mean of the bars in [t - span, t]."""
    w = Window.partitionBy("symbol").orderBy("open_time").rangeBetween(-span_ms, 0)
    mean = F.avg(x).over(w)
    return F.when(mean > 0, F.stddev_pop(x).over(w) / F.nullif(mean, F.lit(0.0))).otherwise(F.lit(0.0))


def regression(x: str, n: int, weight: str | None = None) -> dict[str, Column]:
    """Least squares on the places 0 .. m-1 of the last n bars; needs a column i of places.  Weights that are all 0 count as equal.

    Moments are taken around the means, so that large places and prices cost no digits.
    """
    w = back(n - 1)
    i = F.col("i").cast("double")
    base = F.min(i).over(w)
    if weight:  # the last n bars as an array: the mean first, then what is left
        rows = F.collect_list(F.struct(i.alias("i"), F.col(x).cast("double").alias("x"), F.col(weight).cast("double").alias("w"))).over(w)
        total = F.sum(weight).over(w)
        of = lambda r: F.when(total > 0, r["w"]).otherwise(1.0)
        add = lambda f: F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + f(r))
        s0 = add(of)
        mi, mx = add(lambda r: of(r) * (r["i"] - base)) / s0, add(lambda r: of(r) * r["x"]) / s0
        var = add(lambda r: of(r) * (r["i"] - base - mi) * (r["i"] - base - mi))
        both = add(lambda r: of(r) * (r["i"] - base - mi) * (r["x"] - mx))
    else:
        mi, mx = F.avg(i).over(w) - base, F.avg(x).over(w)
        var, both = F.var_pop(i).over(w), F.covar_pop(i, F.col(x)).over(w)
    slope = F.when(var > 1e-9, both / F.nullif(var, F.lit(0.0))).otherwise(F.lit(0.0))
    at0 = mx - slope * mi
    fitted = at0 + slope * (i - base)
    return {"slope": slope, "intercept": at0, "fitted": fitted, "next": fitted + slope}


def placed(bars: DataFrame) -> DataFrame:
    return bars.withColumn("i", F.row_number().over(by_symbol()) - 1)


def price_range(n: int) -> tuple[Column, Column]:
    return F.min("low").over(back(n - 1)), F.max("high").over(back(n - 1))


def log_return_volatility(n: int) -> Column:
    """Population deviation of the last n log returns; needs a column lr."""
    return F.stddev_pop("lr").over(back(n - 1))


def temperature(scale: float, horizon: int, sigma: Column | None = None) -> Column:
    return F.lit(scale * math.sqrt(horizon)) * (F.lit(1.0) if sigma is None else sigma)


def range_percent(bars: DataFrame, n: int) -> DataFrame:
    """Mean and greatest (high - low) / open * 100 of the last n bars."""
    x = bars.withColumn("r", (F.col("high") - F.col("low")) / F.col("open") * 100)
    return x.select("symbol", "open_time", F.avg("r").over(back(n - 1)).alias("mean_range"), F.max("r").over(back(n - 1)).alias("max_range"))


def rolling_span(span_ms: int) -> Column:
    w = Window.partitionBy("symbol").orderBy("open_time").rangeBetween(-span_ms, 0)
    low = F.min("low").over(w)
    return (F.max("high").over(w) - low) / low * 100


def threshold(rate: Column, lower: float, upper: float) -> Column:
    return F.when(rate >= upper, 1).when(rate <= -lower, -1).otherwise(0)


def quadratic(x: str, n: int) -> dict[str, Column]:
    """a, b, c of the least-squares parabola over the last n bars, t from 0; null until the window is full. Needs i."""
    w = back(n - 1)
    t = F.col("i").cast("double") - F.min("i").over(w)
    m = float(n)
    # sums of powers of 0 .. n-1 are constants; those with x are over the places in the window
    p1, p2, p3, p4 = (float(sum(k**e for k in range(n))) for e in (1, 2, 3, 4))
    rows = F.collect_list(F.col(x).cast("double")).over(w)
    add = lambda f: F.aggregate(F.transform(rows, f), F.lit(0.0), lambda acc, v: acc + v)
    y0, s1, s2 = add(lambda v, k: v), add(lambda v, k: v * k), add(lambda v, k: v * k * k)
    det = p4 * (p2 * m - p1 * p1) - p3 * (p3 * m - p1 * p2) + p2 * (p3 * p1 - p2 * p2)
    a = (s2 * (p2 * m - p1 * p1) - p3 * (s1 * m - p1 * y0) + p2 * (s1 * p1 - p2 * y0)) / det
    b = (p4 * (s1 * m - p1 * y0) - s2 * (p3 * m - p1 * p2) + p2 * (p3 * y0 - s1 * p2)) / det
    c = (p4 * (p2 * y0 - p1 * s1) - p3 * (p3 * y0 - s1 * p2) + s2 * (p3 * p1 - p2 * p2)) / det
    full = F.count(x).over(w) == n
    return {"a": F.when(full, a), "b": F.when(full, b), "c": F.when(full, c), "_t": t}


# --- recurrences ---------------------------------------------------------------------


def scan(bars: DataFrame, columns: list[str], kernel: Callable[..., Iterator[tuple]], schema: str, keys: tuple = ("symbol",)) -> DataFrame:
    """kernel(rows) yields a tuple for each row (a tuple of the columns, in time order) of a group.

    Groups are sorted by Spark, which spills, and reach the kernel as a stream: a kernel that holds a few numbers of state
    needs no more memory for a long run than for a short one.
    """
    names = [x.split()[0] for x in schema.split(",")]
    key_types = {f.name: f.dataType.simpleString() for f in bars.schema.fields}
    head = ", ".join(f"{k} {key_types[k]}" for k in (*keys, "open_time"))
    used = list(dict.fromkeys((*keys, "open_time", *columns)))
    types = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    kinds = [types.get(x.split()[1]) for x in f"{head}, {schema}".split(", ")]
    heads, body = [used.index(k) for k in (*keys, "open_time")], [used.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in range(len(used))), strict=True))
        out: list[tuple] = []
        for _, group in groupby(rows, key=lambda row: tuple(row[: len(keys)])):
            waiting: deque = deque()

            def feed(group=group, waiting=waiting):
                for row in group:
                    waiting.append(tuple(row[k] for k in heads))
                    yield tuple(row[k] for k in body)

            for result in kernel(feed()):
                out.append((*waiting.popleft(), *result))
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], [*keys, "open_time", *names])

    return bars.select(*used).repartition(*keys).sortWithinPartitions(*keys, "open_time").mapInArrow(run, f"{head}, {schema}")


def alpha_of(period: float) -> float:
    return min(1.0, max(0.0, period)) if period <= 1 else 2 / (period + 1)


class Ema:
    """A state of 0 means that there is none yet."""

    def __init__(self, alpha: float):
        self.alpha, self.value, self.change = alpha, 0.0, 0.0

    def step(self, x: float, alpha: float | None = None) -> float:
        if self.value == 0:
            self.value, self.change = x, 0.0
        else:
            self.change = (self.alpha if alpha is None else alpha) * (x - self.value)
            self.value += self.change
        return self.value


def ema(period: float):
    def run(rows):
        e = Ema(alpha_of(period))
        for (x,) in rows:
            yield e.step(x), e.change

    return run


def vwema(period: float):
    def run(rows):
        pv, vol = Ema(alpha_of(period)), Ema(alpha_of(period))
        value = None
        for x, v in rows:
            if v > 0:
                pv.step(x * v)
                vol.step(v)
                value = pv.value / vol.value
            yield (value,)

    return run


class Efficiency:
    """Efficiency ratio of n changes, each scaled by (volume / its average) ** power."""

    def __init__(self, n: int, power: float = 0.0, volume_period: float = 20):
        self.changes, self.last, self.power, self.volume = deque(maxlen=n), None, power, Ema(alpha_of(volume_period))

    def step(self, x: float, v: float) -> float:
        relative = 1.0
        if self.power > 0 and v > 0:
            self.volume.step(v)
            relative = v / self.volume.value
        if self.last is not None:
            self.changes.append((x - self.last) * relative**self.power)
        self.last = x
        if len(self.changes) < self.changes.maxlen:
            return 0.0
        path = math.fsum(abs(c) for c in self.changes)
        return min(1.0, abs(math.fsum(self.changes)) / path) if path > 0 else 0.0


def vw_efficiency(n: int, power: float, volume_period: float):
    def run(rows):
        e = Efficiency(n, power, volume_period)
        for x, v in rows:
            yield (e.step(x, v),)

    return run


class Kama:
    """Adaptive average; with volume power 0 it is the plain one.  The volume average counts before this bar's volume."""

    def __init__(self, n: int = 10, fast: float = 2, slow: float = 30, power: float = 2.0, volume_power: float = 0.0, volume_period: float = 20, cap: float = 3.0, er_power: float = 0.0):
        self.er, self.fast, self.slow, self.power = Efficiency(n, er_power, volume_period), alpha_of(fast), alpha_of(slow), power
        self.volume_power, self.cap, self.volume, self.average = volume_power, cap, Ema(alpha_of(volume_period)), Ema(0.0)

    def step(self, x: float, v: float) -> float:
        er = self.er.step(x, v)
        relative = min(v / self.volume.value, self.cap) if v > 0 and self.volume.value > 0 else 1.0
        er = min(1.0, max(0.0, er * relative**self.volume_power))
        alpha = min(1.0, max(0.0, (self.slow + er * (self.fast - self.slow)) ** self.power))
        self.average.step(x, alpha)
        if v > 0:
            self.volume.step(v)
        return self.average.value


def kama(**options):
    def run(rows):
        k = Kama(**options)
        for x, v in rows:
            yield k.step(x, v), k.average.change

    return run


def chop_fast_ema(n: int = 10, fast: float = 2, slow: float = 30, chop_power: float = 1.0, volume_power: float = 1.0, cap: float = 3.0, volume_period: float = 20, combine: str = "both", mix: float = 0.5):
    """Fast where the path is choppy, the volume high, or both."""

    def run(rows):
        er, volume, average = Efficiency(n), Ema(alpha_of(volume_period)), Ema(0.0)
        a, b = alpha_of(fast), alpha_of(slow)
        for x, v in rows:
            chop = (1 - er.step(x, v)) ** chop_power
            if v > 0:
                volume.step(v)
            relative = min(v / volume.value, cap) if volume.value > 0 else 1.0
            score = max(0.0, (relative - 1) / (cap - 1)) ** volume_power
            speed = {"both": chop * score, "either": max(chop, score), "weighted": mix * chop + (1 - mix) * score}[combine]
            yield average.step(x, b + min(1.0, max(0.0, speed)) * (a - b)), average.change

    return run


def macd(fast: float, slow: float, signal: float):
    def run(rows):
        a, b, s = Ema(alpha_of(fast)), Ema(alpha_of(slow)), Ema(alpha_of(signal))
        for (x,) in rows:
            value = a.step(x) - b.step(x)
            s.step(value)
            yield value, s.value, value - s.value

    return run


def rsi(period: int):
    def run(rows):
        gain, loss, last = Ema(1 / period), Ema(1 / period), None
        for (x,) in rows:
            if last is not None:
                gain.step(max(x - last, 0.0))
                loss.step(max(last - x, 0.0))
            last = x
            yield ((100.0 if gain.value > 0 else 50.0) if loss.value <= 0 else 100 - 100 / (1 + gain.value / loss.value),)

    return run


def rate_noise(n: int):
    """Average of the absolute changes of a rate, from 0 on, without a seed."""

    def run(rows):
        noise, last = 0.0, None
        for (r,) in rows:
            if last is not None:
                noise += 2 / (n + 1) * (abs(r - last) - noise)
            last = r
            yield (noise,)

    return run


def dmi(n: int):
    def run(rows):
        up, down, true, adx, last = Ema(1 / n), Ema(1 / n), Ema(1 / n), Ema(1 / n), None
        for h, low, c in rows:
            direction = 0.0
            if last is not None:
                u, d = h - last[0], last[1] - low
                up.step(u if u > d and u > 0 else 0.0)
                down.step(d if d > u and d > 0 else 0.0)
                true.step(max(h - low, abs(h - last[2]), abs(low - last[2])))
                p, m = (100 * up.value / true.value, 100 * down.value / true.value) if true.value > 0 else (0.0, 0.0)
                direction = p - m
                adx.step(100 * abs(p - m) / (p + m) if p + m > 0 else 0.0)
            last = (h, low, c)
            yield direction, adx.value

    return run


def irregular_ema(span_ms: float):
    """alpha = 1 - exp(-dt / (span / 2))."""

    def run(rows):
        value, last = None, None
        for t, x in rows:
            value = x if value is None else value + (1 - math.exp(-(t - last) / (span_ms / 2))) * (x - value)
            last = t
            yield (value,)

    return run
