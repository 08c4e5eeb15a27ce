"""Signals: thresholds with memory, extrema, regimes, transitions, alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import by_symbol

STEP_MS = 3_600_000


def rate_bps_per_hour(value: str, change: str, step_ms: int = STEP_MS) -> Column:
    return F.when(F.col(value) != 0, F.col(change) / F.nullif(F.col(value), F.lit(0.0)) / (step_ms / 1000) * 10_000 * 3600).otherwise(F.lit(0.0))


def adaptive_threshold(noise, deadband: float, multiplier: float | None = None, most: float = 0.0, scale: float = 1.0) -> Column:
    """deadband plus noise * multiplier, or plus most / (1 + noise / scale)."""
    return F.lit(deadband) + (F.col(noise) * multiplier if multiplier is not None else most / (1 + F.col(noise) / scale))


def clamped_rate(mode: str, low: float, high: float, inner: float = 0.5):
    """The rate where it counts, else 0 (deadband, hysteresis) or what counted last (hold); comparisons are strict."""

    def run(rows):
        state = 0.0
        for (r,) in rows:
            if mode == "hold":
                state = r if r > high or r < -low else state
            else:
                keeps = mode == "hysteresis" and state != 0 and r * state > 0 and abs(r) >= low * min(1.0, max(0.0, inner))
                bar = high if mode == "hysteresis" and state == 0 else low
                state = r if keeps or abs(r) > bar else 0.0
            yield (state,)

    return run


def accepted_signals(friction: float):
    """Rows (wanted sign, price): a change of sign is asked for once, and taken if the price has left the last accepted one."""

    def run(rows):
        before, accepted, last = 0, 0, None
        for wanted, price in rows:
            asked = wanted != before and wanted != accepted
            taken = asked and (last is None or friction <= 0 or abs(price - last) > last * friction)
            if taken:
                accepted, last = wanted, price
            before = wanted
            yield accepted, bool(taken)

    return run


def extremum(rate: str) -> Column:
    """1 where a falling rate stops falling (valley), -1 where a rising one stops rising (peak)."""
    old = F.lag(rate).over(by_symbol())
    return F.when((old < 0) & (F.col(rate) >= 0), 1).when((old > 0) & (F.col(rate) <= 0), -1).otherwise(0)


def regime(rates: list[str]) -> Column:
    """Sign of the strongest of several rates."""
    top = F.array_max(F.array(*[F.struct(F.abs(r).alias("a"), F.col(r).alias("r")) for r in rates]))
    return F.when(top["r"] > 0, "rising").when(top["r"] < 0, "falling").otherwise("sideways")


def centred_extrema(bars: DataFrame, n: int, step: int) -> DataFrame:
    """Strict local extrema of the full n-bar average, dated half a window back."""
    w = by_symbol().rowsBetween(-(n - 1), 0)
    x = bars.withColumn("m", F.when(F.count("close").over(w) == n, F.avg("close").over(w))).where("m is not null")
    a, b, eps = F.lag("m").over(by_symbol()), F.lead("m").over(by_symbol()), F.greatest(F.col("m") * 1e-12, F.lit(1e-9))
    kind = F.when((F.col("m") > a + eps) & (F.col("m") > b + eps), "peak").when((F.col("m") < a - eps) & (F.col("m") < b - eps), "valley")
    return x.select("symbol", (F.col("open_time") - F.lit(n * step // 2)).alias("event_time"), kind.alias("kind"), F.col("m").alias("price")).where("kind is not null")


def transitions(rows: DataFrame, state: str) -> DataFrame:
    """Rows where the state differs from the one before; the first row counts if it is not 0."""
    old = F.coalesce(F.lag(state).over(by_symbol()), F.lit(0))
    return rows.withColumn("from_state", old).where(F.col(state) != F.col("from_state"))


def mean_interval(changes: DataFrame) -> DataFrame:
    x = changes.withColumn("dt", F.col("open_time") - F.lag("open_time").over(by_symbol()))
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("dt").alias("mean_ms"))


def align(candidates: DataFrame, oracle: DataFrame, window_ms: int, half_life_ms: float) -> DataFrame:
    """One-to-one chronological matches (symbol, candidate_time, oracle_time, credit) of equal states.

    Both sides have symbol, time, state.  The sum of 2 ** (-|lag| / half-life) is largest; then the number of pairs,
    then the smaller sum of lags decides.  Matches don't cross.  A prefix tree over the oracle's places holds the best chain.
    """
    c = candidates.select("symbol", F.struct("time", F.lit(0).alias("side"), "state").alias("x"))
    o = oracle.select("symbol", F.struct("time", F.lit(1).alias("side"), "state").alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = sorted(((d["time"], d["side"], d["state"]) for d in pdf["x"]))
        cand = [(t, s) for t, side, s in x if side == 0]
        orac = [(t, s) for t, side, s in x if side == 1]
        none = (0.0, 0, 0, None)
        tree = [none] * (len(orac) + 1)
        better = lambda a, b: (abs(a[0] - b[0]) > 32 * 2.0**-52 * max(1.0, a[0], b[0])) and a[0] > b[0] or abs(a[0] - b[0]) <= 32 * 2.0**-52 * max(1.0, a[0], b[0]) and (a[1], -a[2]) > (b[1], -b[2])
        low = 0
        for t, s in cand:
            while low < len(orac) and orac[low][0] < t - window_ms:
                low += 1
            found, j = [], low
            while j < len(orac) and orac[j][0] <= t + window_ms:
                if orac[j][1] == s:
                    best, k = none, j
                    while k > 0:
                        best = tree[k] if better(tree[k], best) else best
                        k -= k & -k
                    lag = abs(t - orac[j][0])
                    credit = 2 ** (-lag / half_life_ms)
                    found.append((j, (best[0] + credit, best[1] + 1, best[2] + lag, (best[3], t, orac[j][0], credit))))
                j += 1
            for j, value in found:
                k = j + 1
                while k < len(tree):
                    tree[k] = value if better(value, tree[k]) else tree[k]
                    k += k & -k
        best, k = none, len(orac)
        while k > 0:
            best = tree[k] if better(tree[k], best) else best
            k -= k & -k
        out, chain = [], best[3]
        while chain:
            out.append(chain[1:])
            chain = chain[0]
        res = pd.DataFrame(out[::-1], columns=["candidate_time", "oracle_time", "credit"])
        res.insert(0, "symbol", pdf["symbol"].iloc[0])
        return res

    return c.unionByName(o).groupBy("symbol").applyInPandas(run, "symbol string, candidate_time long, oracle_time long, credit double")


def match_scores(candidates: DataFrame, oracle: DataFrame, matches: DataFrame) -> DataFrame:
    """precision, recall, f1, cleanliness by symbol; nothing on both sides is a perfect match."""
    x = candidates.groupBy("symbol").agg(F.count("*").alias("nc")).join(oracle.groupBy("symbol").agg(F.count("*").alias("no")), "symbol", "full")
    x = x.join(matches.groupBy("symbol").agg(F.count("*").alias("nm"), F.sum("credit").alias("credit")), "symbol", "left").fillna(0)
    empty = F.when((F.col("nc") == 0) & (F.col("no") == 0), 1.0).otherwise(0.0)
    p, r = F.when(F.col("nc") > 0, F.try_divide("credit", "nc")).otherwise(empty), F.when(F.col("no") > 0, F.try_divide("credit", "no")).otherwise(empty)
    x = x.withColumns({"precision": p, "recall": r})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return x.withColumns({"f1": f1, "cleanliness": F.coalesce(F.try_divide("nm", "nc"), F.lit(1.0))})
