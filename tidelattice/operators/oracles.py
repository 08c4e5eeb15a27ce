"""Hindsight oracles (dynamic programs over a run of prices) and policies on an exposure grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import scan

EPS = 2.0**-52


def perfect_margin(start: float, leverage: float, friction: float):
    """Kernel over prices: best additive and compounded equity gain of flat, long and short so far; no cost to end."""
    size = start * leverage
    open_ = size * friction

    def run(rows):
        best, grown, last = None, None, None
        for (p,) in rows:
            if best is None:
                best = [(0.0, 0), (-open_, 1), (-open_, 1)]
                way = 1 - leverage * friction
                grown = [1.0, way if way > 0 else -np.inf, way if way > 0 else -np.inf]
            else:
                move = p / last - 1
                f, lo, sh = best[0], (best[1][0] + size * move, best[1][1]), (best[2][0] - size * move, best[2][1])
                cost = lambda x, ways: (x[0] - open_ * ways, x[1] + 1)
                best = [_most(f, cost(lo, 1), cost(sh, 1)), _most(lo, cost(f, 1), cost(sh, 2)), _most(sh, cost(f, 1), cost(lo, 2))]
                step = lambda x, k: x * k if x > 0 and k > 0 else -np.inf
                one, two = 1 - leverage * friction, 1 - 2 * leverage * friction
                gf, gl, gs = grown[0], step(grown[1], 1 + leverage * move), step(grown[2], 1 - leverage * move)
                grown = [max(gf, step(gl, one), step(gs, one)), max(gl, step(gf, one), step(gs, two)), max(gs, step(gf, one), step(gl, two))]
            last = p
            top = _most(*best)
            yield best[0][0], best[1][0], best[2][0], top[0], top[1], start * (max(grown) - 1)

    return run


def margin_parents(start: float, leverage: float, friction: float):
    """Kernel over prices: for each bar from which state the best way to flat, long and short came (two bits each), and the best state so far."""
    size = start * leverage
    open_ = size * friction

    def run(rows):
        best, last = None, None
        for (p,) in rows:
            if best is None:
                best, came = [(0.0, 0, 0), (-open_, 1, 1), (-open_, 1, 2)], (0, 0, 0)
            else:
                move = size * (p / last - 1 if last > 0 else 0.0)
                now = [(best[0][0], best[0][1], 0), (best[1][0] + move, best[1][1], 1), (best[2][0] - move, best[2][1], 2)]
                # to go over from long to short, or back, takes two orders
                cost = lambda k, to: now[k] if k == to else (now[k][0] - open_ * (2 if k and to else 1), now[k][1] + 1, k)  # noqa: B023, E731
                best = [_most(cost(to, to), *[cost(k, to) for k in range(3) if k != to]) for to in range(3)]
                came = tuple(x[2] for x in best)
            last = p
            top = _most(*[(v, n, k) for k, (v, n, _) in enumerate(best)])
            yield came[0] | came[1] << 2 | came[2] << 4, top[2]

    return run


def traced(rows):
    """Kernel over (parents, best) from the last bar back to the first: the state at each bar on the best way."""
    state = None
    for came, best in rows:
        state = best if state is None else state
        yield (state,)
        state = came >> 2 * state & 3


def margin_path(bars: DataFrame, start: float, leverage: float, friction: float) -> DataFrame:
    """(symbol, open_time, from_state, state): where the best way in hindsight goes to another state; 0 flat, 1 long, 2 short, flat before the first bar.

    The dynamic program runs forwards, its parents are followed backwards: two passes over sorted rows that hold a few numbers of state.
    """
    forth = scan(bars, ["close"], margin_parents(start, leverage, friction), "parents int, best int")
    back = scan(forth.withColumn("open_time", -F.col("open_time")), ["parents", "best"], traced, "state int")
    out = back.withColumn("open_time", -F.col("open_time"))
    out = out.withColumn("from_state", F.coalesce(F.lag("state").over(Window.partitionBy("symbol").orderBy("open_time")), F.lit(0)))
    return out.where("state <> from_state").select("symbol", "open_time", "from_state", "state")


def _most(*options):
    """The largest value; of equals (16 eps, relative) the one with fewer transitions."""
    best = options[0]
    for x in options[1:]:
        slack = 16 * EPS * max(1.0, abs(x[0]), abs(best[0]))
        if x[0] > best[0] + slack or abs(x[0] - best[0]) <= slack and x[1] < best[1]:
            best = x
    return best


def rebalance(x: np.ndarray, a: np.ndarray, f: float) -> np.ndarray:
    """Log of the equity left after moving from x to a (broadcast); -inf where it can't be done."""
    with np.errstate(divide="ignore", invalid="ignore"):
        buy, sell = np.log(1 - f + f * x) - np.log(1 - f + f * a), np.log(1 - f * x) - np.log(1 - f * a)
        out = np.where(a > x, buy, sell)
    return np.where(np.abs(a - x) <= EPS, 0.0, np.where(np.isfinite(out), out, -np.inf))


def hold(x: np.ndarray, p: float, q: float, f: float, lend: float = 0.0, borrow: float = 0.0, asset_borrow: float = 0.0, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """One step at exposures x from price p to q: log growth and the exposure drifted to; ruin is -inf, too much leverage is closed."""
    cash = 1 - x
    cash = cash * np.where(cash >= 0, 1 + lend, 1 + borrow)
    value = np.where(x >= 0, x, x * (1 + asset_borrow)) * (q / p)
    worth = np.where(value >= 0, value * (1 - f), value / (1 - f))
    equity = cash + worth
    with np.errstate(divide="ignore", invalid="ignore"):
        closed = np.abs(worth / equity) > most
        marked = np.where(closed, equity, cash + value)
        growth = np.where(equity > 0, np.log(np.maximum(marked, EPS)), -np.inf)
        drifted = np.where(closed | (equity <= 0), 0.0, value / np.where(marked == 0, 1, marked))
    return growth, drifted


def continuation(values: np.ndarray, grid: np.ndarray, at: np.ndarray, f: float) -> np.ndarray:
    """max over targets a of log R(x -> a) + values(a), for all x at once.

    A sale's cost splits into a term of x and one of a, so the best target below x is a
    running maximum; the same from the other side for purchases.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        sell = np.maximum.accumulate(np.where(1 - f * grid > 0, values - np.log(np.maximum(1 - f * grid, EPS)), -np.inf))
        buy = np.maximum.accumulate(np.where(1 - f + f * grid > 0, values - np.log(np.maximum(1 - f + f * grid, EPS)), -np.inf)[::-1])[::-1]
        below = np.searchsorted(grid, at, "right") - 1
        above = np.searchsorted(grid, at, "left")
        down = np.where(below >= 0, sell[np.maximum(below, 0)] + np.log(np.maximum(1 - f * at, EPS)), -np.inf)
        up = np.where(above < len(grid), buy[np.minimum(above, len(grid) - 1)] + np.log(np.maximum(1 - f + f * at, EPS)), -np.inf)
    return np.maximum(down, up)


def exposure_values(prices: np.ndarray, points: int, most: float, friction: float, holding: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(grid, F): F[t, a] is the log growth from t to the end when a is held for `holding` steps and the best follows."""
    grid = np.linspace(-most, most, points)
    n = len(prices)
    out = np.zeros((n, points))
    for t in range(n - 2, -1, -1):
        growth, x = np.zeros(points), grid.copy()
        end = min(n - 1, t + holding)
        for k in range(t, end):
            g, x = hold(x, prices[k], prices[k + 1], friction, most=2 * most + 1)
            growth = growth + g
        out[t] = growth + (continuation(out[end], grid, np.clip(x, -most, most), friction) if end < n - 1 else 0.0)
    return grid, out


def preference(values: np.ndarray, grid: np.ndarray, temperature: float) -> dict[str, float]:
    """Softmax statistics of a row of values: mean, second moment, mode, entropy, opportunity."""
    good = np.isfinite(values)
    top = values[good].max() if good.any() else 0.0
    score = np.where(good, np.maximum(-50.0, (np.where(good, values, 0.0) - top) / temperature), -50.0)
    w = np.exp(score)
    z = w.sum()
    opportunity = float(top - values[good].min()) if good.any() else 0.0
    return {
        "mean": float((w * grid).sum() / z),
        "second": float((w * grid * grid).sum() / z),
        "mode": float(grid[int(np.argmax(score))]),
        "entropy": float(np.log(z) - (w * score).sum() / z),
        "opportunity": max(opportunity, 50 * temperature) if not good.all() else opportunity,
    }


def transition_policy(values: np.ndarray, grid: np.ndarray, friction: float, temperature: float) -> np.ndarray:
    """p(a | x): rows are states."""
    score = (values[None, :] + rebalance(grid[:, None], grid[None, :], friction)) / temperature
    score = np.where(np.isfinite(score), score, -np.inf)
    score = np.maximum(score - score.max(axis=1, keepdims=True), -50.0)
    w = np.exp(score)
    return w / w.sum(axis=1, keepdims=True)


def average_regret(values: np.ndarray, grid: np.ndarray, friction: float) -> float:
    x = values[None, :] + rebalance(grid[:, None], grid[None, :], friction)
    x = np.where(np.isfinite(x), x, np.nan)
    return float(np.nanmean(np.nanmax(x, axis=1) - np.nanmean(x, axis=1)))


def strategy_distribution(slope: float, curve: float, grid: np.ndarray, mix: float = 0.0, centre: float = 0.0, sigma: float = 1.0) -> np.ndarray:
    """exp(slope a + curve a^2) on the grid, mixed with a normal around the exposure held."""
    own = slope * grid + curve * grid * grid
    own = own - own.max() - np.log(np.exp(own - own.max()).sum())
    if mix <= 0:
        return np.exp(own)
    bell = -0.5 * ((grid - centre) / sigma) ** 2
    bell = bell - bell.max() - np.log(np.exp(bell - bell.max()).sum())
    return np.exp(np.logaddexp(np.log1p(-mix) + own if mix < 1 else -np.inf, np.log(mix) + bell))


def four_segment(grid: np.ndarray, x: float, start: tuple, slopes: list[tuple], knots: tuple, kappa: float) -> np.ndarray:
    """Probabilities of a log density of four slopes that meet softly at two knots and at the exposure held."""
    low, high = grid[0], grid[-1]
    xi = float(np.clip((2 * x - low - high) / (high - low), -1, 1))
    score = (start[0] + start[1] * xi) * (grid - low)
    for (b0, b1), k in zip(slopes, (knots[0], x, knots[1]), strict=True):
        score = score + (b0 + b1 * xi) * np.logaddexp(0.0, kappa * (grid - k)) / kappa
    w = np.exp(score - score.max())
    return w / w.sum()


def fit_quadratic(grid: np.ndarray, rows: np.ndarray, iterations: int = 40, tolerance: float = 1e-10) -> tuple[float, float]:
    """Shared (slope, curve <= 0) with the least mean cross-entropy to rows of probabilities, by damped Newton steps."""
    z = (grid - (grid[0] + grid[-1]) / 2) / ((grid[-1] - grid[0]) / 2)
    m1, m2 = float((rows @ z).mean()), float((rows @ (z * z)).mean())

    def state(b):
        s = b[0] * z + b[1] * z * z
        top = s.max()
        w = np.exp(s - top)
        p = w / w.sum()
        e1, e2, e3, e4 = (float((p * z**k).sum()) for k in (1, 2, 3, 4))
        loss = top + np.log(w.sum()) - b[0] * m1 - b[1] * m2
        return loss, np.array([e1 - m1, e2 - m2]), np.array([[e2 - e1 * e1, e3 - e1 * e2], [e3 - e1 * e2, e4 - e2 * e2]])

    b = np.zeros(2)
    loss, g, h = state(b)
    for _ in range(iterations):
        if np.abs(g).max() < tolerance:
            break
        step, size = np.linalg.solve(h + 1e-10 * np.eye(2), g), 1.0
        while size >= 1 / 4096:
            t = b - size * step
            t[1] = min(t[1], 0.0)
            now = state(t)
            if now[0] < loss:
                break
            size /= 2
        else:
            break
        b, (loss, g, h) = t, now
    return float(b[0]), float(b[1])


def bfgs(f, x: np.ndarray, iterations: int = 200, tolerance: float = 1e-8) -> np.ndarray:
    """Minimiser of f(x) -> (value, gradient) with an inverse Hessian built from steps; Armijo line search."""
    x = np.asarray(x, float)
    value, g = f(x)
    inverse = np.eye(len(x))
    for _ in range(iterations):
        if np.abs(g).max() < tolerance:
            break
        d = -inverse @ g
        if d @ g >= 0:
            inverse, d = np.eye(len(x)), -g
        d = d * min(1.0, 4 / max(np.abs(d).max(), EPS))
        size = 1.0
        for _ in range(24):
            v, k = f(x + size * d)
            if v <= value + 1e-4 * size * (d @ g):
                break
            size /= 2
        else:
            break
        s, y = size * d, k - g
        x, value, g = x + s, v, k
        if s @ y > EPS:
            r = 1 / (s @ y)
            a = np.eye(len(x)) - r * np.outer(s, y)
            inverse = a @ inverse @ a.T + r * np.outer(s, s)
    return x


def distillation(weights, cross, oracle_entropy) -> dict[str, float]:
    w, c, h = (np.asarray(x, float) for x in (weights, cross, oracle_entropy))
    ce, own = float((w * c).sum() / w.sum()), float((w * h).sum() / w.sum())
    kl = max(0.0, ce - own)
    return {"cross_entropy": ce, "kl": kl, "score": float(np.exp(-kl))}


def exposure_return(friction: float):
    """Kernel over (target exposure, price): log equity and drawdown fraction when every bar rebalances, then holds."""

    def run(rows):
        log, peak, x, last = 0.0, 0.0, 0.0, None
        for a, p in rows:
            if last is not None:
                g, y = hold(np.array([x]), last, p, friction)
                log, x = log + float(g[0]), float(y[0])
            log += float(rebalance(np.array([x]), np.array([a]), friction)[0])
            x, last, peak = a, p, max(peak, log)
            yield log, 1 - float(np.exp(log - peak))

    return run
