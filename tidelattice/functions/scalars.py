"""Scalar functions over columns; all stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000
DAY = 24 * HOUR
UNIT_MS = {"s": 1000, "m": 60_000, "h": HOUR, "d": DAY, "w": 7 * DAY}
#: Quote assets in the order in which a symbol's suffix is tried.
QUOTES = ["USDT", "USDC", "FDUSD", "BUSD", "TUSD", "USD", "BTC", "ETH", "BNB", "EUR", "TRY"]


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x, low, high) -> Column:
    """x within [low, high]; NaN and null give low."""
    x = col(x)
    return F.when(x.isNull() | F.isnan(x), F.lit(low).cast("double")).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def clamp01(x) -> Column:
    return clamp(x, 0.0, 1.0)


def align_down(ms, step: int) -> Column:
    return F.floor(col(ms) / F.lit(step)) * F.lit(step)


def align_up(ms, step: int) -> Column:
    return F.ceil(col(ms) / F.lit(step)) * F.lit(step)


def day_start(ms) -> Column:
    return align_down(ms, DAY)


def interval_ms(text: str) -> int:
    m = re.fullmatch(r"(\d+)([smhdw])", text)
    if not m:
        raise ValueError(f"no interval: {text}")
    return int(m[1]) * UNIT_MS[m[2]]


def interval_ms_column(text) -> Column:
    unit = F.regexp_extract(col(text), r"^\d+([smhdw])$", 1)
    number = F.regexp_extract(col(text), r"^(\d+)[smhdw]$", 1)
    factor = F.lit(None).cast("long")
    for u, ms in UNIT_MS.items():
        factor = F.when(unit == u, F.lit(ms)).otherwise(factor)
    return F.when(number != "", number.try_cast("long")) * factor


def format_interval(ms) -> Column:
    ms = col(ms)
    out = F.concat((ms / 1000).cast("long").cast("string"), F.lit("s"))
    for u in ("m", "h", "d"):
        out = F.when(ms % UNIT_MS[u] == 0, F.concat((ms / UNIT_MS[u]).cast("long").cast("string"), F.lit(u))).otherwise(out)
    return out


def compound_per_bar(hourly, step_ms) -> Column:
    return F.expm1(F.log1p(col(hourly)) * col(step_ms) / HOUR)


def log_add_exp(a, b) -> Column:
    a, b = col(a), col(b)
    top = F.greatest(a, b)
    return top + F.log1p(F.exp(F.least(a, b) - top))


def softplus(x) -> Column:
    x = col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x) -> Column:
    x = col(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p) -> Column:
    p = col(p)
    return F.ln(p) - F.log1p(-p)


def gaussian(x, sigma) -> Column:
    x, sigma = col(x), col(sigma)
    return F.when(sigma > 0, F.exp(-0.5 * (x / sigma) * (x / sigma))).otherwise(F.lit(1.0))


def floor_to_step(x, step) -> Column:
    return F.floor(col(x) / step + 1e-9) * step


def path_part(text, keep_dot: bool = True) -> Column:
    return F.regexp_replace(col(text), r"[^A-Za-z0-9._-]" if keep_dot else r"[^A-Za-z0-9_-]", "_")


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def searchable(*texts) -> Column:
    return F.lower(F.concat_ws(" ", *[col(x) for x in texts]))


def quote_asset(symbol) -> Column:
    out = F.lit("USDT")
    for q in reversed(QUOTES):
        out = F.when(F.endswith(col(symbol), F.lit(q)), F.lit(q)).otherwise(out)
    return out


def base_asset(symbol) -> Column:
    s, q = col(symbol), quote_asset(symbol)
    return F.when(F.endswith(s, q) & (F.length(s) > F.length(q)), F.substring(s, F.lit(1), F.length(s) - F.length(q))).otherwise(s)


def selection_score(quote_volume, trades, volume, move) -> Column:
    return 3 * F.log10(col(quote_volume) + 1) + 2 * F.log10(col(trades) + 1) + F.log10(col(volume) + 1) + 0.25 * F.abs(col(move))


def slipped(price, side, bps) -> Column:
    """Market price after slippage; never below 1e-6."""
    sign = F.when(col(side) == "buy", 1).otherwise(-1)
    return F.greatest(col(price) * (1 + sign * F.lit(bps) / 10_000), F.lit(1e-6))


def beyond_friction(price, last, friction) -> Column:
    last, friction = col(last), F.lit(friction)
    return last.isNull() | (friction <= 0) | (F.abs(col(price) - last) > last * friction)


def rebalance_factor(exposure, target, friction) -> Column:
    """Equity left after moving from one exposure to another at proportional costs."""
    x, a, f = col(exposure), col(target), F.lit(friction)
    buy, sell = 1 - f + f * a, 1 - f * a
    return F.when(F.abs(a - x) <= 2.0**-52, F.lit(1.0)).when(a > x, F.when(buy > 0, (1 - f + f * x) / F.nullif(buy, F.lit(0.0)))).otherwise(F.when(sell > 0, (1 - f * x) / F.nullif(sell, F.lit(0.0))))


def order_capacity(available, leverage, friction) -> Column:
    return col(available) / (1 / F.lit(leverage) + F.lit(friction))


def order_valid(quantity, price, min_quantity, max_quantity, min_notional) -> Column:
    q = col(quantity)
    return (q > 0) & (q >= min_quantity) & (q <= max_quantity) & (q * col(price) >= min_notional)


def limit_reached(kind, side, price, trigger) -> Column:
    """Whether a resting order fills at a tick: limits inwards, stops outwards."""
    buy = col(side) == "buy"
    down, up = col(price) <= col(trigger), col(price) >= col(trigger)
    return F.when(col(kind) == "limit", F.when(buy, down).otherwise(up)).otherwise(F.when(buy, up).otherwise(down))


def grid_weights(n: int, ratio: float | None = None) -> Column:
    """n weights that sum to one: falling linearly, or geometric."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.lit(n) - i).cast("double") if ratio is None else F.pow(F.lit(ratio), i))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raw, lambda x: x / total)


def grid_price(anchor, step, i, side: str) -> Column:
    return col(anchor) * (1 + (-1 if side == "buy" else 1) * F.lit(step) * col(i))


def lot_status(opened, remaining) -> Column:
    opened, remaining = col(opened), col(remaining)
    return F.when(opened <= 0, "pending").when(remaining <= 0, "closed").when(remaining < opened, "partially-closed").otherwise("open")


def truncated_exponential_log_partition(slope, low: float, high: float, points: int) -> Column:
    """ln of the sum of exp(slope * a) over a uniform grid, in closed form."""
    b = col(slope)
    step = F.abs(b) * ((high - low) / (points - 1))
    top = F.greatest(b * low, b * high)
    return F.when(b == 0, F.lit(points).cast("double") * 0 + F.ln(F.lit(float(points)))).otherwise(top + F.ln(-F.expm1(-step * points)) - F.ln(-F.expm1(-step)))


def gaussian_oracle_information(rho, points: int) -> Column:
    r = clamp(col(rho) * col(rho), 0.0, 1 - 2.0**-52)
    return clamp01(-0.5 * F.ln(1 - r) / F.ln(F.lit(float(points))))


def gaussian_state_information(total, conditional, points: int) -> Column:
    t, c = col(total), col(conditional)
    return F.when((t > 0) & (c > 0), clamp01(0.5 * F.ln(t / c) / F.ln(F.lit(float(points))))).otherwise(F.lit(0.0))


def ratio_or(numerator, denominator, empty: float) -> Column:
    return F.when(col(denominator) > 0, F.try_divide(col(numerator), col(denominator))).otherwise(F.lit(empty))


def signal_score(f1, agreement, cleanliness) -> Column:
    return 0.2 * col(f1) + 0.6 * col(agreement) + 0.2 * col(cleanliness)


def marked_exposure(fraction, move) -> Column:
    """Signed fraction marked to a price move (price / anchor); bankrupt or full positions are whole ones."""
    phi, m = F.abs(col(fraction)), col(move)
    long_, short = 1 - phi + phi * m, 1 + phi - phi * m
    value = F.when(col(fraction) > 0, F.when(long_ > 2.0**-52, phi * m / F.nullif(long_, F.lit(0.0))).otherwise(F.lit(1.0)))
    value = value.when(col(fraction) < 0, F.when(short > 2.0**-52, -phi * m / F.nullif(short, F.lit(0.0))).otherwise(F.lit(-1.0))).otherwise(F.lit(0.0))
    return F.when(phi >= 1, F.signum(col(fraction))).otherwise(value)


def agreement_credit(exposure, oracle_sign) -> Column:
    e, o = col(exposure), col(oracle_sign)
    return F.when(o > 0, clamp01(e)).when(o < 0, clamp01(-e)).otherwise(1 - clamp01(F.abs(e)))


def sized(fraction, rate, sigma) -> Column:
    return F.when(col(sigma).isNull(), F.lit(fraction)).otherwise(F.lit(fraction) * gaussian(rate, sigma))
