"""The registered queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fx
from ..operators import bars, indicators as ind, joins, ledger, measures, oracles, portfolio, ranking, signals

H = fx.HOUR
#: Amounts end in a five often; this much beside it, both engines round them alike.
OFF_TIES = 0.00001331971
QUERIES: dict = {}
SQL: dict[str, str] = {}

CTE = """WITH RECURSIVE ticks AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS event_time, value AS price, CAST(coalesce(json_extract_string(props, '$.k'), '0') AS DOUBLE) AS quantity, event_id AS seq FROM events WHERE value > 0),
candles AS (SELECT symbol, event_time // 3600000 * 3600000 AS open_time, arg_min(price, event_time) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_time) AS close, sum(quantity) AS volume FROM ticks GROUP BY ALL),
bars AS (SELECT *, open_time + 3599999 AS close_time, row_number() OVER w AS rn, lag(open_time) OVER w AS prev_time, lag(close) OVER w AS prev FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
segs AS (SELECT *, CAST(sum(CASE WHEN open_time - prev_time = 3600000 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS BIGINT) AS segment FROM bars)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.build(bars.ticks(table(spark, sf_dir, "events")), H)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many places, whole numbers to long, so that two engines agree."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append(F.round(c + 0.0, digits).alias(name) if kind in ("double", "float") else c.cast("long").alias(name) if kind in ("int", "bigint", "smallint") else c)
    return df.select(*out)


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql if sql.lstrip().startswith("WITH ") else CTE + sql if sql.lstrip()[0] != "," else CTE.rstrip() + sql
        return f

    return add


def r(*names: str) -> str:
    return ", ".join(f"round({n} + 0.0, 6) AS {n}" for n in names)


OHLCV = r("open", "high", "low", "close", "volume")


# --- bars ------------------------------------------------------------------------------


@query(f"SELECT symbol, event_time, {r('price', 'quantity')}, seq FROM ticks")
def ticks(spark, sf):
    return bars.ticks(table(spark, sf, "events"))


@query(f"SELECT symbol, CAST(open_time AS BIGINT) AS open_time, {OHLCV}, CAST(close_time AS BIGINT) AS close_time FROM bars")
def bars_hourly(spark, sf):
    return hourly(spark, sf)


@query("""WITH x AS (SELECT l_suppkey % 8 AS symbol, epoch_ms(l_shipdate) AS open_time, l_extendedprice / l_quantity AS p, l_quantity AS q, l_orderkey * 10 + l_linenumber AS s FROM lineitem)
SELECT CAST(symbol AS BIGINT) AS symbol, open_time, round(arg_min(p, s), 6) AS open, round(max(p), 6) AS high, round(min(p), 6) AS low, round(arg_max(p, s), 6) AS close, round(sum(q), 6) AS volume, open_time + 86399999 AS close_time FROM x GROUP BY symbol, open_time""")
def bars_daily_lineitem(spark, sf):
    return bars.daily(table(spark, sf, "lineitem"))


_MERGE = "arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume"


@query(f", x AS (SELECT symbol, open_time // 14400000 * 14400000 AS b, {_MERGE}, count(*) AS n, min(open_time) AS f FROM bars GROUP BY ALL) SELECT symbol, CAST(b AS BIGINT) AS open_time, {OHLCV}, CAST(b + 14399999 AS BIGINT) AS close_time FROM x WHERE n = 4 AND f = b")
def resample_strict(spark, sf):
    return bars.resample_strict(hourly(spark, sf), H, 4 * H)


@query(f", x AS (SELECT symbol, open_time // 21600000 * 21600000 AS b, {_MERGE}, max(close_time) AS l FROM bars GROUP BY ALL) SELECT symbol, CAST(b AS BIGINT) AS open_time, {OHLCV}, CAST(greatest(b + 21599999, l) AS BIGINT) AS close_time FROM x")
def resample_lenient(spark, sf):
    return bars.resample_lenient(hourly(spark, sf), 6 * H)


@query("SELECT symbol, open_time, segment, round(close, 6) AS close FROM segs")
def continuous_segments(spark, sf):
    return bars.segments(hourly(spark, sf), H).select("symbol", "open_time", "segment", "close")


@query(f", x AS (SELECT symbol, segment, open_time // 21600000 AS b, {_MERGE}, min(open_time) AS ot, max(close_time) AS close_time FROM segs GROUP BY ALL) SELECT symbol, segment, {OHLCV}, ot AS open_time, close_time FROM x")
def render_downsample(spark, sf):
    return bars.render(hourly(spark, sf), H, 6 * H)


@query(f", x AS (SELECT symbol, (rn - 1) // 7 AS bucket, {_MERGE}, min(open_time) AS ot, max(close_time) AS close_time FROM bars GROUP BY ALL) SELECT symbol, CAST(bucket AS BIGINT) AS bucket, {OHLCV}, ot AS open_time, close_time FROM x")
def merge_every_n(spark, sf):
    return bars.every_n(hourly(spark, sf), 7)


@query(f"SELECT symbol, CAST(open_time AS BIGINT) AS open_time, {OHLCV}, close_time FROM segs QUALIFY segment = max(segment) OVER (PARTITION BY symbol)")
def continuous_suffix(spark, sf):
    return bars.continuous_suffix(hourly(spark, sf), H)


@query("""SELECT symbol, prev_time + 3600000 AS start, open_time - 1 AS "end", CAST((open_time - prev_time) // 3600000 - 1 AS BIGINT) AS n FROM bars WHERE open_time - prev_time > 3600000""")
def coverage_missing_ranges(spark, sf):
    return bars.missing_ranges(hourly(spark, sf), H)


@query(""", x AS (SELECT symbol, open_time // 86400000 * 86400000 AS day, count(*) AS n, min(open_time) AS f, max(open_time) AS l FROM bars GROUP BY ALL) SELECT symbol, CAST(day AS BIGINT) AS day, n, n = 24 AND f = day AND l = day + 82800000 AS complete FROM x""")
def day_completeness(spark, sf):
    return bars.day_completeness(hourly(spark, sf), H)


@query(""", x AS (SELECT symbol, open_time // 7200000 * 7200000 AS s, (open_time + 3600000 + 7199999) // 7200000 * 7200000 AS e FROM bars), y AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY symbol ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 7200000 THEN 0 ELSE 1 END AS new FROM x), z AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY s, e) AS run FROM y) SELECT symbol, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end" FROM z GROUP BY symbol, run""")
def merge_time_ranges(spark, sf):
    x = hourly(spark, sf).select("symbol", F.col("open_time").alias("start"), (F.col("open_time") + H).alias("end"))
    return bars.merge_ranges(x, 2 * H)


@query("SELECT symbol, CAST(open_time AS BIGINT) AS open_time, round(CASE WHEN open_time % 7200000 = 0 THEN close * 2 ELSE close END, 6) AS close, CASE WHEN open_time % 7200000 = 0 THEN 2 ELSE 1 END AS seq FROM bars".replace("CASE WHEN open_time % 7200000 = 0 THEN 2 ELSE 1 END", "CAST(CASE WHEN open_time % 7200000 = 0 THEN 2 ELSE 1 END AS BIGINT)"))
def shard_upsert(spark, sf):
    x = hourly(spark, sf).select("symbol", "open_time", "close")
    new = x.where(F.col("open_time") % (2 * H) == 0).withColumn("close", F.col("close") * 2)
    return bars.upsert(x.withColumn("seq", F.lit(1)), new.withColumn("seq", F.lit(2)), ["symbol", "open_time"], "seq")


@query("SELECT symbol, CAST(open_time AS BIGINT) AS open_time, round((open - (open + close) / 2) / ((open + close) / 2), 6) + 0.0 AS open, round((high - (open + close) / 2) / ((open + close) / 2), 6) + 0.0 AS high, round((low - (open + close) / 2) / ((open + close) / 2), 6) + 0.0 AS low, round((close - (open + close) / 2) / ((open + close) / 2), 6) + 0.0 AS close, round(volume, 6) AS volume FROM bars")
def body_midpoint_returns(spark, sf):
    return bars.body_midpoint(bars.normalise(hourly(spark, sf)))


@query("SELECT symbol, CAST(open_time AS BIGINT) AS open_time, CAST(place AS BIGINT) AS place, CAST(open_time + floor(3599999 * [0.0, 0.33, 0.66, 1.0][place + 1]) AS BIGINT) AS event_time, round([open, high, low, close][place + 1], 6) AS price, round(volume / 4, 6) AS quantity FROM bars, (SELECT unnest([0, 1, 2, 3]) AS place)")
def intrabar_ticks(spark, sf):
    return bars.intrabar(hourly(spark, sf))


@query(", x AS (SELECT symbol, open_time - prev_time AS s, row_number() OVER (PARTITION BY symbol ORDER BY open_time - prev_time, open_time) AS k, count(*) OVER (PARTITION BY symbol) AS m FROM bars WHERE rn BETWEEN 2 AND 33) SELECT symbol, s AS interval_ms FROM x WHERE k = m // 2 + 1")
def infer_interval(spark, sf):
    return bars.infer_interval(hourly(spark, sf))


@query(", x AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, CAST(open_time AS BIGINT) AS open_time, round(close, 6) AS close FROM x WHERE n <= 50 OR rn - 1 IN (SELECT CAST(floor(k * (n - 1) / 49.0 + 0.5) AS BIGINT) FROM (SELECT unnest(range(50)) AS k))")
def sample_even(spark, sf):
    return bars.sample_even(hourly(spark, sf), 50).select("symbol", "open_time", "close")


@query("SELECT symbol, CAST(open_time AS BIGINT) AS open_time, CAST(least((rn - 1) // greatest(count(*) OVER (PARTITION BY symbol) // 5, 1), 4) AS BIGINT) AS fold FROM bars")
def contiguous_folds(spark, sf):
    return bars.folds(hourly(spark, sf), 5).select("symbol", "open_time", "fold")


# --- joins and measures ----------------------------------------------------------------

_LR = ", lr AS (SELECT symbol, open_time, rn, ln(close / prev) AS r FROM bars WHERE prev IS NOT NULL)"


@query(_LR + " SELECT symbol, open_time, round(r, 6) + 0.0 AS r FROM lr")
def log_returns(spark, sf):
    return joins.log_returns(hourly(spark, sf))


@query(_LR + " SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(corr(a.r, b.r), 6) AS correlation FROM lr a JOIN lr b ON a.open_time = b.open_time AND a.symbol < b.symbol GROUP BY ALL")
def pair_correlation(spark, sf):
    return joins.correlation(joins.pair_sums(joins.log_returns(hourly(spark, sf)))).select("a", "b", "n", "correlation")


@query("SELECT CAST(open_time AS BIGINT) AS open_time FROM bars GROUP BY open_time HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)")
def common_times(spark, sf):
    return joins.common_times(hourly(spark, sf))


_SMA9 = ", m AS (SELECT symbol, open_time, CASE WHEN count(*) OVER w = 9 THEN avg(close) OVER w END AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)), n AS (SELECT *, lag(m) OVER w AS a, lead(m) OVER w AS b FROM m WHERE m IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY open_time)), ex AS (SELECT symbol, open_time - 16200000 AS event_time, CASE WHEN m > a + greatest(m * 1e-12, 1e-9) AND m > b + greatest(m * 1e-12, 1e-9) THEN 'peak' WHEN m < a - greatest(m * 1e-12, 1e-9) AND m < b - greatest(m * 1e-12, 1e-9) THEN 'valley' END AS kind, m AS price FROM n)"


@query(_SMA9 + " SELECT symbol, event_time, kind, round(price, 6) AS price FROM ex WHERE kind IS NOT NULL")
def centred_extrema(spark, sf):
    return signals.centred_extrema(hourly(spark, sf), 9, H)


@query(_SMA9 + ", v AS (SELECT * FROM ex WHERE kind IS NOT NULL), k AS (SELECT t.symbol, t.seq AS id, t.event_time, arg_min(v.event_time, (abs(v.event_time - t.event_time), v.event_time)) AS near_time FROM ticks t JOIN v ON v.symbol = t.symbol GROUP BY ALL) SELECT k.symbol, k.id, k.event_time, k.near_time, round(v.price, 6) AS near_price FROM k JOIN v ON v.symbol = k.symbol AND v.event_time = k.near_time")
def nearest_extremum(spark, sf):
    x = bars.ticks(table(spark, sf, "events")).select("symbol", "event_time", F.col("seq").alias("id"))
    return joins.nearest(x, signals.centred_extrema(hourly(spark, sf), 9, H))


@query(", d AS (SELECT symbol, min(open_time) AS a, max(open_time) AS b FROM bars WHERE (open_time // 86400000) % 2 = 0 GROUP BY symbol) SELECT symbol, CAST(open_time AS BIGINT) AS open_time, round(CASE WHEN open_time BETWEEN a AND b THEN -close ELSE close END, 6) AS close FROM bars JOIN d USING (symbol) WHERE open_time NOT BETWEEN a AND b OR (open_time // 86400000) % 2 = 0")
def detail_replacement(spark, sf):
    x = hourly(spark, sf).select("symbol", "open_time", "close")
    return joins.detail_merge(x, x.where(F.floor(F.col("open_time") / fx.DAY) % 2 == 0).withColumn("close", -F.col("close")))


@query(", x AS (SELECT symbol, count(*) AS n, avg(close / prev - 1) AS m, stddev_samp(close / prev - 1) AS sd FROM bars WHERE prev IS NOT NULL GROUP BY symbol), y AS (SELECT symbol, (max(open_time) - min(open_time)) / 31536000000.0 AS years FROM bars GROUP BY symbol) SELECT symbol, n, round(m / sd * sqrt(n / years), 6) AS sharpe, round(sd * sqrt(n / years) * 100, 6) AS volatility_pct FROM x JOIN y USING (symbol)")
def sharpe_ratio(spark, sf):
    return measures.sharpe(hourly(spark, sf))


@query(", p AS (SELECT symbol, max((peak - close) / peak * 100) AS dd FROM (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY open_time) AS peak FROM bars) GROUP BY symbol), e AS (SELECT symbol, (arg_max(close, open_time) / arg_min(close, open_time) - 1) * 100 AS ret FROM bars GROUP BY symbol) SELECT symbol, round(ret, 6) AS return_pct, round(dd, 6) AS max_drawdown_pct, round(ret / dd, 6) AS risk_adjusted FROM p JOIN e USING (symbol)")
def risk_adjusted_return(spark, sf):
    return measures.risk_adjusted(hourly(spark, sf))


@query("SELECT symbol, round(sum(price * quantity) / sum(quantity), 6) AS vwap, round(quantile_cont(price, 0.5), 6) AS p50, round(quantile_cont(price, 0.9), 6) AS p90, round(quantile_cont(price, 0.99), 6) AS p99 FROM ticks GROUP BY symbol")
def weighted_and_percentiles(spark, sf):
    x = bars.ticks(table(spark, sf, "events"))
    return x.groupBy("symbol").agg(measures.weighted_average("price", "quantity").alias("vwap"), *[F.expr(f"percentile(price, {p / 100})").alias(f"p{p}") for p in (50, 90, 99)])


@query(", x AS (SELECT symbol, price, sum(quantity) OVER (PARTITION BY symbol ORDER BY price) AS c, sum(quantity) OVER (PARTITION BY symbol) AS t FROM ticks WHERE quantity > 0) SELECT symbol, round(min(price), 6) AS quantile FROM x WHERE c >= t * 0.9 GROUP BY symbol")
def weighted_quantile_step(spark, sf):
    return measures.weighted_quantile(bars.ticks(table(spark, sf, "events")), ["symbol"], "price", "quantity", 0.9)


@query(", x AS (SELECT symbol, arg_min(open, open_time) AS o, arg_max(close, open_time) AS c, min(low) AS l, max(high) AS h, avg((open + high + low + close) / 4) AS m FROM bars GROUP BY symbol) SELECT symbol, round((c / o - 1) * 100, 6) AS return_pct, round((h / l - 1) * 100, 6) AS span_pct, round((m / ((l + h) / 2) - 1) * 100, 6) AS bias_pct, round(l, 6) AS low, round(h, 6) AS high FROM x")
def interval_movement(spark, sf):
    return measures.movement(hourly(spark, sf))


@query(""", z AS (SELECT symbol, rn, close AS a, 0 AS way, 0 AS turns FROM bars WHERE rn = 1 UNION ALL
SELECT symbol, rn, CASE WHEN way <> 0 AND on_ OR far THEN close ELSE a END, CASE WHEN way = 0 THEN CASE WHEN far THEN CASE WHEN close > a THEN 1 ELSE -1 END ELSE 0 END WHEN NOT on_ AND far THEN -way ELSE way END, turns + CASE WHEN way <> 0 AND NOT on_ AND far THEN 1 ELSE 0 END
FROM (SELECT b.symbol, b.rn, b.close, z.a, z.way, z.turns, (b.close - z.a) * z.way > 0 AS on_, z.a > 0 AND abs(b.close / z.a - 1) * 100 >= 50 AS far FROM z JOIN bars b ON b.symbol = z.symbol AND b.rn = z.rn + 1)) SELECT symbol, CAST(max(turns) AS BIGINT) AS turns FROM z GROUP BY symbol""")
def zigzag_turns(spark, sf):
    x = ind.scan(hourly(spark, sf), ["close"], measures.zigzag(50.0), "turns long")
    return x.groupBy("symbol").agg(F.max("turns").alias("turns"))


@query(", x AS (SELECT symbol, rn - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, close FROM bars), k AS (SELECT DISTINCT symbol, n, k FROM x, (SELECT unnest(range(100)) AS k)) SELECT k.k, round(avg(x.close), 6) AS value, count(*) AS curves FROM k JOIN x ON x.symbol = k.symbol AND x.i = CAST(floor(k.k * (k.n - 1) / 99.0 + 0.5) AS BIGINT) GROUP BY k.k")
def average_equity_curves(spark, sf):
    return measures.average_curves(hourly(spark, sf), 100)


@query("WITH g AS (SELECT unnest(['click', 'view', 'none']) AS event_type) SELECT g.event_type, count(e.event_id) AS n FROM g LEFT JOIN events e ON e.event_type = g.event_type GROUP BY g.event_type")
def group_counts(spark, sf):
    return measures.group_counts(table(spark, sf, "events"), "event_type", ["click", "view", "none"])


@query(_LR + ", x AS (SELECT symbol, abs(r) AS a, row_number() OVER (PARTITION BY symbol ORDER BY abs(r)) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM lr) SELECT symbol, round(a, 6) AS scale FROM x WHERE k = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)")
def robust_scale(spark, sf):
    x = joins.log_returns(hourly(spark, sf)).withColumn("a", F.abs("r"))
    return measures.floor_index_quantile(x, ["symbol"], "a", 0.95)


@query(_LR + " SELECT symbol, round(avg(r), 6) + 0.0 AS mean, round(quantile_cont(r, 0.5), 6) + 0.0 AS median, round(quantile_cont(r, 0.1), 6) AS p10, round(max(r), 6) AS best, round(min(r), 6) AS worst, count(*) AS n FROM lr GROUP BY symbol")
def sample_summary(spark, sf):
    return measures.sample_summary(joins.log_returns(hourly(spark, sf)), ["symbol"], "r")


@query(_LR + ", x AS (SELECT symbol, quantile_cont(r, 0.5) AS a, quantile_cont(r, 0.1) AS b FROM lr GROUP BY symbol) SELECT symbol, round(a, 6) + 0.0 AS median, round(b, 6) AS p10, round((a + b) / 2, 6) AS objective, row_number() OVER (ORDER BY (a + b) / 2 DESC, b DESC, symbol) AS rank FROM x")
def search_objective(spark, sf):
    return measures.objective(joins.log_returns(hourly(spark, sf)), ["symbol"], "r")


@query(_LR + ", d AS (SELECT symbol, open_time // 86400000 AS c, sum(r) AS pnl FROM lr GROUP BY ALL), x AS (SELECT symbol || '-' || CAST(c AS BIGINT) AS cs, round(pnl, 9) AS pnl FROM d), y AS (SELECT *, row_number() OVER (ORDER BY pnl, cs) AS k FROM x) SELECT cs AS \"case\", round(pnl, 6) + 0.0 AS pnl, CAST((pnl < 0)::INT + (k <= 10)::INT AS BIGINT) AS n_reasons FROM y WHERE pnl < 0 OR k <= 10")
def pathology_selection(spark, sf):
    x = joins.log_returns(hourly(spark, sf)).groupBy("symbol", F.floor(F.col("open_time") / fx.DAY).alias("c")).agg(F.round(F.sum("r"), 9).alias("pnl"))
    x = x.select(F.concat_ws("-", "symbol", F.col("c").cast("string")).alias("case"), "pnl", F.col("pnl").alias("capture"), F.col("pnl").alias("ret"))
    return measures.pathologies(x, 5).select("case", "pnl", F.size("reasons").alias("n_reasons"))


@query("WITH t AS (SELECT count(*) AS t FROM lineitem), ab AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), pa AS (SELECT a, sum(n) AS na FROM ab GROUP BY a), pb AS (SELECT b, sum(n) AS nb FROM ab GROUP BY b), m AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM ab JOIN pa USING (a) JOIN pb USING (b), t), ha AS (SELECT -sum(na / t * ln(na / t)) AS ha FROM pa, t), hb AS (SELECT -sum(nb / t * ln(nb / t)) AS hb FROM pb, t) SELECT round(mi, 6) + 0.0 AS mi, round(ha, 6) AS ha, round(hb, 6) AS hb, round(greatest(0.0, mi) / sqrt(ha * hb), 6) + 0.0 AS normalised FROM m, ha, hb")
def categorical_information(spark, sf):
    return measures.category_information(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


# --- indicators ------------------------------------------------------------------------


def _w(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(f"SELECT symbol, open_time, round(close, 6) AS value, round(coalesce(lag(close, 5) OVER (PARTITION BY symbol ORDER BY open_time), close), 6) AS previous, round(avg(close) {_w(10)}, 6) AS sma, round(CASE WHEN sum(volume) {_w(10)} > 0 THEN sum(close * volume) {_w(10)} / sum(volume) {_w(10)} ELSE avg(close) {_w(10)} END, 6) AS vwsma, round(min(low) {_w(14)}, 6) AS lowest, round(max(high) {_w(14)}, 6) AS highest FROM bars")
def rolling_averages(spark, sf):
    low, high = ind.price_range(14)
    return hourly(spark, sf).select("symbol", "open_time", F.col("close").alias("value"), ind.lookback("close", 5)[0].alias("previous"), ind.sma("close", 10).alias("sma"), ind.vwsma("close", "volume", 10).alias("vwsma"), low.alias("lowest"), high.alias("highest"))


@query(f", x AS (SELECT *, abs(close - prev) AS d, lag(close, 10) OVER (PARTITION BY symbol ORDER BY open_time) AS old FROM bars) SELECT symbol, open_time, round(CASE WHEN old IS NOT NULL AND sum(d) {_w(10)} > 0 THEN abs(close - old) / sum(d) {_w(10)} ELSE 0 END, 6) AS er FROM x")
def efficiency_ratio(spark, sf):
    return ind.with_changes(hourly(spark, sf)).select("symbol", "open_time", ind.efficiency_ratio("close", 10).alias("er"))


@query(f", x AS (SELECT symbol, open_time, avg(close) {_w(20)} AS m, stddev_pop(close) {_w(20)} AS s FROM bars) SELECT symbol, open_time, round(m, 6) AS middle, round(m - 2 * s, 6) AS lower, round(m + 2 * s, 6) AS upper FROM x")
def bollinger_bands(spark, sf):
    b = ind.bollinger("close", 20, 2.0)
    return hourly(spark, sf).select("symbol", "open_time", *[b[k].alias(k) for k in ("middle", "lower", "upper")])


@query(", x AS (SELECT symbol, open_time, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW)) SELECT symbol, open_time, round(CASE WHEN m > 0 THEN s / m ELSE 0 END, 6) AS deviation FROM x")
def relative_deviation(spark, sf):
    return hourly(spark, sf).select("symbol", "open_time", ind.relative_deviation("close", fx.DAY).alias("deviation"))


@query(f", x AS (SELECT symbol, open_time, close, CASE WHEN rn = 1 THEN 0 ELSE regr_slope(close, rn - 1) {_w(12)} END AS s, CASE WHEN rn > 1 THEN regr_intercept(close, rn - 1) {_w(12)} END AS i, rn - 1 AS p FROM bars) SELECT symbol, open_time, round(s, 6) + 0.0 AS slope, round(coalesce(i + s * p, close), 6) + 0.0 AS fitted, round(coalesce(i + s * (p + 1), close), 6) + 0.0 AS next FROM x")
def linear_regression(spark, sf):
    g = ind.regression("close", 12)
    return ind.placed(hourly(spark, sf)).select("symbol", "open_time", *[(g[k] + 0.0).alias(k) for k in ("slope", "fitted", "next")])


_NEAR = ", p AS (SELECT b.symbol, b.open_time, b.rn, y.rn - greatest(b.rn - 11, 1) AS t, least(b.rn - 1, 11) AS pos, y.close AS v, y.volume AS q FROM bars b JOIN bars y ON y.symbol = b.symbol AND y.rn BETWEEN b.rn - 11 AND b.rn)"


@query(_NEAR + """, w AS (SELECT *, CASE WHEN sum(q) OVER k > 0 THEN q ELSE 1 END AS w FROM p WINDOW k AS (PARTITION BY symbol, rn)),
c AS (SELECT *, sum(w * t) OVER k / sum(w) OVER k AS mt, sum(w * v) OVER k / sum(w) OVER k AS mv FROM w WINDOW k AS (PARTITION BY symbol, rn)),
g AS (SELECT symbol, open_time, any_value(pos) AS pos, any_value(mt) AS mt, any_value(mv) AS mv, sum(w * (t - mt) * (t - mt)) AS var, sum(w * (t - mt) * (v - mv)) AS cov FROM c GROUP BY symbol, open_time),
s AS (SELECT *, CASE WHEN var > 1e-9 THEN cov / var ELSE 0 END AS s FROM g) SELECT symbol, open_time, round(s, 6) + 0.0 AS slope, round(mv + s * (pos + 1 - mt), 6) + 0.0 AS next FROM s""")
def weighted_regression(spark, sf):
    g = ind.regression("close", 12, "volume")
    return ind.placed(hourly(spark, sf)).select("symbol", "open_time", (g["slope"] + 0.0).alias("slope"), (g["next"] + 0.0).alias("next"))


@query(_NEAR + """, g AS (SELECT symbol, open_time, sum(v) AS y0, sum(v * t) AS y1, sum(v * t * t) AS y2 FROM p GROUP BY symbol, open_time, rn HAVING count(*) = 12),
d AS (SELECT *, 39974 * (506 * 12 - 66 * 66) - 4356 * (4356 * 12 - 66 * 506) + 506 * (4356 * 66 - 506 * 506) AS det FROM g)
SELECT b.symbol, b.open_time, round((y2 * (506 * 12 - 66 * 66) - 4356 * (y1 * 12 - 66 * y0) + 506 * (y1 * 66 - 506 * y0)) / det, 6) + 0.0 AS a,
round((39974 * (y1 * 12 - 66 * y0) - y2 * (4356 * 12 - 66 * 506) + 506 * (4356 * y0 - y1 * 506)) / det, 6) + 0.0 AS b,
round((39974 * (506 * y0 - 66 * y1) - 4356 * (4356 * y0 - y1 * 506) + y2 * (4356 * 66 - 506 * 506)) / det, 6) + 0.0 AS c FROM bars b LEFT JOIN d ON d.symbol = b.symbol AND d.open_time = b.open_time""")
def quadratic_fit(spark, sf):
    g = ind.quadratic("close", 12)
    return ind.placed(hourly(spark, sf)).select("symbol", "open_time", *[(g[k] + 0.0).alias(k) for k in "abc"])


@query(_LR + f", x AS (SELECT symbol, open_time, stddev_pop(r) {_w(24)} AS s FROM lr) SELECT symbol, open_time, round(s, 6) AS sigma, round(0.5 * sqrt(24) * s, 6) AS temperature FROM x")
def volatility_temperature(spark, sf):
    x = joins.log_returns(hourly(spark, sf)).withColumn("lr", F.col("r"))
    s = ind.log_return_volatility(24)
    return x.select("symbol", "open_time", s.alias("sigma"), ind.temperature(0.5, 24, s).alias("temperature"))


@query(f"SELECT symbol, open_time, round(avg((high - low) / open * 100) {_w(100)}, 6) AS mean_range, round(max((high - low) / open * 100) {_w(100)}, 6) AS max_range FROM bars")
def candle_range(spark, sf):
    return ind.range_percent(hourly(spark, sf), 100)


_EMA = """, e AS (SELECT symbol, rn, open_time, close, close AS ema, CAST(0.0 AS DOUBLE) AS d FROM bars WHERE rn = 1 UNION ALL
SELECT b.symbol, b.rn, b.open_time, b.close, CASE WHEN e.ema = 0 THEN b.close ELSE e.ema + 2.0 / 13 * (b.close - e.ema) END, CASE WHEN e.ema = 0 THEN 0 ELSE 2.0 / 13 * (b.close - e.ema) END FROM e JOIN bars b ON b.symbol = e.symbol AND b.rn = e.rn + 1)"""


@query(_EMA + " SELECT symbol, open_time, round(ema, 6) AS ema, round(d, 6) + 0.0 AS change FROM e")
def ema(spark, sf):
    return ind.scan(hourly(spark, sf), ["close"], ind.ema(12), "ema double, change double")


@query(_EMA + " SELECT symbol, open_time, CAST(CASE WHEN d / ema * 10000 >= 50 THEN 1 WHEN d / ema * 10000 <= -50 THEN -1 ELSE 0 END AS BIGINT) AS signal FROM e")
def derivative_threshold(spark, sf):
    x = ind.scan(hourly(spark, sf), ["close"], ind.ema(12), "ema double, change double")
    return x.select("symbol", "open_time", ind.threshold(F.col("change") / F.col("ema") * 10_000, 50, 50).alias("signal"))


_MACD = """, m AS (SELECT symbol, rn, open_time, close AS a, close AS b, CAST(0.0 AS DOUBLE) AS s FROM bars WHERE rn = 1 UNION ALL
SELECT symbol, rn, open_time, a, b, CASE WHEN s = 0 THEN a - b ELSE s + 0.2 * (a - b - s) END FROM (SELECT x.symbol, x.rn, x.open_time, m.a + 2.0 / 13 * (x.close - m.a) AS a, m.b + 2.0 / 27 * (x.close - m.b) AS b, m.s FROM m JOIN bars x ON x.symbol = m.symbol AND x.rn = m.rn + 1))"""


@query(_MACD + " SELECT symbol, open_time, round(a - b, 6) + 0.0 AS macd, round(s, 6) + 0.0 AS signal, round(a - b - s, 6) + 0.0 AS histogram FROM m")
def macd(spark, sf):
    return ind.scan(hourly(spark, sf), ["close"], ind.macd(12, 26, 9), "macd double, signal double, histogram double")


_RSI = """, q AS (SELECT symbol, rn, open_time, CAST(0.0 AS DOUBLE) AS g, CAST(0.0 AS DOUBLE) AS l FROM bars WHERE rn = 1 UNION ALL
SELECT b.symbol, b.rn, b.open_time, CASE WHEN q.g = 0 THEN greatest(b.close - b.prev, 0) ELSE q.g + (greatest(b.close - b.prev, 0) - q.g) / 14 END, CASE WHEN q.l = 0 THEN greatest(b.prev - b.close, 0) ELSE q.l + (greatest(b.prev - b.close, 0) - q.l) / 14 END FROM q JOIN bars b ON b.symbol = q.symbol AND b.rn = q.rn + 1)"""


@query(_RSI + " SELECT symbol, open_time, round(CASE WHEN l <= 0 THEN CASE WHEN g > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi FROM q")
def rsi(spark, sf):
    return ind.scan(hourly(spark, sf), ["close"], ind.rsi(14), "rsi double")


_KAMA = f""", er AS (SELECT *, CASE WHEN old IS NOT NULL AND sum(d) {_w(10)} > 0 THEN least(1, abs(close - old) / sum(d) {_w(10)}) ELSE 0 END AS er FROM (SELECT *, abs(close - prev) AS d, lag(close, 10) OVER (PARTITION BY symbol ORDER BY open_time) AS old FROM bars)),
k AS (SELECT symbol, rn, open_time, close AS kama, CAST(0.0 AS DOUBLE) AS d FROM er WHERE rn = 1 UNION ALL
SELECT b.symbol, b.rn, b.open_time, k.kama + pow(2.0 / 31 + b.er * (2.0 / 3 - 2.0 / 31), 2) * (b.close - k.kama), pow(2.0 / 31 + b.er * (2.0 / 3 - 2.0 / 31), 2) * (b.close - k.kama) FROM k JOIN er b ON b.symbol = k.symbol AND b.rn = k.rn + 1)"""


def _kama(spark, sf):
    return ind.scan(hourly(spark, sf), ["close", "volume"], ind.kama(), "kama double, change double")


@query(_KAMA + " SELECT symbol, open_time, round(kama, 6) AS kama, round(d, 6) + 0.0 AS change FROM k")
def kama(spark, sf):
    return _kama(spark, sf)


@query(_KAMA + ", t AS (SELECT symbol, open_time, d / kama / 3600 * 10000 * 3600 AS rate FROM k) SELECT symbol, open_time, CAST(CASE WHEN abs(rate) > 40 THEN sign(rate) ELSE 0 END AS BIGINT) AS state FROM t")
def signal_deadband(spark, sf):
    x = _kama(spark, sf).withColumn("rate", signals.rate_bps_per_hour("kama", "change"))
    return ind.scan(x, ["rate"], signals.clamped_rate("deadband", 40, 40), "r double").select("symbol", "open_time", F.signum("r").cast("int").alias("state"))


_HOLD = _KAMA + """, t AS (SELECT symbol, rn, open_time, d / kama * 10000 AS rate FROM k), h AS (SELECT symbol, rn, open_time, CASE WHEN rate > 60 OR rate < -40 THEN rate ELSE 0 END AS r FROM t WHERE rn = 1 UNION ALL SELECT t.symbol, t.rn, t.open_time, CASE WHEN t.rate > 60 OR t.rate < -40 THEN t.rate ELSE h.r END FROM h JOIN t ON t.symbol = h.symbol AND t.rn = h.rn + 1)"""


def _hold(spark, sf, mode="hold"):
    x = _kama(spark, sf).withColumn("rate", signals.rate_bps_per_hour("kama", "change"))
    return ind.scan(x, ["rate"], signals.clamped_rate(mode, 40, 60), "r double").select("symbol", "open_time", F.signum("r").cast("int").alias("state"))


@query(_HOLD + " SELECT symbol, open_time, CAST(sign(r) AS BIGINT) AS state FROM h")
def signal_hold(spark, sf):
    return _hold(spark, sf)


@query(_HOLD + ", z AS (SELECT symbol, open_time, CAST(sign(r) AS BIGINT) AS state, coalesce(lag(CAST(sign(r) AS BIGINT)) OVER (PARTITION BY symbol ORDER BY open_time), 0) AS from_state FROM h) SELECT symbol, open_time, state, from_state FROM z WHERE state <> from_state")
def state_transitions(spark, sf):
    return signals.transitions(_hold(spark, sf), "state")


@query(_HOLD + ", z AS (SELECT symbol, open_time, sign(r) AS s, coalesce(lag(sign(r)) OVER (PARTITION BY symbol ORDER BY open_time), 0) AS f FROM h), y AS (SELECT symbol, open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS dt FROM z WHERE s <> f) SELECT symbol, count(*) AS n, round(avg(dt), 6) AS mean_ms FROM y GROUP BY symbol")
def mean_transition_interval(spark, sf):
    return signals.mean_interval(signals.transitions(_hold(spark, sf), "state"))


@query(_KAMA + """, t AS (SELECT symbol, rn, open_time, d / kama * 10000 AS rate FROM k), h AS (SELECT symbol, rn, open_time, CASE WHEN abs(rate) > 60 THEN rate ELSE 0 END AS r FROM t WHERE rn = 1 UNION ALL
SELECT t.symbol, t.rn, t.open_time, CASE WHEN h.r <> 0 AND t.rate * h.r > 0 AND abs(t.rate) >= 20 OR abs(t.rate) > CASE WHEN h.r = 0 THEN 60 ELSE 40 END THEN t.rate ELSE 0 END FROM h JOIN t ON t.symbol = h.symbol AND t.rn = h.rn + 1) SELECT symbol, open_time, CAST(sign(r) AS BIGINT) AS state FROM h""")
def signal_hysteresis(spark, sf):
    return _hold(spark, sf, "hysteresis")


@query(_HOLD + """, s AS (SELECT h.symbol, h.rn, h.open_time, CAST(sign(h.r) AS BIGINT) AS w, b.close FROM h JOIN bars b ON b.symbol = h.symbol AND b.rn = h.rn), a AS (SELECT symbol, rn, open_time, w AS before, w AS accepted, CASE WHEN w <> 0 THEN close END AS last, w <> 0 AS taken FROM s WHERE rn = 1 UNION ALL
SELECT symbol, rn, open_time, w, CASE WHEN taken THEN w ELSE accepted END, CASE WHEN taken THEN close ELSE last END, taken FROM (SELECT s.symbol, s.rn, s.open_time, s.w, s.close, a.accepted, a.last, s.w <> a.before AND s.w <> a.accepted AND (a.last IS NULL OR abs(s.close - a.last) > a.last * 0.002) AS taken FROM a JOIN s ON s.symbol = a.symbol AND s.rn = a.rn + 1))
SELECT symbol, open_time, accepted, taken FROM a""")
def accepted_signals(spark, sf):
    x = _hold(spark, sf).join(hourly(spark, sf).select("symbol", "open_time", "close"), ["symbol", "open_time"])
    return ind.scan(x, ["state", "close"], signals.accepted_signals(0.002), "accepted int, taken boolean")


@query()
def volume_indicators(spark, sf):
    """VW-EMA, VW efficiency, VW-KAMA, chop-fast average, ADX and rate noise, one after the other on one table."""
    b = hourly(spark, sf)
    keys = ["symbol", "open_time"]
    out = ind.scan(b, ["close", "volume"], ind.vwema(12), "vwema double")
    out = out.join(ind.scan(b, ["close", "volume"], ind.vw_efficiency(10, 0.5, 20), "vwer double"), keys)
    out = out.join(ind.scan(b, ["close", "volume"], ind.kama(power=1.0, volume_power=0.5), "vwkama double, change double"), keys)
    out = out.join(ind.scan(b, ["close", "volume"], ind.chop_fast_ema(), "chop double, chop_change double"), keys)
    out = out.join(ind.scan(b, ["high", "low", "close"], ind.dmi(14), "direction double, adx double"), keys)
    out = out.join(ind.scan(b, ["open_time", "close"], ind.irregular_ema(6 * H), "time_ema double"), keys)
    return out


# --- oracles, ledgers, portfolios ------------------------------------------------------


@query(""", dp AS (SELECT symbol, rn, open_time, close, CAST(0.0 AS DOUBLE) AS f, CAST(-2.0 AS DOUBLE) AS l, CAST(-2.0 AS DOUBLE) AS s FROM bars WHERE rn = 1 UNION ALL
SELECT symbol, rn, open_time, close, greatest(f, l - 2, s - 2), greatest(l, f - 2, s - 4), greatest(s, f - 2, l - 4) FROM (SELECT b.symbol, b.rn, b.open_time, b.close, dp.f, dp.l + 2000 * (b.close / b.prev - 1) AS l, dp.s - 2000 * (b.close / b.prev - 1) AS s FROM dp JOIN bars b ON b.symbol = dp.symbol AND b.rn = dp.rn + 1))
SELECT symbol, open_time, round(f, 4) + 0.0 AS flat, round(l, 4) + 0.0 AS long, round(s, 4) + 0.0 AS short, round(greatest(f, l, s), 4) + 0.0 AS best FROM dp""")
def perfect_margin_oracle(spark, sf):
    x = ind.scan(hourly(spark, sf), ["close"], oracles.perfect_margin(1000.0, 2.0, 0.001), "flat double, long double, short double, best double, transitions long, compounded double")
    return x.select("symbol", "open_time", *[F.round(c, 4).alias(c) for c in ("flat", "long", "short", "best")])


@query()
def exposure_value_oracle(spark, sf):
    def run(rows):
        prices = np.array([p for (p,) in rows])
        grid, value = oracles.exposure_values(prices, 21, 1.0, 0.001)
        for v in value:
            s = oracles.preference(v, grid, 0.005)
            yield tuple(s[k] for k in ("mean", "second", "mode", "entropy", "opportunity"))

    b = bars.segments(hourly(spark, sf), H)
    return ind.scan(b, ["close"], run, "mean double, second double, mode double, entropy double, opportunity double", ("symbol", "segment"))


@query(_HOLD + """, g AS (SELECT h.symbol, h.rn, h.open_time, sign(h.r) * 0.003 AS a, coalesce(lag(sign(h.r) * 0.003) OVER (PARTITION BY h.symbol ORDER BY h.rn), 0) AS x, CASE WHEN h.rn > 1 THEN b.close / b.prev ELSE 1 END AS m FROM h JOIN bars b ON b.symbol = h.symbol AND b.rn = h.rn),
e AS (SELECT *, 1 - x + x * m AS w, 1 - x + CASE WHEN x >= 0 THEN x * m * 0.999 ELSE x * m / 0.999 END AS net FROM g), d AS (SELECT *, CASE WHEN net > 0 THEN x * m / w ELSE 0 END AS y FROM e),
i AS (SELECT *, CASE WHEN net > 0 THEN ln(greatest(w, 2.220446049250313e-16)) ELSE CAST('-inf' AS DOUBLE) END + CASE WHEN abs(a - y) <= 2.220446049250313e-16 THEN 0 WHEN a > y THEN ln(0.999 + 0.001 * y) - ln(0.999 + 0.001 * a) ELSE ln(1 - 0.001 * y) - ln(1 - 0.001 * a) END AS inc FROM d),
l AS (SELECT symbol, rn, open_time, CASE WHEN bool_or(isinf(inc)) OVER w THEN CAST('-inf' AS DOUBLE) ELSE sum(CASE WHEN isinf(inc) THEN 0 ELSE inc END) OVER w END AS lg FROM i WINDOW w AS (PARTITION BY symbol ORDER BY rn))
SELECT symbol, open_time, round(lg, 6) + 0.0 AS log_equity, round(1 - exp(lg - greatest(max(lg) OVER (PARTITION BY symbol ORDER BY rn), 0)), 6) + 0.0 AS drawdown FROM l""")
def exposure_path_return(spark, sf):
    x = _hold(spark, sf).join(hourly(spark, sf).select("symbol", "open_time", "close"), ["symbol", "open_time"]).withColumn("a", F.col("state") * 0.003)
    return ind.scan(x, ["a", "close"], oracles.exposure_return(0.001), "log_equity double, drawdown double")


@query()
def aligned_transitions(spark, sf):
    t = signals.transitions(_hold(spark, sf), "state").select("symbol", F.col("open_time").alias("time"), "state")
    o = signals.transitions(_hold(spark, sf, "deadband"), "state").select("symbol", F.col("open_time").alias("time"), "state")
    return signals.align(t, o, 6 * H, 3.0 * H)


@query("WITH x AS (SELECT l_discount * 10 - 0.5 AS x, l_tax * 10 - 0.4 AS a, l_orderkey, l_linenumber FROM lineitem) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(CASE WHEN abs(a - x) <= 2.220446049250313e-16 THEN 1 WHEN a > x THEN (1 - 0.001 + 0.001 * x) / (1 - 0.001 + 0.001 * a) ELSE (1 - 0.001 * x) / (1 - 0.001 * a) END, 6) AS factor FROM x")
def rebalance_factor(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10 - 0.5).alias("x"), (F.col("l_tax") * 10 - 0.4).alias("a"))
    return x.select("l_orderkey", "l_linenumber", fx.rebalance_factor("x", "a", 0.001).alias("factor"))


_LOTS = """WITH f AS (SELECT o_custkey AS account, row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_quantity, l_extendedprice) AS n, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign, l_quantity AS q, (l_extendedprice + CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_extendedprice * l_tax) / l_quantity AS unit FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT *, sum(sign * q) OVER w AS after, sum(sign * q) OVER w - sign * q AS before FROM f WINDOW w AS (PARTITION BY account ORDER BY n)),
m AS (SELECT account, n, id, unit, s, greatest(s * after, 0) - greatest(s * before, 0) AS c FROM p, (SELECT unnest([1, -1]) AS s)),
o AS (SELECT account, s, n, id, unit, c, sum(c) OVER w - c AS a, sum(c) OVER w AS b FROM m WHERE c > 1e-8 WINDOW w AS (PARTITION BY account, s ORDER BY n)),
k AS (SELECT account, s, unit, sum(-c) OVER w + c AS a, sum(-c) OVER w AS b FROM m WHERE c < -1e-8 WINDOW w AS (PARTITION BY account, s ORDER BY n)),
g AS (SELECT o.account, o.s, o.n, o.id, any_value(o.c) AS opened, any_value(o.unit) AS unit, coalesce(sum(least(o.b, k.b) - greatest(o.a, k.a)) FILTER (k.a IS NOT NULL), 0) AS gone, coalesce(sum(round((least(o.b, k.b) - greatest(o.a, k.a)) * k.unit, 6)) FILTER (k.a IS NOT NULL), 0) AS paid
  FROM o LEFT JOIN k ON k.account = o.account AND k.s = o.s AND k.a < o.b AND k.b > o.a GROUP BY ALL),
l AS (SELECT account, id AS lot, s, opened, opened - gone AS remaining, round(opened * unit, 6) - paid AS money FROM g),
lots AS (SELECT account, lot, CASE WHEN s = 1 THEN 'long' ELSE 'short' END AS side, opened, remaining, CASE WHEN remaining = 0 THEN -s * money END AS profit,
  CASE WHEN remaining > 0 THEN money / remaining * CASE WHEN s = 1 THEN 1.0015 ELSE 1 / (1.0015 * 1.0015) END END AS break_even, CASE WHEN remaining = 0 THEN 'closed' WHEN remaining < opened THEN 'partially-closed' ELSE 'open' END AS status FROM l)
"""


@query(_LOTS + f"SELECT account, lot, side, {r('opened', 'remaining')}, round(profit + 0.00001331971, 3) + 0.0 AS profit, round(break_even + 0.00001331971, 3) + 0.0 AS break_even, status FROM lots")
def position_lots(spark, sf):
    x = ledger.lots(ledger.fills(table(spark, sf, "lineitem"), table(spark, sf, "orders")))
    return x.withColumns({c: F.round(F.col(c) + OFF_TIES, 3) + 0.0 for c in ("profit", "break_even")})


@query(_LOTS + "SELECT account, count(*) AS lots, count(*) FILTER (status = 'closed') AS closed, count(*) FILTER (status = 'closed' AND profit > 0) AS profitable, round(sum(coalesce(profit, 0)) + 0.00001331971, 3) + 0.0 AS profit FROM lots GROUP BY account")
def closed_position_summary(spark, sf):
    x = ledger.closed_summary(ledger.lots(ledger.fills(table(spark, sf, "lineitem"), table(spark, sf, "orders"))))
    return x.withColumn("profit", F.round(F.col("profit") + OFF_TIES, 3) + 0.0)


@query("SELECT o_custkey AS account, CASE l_returnflag WHEN 'R' THEN 'sell' ELSE 'buy' END AS side, round(sum(l_quantity), 6) AS quantity, round(sum(l_extendedprice), 4) AS quote, round(sum(l_extendedprice * l_tax), 4) AS fee, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def account_fills(spark, sf):
    x = ledger.fills(table(spark, sf, "lineitem"), table(spark, sf, "orders"))
    return x.groupBy("account", "side").agg(F.sum("quantity").alias("quantity"), F.round(F.sum("quote"), 4).alias("quote"), F.round(F.sum("fee"), 4).alias("fee"), F.count("*").alias("n"))


@query()
def grid_backtest(spark, sf):
    return ind.scan(hourly(spark, sf), ["open", "high", "low", "close", "volume"], ledger.replay(ledger.GridStrategy), "equity double, asset double, fills long")


@query("SELECT c_custkey, round(c_acctbal, 6) AS equity, round(greatest(-(c_acctbal - 500), 0) + 0, 6) AS debt, round(CASE WHEN c_acctbal > 0 THEN 500 / c_acctbal END, 6) AS leverage FROM customer")
def margin_projection(spark, sf):
    m = ledger.margin(F.col("c_acctbal") - 500, F.lit(5.0), F.lit(100.0))
    return table(spark, sf, "customer").select("c_custkey", m["equity"].alias("equity"), m["debt"].alias("debt"), m["leverage"].alias("leverage"))


_PAST = _LR + ", p AS (SELECT symbol, sum(r) AS s, stddev_samp(r) AS sd FROM lr GROUP BY symbol)"


@query(_PAST + ", w AS (SELECT symbol, 1.0 / count(*) OVER () AS eq, (1 / sd) / sum(1 / sd) OVER () AS iv, CASE WHEN sum(greatest(s, 0)) OVER () > 0 THEN greatest(s, 0) / sum(greatest(s, 0)) OVER () ELSE 1.0 / count(*) OVER () END AS win, row_number() OVER (ORDER BY s DESC, symbol) AS k, count(*) OVER () AS m FROM p) SELECT symbol, round(eq, 6) AS equal, round(iv, 6) AS inverse_vol, round(win, 6) + 0.0 AS winner, round(CASE WHEN k <= m // 2 THEN 1.0 / (m // 2) WHEN k > m - m // 2 THEN -1.0 / (m // 2) ELSE 0 END, 6) AS momentum FROM w")
def portfolio_weights(spark, sf):
    x = joins.log_returns(hourly(spark, sf))
    out = portfolio.equal(x).withColumnRenamed("weight", "equal")
    for name, f in (("inverse_vol", portfolio.inverse_volatility), ("winner", portfolio.winners), ("momentum", portfolio.momentum)):
        out = out.join(f(x).withColumnRenamed("weight", name), "symbol")
    return out


@query()
def portfolio_simulation(spark, sf):
    def allocate(past):
        sd = past.std(axis=0, ddof=1)
        w = 1 / np.where(sd > 0, sd, 1.0)
        return w / w.sum()

    return portfolio.simulate(measures.curve_returns(hourly(spark, sf)), allocate, 24, 0.001, 48)


@query("SELECT c_custkey, n_name, CAST(row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS turn FROM customer JOIN nation ON c_nationkey = n_nationkey QUALIFY turn <= 3")
def category_quotas(spark, sf):
    x = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ranking.round_robin(x, "n_name", "c_acctbal", "c_custkey", 3).select("c_custkey", "n_name", "turn")


@query("WITH x AS (SELECT c_custkey, n_name, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS turn FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, row_number() OVER (ORDER BY turn, n_name) AS place FROM x")
def category_round_robin(spark, sf):
    x = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ranking.round_robin(x, "n_name", "c_acctbal", "c_custkey").select("c_custkey", "place")


@query("SELECT p_partkey, round(3 * log10(p_retailprice + 1) + 2 * log10(p_size + 1) + log10(p_size + 1) + 0.25 * abs(p_size - 25), 6) AS score FROM part")
def selection_score(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fx.selection_score("p_retailprice", "p_size", "p_size", F.col("p_size") - 25).alias("score"))


@query("SELECT user_id, min(event_id) AS place, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def dedupe_last_at_first(spark, sf):
    x = table(spark, sf, "events").select("user_id", F.col("event_id").alias("place"), "event_type")
    return ranking.last_at_first_place(x, "user_id", "place")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(p_brand, '[^A-Za-z0-9._-]', '_', 'g') AS path, round(ln(1 + exp(-abs(p_size - 25.0))) + greatest(p_size - 25.0, 0), 6) AS softplus, round(1 / (1 + exp(-(p_size - 25.0))), 6) AS sigmoid, round(floor(p_retailprice / 0.25 + 1e-9) * 0.25, 6) AS stepped FROM part")
def scalar_functions(spark, sf):
    d = F.col("p_size") - 25.0
    return table(spark, sf, "part").select("p_partkey", fx.slug("p_name").alias("slug"), fx.path_part("p_brand").alias("path"), fx.softplus(d).alias("softplus"), fx.sigmoid(d).alias("sigmoid"), fx.floor_to_step("p_retailprice", 0.25).alias("stepped"))


# --- formulas over the driver's tables ---------------------------------------------------


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CASE WHEN l_linestatus = 'F' THEN 'limit' ELSE 'stop' END AS kind, l_extendedprice * (0.98 + l_discount / 5) AS trig FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(greatest(p * (1 + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * 25 / 10000), 1e-6), 6) AS slipped, round(p / (1 / 3.0 + 0.002), 6) AS capacity,
q > 0 AND q >= 5 AND q <= 45 AND q * p >= 100000 AS valid, CASE WHEN kind = 'limit' THEN CASE WHEN side = 'buy' THEN p <= trig ELSE p >= trig END ELSE CASE WHEN side = 'buy' THEN p >= trig ELSE p <= trig END END AS reached,
round(p * (1 - 0.01 * l_linenumber), 6) AS buy_level, round(p * (1 + 0.01 * l_linenumber), 6) AS sell_level, CASE WHEN q - 10 <= 0 THEN 'pending' WHEN q - 25 <= 0 THEN 'closed' WHEN q - 25 < q - 10 THEN 'partially-closed' ELSE 'open' END AS status, abs(p - trig) > trig * 0.01 AS beyond FROM x""")
def order_formulas(spark, sf):
    x = table(spark, sf, "lineitem").withColumns({
        "side": F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy"), "kind": F.when(F.col("l_linestatus") == "F", "limit").otherwise("stop"),
        "trig": F.col("l_extendedprice") * (0.98 + F.col("l_discount") / 5), "q": F.col("l_quantity"), "p": F.col("l_extendedprice"),
    })
    return x.select(
        "l_orderkey", "l_linenumber", fx.slipped("p", "side", 25).alias("slipped"), fx.order_capacity("p", 3.0, 0.002).alias("capacity"), fx.order_valid("q", "p", 5, 45, 100_000).alias("valid"),
        fx.limit_reached("kind", "side", "p", "trig").alias("reached"), fx.grid_price("p", 0.01, "l_linenumber", "buy").alias("buy_level"), fx.grid_price("p", 0.01, "l_linenumber", "sell").alias("sell_level"),
        fx.lot_status(F.col("q") - 10, F.col("q") - 25).alias("status"), fx.beyond_friction("p", "trig", 0.01).alias("beyond"),
    )


@query("""WITH x AS (SELECT p_partkey, (p_size - 25.5) / 10 AS z, p_size / 51.0 AS u, p_retailprice / 1000 AS w FROM part)
SELECT p_partkey, round(greatest(z, w) + ln(1 + exp(least(z, w) - greatest(z, w))), 6) AS log_sum, round(ln(u) - ln(1 - u), 6) AS logit, round(exp(-0.5 * (z / w) * (z / w)), 6) AS bell, round(exp(ln(1 + u / 100) * 900000 / 3600000) - 1, 6) AS compounded,
round(least(greatest(z, -1), 1), 6) + 0.0 AS clamped, round((SELECT ln(sum(exp(z * (-1 + 0.1 * k)))) FROM range(21) t(k)), 6) AS log_partition, round(least(greatest(-0.5 * ln(1 - least(greatest(u * u, 0), 1 - 2.220446049250313e-16)) / ln(21), 0), 1), 6) AS oracle_information,
round(least(greatest(0.5 * ln(w / u) / ln(21), 0), 1), 6) AS state_information, round(0.25 * exp(-0.5 * (z / w) * (z / w)), 6) AS sized FROM x""")
def probability_formulas(spark, sf):
    x = table(spark, sf, "part").select("p_partkey", ((F.col("p_size") - 25.5) / 10).alias("z"), (F.col("p_size") / 51.0).alias("u"), (F.col("p_retailprice") / 1000).alias("w"))
    return x.select(
        "p_partkey", fx.log_add_exp("z", "w").alias("log_sum"), fx.logit("u").alias("logit"), fx.gaussian("z", "w").alias("bell"), fx.compound_per_bar(F.col("u") / 100, F.lit(900_000)).alias("compounded"), (fx.clamp("z", -1.0, 1.0) + 0.0).alias("clamped"),
        fx.truncated_exponential_log_partition("z", -1.0, 1.0, 21).alias("log_partition"), fx.gaussian_oracle_information("u", 21).alias("oracle_information"), fx.gaussian_state_information("w", "u", 21).alias("state_information"), fx.sized(0.25, "z", "w").alias("sized"),
    )


@query("""WITH x AS (SELECT c_custkey, upper(replace(c_name, '#', '')) || ['USDT', 'USDC', 'FDUSD', 'BUSD', 'BTC', 'ETH', 'EUR', 'XYZ'][1 + c_custkey % 8] AS s, (1 + c_custkey % 90) || ['s', 'm', 'h', 'd', 'w', 'x'][1 + c_custkey % 6] AS t, c_mktsegment AS m FROM customer),
q AS (SELECT *, CASE WHEN suffix(s, 'USDT') THEN 'USDT' WHEN suffix(s, 'USDC') THEN 'USDC' WHEN suffix(s, 'FDUSD') THEN 'FDUSD' WHEN suffix(s, 'BUSD') THEN 'BUSD' WHEN suffix(s, 'BTC') THEN 'BTC' WHEN suffix(s, 'ETH') THEN 'ETH' WHEN suffix(s, 'EUR') THEN 'EUR' ELSE 'USDT' END AS quote,
CAST(regexp_extract(t, '^([0-9]+)', 1) AS BIGINT) * CASE right(t, 1) WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 WHEN 'd' THEN 86400000 WHEN 'w' THEN 604800000 END AS ms FROM x)
SELECT c_custkey, quote, CASE WHEN suffix(s, quote) AND length(s) > length(quote) THEN left(s, length(s) - length(quote)) ELSE s END AS base, lower(s || ' ' || m) AS text, ms, CASE WHEN ms % 86400000 = 0 THEN (ms // 86400000) || 'd' WHEN ms % 3600000 = 0 THEN (ms // 3600000) || 'h' WHEN ms % 60000 = 0 THEN (ms // 60000) || 'm' ELSE (ms // 1000) || 's' END AS written FROM q""")
def market_names(spark, sf):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (1 + F.col("c_custkey") % len(xs)).cast("int"))
    x = table(spark, sf, "customer").withColumn("s", F.concat(F.upper(F.replace("c_name", F.lit("#"), F.lit(""))), pick(["USDT", "USDC", "FDUSD", "BUSD", "BTC", "ETH", "EUR", "XYZ"])))
    x = x.withColumn("ms", fx.interval_ms_column(F.concat((1 + F.col("c_custkey") % 90).cast("string"), pick(["s", "m", "h", "d", "w", "x"]))))
    written = F.when(F.col("ms").isNotNull(), fx.format_interval("ms"))
    return x.select("c_custkey", fx.quote_asset("s").alias("quote"), fx.base_asset("s").alias("base"), fx.searchable("s", "c_mktsegment").alias("text"), "ms", written.alias("written"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, (l_discount - 0.05) * 24 AS f, 0.5 + l_quantity / 50 AS m, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS o, l_tax AS t FROM lineitem),
y AS (SELECT *, abs(f) AS a, 1 - abs(f) + abs(f) * m AS lng, 1 + abs(f) - abs(f) * m AS sht FROM x)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(CASE WHEN a >= 1 THEN sign(f) WHEN f > 0 THEN CASE WHEN lng > 2.220446049250313e-16 THEN a * m / lng ELSE 1 END WHEN f < 0 THEN CASE WHEN sht > 2.220446049250313e-16 THEN -a * m / sht ELSE -1 END ELSE 0 END, 6) + 0.0 AS marked,
round(CASE WHEN o > 0 THEN least(greatest(f, 0), 1) WHEN o < 0 THEN least(greatest(-f, 0), 1) ELSE 1 - least(greatest(abs(f), 0), 1) END, 6) + 0.0 AS credit, round(0.2 * t + 0.6 * m + 0.2 * a, 6) AS score, round(CASE WHEN t > 0 THEN m / t ELSE -1 END, 6) AS ratio FROM y""")
def exposure_formulas(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_discount") - 0.05) * 24).alias("f"), (0.5 + F.col("l_quantity") / 50).alias("m"), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0).alias("o"), F.col("l_tax").alias("t"))
    return x.select("l_orderkey", "l_linenumber", (fx.marked_exposure("f", "m") + 0.0).alias("marked"), (fx.agreement_credit("f", "o") + 0.0).alias("credit"), fx.signal_score("t", "m", F.abs("f")).alias("score"), fx.ratio_or("m", "t", -1.0).alias("ratio"))


@query("""WITH k AS (SELECT unnest(range(7)) AS k), l AS (SELECT k, (7 - k) / 28.0 AS linear, pow(0.8, k) AS g FROM k) SELECT CAST(k AS BIGINT) AS k, round(linear, 6) AS linear, round(g / sum(g) OVER (), 6) AS geometric FROM l""")
def grid_level_weights(spark, sf):
    x = spark.range(1).select(F.posexplode(F.arrays_zip(fx.grid_weights(7).alias("linear"), fx.grid_weights(7, 0.8).alias("geometric"))).alias("k", "w"))
    return x.select("k", "w.linear", "w.geometric")


@query("SELECT seq, CAST(floor(event_time / 900000.0) * 900000 AS BIGINT) AS down, CAST(ceil(event_time / 900000.0) * 900000 AS BIGINT) AS up, CAST(floor(event_time / 86400000.0) * 86400000 AS BIGINT) AS day FROM ticks")
def aligned_times(spark, sf):
    return bars.ticks(table(spark, sf, "events")).select("seq", fx.align_down("event_time", 900_000).cast("long").alias("down"), fx.align_up("event_time", 900_000).cast("long").alias("up"), fx.day_start("event_time").cast("long").alias("day"))


@query("""SELECT c_custkey, round(CASE WHEN c_nationkey - 12 > 0 AND c_acctbal - 4000 < 0 THEN -(c_acctbal - 4000) / ((c_nationkey - 12) * 0.998) WHEN c_nationkey - 12 < 0 AND c_acctbal - 4000 > 0 THEN -(c_acctbal - 4000) * 0.998 / (c_nationkey - 12) END, 4) AS price FROM customer""")
def liquidation_prices(spark, sf):
    p = ledger.liquidation_price(F.col("c_acctbal") - 4000, (F.col("c_nationkey") - 12).cast("double"), 0.998)
    return table(spark, sf, "customer").select("c_custkey", F.round(p, 4).alias("price"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_custkey) AS place FROM customer")
def market_order(spark, sf):
    return ranking.market_order(table(spark, sf, "customer"), ["MACHINERY", "BUILDING"], "c_mktsegment", "c_custkey").select("c_custkey", F.col("place"))


@query("""WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_extendedprice AS q, (l_quantity - 25) * 20000 AS lag, l_discount - 0.05 AS pct FROM lineitem)
SELECT side, round(sum(q), 2) AS quote, round(sum(q * abs(lag)) / sum(q), 3) AS mean_lag, round(sum(CASE WHEN abs(lag) / 300000 <= 1 AND abs(pct) / 0.0203 <= 1 THEN q ELSE 0 END) / sum(q) * 100, 6) AS within_pct FROM x GROUP BY side""")
def extrema_order_mass(spark, sf):
    x = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_extendedprice").alias("quote"), ((F.col("l_quantity") - 25) * 20_000).alias("lag_ms"), (F.col("l_discount") - 0.05).alias("price_pct"))
    out = ledger.extrema_mass(x, percent=0.0203)
    return out.withColumns({"quote": F.round("quote", 2), "mean_lag": F.round("mean_lag", 3)})


@query(_HOLD + """, tr AS (SELECT symbol, open_time, s FROM (SELECT symbol, open_time, CAST(sign(r) AS BIGINT) AS s, coalesce(lag(CAST(sign(r) AS BIGINT)) OVER (PARTITION BY symbol ORDER BY open_time), 0) AS f FROM h) WHERE s <> f),
c AS (SELECT symbol, open_time AS time, s AS state, open_time // 7200000 * 7200000 AS m FROM tr), o AS (SELECT symbol, open_time // 7200000 * 7200000 AS time, s AS state, max(open_time) AS m FROM tr GROUP BY ALL)
SELECT c.time AS c_time, c.state AS c_state, c.m AS c_match, o.time AS o_time, o.state AS o_state, o.m AS o_match FROM (SELECT * FROM c WHERE symbol = 'view') c FULL OUTER JOIN (SELECT * FROM o WHERE symbol = 'view') o ON c.state = o.state AND c.m = o.time AND o.m = c.time""")
def reciprocal_pairs(spark, sf):
    t = signals.transitions(_hold(spark, sf), "state").where("symbol = 'view'")
    near = F.expr("open_time div 7200000 * 7200000")
    c = t.select(F.col("open_time").alias("time"), "state", near.alias("matched_time"))
    o = t.groupBy(near.alias("time"), "state").agg(F.max("open_time").alias("matched_time"))
    return joins.reciprocal(c, o)


@query("SELECT symbol, CAST(open_time AS BIGINT) AS open_time, round(close, 6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 5")
def latest_bars(spark, sf):
    return bars.latest(hourly(spark, sf), 5).select("symbol", "open_time", "close")


@query(", w AS (SELECT symbol, open_time AS a, open_time + 18000000 AS b FROM bars WHERE rn % 7 = 0) SELECT DISTINCT bars.symbol, CAST(open_time AS BIGINT) AS open_time, round(close, 6) AS close FROM bars JOIN w ON w.symbol = bars.symbol AND open_time >= a AND open_time < b")
def preloaded_windows(spark, sf):
    x = ind.placed(hourly(spark, sf))
    w = x.where((F.col("i") + 1) % 7 == 0).select("symbol", F.col("open_time").alias("start"), (F.col("open_time") + 5 * H).alias("end"))
    return bars.preload(x, w, H).select("symbol", "open_time", "close")


@query(", p AS (SELECT symbol, (max(close) OVER (PARTITION BY symbol ORDER BY open_time) - close) / max(close) OVER (PARTITION BY symbol ORDER BY open_time) * 100 AS d FROM bars) SELECT symbol, round(max(d), 6) AS max_drawdown_pct FROM p GROUP BY symbol")
def max_drawdown(spark, sf):
    return measures.drawdown(hourly(spark, sf))


@query(_LR + " SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(sum(a.r), 6) + 0.0 AS sx, round(sum(b.r), 6) + 0.0 AS sy, round(sum(a.r * b.r), 6) + 0.0 AS sxy, CAST(min(a.open_time) AS BIGINT) AS first, CAST(max(a.open_time) AS BIGINT) AS last FROM lr a JOIN lr b ON a.open_time = b.open_time AND a.symbol < b.symbol GROUP BY ALL")
def merged_pair_sums(spark, sf):
    lr = joins.log_returns(hourly(spark, sf))
    odd = F.floor(F.col("open_time") / H) % 2 == 1
    return joins.merge_pairs(joins.pair_sums(lr.where(odd)), joins.pair_sums(lr.where(~odd))).select("a", "b", "n", *[(F.col(c) + 0.0).alias(c) for c in ("sx", "sy", "sxy")], "first", "last")


@query(", x AS (SELECT symbol, open_time, max(high) OVER w AS h, min(low) OVER w AS l FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time RANGE BETWEEN 43200000 PRECEDING AND CURRENT ROW)) SELECT symbol, CAST(open_time AS BIGINT) AS open_time, round((h - l) / l * 100, 6) AS span FROM x")
def rolling_span(spark, sf):
    return hourly(spark, sf).select("symbol", "open_time", ind.rolling_span(fx.DAY // 2).alias("span"))


@query(_LR + ", m AS (SELECT open_time, avg(r) AS r FROM lr GROUP BY open_time), s AS (SELECT stddev_samp(r) AS sd FROM m), n AS (SELECT count(DISTINCT symbol) AS n FROM lr) SELECT DISTINCT symbol, round(least(0.05 / sd, 1.5) / n, 6) AS weight FROM lr, s, n")
def volatility_target_weights(spark, sf):
    return portfolio.volatility_target(joins.log_returns(hourly(spark, sf)), 0.05, 1.5)


def _pick(*options: str) -> str:
    """SQL of the option (v, n, s) with the largest v; of nearly equal ones that with the smaller n."""
    out = options[0]
    for x in options[1:]:
        out = f"(SELECT CASE WHEN y.v > x.v + 16 * 2.220446049250313e-16 * greatest(1, abs(x.v), abs(y.v)) OR abs(y.v - x.v) <= 16 * 2.220446049250313e-16 * greatest(1, abs(x.v), abs(y.v)) AND y.n < x.n THEN y ELSE x END FROM (SELECT {out} AS x, {x} AS y))"
    return out


def _way(k: str, cost: int, s: int) -> str:
    return f"{{'v': m.{k}.v - {cost}, 'n': m.{k}.n + {int(cost > 0)}, 's': {s}}}"


_PATH = f""", d AS (SELECT symbol, rn, open_time, {{'v': CAST(0 AS DOUBLE), 'n': 0, 's': 0}} AS f, {{'v': CAST(-2 AS DOUBLE), 'n': 1, 's': 0}} AS l, {{'v': CAST(-2 AS DOUBLE), 'n': 1, 's': 0}} AS h FROM bars WHERE rn = 1 UNION ALL
SELECT m.symbol, m.rn, m.open_time, {_pick(_way("f", 0, 0), _way("l", 2, 1), _way("h", 2, 2))}, {_pick(_way("l", 0, 1), _way("f", 2, 0), _way("h", 4, 2))}, {_pick(_way("h", 0, 2), _way("f", 2, 0), _way("l", 4, 1))}
FROM (SELECT b.symbol, b.rn, b.open_time, {{'v': d.f.v, 'n': d.f.n}} AS f, {{'v': d.l.v + 2000 * (b.close / b.prev - 1), 'n': d.l.n}} AS l, {{'v': d.h.v - 2000 * (b.close / b.prev - 1), 'n': d.h.n}} AS h FROM d JOIN bars b ON b.symbol = d.symbol AND b.rn = d.rn + 1) m),
e AS (SELECT symbol, rn, {_pick("{'v': f.v, 'n': f.n, 's': 0}", "{'v': l.v, 'n': l.n, 's': 1}", "{'v': h.v, 'n': h.n, 's': 2}")}.s AS state FROM d QUALIFY rn = max(rn) OVER (PARTITION BY symbol)),
t AS (SELECT symbol, rn, state FROM e UNION ALL SELECT d.symbol, d.rn - 1, CASE t.state WHEN 0 THEN d.f.s WHEN 1 THEN d.l.s ELSE d.h.s END FROM t JOIN d ON d.symbol = t.symbol AND d.rn = t.rn WHERE t.rn > 1),
p AS (SELECT bars.symbol, bars.open_time, t.state, coalesce(lag(t.state) OVER (PARTITION BY bars.symbol ORDER BY bars.rn), 0) AS from_state FROM t JOIN bars ON bars.symbol = t.symbol AND bars.rn = t.rn)
SELECT symbol, CAST(open_time AS BIGINT) AS open_time, CAST(from_state AS BIGINT) AS from_state, CAST(state AS BIGINT) AS state FROM p WHERE state <> from_state"""


@query(_PATH)
def perfect_margin_path(spark, sf):
    return oracles.margin_path(hourly(spark, sf), 1000.0, 2.0, 0.001)
