"""Fixtures with known results, and brute-force twins of what SQL can't say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelattice.functions import scalars as fx
from tidelattice.operators import bars, joins, ledger, measures, oracles, portfolio, ranking, signals
from tidelattice.operators import indicators as ind
from tidelattice.plans import queries as plans
from tidelattice.sources import market
from tidelattice.streaming import bars as stream

H = fx.HOUR


def series(spark, closes, step=H, symbol="x", volume=1.0):
    return spark.createDataFrame([(symbol, i * step, float(c), float(c), float(c), float(c), volume, (i + 1) * step - 1) for i, c in enumerate(closes)], "symbol string, open_time long, open double, high double, low double, close double, volume double, close_time long")


def column(df, name):
    return [r[name] for r in df.orderBy("open_time").collect()]


def test_lookback_sma_regression(spark):
    x = series(spark, [1, 2, 4, 8])
    old, change = ind.lookback("close", 2)
    assert column(x.select("open_time", old.alias("o")), "o")[-1] == 2
    assert column(x.select("open_time", change.alias("d")), "d")[-1] == 6
    assert column(series(spark, [-1, 0, 2]).select("open_time", ind.sma("close", 3).alias("m")), "m")[-1] == pytest.approx(1 / 3)
    g = ind.regression("close", 4)
    y = ind.placed(series(spark, [0, -2, -4, -6])).select("open_time", g["slope"].alias("s"), g["next"].alias("n"))
    assert column(y, "s")[-1] == pytest.approx(-2) and column(y, "n")[-1] == pytest.approx(-8)


def test_kernels():
    e = ind.Ema(1.0)
    e.step(-2)
    assert e.step(-4) == -4 and e.change == -2
    zero = ind.Ema(0.5)  # a state of 0 is no state
    assert [zero.step(v) for v in (0.0, 4.0, 0.0)] == [0.0, 4.0, 2.0]
    rows = [(float(p), 1.0) for p in (3, 4, 3, 5, 6, 7, 6, 8)]
    assert list(ind.kama(n=3, volume_power=0.0)(iter(rows))) == list(ind.kama(n=3, volume_power=0.0, cap=9.0)(iter(rows)))
    assert [v for (v,) in ind.rate_noise(1)(iter([(1.0,), (3.0,), (2.0,)]))] == [0.0, 2.0, 1.0]


def test_signal_memory_consumes_rejected_edges():
    out = list(signals.accepted_signals(0.05)(iter([(1, 100.0), (-1, 101.0), (-1, 120.0), (1, 121.0), (-1, 130.0)])))
    assert [a for a, _ in out] == [1, 1, 1, 1, -1]
    hold = [v for (v,) in signals.clamped_rate("hold", 1, 2)(iter([(1.5,), (3.0,), (1.5,), (-1.5,)]))]
    assert hold == [0.0, 3.0, 3.0, -1.5]
    hyst = [v for (v,) in signals.clamped_rate("hysteresis", 1, 2, 0.5)(iter([(1.5,), (2.5,), (0.6,), (0.4,)]))]
    assert hyst == [0.0, 2.5, 0.6, 0.0]


def test_perfect_margin():
    out = list(oracles.perfect_margin(1000.0, 1.0, 0.0)(iter([(100.0,), (110.0,), (100.0,)])))
    assert out[-1][3] > 190


def test_exposure_oracle_and_continuation():
    up = oracles.exposure_values(np.array([100.0, 110.0]), 21, 1.0, 0.0)
    assert oracles.preference(up[1][0], up[0], 0.005)["mean"] > 0.5
    down = oracles.exposure_values(np.array([100.0, 90.0]), 21, 1.0, 0.0)
    assert oracles.preference(down[1][0], down[0], 0.005)["mean"] < -0.5
    rng = np.random.default_rng(3)
    grid, value, at = np.linspace(-1, 1, 31), rng.normal(size=31), rng.uniform(-1, 1, 50)
    brute = (value[None, :] + oracles.rebalance(at[:, None], grid[None, :], 0.01)).max(axis=1)
    assert np.allclose(oracles.continuation(value, grid, at, 0.01), brute)


def test_policies():
    grid = np.linspace(-1, 1, 41)
    target = oracles.strategy_distribution(0.7, -1.1, grid)
    b = oracles.fit_quadratic(grid, np.stack([target, target]))
    assert b == pytest.approx((0.7, -1.1), abs=1e-6)
    x = oracles.bfgs(lambda v: (float(((v - 3) ** 2).sum()), 2 * (v - 3)), np.zeros(3))
    assert np.allclose(x, 3, atol=1e-6)
    p = oracles.transition_policy(np.zeros(41), grid, 0.001, 0.01)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == np.arange(41)).all()
    assert oracles.four_segment(grid, 0.2, (1.0, 0.0), [(0.0, 0.0)] * 3, (-0.5, 0.5), 8.0).sum() == pytest.approx(1)


def test_truncated_exponential(spark):
    x = spark.createDataFrame([(0.0,), (1.3,), (-2.0,)], "b double").select("b", fx.truncated_exponential_log_partition("b", -1, 1, 21).alias("z"))
    grid = np.linspace(-1, 1, 21)
    for r in x.collect():
        assert r["z"] == pytest.approx(np.log(np.exp(r["b"] * grid).sum()))


@pytest.mark.parametrize(
    "cand, oracle, window, half, want",
    [
        ([(8, 1), (9, 1)], [(0, 1), (10, 1)], 20, 10, [(8, 0), (9, 10)]),
        ([(90, 1), (99, 1)], [(100, 1)], 20, 10, [(99, 100)]),
        ([(100, 0)], [(100, -1)], 1000, 100, []),
    ],
)
def test_alignment(spark, cand, oracle, window, half, want):
    make = lambda rows: spark.createDataFrame([("x", *r) for r in rows], "symbol string, time long, state int")
    got = signals.align(make(cand), make(oracle), window, half).orderBy("candidate_time").collect()
    assert [(r["candidate_time"], r["oracle_time"]) for r in got] == want


def test_ranges_segments_and_gaps(spark):
    x = series(spark, range(1, 9)).where(F.col("open_time") != 3 * H)
    assert {r["segment"] for r in bars.segments(x, H).collect()} == {0, 1}
    gap = bars.missing_ranges(x, H).collect()
    assert [(g["start"], g["end"]) for g in gap] == [(3 * H, 4 * H - 1)]
    assert bars.continuous_suffix(x, H).count() == 4
    strict = bars.resample_strict(x, H, 2 * H)
    assert sorted(r["open_time"] for r in strict.collect()) == [0, 4 * H, 6 * H]


def test_nearest_prefers_the_earlier(spark):
    left = spark.createDataFrame([("x", 10, 1), ("x", 17, 2)], "symbol string, event_time long, id long")
    right = spark.createDataFrame([("x", 5, 1.0), ("x", 15, 2.0)], "symbol string, event_time long, price double")
    assert {r["id"]: r["near_time"] for r in joins.nearest(left, right).collect()} == {1: 5, 2: 15}


def test_paper_account_and_lots(spark):
    a = ledger.PaperAccount(100.0, 0.01)
    a.place("buy", 2.0, limit=10.0)
    a.tick(0, 11.0)
    a.tick(1, 9.0, 0.5)
    assert a.filled == [(1, "buy", 0.5, 10.0)] and a.quote == pytest.approx(100 - 5 * 1.01)
    rows = spark.createDataFrame([(1, 1, 1, "buy", 2.0, 20.0, 0.0), (1, 2, 2, "sell", 1.0, 15.0, 0.0), (1, 3, 3, "sell", 2.0, 24.0, 0.0)], "account long, time long, id long, side string, quantity double, quote double, fee double")
    got = {r["lot"]: r for r in ledger.lots(rows).collect()}
    assert got[1]["status"] == "closed" and got[1]["profit"] == pytest.approx(7.0)
    assert got[3]["side"] == "short" and got[3]["remaining"] == 1.0


def test_portfolio_and_ranking(spark):
    assert list(portfolio.within_gross(np.array([0.2, 0.2]), 1.0)) == [0.2, 0.2]
    assert ranking.merge_rankings([["a", "b"], ["b", "c"]], 3) == ["a", "b", "c"]
    best, score = ranking.evolve(lambda m: -((m - 0.3) ** 2).sum(axis=1), 3, 24, 40)
    assert score > -1e-2 and best.shape == (3,)
    x = spark.createDataFrame([("k", 0, "a"), ("j", 1, "b"), ("k", 2, "c")], "id string, place long, v string")
    assert {(r["id"], r["place"], r["v"]) for r in ranking.last_at_first_place(x, "id", "place").collect()} == {("k", 0, "c"), ("j", 1, "b")}


def test_parsers(spark):
    lines = lambda *t: spark.createDataFrame([(x,) for x in t], "value string")
    k = market.kline_rows(lines('[1000,"1","2","0.5","1.5","9",1999]', "oops")).collect()
    assert len(k) == 1 and k[0]["close"] == 1.5
    t = market.trade_messages(lines('{"s":"A","p":"2.5","T":7}')).first()
    assert (t["event_time"], t["quantity"]) == (7, 0.0)
    d = market.depth_messages(lines('{"s":"A","bids":[["1","2"]],"asks":[["3","1"]]}', '{"s":"A","bids":[],"asks":[["3","1"]]}'))
    assert d.select(market.book_mid().alias("m")).collect()[0]["m"] == 2.0 and d.count() == 1
    assert [r["cells"] for r in market.markdown_rows(lines("| a | b |", "| --- | --- |", "| 1 | 2 |")).collect()] == [["a", "b"], ["1", "2"]]


def test_bar_shards_round_trip(spark, tmp_path):
    x = series(spark, range(1, 50)).withColumn("closed", F.lit(True))
    market.write_bars(x, str(tmp_path / "bars"))
    got = market.read_bars(spark, str(tmp_path / "bars"), start=24 * H, end=30 * H)
    assert sorted(r["open_time"] for r in got.collect()) == [h * H for h in range(24, 31)]


def test_streams(spark, tmp_path):
    x = series(spark, range(1, 9)).withColumn("closed", F.col("open_time") != 2 * H)
    x.unionByName(x).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(x.schema).parquet(str(tmp_path / "in"))
    for name, df, n in (("once", stream.closed_once(source), 7), ("ema", stream.running_ema(source.where("closed"), 3, H), 7)):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        assert spark.sql(f"select distinct symbol, open_time from {name}").count() == n


def test_registry_has_sql_names():
    assert set(plans.SQL) <= set(plans.QUERIES) and len(plans.QUERIES) > 70


@pytest.mark.parametrize("name", ["resample_strict", "ema", "kama", "signal_hold", "perfect_margin_oracle", "pair_correlation", "nearest_extremum", "portfolio_weights"])
def test_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = plans.QUERIES[name](spark, sf)
    want = c.sql(plans.SQL[name])
    at = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(r[k] for k in sorted(got.columns)) for r in got.collect()), key=str)
    assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_drawdown(spark):
    assert measures.drawdown(series(spark, [100, 50, 80])).first()["max_drawdown_pct"] == 50
    assert list(measures.zigzag(10)(iter([(100.0,), (120.0,), (100.0,), (99.0,), (130.0,)])))[-1] == (2,)
