"""Causality, independence of partitions, brute force for folds and scans, and hand cases."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.series import linear_scan
from barloom.operators import backtest, candles, indicators, joins, labels, recursive, scaling, scores, stats, structure, ticks
from barloom.plans.bar_queries import hourly
from barloom.sources import bars as src

from .conftest import DATA

T0 = dt.datetime(2024, 1, 1)


def made_bars(spark, closes, symbol="a", spread=1.0):
    rows = [(symbol, "1 hour", T0 + dt.timedelta(hours=i), float(c), float(c + spread), float(c - spread), float(c), 1000.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, src.BAR_SCHEMA)


CAUSAL = {
    "momentum": (indicators.momentum, "mom"), "bollinger": (indicators.bollinger, "bb_upper"), "vwap": (indicators.rolling_vwap, "vwap"), "obv": (indicators.obv, "obv"), "zones": (indicators.quantile_zones, "support_dist"),
    "ema": (lambda b: recursive.ema(b, "close", 9), "ema_9"), "rsi": (recursive.rsi, "rsi"), "macd": (recursive.macd, "macd_hist"), "supertrend": (recursive.supertrend, "supertrend"), "psar": (recursive.psar, "psar"), "heikin_ashi": (recursive.heikin_ashi, "ha_open"),
    "exhaustion": (indicators.exhaustion, "exhaustion_score"), "window": (lambda b: scaling.feature_window(b, ("close",), 4).withColumn("w", F.to_json("window")), "w"),
}


@pytest.mark.parametrize("name", sorted(CAUSAL))
def test_causal(spark, name):
    """Rows up to a time don't change when later rows go."""
    op, column = CAUSAL[name]
    bars = hourly(spark, DATA).persist()
    cut = dt.datetime(2024, 1, 20)
    key = lambda df: {(r.symbol, r.ts): r[column] for r in df.select("symbol", "ts", column).collect()}
    full, part = key(op(bars)), key(op(bars.filter(F.col("ts") < F.lit(cut))))
    for k, v in part.items():
        assert full[k] == pytest.approx(v, nan_ok=True) if isinstance(v, float) else full[k] == v
    bars.unpersist()


def test_same_with_any_partitioning(spark):
    bars = hourly(spark, DATA)
    ops = lambda b: recursive.rsi(indicators.bollinger(b)).select("symbol", "ts", F.round("rsi", 8).alias("rsi"), F.round("bb_upper", 8).alias("u"))
    one = sorted(map(tuple, ops(bars.repartition(1)).collect()), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(tuple, ops(bars.repartition(9)).collect()), key=repr) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("decay", [0.1, 0.9, 0.995])
def test_linear_scan(spark, decay):
    rng = np.random.default_rng(1)
    x = [None if i % 17 == 3 else float(v) for i, v in enumerate(rng.normal(size=3000))]
    df = spark.createDataFrame([("a", "t", T0 + dt.timedelta(minutes=2 * i), v) for i, v in enumerate(x)], "symbol string, tf string, ts timestamp, b double")
    got = [r.y for r in linear_scan(df, "b", decay, "y").orderBy("ts").collect()]
    y, want = 0.0, []
    for v in x:
        y = y if v is None else decay * y + v
        want.append(None if v is None else y)
    assert [g is None for g in got] == [w is None for w in want]
    assert np.allclose([g for g in got if g is not None], [w for w in want if w is not None], rtol=1e-9, atol=1e-12)


def test_rsi_bounds_and_flat(spark):
    assert {r.rsi for r in recursive.rsi(made_bars(spark, [5.0] * 20)).filter("rsi is not null").select("rsi").collect()} == {50.0}
    rising = [r.rsi for r in recursive.rsi(made_bars(spark, range(1, 30))).orderBy("ts").collect()]
    assert rising[:14] == [None] * 14 and set(rising[14:]) == {100.0}


def test_supertrend_follows_trend(spark):
    closes = [*range(100, 160), *range(160, 100, -1)]
    got = [r.supertrend_dir for r in recursive.supertrend(made_bars(spark, closes), 5, 1.0).orderBy("ts").collect()]
    assert got[40] == 1 and got[-1] == -1 and got[2] == 0


def test_psar_flips(spark):
    got = [r.psar_dir for r in recursive.psar(made_bars(spark, [*range(100, 130), *range(130, 100, -1)])).orderBy("ts").collect()]
    assert got[20] == 1 and got[-1] == -1


def test_zigzag(spark):
    got = [r.zz_pivot for r in recursive.zigzag(made_bars(spark, [100, 104, 110, 106, 99, 95, 100, 108]), 0.05, 0.05).orderBy("ts").collect()]
    assert got == [-1, 0, 1, 0, 0, -1, 0, 0]


def test_positions(spark):
    b = made_bars(spark, range(8)).withColumn("e", F.element_at(F.array(*map(F.lit, [0, 1, 1, 0, 0, -1, 1, 0])), (F.col("close") + 1).cast("int"))).withColumn("x", (F.col("close") == 4).cast("int"))
    got = [(r.position, r.event) for r in recursive.bias_positions(b, "e", "x").orderBy("ts").collect()]
    assert got == [(0, "hold"), (1, "enter"), (1, "add"), (1, "hold"), (0, "exit"), (-1, "enter"), (0, "exit"), (0, "hold")]


def test_non_overlapping(spark):
    b = made_bars(spark, [1, 2, 3, 2, 5, 6, 7]).withColumn("action", F.lit(1))
    got = [(r.taken, r.won) for r in recursive.non_overlapping(b, 2).orderBy("ts").collect()]
    assert [g[0] for g in got] == [1, 0, 1, 0, 1, 0, 0] and [g[1] for g in got if g[0]] == [1.0, 1.0, 1.0]


def test_value_area(spark):
    rows = [("a", T0, float(p), 0.0, 0.0, float(v)) for p, v in [(1, 5), (2, 10), (3, 40), (4, 20), (5, 15), (6, 10)]]
    r = ticks.value_area(spark.createDataFrame(rows, "symbol string, bar timestamp, level double, buy double, sell double, total double")).first()
    assert (r.poc, r.val, r.vah, r.area_volume) == (3.0, 3.0, 5.0, 75.0)


def test_tick_rule(spark):
    df = spark.createDataFrame([("a", T0, p, 1.0, i) for i, p in enumerate([5.0, 5.0, 6.0, 6.0, 4.0, 4.0])], "symbol string, ts timestamp, price double, volume double, seq long")
    assert [r.side for r in ticks.classify(df).orderBy("seq").collect()] == [1.0, 1.0, 1.0, 1.0, -1.0, -1.0]


def test_asof_matches_pandas(spark):
    rng = np.random.default_rng(4)
    times = lambda n: [T0 + dt.timedelta(minutes=int(m)) for m in sorted(rng.integers(0, 500, n))]
    base = pd.DataFrame({"symbol": "a", "ts": times(80), "x": range(80)})
    other = pd.DataFrame({"symbol": "a", "ts": sorted(set(times(60)))}).assign(y=lambda d: np.arange(len(d), dtype=float))
    for strict in (False, True):
        got = joins.asof(spark.createDataFrame(base), spark.createDataFrame(other), ("y",), strict=strict).toPandas().sort_values("x")
        want = pd.merge_asof(base, other[["ts", "y"]], on="ts", allow_exact_matches=not strict)
        assert np.allclose(got["y"].to_numpy(float), want["y"].to_numpy(float), equal_nan=True)


def test_fifo(spark):
    fills = lambda symbol, sides: [(i, symbol, side, p, q, T0 + dt.timedelta(hours=i)) for i, (side, p, q) in enumerate(sides)]
    kind = "id long, symbol string, side string, price double, qty double, ts timestamp"
    rows = fills("a", [("buy", 10.0, 2.0), ("buy", 11.0, 2.0), ("sell", 12.0, 1.0), ("sell", 10.0, 2.0), ("sell", 9.0, 2.0)])
    got = joins.fifo_match(spark.createDataFrame(rows, kind)).orderBy("id").collect()
    assert [(r.side, r.pnl, r.pnl_pct) for r in got] == [("buy", -8.0, -40.0), ("buy", -2.0, pytest.approx(-100 / 11)), ("sell", 0.0, 0.0)]
    # a sell before any buy stays alone, whatever comes later
    got = joins.fifo_match(spark.createDataFrame(fills("b", [("sell", 5.0, 1.0), ("buy", 4.0, 1.0), ("sell", 6.0, 1.0)]), kind)).orderBy("id").collect()
    assert [(r.side, r.pnl) for r in got] == [("sell", 0.0), ("buy", 2.0)]
    rng = np.random.default_rng(3)
    rows = [r for k in ("x", "A/B") for r in fills(k, [(str(rng.choice(["buy", "sell"])), float(p), float(q)) for p, q in rng.uniform(1, 9, (80, 2)).round(2)])]
    want = []
    for symbol in ("x", "A/B"):
        open_buys = []
        for i, k, side, p, q, _ in rows:
            if k == symbol and side == "buy":
                open_buys.append((p, q))
            elif k == symbol:
                paid = open_buys.pop(0) if open_buys else None
                want.append((k, i, round(p * q * (0.9975 if "/" in k else 1) - paid[0] * paid[1], 6) if paid else 0.0))
    got = joins.fifo_match(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.symbol, r.id, round(r.pnl, 6)) for r in got) == sorted(want)


def test_event_pairing_ties(spark):
    kind = "symbol string, direction string, ts timestamp, strength double"
    at = lambda h: T0 + dt.timedelta(hours=h)
    h1 = spark.createDataFrame([("a", "bullish", at(3), 1.0), ("a", "bullish", at(3), 2.0), ("a", "bearish", at(3), 3.0)], kind)
    h4 = spark.createDataFrame([("a", "bullish", at(0), 10.0), ("a", "bullish", at(9), 20.0)], kind)
    got = [(r.direction, r.strength, r.h4_strength, r.composite) for r in joins.event_pairing(h1, h4).collect()]
    assert sorted(got, key=str) == sorted([("bullish", 1.0, 10.0, 3.7), ("bullish", 2.0, 10.0, pytest.approx(4.4)), ("bearish", 3.0, None, 3.0), ("bullish", None, 20.0, 20.0)], key=str)


def test_scores(spark):
    kind = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double, lvl double, atr double"
    bars = [("a", "1 hour", T0 + dt.timedelta(hours=i), *x) for i, x in enumerate([(9.9, 10.0, 8.0, 10.0, 1.0, 50.0, 1.0), (9.9, 10.0, 8.0, 10.0, 1.0, 10.5, 1.0), (8.1, 10.0, 8.0, 8.0, 1.0, 50.0, 1.0), (5.0, 5.0, 5.0, 5.0, 1.0, 5.0, 1.0)])]
    got = scores.candle_scores(scores.pin_bar(spark.createDataFrame(bars, kind), ("lvl",), "atr")).orderBy("ts").collect()
    raw = (0.95 - 0.6) / 0.4 * (1 - 0.05 / 0.3)
    assert [r.pin_bull for r in got] == pytest.approx([raw, min(1, raw * 1.4), 0, 0]) and [r.pin_bear for r in got] == pytest.approx([0, 0, raw, 0])
    assert got[2].pin_recent_bull == pytest.approx((0.55 * min(1, raw * 1.4) + 0.25 * raw) / 1.8) and [r.pin_at_level for r in got] == [0, 1, 0, 1]
    # first bar: body 0.05, close at the top, long lower wick; nothing before it
    up = 0.05 * 0.25 + 0.20 + 0.95 * 0.15 + 0.15 + 0.5 * 0.10 + 0.5 * 0.10 + 0.5 * 0.05
    assert got[0].candle_bull_score == pytest.approx(up)
    assert all(0 <= r.candle_bear_score <= 1 and 0 <= r.candle_bull_score <= 1 for r in got)


def test_first_break(spark):
    b = made_bars(spark, [10, 12, 9, 13, 8])
    lv = spark.createDataFrame([("a", "1 hour", "u", T0, 11.5, 1), ("a", "1 hour", "d", T0, 8.5, -1), ("a", "1 hour", "n", T0, 99.0, 1)], "symbol string, tf string, level_id string, ts timestamp, price double, side int")
    got = {r.level_id: r.broken_at for r in structure.first_break(lv, b).collect()}
    assert got == {"u": T0 + dt.timedelta(hours=1), "d": T0 + dt.timedelta(hours=4), "n": None}


def test_scaler_round_trip(spark):
    b = scaling.split_sequential(hourly(spark, DATA))
    kinds = {"open": "minmax", "high": "standard", "close": "robust"}
    fitted = scaling.fit_scaler(b, tuple(kinds))
    back = scaling.invert_scaler(scaling.apply_scaler(b, fitted, kinds), fitted, kinds)
    d = back.select("symbol", "ts", F.col("open").alias("o"), F.col("high").alias("h"), F.col("close").alias("c")).join(b, ["symbol", "ts"])
    assert d.agg(F.max(F.greatest(F.abs(F.col("o") - F.col("open")), F.abs(F.col("h") - F.col("high")), F.abs(F.col("c") - F.col("close"))))).first()[0] < 1e-9
    # the fit doesn't see later rows
    again = scaling.fit_scaler(b.withColumn("close", F.when(F.col("split") == "train", F.col("close")).otherwise(1e9)), ("close",))
    assert sorted(r.close_max for r in again.collect()) == sorted(r.close_max for r in scaling.fit_scaler(b, ("close",)).collect())


def test_split_boundaries(spark):
    for n in (1, 7, 100):
        got = [r.split for r in scaling.split_sequential(made_bars(spark, range(n))).orderBy("ts").collect()]
        assert (got.count("train"), got.count("val")) == (int(n * 0.7), int(n * 0.15)) and got == sorted(got, key=["train", "val", "test"].index)


def test_window_is_padded_and_ends_at_its_row(spark):
    got = [r.window for r in scaling.feature_window(made_bars(spark, [1, 2, 3, 4]), ("close",), 3).orderBy("ts").collect()]
    assert got == [[0, 0, 1], [0, 1, 2], [1, 2, 3], [2, 3, 4]]


def test_streaks(spark):
    df = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), i, w) for i, w in enumerate([1, 1, 0, 1, 0, 0, 0])], "symbol string, ts timestamp, seq long, win int")
    r = backtest.streak_stats(df).first()
    assert (r.max_win_run, r.max_loss_run, r.last_run, r.n_win_runs) == (2, 3, -3, 2)
    assert [x.size for x in backtest.equity_curve(df, step=True).orderBy("seq").collect()] == [1, 1, 1, 2, 1, 2, 4]


def test_scans(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Time,O,H,L,C,V,open\n2024-01-01 00:00:00,1,2,0.5,1.5,10,9\n1704070800,1,nan,0.5,inf,x,9\n")
    got = src.scan_bars_csv(spark, str(tmp_path / "b.csv"), "a", "1 hour").orderBy("ts").collect()
    assert [(r.open, r.high, r.close) for r in got] == [(1.0, 2.0, 1.5), (1.0, None, None)] and got[1].ts == dt.datetime(2024, 1, 1, 1)
    with pytest.raises(ValueError, match="close"):
        src.require(spark.createDataFrame([(1.0,)], "open double"), ("open", "close"))
    raw = spark.createDataFrame([('{"t": "1704067200000", "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 3, "symbol": "a"}',), ('{"time": "2024-01-01T01:00:00", "open": 2, "close": 3}',)], "value string")
    got = src.scan_bars_json(raw).orderBy("ts").collect()
    assert [r.ts for r in got] == [T0, T0 + dt.timedelta(hours=1)] and [r.close for r in got] == [1.5, 3.0]
    made_bars(spark, range(50)).write.parquet(f"{tmp_path}/t")
    assert src.scan_bars_table(spark, f"{tmp_path}/t", symbol="a", close=(10, 19)).count() == 10
    texts = spark.createDataFrame([("1", "x"), ("?", "y")], "a string, b string")
    assert dict(src.restore_numeric_types(texts).dtypes) == {"a": "double", "b": "string"}
    assert src.json_rows(spark.createDataFrame([(1.0, float("nan"))], "a double, b double")).first().json == '{"a":1.0}'


def test_labels_have_no_future_in_the_tail(spark):
    b = labels.horizon_moves(labels.mfe_mae(made_bars(spark, range(1, 31)), 24), (3,))
    got = b.orderBy("ts").collect()
    assert [r.mfe > 0 for r in got] == [True] * 6 + [False] * 24 and [r.forward_move_3 for r in got][-4:] == [3.0, None, None, None]


def test_confidence_and_names(spark):
    r = candles.prediction_confidence(spark.createDataFrame([([0.7, 0.2, 0.1],)], "p array<double>"), "p").first()
    assert r.confidence == pytest.approx(0.7) and r.margin == pytest.approx(0.5) and 0 < r.uncertainty < 1
    r = spark.createDataFrame([("spy", dt.date(2024, 3, 15), "call", 412.5)], "r string, e date, k string, s double").select(candles.occ_symbol(F.col("r"), F.col("e"), F.col("k"), F.col("s")).alias("o")).first()
    assert r.o == "SPY240315C00412500"


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    inv = np.linalg.inv(np.corrcoef(x.T))
    assert [r.vif for r in stats.vif(df, ("a", "b", "c")).orderBy("column").collect()] == pytest.approx(np.diag(inv).tolist())
    part = {(r.a, r.b): r.r for r in stats.partial_correlations(df, ("a", "b", "c")).collect()}
    assert part["a", "c"] == pytest.approx(-inv[0, 2] / np.sqrt(inv[0, 0] * inv[2, 2]))
    d = x - x.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x.T)), d))
    assert np.allclose([r.distance for r in stats.mahalanobis(df, ("a", "b", "c"), "id").orderBy("id").collect()], want)
    rank = pd.DataFrame(np.round(x, 1), columns=list("abc")).corr("spearman")
    got = {(r.a, r.b): r.r for r in stats.spearman_pairs(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(np.round(x, 1))], "id long, a double, b double, c double"), ("a", "b", "c"), "id").collect()}
    assert got["a", "c"] == pytest.approx(rank.loc["a", "c"])


def test_level_snapshots_are_spaced_and_known(spark):
    from barloom.operators import zones

    bars = hourly(spark, DATA)
    snaps = zones.level_snapshots(bars, min_distance=0.05).collect()
    assert len(snaps) > 50
    for r in snaps:
        prices = [x.price for x in r.levels]
        assert all(abs(a - b) >= 0.05 * min(a, b) * 0.95 for i, a in enumerate(prices) for b in prices[i + 1 :])
    cut = dt.datetime(2024, 1, 20)
    part = {(r.symbol, r.period): r.levels for r in zones.level_snapshots(bars.filter(F.col("ts") < F.lit(cut)), min_distance=0.05).collect()}
    full = {(r.symbol, r.period): r.levels for r in snaps}
    assert all(full[k] == v for k, v in part.items() if k[1] <= cut)
    z = zones.cluster_zones(zones.level_snapshots(bars)).collect()
    assert all(r.lower <= r.price <= r.upper for r in z) and max(r.zone for r in z) < 8


def test_zone_signals(spark):
    from barloom.operators import zones

    b = made_bars(spark, [100, 103, 104, 105, 100, 95, 94, 93]).withColumn("zones", F.array(F.struct(F.lit(99.5).alias("price"), F.lit(99.0).alias("lower"), F.lit(100.0).alias("upper"), F.lit("support").alias("kind"))))
    got = [(r.signal, r.signal_side) for r in zones.zone_signals(b, 0.01, 3).orderBy("ts").collect()]
    assert got[0] == ("bounce", 1) and got[4] == ("breakout", -1) and got[5] == (None, None)
    r = zones.snr_features(b).orderBy("ts").first()
    assert (r.zones_below, r.zones_above, r.in_zone, r.resistance_price) == (1, 0, True, 99_999.0)


def test_mtf_rsi_without_closed_bars_is_the_own_one(spark):
    b = made_bars(spark, [*range(100, 130), *range(130, 110, -1)])
    out = recursive.mtf_rsi(b, {"d": (src.resample_bars(b, "1 day"), F.expr("interval 1 day"), 0.6)}, n=5).orderBy("ts").collect()
    assert all(r.mtf_rsi == pytest.approx(r.rsi) for r in out if r.rsi is not None and r.rsi_d is None)
    assert all(0 <= r.mtf_rsi <= 100 for r in out if r.mtf_rsi is not None)
