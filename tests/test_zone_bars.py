"""Signals at every bar against a naive computation from each bar's own window, and movement statistics on hand-made bars."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from barloom.operators import movement, zone_bars

FIELDS = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double"


def walk(n, seed=1, symbol="a"):
    rnd, price, rows = random.Random(seed), 100.0, []
    for k in range(n):
        o = price
        price = max(1.0, price * (1 + rnd.gauss(0, 0.01)))
        rows.append((symbol, "1h", datetime(2024, 1, 1) + timedelta(hours=k + 5 * (k // 30)), o, max(o, price) * (1 + abs(rnd.gauss(0, 0.004))), min(o, price) * (1 - abs(rnd.gauss(0, 0.004))), price, rnd.choice([float(rnd.randrange(1, 99)), None])))
    return rows


def naive_levels(w, distance):
    highs, lows = [r[4] for r in w], [r[5] for r in w]
    least, taken = (max(highs) - min(lows)) * distance / 100, []

    def offer(price, kind):
        if all(abs(price - p) >= least for p, _ in taken):
            taken.append((price, kind))

    inner, far = range(2, len(w) - 2), range(5, len(w) - 5)
    for j in inner:
        if lows[j - 2] > lows[j - 1] > lows[j] < lows[j + 1] < lows[j + 2]:
            offer(lows[j], "support")
    for j in inner:
        if highs[j - 2] < highs[j - 1] < highs[j] > highs[j + 1] > highs[j + 2]:
            offer(highs[j], "resistance")
    for j in far:
        if all(highs[j] > highs[x] for x in range(j - 5, j + 6) if x != j):
            offer(highs[j], "resistance")
    for j in far:
        if all(lows[j] < lows[x] for x in range(j - 5, j + 6) if x != j):
            offer(lows[j], "support")
    return taken


def naive_zones(levels, k):
    prices = sorted(p for p, _ in levels)
    k = min(k, len(set(prices)))

    def quantile(q):
        at = q * (len(prices) - 1)
        return prices[int(at)] + (at - int(at)) * (prices[min(int(at) + 1, len(prices) - 1)] - prices[int(at)])

    centres = sorted({quantile((j + 0.5) / k) for j in range(k)})
    for _ in range(20):
        groups = [[] for _ in centres]
        for p, kind in levels:
            groups[min(range(len(centres)), key=lambda j: (abs(p - centres[j]), j))].append((p, kind))
        groups = [g for g in groups if g]
        moved = [sum(p for p, _ in g) / len(g) for g in groups]
        if moved == pytest.approx(centres, rel=1e-12):
            break
        centres = moved
    return [(sum(p for p, _ in g) / len(g), sum(1 if kind == "support" else -1 for _, kind in g)) for g in groups]


def naive_signals(rows, lookback, confirm, distance, k, width, share):
    out = {}
    for t in range(lookback, len(rows) - confirm):
        w, after, price = rows[t - lookback : t + 1], rows[t + 1 : t + 1 + confirm], rows[t][6]
        levels = naive_levels(w, distance)
        if not levels:
            continue
        signals, part = [], lambda flags: sum(flags) / confirm >= share
        zones = naive_zones(levels, k)
        for zone, balance in zones:
            if abs(price - zone) / zone > width:
                continue
            kind = "support" if balance > 0 or balance == 0 and price > zone else "resistance"
            if kind == "support":
                told = "bounce" if part([r[5] >= zone * 0.995 for r in after]) and after[-1][6] > price else "breakout" if price < zone and part([r[6] < zone * 1.005 for r in after]) else None
            else:
                told = "bounce" if part([r[4] <= zone * 1.005 for r in after]) and after[-1][6] < price else "breakout" if price > zone and part([r[6] > zone * 0.995 for r in after]) else None
            if told:
                touch = [(r[7] or 0, r[6] > r[3]) for r in w if r[5] <= zone <= r[4]]
                signals.append((f"{told}_{kind}", zone, sum(v for v, _ in touch), sum(v if up else -v for v, up in touch)))
        near = lambda kind: min(((abs(price - p), p) for p, s in levels if s == kind), default=(99_999.0, 0.0))
        sup, res = near("support"), near("resistance")
        out[rows[t][2]] = (signals, (min(sup[0], res[0]), sup[0], res[0], float(any(abs(price - z) < 0.004 * price for z, _ in zones)), sum(p > price for p, _ in levels), sum(p < price for p, _ in levels), sup[1], res[1]))
    return out


@pytest.mark.parametrize("share,block", [(0.8, 64), (1.0, 4096)])
def test_bar_signals(spark, monkeypatch, share, block):
    monkeypatch.setattr(zone_bars, "BLOCK", block)
    data = {s: walk(n, seed, s) for seed, (s, n) in enumerate({"a": 260, "b": 57, "c": 30}.items())}
    df = spark.createDataFrame([r for rows in data.values() for r in rows] + [("a", "1h", datetime(2024, 1, 1, 0, 30), None, 1.0, 1.0, 1.0, 1.0)], FIELDS).repartition(3)
    got = {(r.symbol, r.ts): r for r in zone_bars.bar_signals(df, share=share, distance=2.0).collect()}
    want = {(s, ts): x for s, rows in data.items() for ts, x in naive_signals(rows, 50, 5, 2.0, 5, 0.01, share).items()}
    assert got.keys() == want.keys() and len(got) > 150
    seen = set()
    for key, (signals, features) in want.items():
        r = got[key]
        assert [(s.signal_type, pytest.approx(s.level_price), s.zone_volume, s.zone_net_volume) for s in r.signals] == signals
        assert (r.snr_dist_to_nearest_level, r.snr_dist_to_nearest_support, r.snr_dist_to_nearest_resistance, r.snr_in_zone, r.snr_num_levels_above, r.snr_num_levels_below, r.snr_nearest_support_level, r.snr_nearest_resistance_level) == pytest.approx(features)
        kinds = {s[0] for s in signals}
        assert all(r[f"signal_{t}"] == float(t in kinds) for t in zone_bars.TYPES)
        seen |= kinds
    assert len(seen) >= 3
    assert zone_bars.bar_signals(df.limit(0)).count() == 0


def test_signals_with_movement(spark):
    df = spark.createDataFrame(walk(300, 5), FIELDS)
    signals = zone_bars.signals_of(zone_bars.bar_signals(df, distance=2.0))
    stats = movement.movement_stats(signals, df, forward=20, back=50)
    assert stats.count() == signals.count() > 0
    assert stats.filter("analysis_period > 20 or entry_price is null").count() == 0


def test_movement_by_hand(spark):
    flat = [("a", "1h", datetime(2024, 1, 1) + timedelta(hours=k), 100.0, 101.0, 99.0, 100.0, 10.0) for k in range(4)]
    after = [(100.0, 104.0, 100.0, 103.0, 20.0), (103.0, 103.0, 99.0, 100.0, 10.0), (100.0, 106.0, 100.0, 105.0, 30.0)]
    rows = flat + [("a", "1h", datetime(2024, 1, 1, 4) + timedelta(hours=k), *x) for k, x in enumerate(after)]
    bars = spark.createDataFrame(rows, FIELDS)
    at = lambda hour, kind, level=100.0: ("a", "1h", datetime(2024, 1, 1, hour), kind, level, "x")
    signals = spark.createDataFrame([at(3, "bounce_support"), at(3, "bounce_support"), at(3, "breakout_support"), at(6, "bounce_support"), at(9, "bounce_support"), at(0, "bounce_resistance", None)], "symbol string, tf string, ts timestamp, signal_type string, level_price double, entry_price string")
    got = movement.movement_stats(signals, bars)
    assert got.count() == 5  # nothing of a time without a bar
    one, two = got.filter("hour(ts) = 3 and signal_type = 'bounce_support'").collect()
    assert one == two
    assert (one.entry_price, one.analysis_period, one.max_favorable_move, one.max_adverse_move, one.final_move) == (100.0, 3, 6.0, 1.0, 5.0)
    assert (one.best_entry_price, one.best_entry_candle, one.optimal_exit_candle, one.time_to_target_1pct) == (99.0, 1, 2, 0)
    # low 99 after the high 104: 4.8 per cent, recovered at the next bar
    assert (one.pullback_occurred, one.pullback_recovery_candles) == (True, 2) and one.max_pullback_pct == pytest.approx(600 / 106)
    assert (one.historical_avg_volume, one.avg_volume_during_move, one.pre_signal_volume_trend) == (10.0, 20.0, 0.0)
    assert one.touches_after_signal == 2 and one.last_touch_candle == 2
    down = got.filter("signal_type = 'breakout_support'").first()
    assert (down.max_favorable_move, down.max_adverse_move, down.final_move, down.level_break_strength) == (1.0, 6.0, -5.0, 1.0)
    last = got.filter("hour(ts) = 6").first()
    assert last.analysis_period == 0 and last.final_move is None and last.entry_price == 105.0
    unknown = got.filter("level_price is null").first()
    assert unknown.max_favorable_move == 1.0 and unknown.touches_after_signal == 0
    assert movement.movement_stats(signals.limit(0), bars).count() == 0


def test_movement_to_a_price_of_zero(spark):
    """Pullbacks from 0 are endless, as in the SQL; a bar that stays there is none or no number."""
    prices = [(100.0, 100.0, 100.0, 100.0), (50.0, 50.0, 0.0, 5.0), (5.0, 8.0, 2.0, 3.0)]
    rows = [("a", "1h", datetime(2024, 1, 1, k), *p, 1.0) for k, p in enumerate(prices)]
    signals = spark.createDataFrame([("a", "1h", datetime(2024, 1, 1), "bounce_resistance", 100.0), ("a", "1h", datetime(2024, 1, 1), "bounce_support", 100.0)], "symbol string, tf string, ts timestamp, signal_type string, level_price double")
    got = {r.signal_type: r for r in movement.movement_stats(signals, spark.createDataFrame(rows, FIELDS)).collect()}
    assert got["bounce_resistance"].pullback_occurred and got["bounce_resistance"].max_pullback_pct == float("inf")
    assert got["bounce_support"].max_pullback_pct == 100.0
    worthless = [("a", "1h", datetime(2024, 1, 1, k), 0.0, 2.0 * k, 0.0, 0.0, 1.0) for k in range(3)]
    one = movement.movement_stats(signals.limit(1), spark.createDataFrame(worthless, FIELDS)).first()
    assert one.max_adverse_pct == float("inf") and one.final_move_pct != one.final_move_pct
