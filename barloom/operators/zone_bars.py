"""Levels, zones and signals at every bar, from the bars up to it.

A series is cut into blocks of rows by number; each block also gets the rows before it that its first bars look back to and
the few after it that confirm its last ones. Within a block levels enter and leave the window as it slides: only when a
candidate or the window's range changes are levels chosen and clustered anew.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import KEYS
from .movement import numbered_days

#: Bars of a block, besides those that it looks back to.
BLOCK = 4096
#: Bars on both sides of a fractal and of a pivot.
NEAR, FAR = 2, 5
#: What stands for a distance where there is nothing; how near (relative) is in a zone; by how much a zone may be overshot.
NOTHING, IN_ZONE, SLACK = 99_999.0, 0.004, 0.005
TYPES = ("bounce_support", "bounce_resistance", "breakout_support", "breakout_resistance")
_FEATURES = ("snr_dist_to_nearest_level", "snr_dist_to_nearest_support", "snr_dist_to_nearest_resistance", "snr_in_zone", "snr_num_levels_above", "snr_num_levels_below", "snr_nearest_zone_volume", "snr_nearest_support_level", "snr_nearest_resistance_level")


def lloyd(prices: np.ndarray, k: int, rounds: int = 20) -> list[np.ndarray]:
    """Members (indices) of at most k clusters of prices, by ascending centre: Lloyd steps from quantile seeds, ties to the lower."""
    order = np.argsort(prices, kind="stable")
    x = prices[order]
    k = min(k, len(np.unique(x)))
    centre = np.unique(np.quantile(x, (np.arange(k) + 0.5) / k))
    cuts = np.empty(0, np.int64)
    for _ in range(rounds):
        cuts = np.searchsorted(x, (centre[1:] + centre[:-1]) / 2, side="right")
        parts = [p for p in np.split(x, cuts) if len(p)]
        moved = np.array([p.mean() for p in parts])
        if len(moved) == len(centre) and np.allclose(moved, centre, rtol=1e-12, atol=0):
            break
        centre = moved
    cuts = np.searchsorted(x, (centre[1:] + centre[:-1]) / 2, side="right")
    return [p for p in np.split(order, cuts) if len(p)]


def _runs(extreme: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of five-bar fractals and of pivots (strictly beyond FAR bars on both sides); sign 1 for tops, -1 for bottoms."""
    x, n = extreme * sign, len(extreme)
    if n < 2 * NEAR + 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m = x[2:-2]
    fractal = np.flatnonzero((m > x[1:-3]) & (m > x[3:-1]) & (x[3:-1] > x[4:]) & (x[1:-3] > x[:-4])) + 2
    if n < 2 * FAR + 1:
        return fractal, np.empty(0, np.int64)
    around = np.lib.stride_tricks.sliding_window_view(x, 2 * FAR + 1)
    others = np.delete(np.arange(2 * FAR + 1), FAR)
    return fractal, np.flatnonzero(around[:, FAR] > around[:, others].max(axis=1)) + FAR


class _Window:
    """Levels and zones of the window that ends at a bar."""

    def __init__(self, o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray, back: int, distance: float, k: int) -> None:
        self.low, self.high, self.volume, self.rising = low, h, v, c > o
        self.back, self.k = back, k
        tops, bottoms = _runs(h, 1), _runs(low, -1)
        # in this order levels are taken: kind, places, prices, bars needed on both sides
        self.kinds = [(-1, bottoms[0], low, NEAR), (1, tops[0], h, NEAR), (1, tops[1], h, FAR), (-1, bottoms[1], low, FAR)]
        if len(h) > back:
            slide = np.lib.stride_tricks.sliding_window_view
            self.least = (slide(h, back + 1).max(axis=1) - slide(low, back + 1).min(axis=1)) * (distance / 100)
        self.key: tuple | None = None
        self.levels: list[tuple[float, int]] = []
        self.zones: list[tuple[float, int]] = []  # mean price, and how many more supports than resistances

    def at(self, t: int) -> None:
        a = t - self.back
        spans = tuple(tuple(np.searchsorted(places, (a + need, t - need + 1))) for _, places, _, need in self.kinds)
        key = (spans, self.least[a])
        if key == self.key:
            return
        self.key, least = key, self.least[a]
        self.levels, taken = [], []
        for (side, places, prices, _), (b, e) in zip(self.kinds, spans, strict=True):
            for price in prices[places[b:e]].tolist():
                i = bisect_left(taken, price)
                if (i == len(taken) or taken[i] - price >= least) and (i == 0 or price - taken[i - 1] >= least):
                    insort(taken, price)
                    self.levels.append((price, side))
        self.zones = []
        if self.levels:
            prices, sides = np.array([p for p, _ in self.levels]), np.array([s for _, s in self.levels])
            self.zones = [(float(prices[m].mean()), -int(sides[m].sum())) for m in lloyd(prices, self.k)]

    def volumes(self, t: int, price: float) -> tuple[float, float]:
        """Volume of the window's bars that touch a price, all and rising less falling."""
        part = slice(t - self.back, t + 1)
        touch = (self.low[part] <= price) & (self.high[part] >= price)
        v, up = self.volume[part][touch], self.rising[part][touch]
        return float(v.sum()), float(v[up].sum() - v[~up].sum())


def _features(price: float, w: _Window, t: int) -> tuple:
    gaps = {side: min(((abs(price - p), n, p) for n, (p, s) in enumerate(w.levels) if s == side), default=None) for side in (-1, 1)}
    found = [g for g in gaps.values() if g]
    away = lambda side: gaps[side][0] if gaps[side] else NOTHING
    level = lambda side: gaps[side][2] if gaps[side] else 0.0
    nearest = min(((abs(price - p), n) for n, (p, _) in enumerate(w.zones)), default=None)
    volume = w.volumes(t, w.zones[nearest[1]][0])[0] if nearest else 0.0
    return (
        min((g[0] for g in found), default=NOTHING), away(-1), away(1), int(any(abs(price - p) < IN_ZONE * price for p, _ in w.zones)),
        sum(p > price for p, _ in w.levels), sum(p < price for p, _ in w.levels), volume, level(-1), level(1),
    )


def _signal(price: float, zone: float, balance: int, highs: np.ndarray, lows: np.ndarray, closes: np.ndarray, share: float) -> tuple[str, str] | None:
    """Kind of signal and of zone, if the bars after confirm one."""
    support = balance > 0 or balance == 0 and price > zone
    enough = lambda flags: flags.mean() >= share
    if support:
        if enough(lows >= zone * (1 - SLACK)) and closes[-1] > price:
            return "bounce_support", "support"
        if price < zone and enough(closes < zone * (1 + SLACK)):
            return "breakout_support", "support"
    else:
        if enough(highs <= zone * (1 + SLACK)) and closes[-1] < price:
            return "bounce_resistance", "resistance"
        if price > zone and enough(closes > zone * (1 - SLACK)):
            return "breakout_resistance", "resistance"
    return None


def bar_signals(df: DataFrame, lookback: int = 50, confirm: int = 5, distance: float = 0.02, k: int = 5, width: float = 0.01, share: float = 0.8, bucket: str = "day") -> DataFrame:
    """Every bar with ``lookback`` bars before it and ``confirm`` after it: level features (``snr_*``), ``signal_*`` flags and ``signals``. Z09, Z10

    Levels at a bar are five-bar fractals and pivots complete by then, taken as supports, resistances, pivot highs, pivot
    lows, each only if at least ``distance`` per cent of the window's range away from all before; zones are at most k
    clusters of them. A zone within ``width`` of the close signals a bounce if ``share`` of the next ``confirm`` bars keep to
    its side (half a per cent of slack) and the last closes further on, else a breakout if the close is beyond it and that
    share of closes stays there. ``share`` 1 is the strict form. Signals are known ``confirm`` bars later; one bar may have several.

    Bars with a null price are left out before all else; a null volume counts 0. An empty table gives no rows.
    """
    if lookback < 1 or confirm < 1:
        raise ValueError("lookback and confirm must be positive")
    whole = df.filter(F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull())
    days = numbered_days(whole, bucket)
    rows = days.select(*KEYS, "_ahead", F.posexplode("_rows").alias("_p", "_r")).select(*KEYS, (F.col("_ahead") + F.col("_p")).alias("i"), "_r.*")
    rows = rows.withColumn("block", F.explode(F.sequence(F.greatest(F.floor((F.col("i") - confirm) / BLOCK), F.lit(0)), F.floor((F.col("i") + lookback) / BLOCK))))
    stamp = df.schema["ts"].dataType.simpleString()
    out = f"symbol string, tf string, ts {stamp}, {', '.join(f'{c} double' for c in _FEATURES)}, {', '.join(f'signal_{t} double' for t in TYPES)}, signals array<struct<signal_type: string, level_price: double, zone_kind: string, zone_volume: double, zone_net_volume: double>>"

    def run(p: pa.Table) -> pa.Table:
        p = p.sort_by("i")
        i = p["i"].to_numpy()
        o, h, low, c, v = (p[n].fill_null(0.0).to_numpy() for n in ("open", "high", "low", "close", "volume"))
        w = _Window(o, h, low, c, v, lookback, distance, k)
        block = p["block"][0].as_py()
        begin, end = np.searchsorted(i, (block * BLOCK, (block + 1) * BLOCK))
        at, features, flags, signals = [], [], [], []
        for t in range(max(begin, lookback), min(end, len(i) - confirm)):
            w.at(t)
            if not w.levels:
                continue
            price, own = float(c[t]), []
            after = slice(t + 1, t + 1 + confirm)
            for zone, balance in w.zones:
                if zone and abs(price - zone) / zone <= width:
                    told = _signal(price, zone, balance, h[after], low[after], c[after], share)
                    if told:
                        total, net = w.volumes(t, zone)
                        own.append({"signal_type": told[0], "level_price": zone, "zone_kind": told[1], "zone_volume": total, "zone_net_volume": net})
            at.append(t)
            features.append(_features(price, w, t))
            flags.append([float(any(s["signal_type"] == kind for s in own)) for kind in TYPES])
            signals.append(own)
        table = p.select(["symbol", "tf", "ts"]).take(pa.array(at, pa.int64()))
        for n, name in enumerate(_FEATURES):
            table = table.append_column(name, pa.array([float(f[n]) for f in features], pa.float64()))
        for n, kind in enumerate(TYPES):
            table = table.append_column(f"signal_{kind}", pa.array([f[n] for f in flags], pa.float64()))
        kind = pa.list_(pa.struct([("signal_type", pa.string()), ("level_price", pa.float64()), ("zone_kind", pa.string()), ("zone_volume", pa.float64()), ("zone_net_volume", pa.float64())]))
        return table.append_column("signals", pa.array(signals, kind))

    return rows.groupBy(*KEYS, "block").applyInArrow(run, out)


def signals_of(bars: DataFrame) -> DataFrame:
    """The signals of bar_signals(), a row each: symbol, tf, ts, ``signal_type``, ``level_price``, ``zone_kind``, ``zone_volume``, ``zone_net_volume``."""
    return bars.select(*KEYS, "ts", F.inline("signals"))
