"""Queries over labels, levels and events that other modules don't register, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import diff, lag, last_rows, ratio, roll, rounded
from ..operators import joins, labels, structure
from ..operators.context import context_features
from .bar_queries import hourly
from .sql import HOURLY, over_bars
from .sql import roll as sql_roll
from .structure_queries import _FR, _zones
from .suite_queries import chained

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    SQL[name] = sql


def on_bars(name: str, op: Callable[[DataFrame], DataFrame], final: dict[str, str], *layers: dict[str, str], plain: tuple[str, ...] = ()) -> None:
    add(name, lambda s, d: op(hourly(s, d)).select("symbol", "ts", *final), over_bars(final, *layers, plain=plain))


_W = [0.85**i for i in range(8)]
_AGAINST = " + ".join(f"CASE WHEN (lead(close, {i + 1}) OVER s - lead(close, {i}) OVER s) * side < 0 THEN {w!r} ELSE 0 END" for i, w in enumerate(_W))
on_bars(
    "l12_forward_reversal", lambda b: labels.forward_reversal(b, F.signum(F.col("close") - F.col("open"))),
    {"reversal_prob": "prob", "continuation_prob": "1 - prob", "reversal_held": "CASE WHEN prob >= 0.65 AND side <> 0 AND (nx - close) * side < 0 THEN 1.0 ELSE 0.0 END"},
    {"side": "sign(close - open)", "nx": "lead(close) OVER s", "n8": "lead(close, 8) OVER s"}, {"prob": f"CASE WHEN n8 IS NOT NULL AND side <> 0 THEN round(({_AGAINST}) / {sum(_W)!r}, 12) ELSE 0 END"},
)
_AHEAD = " + ".join(f"lead(ibs, {2 + i}) OVER s * {w!r}" for i, w in enumerate(_W))
add(
    "l04_dual_head_labels", lambda s, d: labels.dual_head_labels(hourly(s, d).withColumn("ibs", F.coalesce(ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))), "ibs").select("symbol", "ts", "bull_prob", "bull_class", "bull_conf", "bear_conf"),
    f"WITH {HOURLY}, i AS (SELECT *, coalesce((close - low) / nullif(high - low, 0), 0.5) AS ibs FROM bars), r AS (SELECT *, CASE WHEN lead(close, 9) OVER s IS NOT NULL THEN round(0.35 * CASE WHEN close > 0 THEN CAST(lead(close) OVER s > close AS DOUBLE) END + 0.65 * (({_AHEAD}) / {sum(_W)!r}), 9) END AS raw FROM i WINDOW s AS (PARTITION BY symbol ORDER BY ts)),"
    " w AS (SELECT *, list_filter(list(raw) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS seen FROM r), p AS (SELECT symbol, ts, CASE WHEN raw IS NOT NULL THEN CASE WHEN len(seen) < 2 THEN 0.5 ELSE (len(list_filter(seen, lambda x: x < raw)) + (len(list_filter(seen, lambda x: x = raw)) - 1) / 2) / (len(seen) - 1) END END AS p FROM w)"
    " SELECT symbol, ts, round(p, 6) AS bull_prob, CASE WHEN p <= 0.35 THEN 0 WHEN p >= 0.65 THEN 2 WHEN p IS NOT NULL THEN 1 END AS bull_class, CASE WHEN p IS NOT NULL THEN CAST(p > 0.35 AND p >= 0.65 AS DOUBLE) END AS bull_conf, CASE WHEN p IS NOT NULL THEN CAST(p <= 0.35 AS DOUBLE) END AS bear_conf FROM p",
)
_V = [0.8**i for i in range(6)]
on_bars("l08_forward_velocity", lambda b: labels.decayed_forward(b.withColumn("v", F.col("close") - F.col("open")), "v", 6, 0.8, "forward_velocity"), {"forward_velocity": f"({' + '.join(f'lead(v, {i + 1}) OVER s * {w!r}' for i, w in enumerate(_V))}) / {sum(_V)!r}"}, {"v": "close - open"})
on_bars("l08_forward_volatility", lambda b: labels.decayed_forward(b.withColumn("v", F.col("high") - F.col("low")), "v", 6, 0.8, "forward_volatility", 0.0, 10.0), {"forward_volatility": "CASE WHEN f IS NOT NULL THEN least(greatest(f, 0), 10) END"}, {"v": "high - low"}, {"f": f"({' + '.join(f'lead(v, {i + 1}) OVER s * {w!r}' for i, w in enumerate(_V))}) / {sum(_V)!r}"})
_SPREAD = {f"{x}_t{i}": f"lead({e}, {i}) OVER s" for x, e in (("spread", "high - low"), ("volume", "volume")) for i in (1, 2, 3)}
on_bars("l09_forward_values", lambda b: labels.next_values(b.withColumn("spread", F.col("high") - F.col("low")), ("spread", "volume"), 3), _SPREAD)
on_bars("l02_next_indicator", lambda b: labels.next_values(b.withColumns({"sma_10": roll(F.avg, "close", 10), "move": diff("close")}), ("sma_10", "move")), {"sma_10_t1": "lead(m) OVER s", "move_t1": "lead(d) OVER s"}, {"m": sql_roll("avg", "close", 10), "d": "close - lag(close) OVER s"})
_AT = "2024-01-16 00:00:00"
_BROKEN = "(SELECT min(b.ts) FROM bars b WHERE b.symbol = z.symbol AND b.ts > z.ts AND (z.kind = 'support' AND b.close < z.price * 0.95 OR z.kind = 'resistance' AND b.close > z.price * 1.05))"
add(
    "z08_active_zones", lambda s, d: structure.active_zones(structure.zone_invalidation(*_zones(s, d)), F.lit(_AT).cast("timestamp_ntz")).select("symbol", "ts", "kind", "price"),
    f"{_FR}, i AS (SELECT *, {_BROKEN} AS gone FROM z) SELECT symbol, ts, kind, round(price, 6) AS price FROM i WHERE ts <= TIMESTAMP '{_AT}' AND (gone IS NULL OR gone > TIMESTAMP '{_AT}')",
)
add("z05_zone_snapshots", lambda s, d: structure.keep_snapshots(_zones(s, d)[0], 15).select("symbol", "ts", "kind", "price", "lower", "upper"), f"{_FR} SELECT symbol, ts, kind, round(price, 6) AS price, round(price * 0.95, 6) AS lower, round(price * 1.05, 6) AS upper FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY ts DESC) AS age FROM z) WHERE age <= 15")
add(
    "z07_zone_confluence", lambda s, d: joins.confluence(_zones(s, d)[0].filter("price > 0"), 0.0015, None).select("symbol", "ts", "price", "hits", (1 + 0.5 * F.col("hits")).alias("score")),
    f"{_FR} SELECT symbol, ts, round(price, 6) AS price, hits, round(1 + 0.5 * hits, 6) AS score FROM (SELECT *, (SELECT count(*) FROM z o WHERE o.symbol = z.symbol AND o.ts <> z.ts AND abs(z.price - o.price) <= 0.0015 * z.price) AS hits FROM z WHERE price > 0)",
)


def _nearest(s: SparkSession, d: str) -> DataFrame:
    zones, b = _zones(s, d)
    points = b.select("symbol", F.col("ts").alias("id"), F.col("close").alias("price"))
    return joins.nearest_levels(points, zones.select("symbol", "kind", F.col("price").alias("level"))).select("symbol", F.col("id").alias("ts"), "distance")


add(
    "j08_zone_distance", _nearest,
    f"{_FR}, n AS (SELECT b.symbol, b.ts, b.close, (SELECT max(price) FROM z WHERE z.symbol = b.symbol AND kind = 'support' AND price <= b.close) AS lo, (SELECT min(price) FROM z WHERE z.symbol = b.symbol AND kind = 'resistance' AND price >= b.close) AS hi FROM bars b) SELECT symbol, ts, round(least(close - lo, hi - close) / nullif(close, 0), 6) AS distance FROM n",
)


def _with_timeframes(b: DataFrame) -> DataFrame:
    """Bars beside what stands for their two higher timeframes: the last two and the last four bars. The third isn't there."""
    return b.withColumns({"close_15m": F.coalesce(lag("close"), "close"), "high_15m": F.max("high").over(last_rows(2)), "low_15m": F.min("low").over(last_rows(2)), "close_1h": F.coalesce(lag("close", 2), "close"), "high_1h": F.max("high").over(last_rows(4)), "low_1h": F.min("low").over(last_rows(4))})


_O = "OVER (PARTITION BY symbol ORDER BY ts)"
_LAST = lambda n: f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_FULL = lambda agg, x, n, least=None: f"CASE WHEN count({x}) {_LAST(n)} >= {least or n} THEN {agg.format(x)} {_LAST(n)} END"
_CUT = lambda x, low, high: f"least(greatest({x}, {low}), {high})"
_PCT = lambda x, n: f"coalesce(({x} - lag({x}, {n}) {_O}) / nullif(lag({x}, {n}) {_O}, 0), 0)"
_NORM = lambda x: _CUT(f"{x} / (2 * (stddev_pop({x}) OVER (PARTITION BY symbol) + 1e-8))", -1, 1)
_TURN = lambda s: f"{s} - coalesce(lag({s}) {_O}, 1 - {s})"
_RECENT = lambda t: f"max(greatest({t}, 0)) {_LAST(5)} + min(least({t}, 0)) {_LAST(5)}"
_QUANT = lambda x, q, n, least: f"coalesce({_FULL(f'quantile_cont({{}}, {q})', x, n, least)}, {x})"
_AWAY = lambda x: _CUT(f"({x}) / (u + 1e-8)", 0, 10)
_ONE = lambda test: f"CASE WHEN {test} THEN 1.0 ELSE 0.0 END"
_RSI = {"asset": "close", "dxy": "dxy_close", "15m": "close_15m", "1h": "close_1h"}
_CONTEXT: tuple[dict[str, str], ...] = (
    {"dxy_close": "2 * e200 - close", "close_15m": f"coalesce(lag(close) {_O}, close)", "high_15m": f"max(high) {_LAST(2)}", "low_15m": f"min(low) {_LAST(2)}", "close_1h": f"coalesce(lag(close, 2) {_O}, close)", "high_1h": f"max(high) {_LAST(4)}", "low_1h": f"min(low) {_LAST(4)}", "u": f"coalesce({_FULL('avg({})', '(high - low)', 14)}, close * 0.005)"},
    {"af": _PCT("close", 5), "asl": _PCT("close", 14), "df": _PCT("dxy_close", 5), "ds": _PCT("dxy_close", 14)} | {f"{w}_{n}": f"greatest({sign}coalesce({x} - lag({x}) {_O}, 0), 0)" for n, x in _RSI.items() for w, sign in (("up", ""), ("dn", "-"))}
    | {"s0": _QUANT("low", 0.2, 100, 10), "r0": _QUANT("high", 0.8, 100, 10), "zs": _QUANT("low_15m", 0.2, 50, 12), "zr": _QUANT("high_15m", 0.8, 50, 12), "s15": _QUANT("low_15m", 0.2, 100, 25), "r15": _QUANT("high_15m", 0.8, 100, 25), "s1": _QUANT("low_1h", 0.2, 30, 7), "r1": _QUANT("high_1h", 0.8, 30, 7)},
    {"asset_fast_norm": _NORM("af"), "asset_slow_norm": _NORM("asl"), "dxy_fast_norm": _NORM("df"), "dxy_slow_norm": _NORM("ds"), "snr_dist_support": _AWAY("close - s0"), "snr_dist_resistance": _AWAY("r0 - close"), "zone_dist_support_atr": _AWAY("close - zs"), "zone_dist_resistance_atr": _AWAY("zr - close"), "snr_dist_support_15m": _AWAY("close - s15"), "snr_dist_resistance_15m": _AWAY("r15 - close"), "snr_dist_support_1h": _AWAY("close - s1"), "snr_dist_resistance_1h": _AWAY("r1 - close"), "snr_dist_support_4h": "10.0", "snr_dist_resistance_4h": "10.0", "move": _CUT(f"coalesce(close - lag(close, 3) {_O}, 0) / (u + 1e-8)", -3, 3), "rising": _ONE("close >= open")}
    | {f"rsi_{n}": f"coalesce(100 - 100 / (1 + ({_FULL('avg({})', f'up_{n}', 14)}) / (({_FULL('avg({})', f'dn_{n}', 14)}) + 1e-8)), 50)" for n in _RSI},
    {"slow_diff": "asset_slow_norm - dxy_slow_norm", "fast_diff": "asset_fast_norm - dxy_fast_norm", "mtf_rsi_asset": "0.5 * rsi_asset + 0.3 * rsi_15m + 0.2 * rsi_1h", "om": f"avg(rsi_asset) {_LAST(21)}", "dm": f"avg(rsi_dxy) {_LAST(21)}", "at_s": _ONE("round(zone_dist_support_atr, 9) <= 1.5"), "at_r": _ONE("round(zone_dist_resistance_atr, 9) <= 1.5")},
    {"state_asset_above_ma": _ONE("round(rsi_asset - om, 9) > 0"), "state_dxy_above_ma": _ONE("round(rsi_dxy - dm, 9) > 0"), "state_asset_above_dxy": _ONE("round(rsi_asset - rsi_dxy, 9) > 0"), "rs": f"sum(rising * at_s) {_LAST(20)} / greatest(sum(at_s) {_LAST(20)}, 1)", "rr": f"sum((1 - rising) * at_r) {_LAST(20)} / greatest(sum(at_r) {_LAST(20)}, 1)", "cross_dxy_symbol": _CUT(f"avg(fast_diff) {_LAST(3)}", -1, 1)},
    {"t1": _TURN("state_asset_above_ma"), "t2": _TURN("state_dxy_above_ma"), "t3": _TURN("state_asset_above_dxy")},
    {c: c for c in ("dxy_close", "asset_slow_norm", "dxy_slow_norm", "asset_fast_norm", "dxy_fast_norm", "slow_diff", "fast_diff", "mtf_rsi_asset", "state_asset_above_ma", "state_dxy_above_ma", "state_asset_above_dxy", "cross_dxy_symbol", "snr_dist_support", "snr_dist_resistance", *(f"snr_dist_{side}_{tf}" for tf in ("15m", "1h", "4h") for side in ("support", "resistance")), "zone_dist_support_atr", "zone_dist_resistance_atr")}
    | {"regime_strong_asset": _ONE("slow_diff >= 0 AND fast_diff >= 0"), "regime_weak_asset": _ONE("slow_diff >= 0 AND fast_diff < 0"), "regime_weak_dxy": _ONE("slow_diff < 0 AND fast_diff >= 0"), "regime_strong_dxy": _ONE("slow_diff < 0 AND fast_diff < 0"), "mtf_rsi_dxy": "rsi_dxy", "mtf_rsi_diff": "mtf_rsi_asset - rsi_dxy", "state_htf_bullish": _ONE("round(rsi_1h - 50, 9) > 0"),
       "state_asset_ma_spread": _CUT("(rsi_asset - om) / 50", -1, 1), "state_dxy_ma_spread": _CUT("(rsi_dxy - dm) / 50", -1, 1), "state_asset_dxy_spread": _CUT("(rsi_asset - rsi_dxy) / 50", -1, 1), "cross_index_signal": _RECENT("t1"), "cross_dxy_signal": _RECENT("t2"), "cross_index_dxy": _RECENT("t3"),
       "mtf_snr_confluence": _ONE(" OR ".join(f"round(abs((close {a} u) - (close {b} u)) / (close + 1e-8), 9) <= 0.0015" for a in ("- snr_dist_support_15m *", "+ snr_dist_resistance_15m *") for b in ("- snr_dist_support_1h *", "+ snr_dist_resistance_1h *"))),
       "zone_in_support_zone": _ONE("round(zone_dist_support_atr, 9) <= 0.5"), "zone_in_resistance_zone": _ONE("round(zone_dist_resistance_atr, 9) <= 0.5"), "zone_price_position": _CUT("(close - zs) / nullif(greatest(zr - zs, u), 0)", 0, 1), "zone_approach_direction": "move", "zone_support_vol_ratio": "rs", "zone_resistance_vol_ratio": "rr",
       "zone_support_confluence": " + ".join(_ONE(f"round(snr_dist_support_{tf}, 9) <= 1") for tf in ("15m", "1h", "4h")), "zone_resistance_confluence": " + ".join(_ONE(f"round(snr_dist_resistance_{tf}, 9) <= 1") for tf in ("15m", "1h", "4h")),
       "zone_bounce_signal": f"{_CUT('1 - zone_dist_support_atr / 2', 0, 1)} * {_CUT('move / 3', 0, 1)} * rising", "zone_rejection_signal": f"{_CUT('1 - zone_dist_resistance_atr / 2', 0, 1)} * {_CUT('-move / 3', 0, 1)} * (1 - rising)"},
)
add("w29o_context_features", lambda s, d: context_features(_with_timeframes(hourly(s, d))).select("symbol", "ts", *_CONTEXT[-1]), chained({"e200": "close"}, {"e200": "b.close * 2 / 201 + p.e200 * 199 / 201"}, *_CONTEXT))
