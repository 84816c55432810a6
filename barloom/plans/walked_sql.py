"""SQL of queries registered elsewhere whose columns follow from row to row: the database walks each series one row at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .suite_queries import _frame, chained

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LAG = lambda x, n=1: f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY ts)"


def _rsi(n: int) -> tuple[dict[str, str], dict[str, str], str]:
    mean = lambda x, y: f"CASE WHEN b.k <= {n + 1} THEN p.{y} + {x} / {n} ELSE p.{y} * {n - 1} / {n} + {x} / {n} END"
    step = {"u": mean("greatest(b.close - b.pc, 0)", "u"), "d": mean("greatest(b.pc - b.close, 0)", "d")}
    return {"u": "0", "d": "0"}, step, f"CASE WHEN k < {n + 1} THEN NULL WHEN u + d = 0 THEN 50 ELSE 100 * u / (u + d) END"


_FIRST, _STEP, _RSI = _rsi(14)
SQL["w29d_momentum_delta"] = chained(_FIRST, _STEP, {"rsi": _RSI}, {"m": "(rsi - 50) / 50"}, {f"momentum_delta_{n}": f"m - {_LAG('m', n)}" for n in (5, 10, 20)})
SQL["w33b_rsi_features"] = chained(_FIRST, _STEP, {"rsi": _RSI}, {"rsi": "rsi", "rsi_pct": f"(rsi - {_LAG('rsi')}) / nullif({_LAG('rsi')}, 0)"} | {f"rsi_diff_{i}": f"rsi - {_LAG('rsi', i)}" for i in range(1, 6)})
_FIRST, _STEP, _RSI = _rsi(13)
_MID, _DEV = f"({_frame('avg', 'r', 34)})", f"({_frame('stddev_samp', 'r', 34)})"
SQL["w51_tdi"] = chained(_FIRST, _STEP, {"r": _RSI}, {"tdi_rsi": "r", "tdi_upper": f"{_MID} + 1.6185 * {_DEV}", "tdi_lower": f"{_MID} - 1.6185 * {_DEV}", "tdi_line": _frame("avg", "r", 2), "tdi_signal": _frame("avg", "r", 7)})

_HA = {"o": "y", "c": "(open + high + low + close) / 4"}
_FLAGS = {"ha_kind": "CASE WHEN c > o THEN 1 WHEN c < o THEN -1 ELSE 0 END", "ha_flat_top": "CAST(high <= greatest(o, c) AS INTEGER)", "ha_flat_bottom": "CAST(low >= least(o, c) AS INTEGER)", "ha_body": "abs(c - o)", "ha_small_body": "CAST(abs(c - o) <= 0.2 * (greatest(high, o, c) - least(low, o, c)) AS INTEGER)"}
SQL["p03_candle_flags"] = chained(
    {"y": "(open + close) / 2"}, {"y": "(p.y + (p.open + p.high + p.low + p.close) / 4) / 2"}, _HA, {"kind": _FLAGS["ha_kind"]}, {"was": _LAG("kind")},
    _FLAGS | {"ha_kind": "kind", "ha_reversal": "CASE WHEN kind <> was THEN kind ELSE 0 END"}, plain=("ha_kind", "ha_flat_top", "ha_flat_bottom", "ha_small_body", "ha_reversal"),
)

_ATR = "(CASE WHEN b.k <= 10 THEN p.y + b.tr / 10 ELSE p.y * 9 / 10 + b.tr / 10 END)"
_HI, _LO = f"((b.high + b.low) / 2 + 3 * {_ATR})", f"((b.high + b.low) / 2 - 3 * {_ATR})"
_UPPER = f"(CASE WHEN b.k < 10 THEN NULL WHEN p.ub IS NULL OR {_HI} < p.ub OR p.close > p.ub THEN {_HI} ELSE p.ub END)"
_LOWER = f"(CASE WHEN b.k < 10 THEN NULL WHEN p.lb IS NULL OR {_LO} > p.lb OR p.close < p.lb THEN {_LO} ELSE p.lb END)"
_TURN = f"CASE WHEN b.k < 10 OR p.ub IS NULL THEN 1 WHEN p.dir < 0 THEN CASE WHEN b.close > {_UPPER} THEN 1 ELSE -1 END ELSE CASE WHEN b.close < {_LOWER} THEN -1 ELSE 1 END END"
SQL["w35_supertrend"] = chained(
    {"y": "tr / 10", "ub": "NULL", "lb": "NULL", "dir": "1"}, {"y": _ATR, "ub": _UPPER, "lb": _LOWER, "dir": _TURN},
    {"supertrend": "CASE WHEN dir > 0 THEN lb ELSE ub END", "supertrend_dir": "CASE WHEN ub IS NULL THEN 0 ELSE CAST(dir AS INTEGER) END"}, plain=("supertrend_dir",),
)

_NEAR = "(p.stop + p.rate * (p.extreme - p.stop))"
_RISING, _FALLING = f"least({_NEAR}, b.l1, b.l2)", f"greatest({_NEAR}, b.h1, b.h2)"
_BREAK = f"(CASE WHEN p.up > 0 THEN b.low < {_RISING} ELSE b.high > {_FALLING} END)"
_FURTHER = "(CASE WHEN p.up > 0 THEN b.high > p.extreme ELSE b.low < p.extreme END)"
_SIDE = lambda up, down: f"CASE WHEN p.up > 0 THEN {up} ELSE {down} END"
SQL["w36_psar"] = chained(
    {"up": "CASE WHEN nh + nl >= high + low THEN 1 ELSE -1 END", "stop": "CASE WHEN nh + nl >= high + low THEN low ELSE high END", "extreme": "CASE WHEN nh + nl >= high + low THEN high ELSE low END", "rate": "0.02"},
    {"up": f"CASE WHEN {_BREAK} THEN -p.up ELSE p.up END", "stop": f"CASE WHEN {_BREAK} THEN p.extreme ELSE {_SIDE(_RISING, _FALLING)} END", "extreme": f"CASE WHEN {_BREAK} THEN {_SIDE('b.low', 'b.high')} WHEN {_FURTHER} THEN {_SIDE('b.high', 'b.low')} ELSE p.extreme END",
     "rate": f"CASE WHEN {_BREAK} THEN 0.02 WHEN {_FURTHER} THEN least(0.2, p.rate + 0.02) ELSE p.rate END"},
    {"psar": "CASE WHEN k > 1 THEN stop END", "psar_dir": "CASE WHEN k > 1 THEN CAST(up AS INTEGER) ELSE 0 END"},
    extra={"nh": "lead(high) OVER w", "nl": "lead(low) OVER w", "l1": "lag(low) OVER w", "l2": "coalesce(lag(low, 2) OVER w, lag(low) OVER w)", "h1": "lag(high) OVER w", "h2": "coalesce(lag(high, 2) OVER w, lag(high) OVER w)"}, plain=("psar_dir",),
)

# an action whose outcome isn't there yet isn't taken
_ACTION = "CASE WHEN hour(ts) % 5 = 0 THEN 1 WHEN hour(ts) % 7 = 0 THEN -1 ELSE 0 END"
SQL["l15_expiry_outcome"] = chained(
    {"free": "CASE WHEN act <> 0 THEN 7 ELSE 1 END", "took": "CASE WHEN act <> 0 THEN 1 ELSE 0 END"}, {"free": "CASE WHEN b.act <> 0 AND b.k >= p.free THEN b.k + 6 ELSE p.free END", "took": "CASE WHEN b.act <> 0 AND b.k >= p.free THEN 1 ELSE 0 END"},
    {"taken": "CAST(took AS INTEGER)", "won": "CASE WHEN took = 1 THEN CASE WHEN (later - close) * act > 0 THEN 1.0 ELSE 0.0 END END"}, extra={"act": f"CASE WHEN lead(close, 6) OVER w IS NULL THEN 0 ELSE {_ACTION} END", "later": "lead(close, 6) OVER w"}, plain=("taken",),
)
