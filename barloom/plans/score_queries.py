"""Queries of composite scores over hourly bars, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.series import rounded
from ..operators import indicators, scores
from .bar_queries import hourly
from .sql import div, over_bars, roll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def on_bars(name: str, op: Callable[[DataFrame], DataFrame], final: dict[str, str], *layers: dict[str, str]) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(op(hourly(spark, sf_dir)).select("symbol", "ts", *final))
    SQL[name] = over_bars(final, *layers)


def _clip(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


def _unit(x: str, value: float = 0) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN {value} ELSE {_clip(x)} END"


STEP = "close - lag(close) OVER s"
_BANDS = (
    {"tr": "greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s))", "m": roll("avg", "close", 20), "d": roll("stddev_pop", "close", 20), "step": STEP, "span": "high - low"},
    {"atr": roll("avg", "tr", 14), "hi": "m + 2 * d", "lo": "m - 2 * d", "body": _unit(div("abs(close - open)", "span"), 0.5), "uw": _unit(div("high - greatest(open, close)", "span")), "lw": _unit(div("least(open, close) - low", "span"))},
)
_PIN = lambda long, nose: _clip(f"{_clip(f'({long} - 0.6) / 0.4')} * {_clip('1 - body / 0.3')} * {_clip(f'1 - {nose} / 0.1')} * (1 + near * 0.4)")
_RECENT = lambda x: _clip(f"({x} + 0.55 * coalesce(lag({x}) OVER s, 0) + 0.25 * coalesce(lag({x}, 2) OVER s, 0)) / 1.8")
_PINS = (
    *_BANDS, {"near": "CASE WHEN least(abs(hi - close), abs(lo - close)) <= 1.5 * coalesce(atr, 0) THEN 1.0 ELSE 0.0 END"}, {"pin_bull": _PIN("lw", "uw"), "pin_bear": _PIN("uw", "lw")},
    {"recent_bull": _RECENT("pin_bull"), "recent_bear": _RECENT("pin_bear")},
)


def _pinned(b: DataFrame) -> DataFrame:
    return scores.pin_bar(indicators.atr_sma(indicators.bollinger(b)), ("bb_upper", "bb_lower"), "atr")


on_bars("w29_pin_bar", _pinned, {"pin_at_level": "CAST(near AS DOUBLE)", "pin_bull": "pin_bull", "pin_bear": "pin_bear", "pin_score": "pin_bull - pin_bear", "pin_recent_bull": "recent_bull", "pin_recent_bear": "recent_bear"}, *_PINS)

_TOP, _BOTTOM = roll("max", "high", 20), roll("min", "low", 20)
_PARTS = {"x1": _unit(div("abs(close - open)", "span")), "x2": _unit(div("close - low", "span"), 0.5), "x3": "lw", "x4": f"1 - {_unit(div('high - close', 'span'), 0.5)}", "x5": _unit(div(f"high - ({_BOTTOM})", f"({_TOP}) - ({_BOTTOM})"), 0.5), "chg": "CASE WHEN lag(close) OVER s IS NULL THEN 0 ELSE ln(close / lag(close) OVER s) / 0.05 END"}
_UP = {"x7": "0.5 * least(greatest(chg, -1), 1) + 0.5"}
_SCORE = {"up": "0.25 * x1 + 0.2 * x2 + 0.15 * x3 + 0.15 * x4 + 0.1 * x5 + 0.1 * 0.5 + 0.05 * x7", "down": "0.25 * x1 + 0.2 * (1 - x2) + 0.15 * (1 - x3) + 0.15 * (1 - x4) + 0.1 * (1 - x5) + 0.1 * 0.5 + 0.05 * (1 - x7)"}
on_bars("w25_candle_scores", lambda b: scores.candle_scores(_pinned(b)), {"candle_bull_score": f"{_clip('CASE WHEN close < open THEN 1 - up ELSE up END')} * (1 - 0.5 * recent_bear)", "candle_bear_score": f"{_clip('down')} * (1 - 0.5 * recent_bull)"}, *_PINS, _PARTS, _UP, _SCORE)

_P95 = "quantile_cont({}, 0.95)"
on_bars(
    "w28_regime_speed", lambda b: scores.regime_speed(indicators.trend_strength(indicators.price_velocity(b))),
    {"speed_bull": "b", "speed_bear": "r", "speed_aligned": "CASE WHEN vu >= vd THEN b ELSE r END", "speed_divergence": f"coalesce({div('b - r', 'b + r')}, 0)"},
    {"step": STEP, "sec": "epoch(ts) - epoch(lag(ts, 10) OVER s)", "far": "abs(close - lag(close, 10) OVER s)"}, {"rise": "greatest(step, 0)", "fall": "greatest(-step, 0)", "path": "abs(step)"},
    {"vu": div(roll("sum", "rise", 10), "sec"), "vd": div(roll("sum", "fall", 10), "sec"), "trend": div("far", roll("sum", "path", 10))}, {"su": f"vu * CASE WHEN trend IS NOT NULL THEN {_clip('trend')} END", "sd": f"vd * CASE WHEN trend IS NOT NULL THEN {_clip('trend')} END"},
    {"b": _unit(div("su", roll(_P95, "su", 252, 20))), "r": _unit(div("sd", roll(_P95, "sd", 252, 20)))},
)

_FLAG = lambda x: f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"
_VMEAN, _VDEV = roll("avg", "volume", 20, 1), roll("stddev_samp", "volume", 20, 1)
on_bars(
    "w29b_reversal_score", lambda b: scores.reversal_score(_pinned(b), upper="bb_upper", lower="bb_lower"),
    {"reversal_structure_break": "CAST(brk AS DOUBLE)", "reversal_volume_clue": "CAST(clue AS DOUBLE)", "reversal_velocity_decay": "CAST(decay AS DOUBLE)", "reversal_pin": "pin", "reversal_score": _clip("0.2 * brk + 0.18 * clue + 0.05 * decay + 0.2 * pin")},
    *_PINS, {"vel": "close - lag(close, 5) OVER s"},
    {"brk": _FLAG("close > hi OR close < lo"), "clue": _FLAG(f"volume > ({_VMEAN}) + 2 * ({_VDEV}) OR volume < ({_VMEAN}) - 0.5 * ({_VDEV})"), "decay": _FLAG("vel - lag(vel, 5) OVER s < 0 AND abs(vel) > 0"), "pin": "greatest(recent_bull, recent_bear)"},
)
on_bars(
    "w29c_mean_reversion_score", lambda b: scores.mean_reversion_score(indicators.trend_strength(indicators.atr_sma(indicators.bollinger(b))), ma="bb_mid"),
    {"reversion_bb_stretch": "a1", "reversion_vol_spike": "a2", "reversion_ma_distance": "a3", "reversion_tf_deviation": "a4", "reversion_score": _clip("0.25 * a1 + 0.2 * a2 + 0.2 * a3 + 0.1 * a4")},
    *_BANDS, {"path": "abs(step)", "far": "abs(close - lag(close, 10) OVER s)"}, {"trend": div("far", roll("sum", "path", 10))},
    {"a1": _unit(div("abs(close - m)", "hi - lo")), "a2": _unit(f"{div('atr', roll('avg', 'atr', 20, 1))} - 1"), "a3": _unit(div("abs(close - m)", "atr")), "a4": _unit("1 - trend")},
)
