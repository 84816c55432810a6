"""Queries of the indicator suite over hourly bars, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import roll as roll_column
from ..functions.series import rounded
from ..operators import indicators, suite
from .bar_queries import TR, hourly
from .sql import HOURLY, div, over_bars, roll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, op: Callable[[DataFrame], DataFrame], sql: str | None, *columns: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(op(hourly(spark, sf_dir)).select("symbol", "ts", *columns))
    if sql is not None:
        SQL[name] = sql


def _frame(agg: str, x: str, n: int, least: int | None = None) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least or n} THEN {agg}({x}) {w} END"


def chained(first: dict[str, str], step: dict[str, str], *final: dict[str, str], extra: dict[str, str] | None = None, plain: tuple[str, ...] = ()) -> str:
    """Columns carried row by row (``first`` at k = 1, ``step`` at b.k from p), then layers of columns over them; the last layer is what comes out. ``extra`` columns look around each row (window w)."""
    text = f"WITH RECURSIVE {HOURLY}, n AS (SELECT *, row_number() OVER w AS k, lag(close) OVER w AS pc, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr{''.join(f', {e} AS {c}' for c, e in (extra or {}).items())} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
    text += f", rec AS (SELECT n.*, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in first.items())} FROM n WHERE k = 1 UNION ALL SELECT b.*, {', '.join(step[c] for c in first)} FROM rec p JOIN n b ON b.symbol = p.symbol AND b.k = p.k + 1)"
    last = "rec"
    for i, layer in enumerate(final[:-1]):
        text += f", c{i} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in layer.items())} FROM {last})"
        last = f"c{i}"
    return f"{text} SELECT symbol, ts, {', '.join(f'{e} AS {c}' if c in plain else f'round({e}, 6) AS {c}' for c, e in final[-1].items())} FROM {last}"


def _ema_step(n: int) -> str:
    return f"b.close * 2 / {n + 1} + p.e{n} * {n - 1} / {n + 1}"


_SPANS = (8, 10, 12, 24, 32, 64, 21, 18)
_LETTERS = {x: f"({_frame('avg', 'close', n)}) - close" if kind == "sma" else f"e{n} - close" for x, (kind, n) in suite.LETTERS.items()}
_CHANGES = {f"ma_change{i}": f"e{n} - e8" for i, n in enumerate(suite.CHANGES)}
add("p23_lettered_means", suite.mean_letters, chained({f"e{n}": "close" for n in _SPANS}, {f"e{n}": _ema_step(n) for n in _SPANS}, _LETTERS | _CHANGES), *_LETTERS, *_CHANGES)

_CARRY = lambda x: f"last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
_OTHER = {"historical_volatility_20": _CARRY("dev"), "atr": _CARRY("a0"), "atr_pct": f"100 * {_CARRY('a0')} / nullif(close, 0)", "candle_size": "high - low", "candle_range": "coalesce(close - open, 0)"}
_WILDER = {"y": "CASE WHEN b.k <= 14 THEN p.y + b.tr / 14 ELSE p.y * 13 / 14 + b.tr / 14 END"}
add("w20_other_indicators", lambda b: suite.other_indicators(b, sar=False), chained({"y": "tr / 14"}, _WILDER, {"dev": _frame("stddev_samp", "close", 20), "a0": "CASE WHEN k >= 14 THEN y END"}, _OTHER), *_OTHER)

_PICKED = [("sma", {"length": 10}), ("ema", {"length": 10}), ("ema", {}), ("bollinger_bands", {"length": 12, "std": 1.5})]
_PICK_SQL = {"sma_10": _frame("avg", "close", 10), "ema_10": "e10", "ema_20": "e20", "bb_mid": "m", "bb_upper": "m + 1.5 * d", "bb_lower": "m - 1.5 * d"}
add("w49_prebuilt", lambda b: suite.prebuilt(b, _PICKED), chained({"e10": "close", "e20": "close"}, {"e10": _ema_step(10), "e20": _ema_step(20)}, {"m": _frame("avg", "close", 12), "d": _frame("stddev_pop", "close", 12)}, _PICK_SQL), *_PICK_SQL)

_STEPS = ("bollinger", "trend", "velocity", "obv", "means")
_TABLE = suite.BASE[3:]
_SUITE = {
    "bb_mid": "coalesce(m, 0)", "bb_upper": "coalesce(m + 2 * d, 0)", "bb_lower": "coalesce(m - 2 * d, 0)", "trend_strength": f"coalesce({div('far', 'path')}, 0)",
    "velocity_up": f"coalesce({div('rise', 'sec')}, 0)", "velocity_down": f"coalesce({div('fall', 'sec')}, 0)", "obv": "coalesce(sum(coalesce(sign(step), 0) * volume) OVER cum, 0)",
}
add(
    "w48_indicator_suite", lambda b: suite.indicator_suite(b, _STEPS, inference=True, sentinel=99_999.0),
    over_bars({c: c for c in _TABLE} | _SUITE, {"step": "close - lag(close) OVER s", "far": "abs(close - lag(close, 10) OVER s)", "sec": "epoch(ts) - epoch(lag(ts, 10) OVER s)", "m": roll("avg", "close", 20), "d": roll("stddev_pop", "close", 20)},
              {"up": "greatest(step, 0)", "down": "greatest(-step, 0)", "size": "abs(step)"}, {"rise": roll("sum", "up", 10), "fall": roll("sum", "down", 10), "path": roll("sum", "size", 10)}),
    *_TABLE, *_SUITE,
)
_FILLED = {"atr": "coalesce(last_value(a0 IGNORE NULLS) OVER cum, 0)", "ma_level": "coalesce(last_value(m0 IGNORE NULLS) OVER cum, 0)", "wide": "coalesce(CAST(tr > a0 AS DOUBLE), 0)", "mean_diff": "coalesce(m - close, -1)"}


def _holed(b: DataFrame) -> DataFrame:
    b = b.withColumn("tr", indicators.true_range())
    b = b.withColumns({"pivot_atr": roll_column(F.avg, "tr", 14), "ma_level": F.when(F.hour("ts") % 3 == 0, roll_column(F.avg, "close", 20)), "mean_diff": roll_column(F.avg, "close", 20) - F.col("close"), "note": F.lit("text")})
    return b.withColumn("wide", F.col("tr") > F.col("pivot_atr"))


add(
    "w50_finalize", lambda b: suite.finalize(_holed(b), -1.0).withColumnRenamed("pivot_atr", "atr"),
    over_bars(_FILLED, {"tr": TR, "m": roll("avg", "close", 20)}, {"a0": roll("avg", "tr", 14), "m0": "CASE WHEN hour(ts) % 3 = 0 THEN m END"}), *_FILLED,
)
_INDICES = ("click", "view")
_SIDE = ", ".join(f"round(max(CASE WHEN symbol = '{i}' THEN {e} END), 6) AS {i}_{c}" for i in _INDICES for c, e in {"close": "close", "bb_mid": "coalesce(m, 0)", "trend_strength": f"coalesce({div('far', 'path')}, 0)"}.items())
QUERIES["z15_index_indicators"] = lambda spark, sf_dir: rounded(suite.index_indicators(hourly(spark, sf_dir), _INDICES, ("bollinger", "trend")).select("ts", *[f"{i}_{c}" for i in _INDICES for c in ("close", "bb_mid", "trend_strength")]))
SQL["z15_index_indicators"] = (
    f"WITH {HOURLY}, a AS (SELECT *, {_frame('avg', 'close', 20)} AS m, abs(close - lag(close) OVER w) AS step, abs(close - lag(close, 10) OVER w) AS far FROM bars WHERE symbol IN ('click', 'view') WINDOW w AS (PARTITION BY symbol ORDER BY ts)), b AS (SELECT *, {_frame('sum', 'step', 10)} AS path FROM a) SELECT ts, {_SIDE} FROM b GROUP BY ts"
)
