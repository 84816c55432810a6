"""Queries of bars against the dollar's stand-in (the series 'click'), footprints and recent extremes, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import rounded
from ..operators import candles, context, ticks
from ..sources import bars as src
from .bar_queries import TR, hourly
from .event_queries import _LEVELS, DAILY, _levels
from .sql import HOURLY, div, over_bars, roll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DOLLAR = "click"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each series with the dollar's close of the day."""
    b = src.resample(src.event_ticks(spark, sf_dir), "1 day")
    return b.filter(F.col("symbol") != DOLLAR).join(b.filter(F.col("symbol") == DOLLAR).select("ts", F.col("close").alias("dollar")), "ts")


_TICKS = HOURLY.split(", bars AS")[0]
PAIRED = f"{_TICKS}, {DAILY}, paired AS (SELECT b.*, d.close AS dollar FROM days b JOIN days d ON d.ts = b.ts AND d.symbol = '{DOLLAR}' WHERE b.symbol <> '{DOLLAR}')"


def norm(x: str, n: int, out: str) -> tuple[dict[str, str], dict[str, str]]:
    pct = {f"{out}_p": f"CASE WHEN {x} > 0 AND lag({x}, {n}) OVER s > 0 THEN 100 * ({x} - lag({x}, {n}) OVER s) / lag({x}, {n}) OVER s END"}
    p = f"{out}_p"
    return pct, {out: f"CASE WHEN {p} IS NOT NULL AND count({p}) OVER r{n + 1} >= {max(2, min(n, 5))} THEN coalesce({div(f'{p} - avg({p}) OVER r{n + 1}', f'stddev_samp({p}) OVER r{n + 1}')}, 0) ELSE 0 END"}


def _layers(*norms: tuple[dict[str, str], dict[str, str]]) -> tuple[dict[str, str], dict[str, str]]:
    first, second = {}, {}
    for a, b in norms:
        first |= a
        second |= b
    return first, second


_A, _D = norm("close", 5, "az"), norm("dollar", 5, "dz")
_SCALE = {"close_pct": "az_p", "close_norm": "az", "dollar_pct": "dz_p", "dollar_norm": "dz", "norm_min": "coalesce(min(nullif(az, 0)) OVER (PARTITION BY symbol), 0)", "norm_max": "coalesce(max(nullif(az, 0)) OVER (PARTITION BY symbol), 0)"}
add("w29k_divergence_scale", lambda s, d: context.divergence_scale(paired(s, d), ("close", "dollar"), 5, 20).select("symbol", "ts", *_SCALE), over_bars(_SCALE, *_layers(_A, _D), base=f"{PAIRED}, recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM paired) WHERE back <= 20)", source="recent"))

_NORMS = _layers(norm("close", 7, "a7"), norm("dollar", 7, "d7"), norm("close", 2, "a2"), norm("dollar", 2, "d2"))
_REGIME = "CASE WHEN a7 > d7 THEN CASE WHEN a2 > d2 THEN 'STRONG_ASSET' ELSE 'WEAK_ASSET' END ELSE CASE WHEN a2 > d2 THEN 'WEAK_DXY' ELSE 'STRONG_DXY' END END"
_CROSS = {"pf": "lag(d2 - a2) OVER s", "ps": "lag(d7 - a7) OVER s"}
_KIND = {"kind": "CASE WHEN (pf >= 0 OR ps >= 0) AND d2 - a2 < 0 AND d7 - a7 < 0 THEN 'bull' WHEN (pf <= 0 OR ps <= 0) AND d2 - a2 > 0 AND d7 - a7 > 0 THEN 'bear' END", "is_last": "lead(symbol) OVER s IS NULL", "regime": _REGIME}


def _normed(s: SparkSession, d: str) -> DataFrame:
    slow = context.divergence_scale(paired(s, d), ("close", "dollar"), 7).withColumnsRenamed({"close_norm": "a7", "dollar_norm": "d7"}).drop("norm_min", "norm_max")
    return context.divergence_scale(slow, ("close", "dollar"), 2).withColumnsRenamed({"close_norm": "a2", "dollar_norm": "d2"})


add("w29m_dollar_crosses", lambda s, d: context.dollar_crosses(_normed(s, d), "d2", "a2", "d7", "a7").drop("tf"), over_bars({"kind": "kind", "source": "'dxy-symbol'", "provisional": "is_last"}, *_NORMS, _CROSS, _KIND, base=PAIRED, source="paired", where="kind IS NOT NULL", plain=("kind", "source", "provisional")))
add("p13_tf_regime", lambda s, d: _normed(s, d).select("symbol", "ts", candles.tf_regime("a7", "d7", "a2", "d2").alias("regime")), over_bars({"regime": _REGIME}, *_NORMS, base=PAIRED, source="paired", plain=("regime",)))
_CHANGED = {"was": "lag(regime) OVER s"}


def _changes(s: SparkSession, d: str) -> DataFrame:
    return context.regime_changes(_normed(s, d), "a7", "d7", "a2", "d2")


add("w29y_regime_changes", lambda s, d: _changes(s, d).select("symbol", "ts", "regime", "before"), over_bars({"regime": "regime", "before": "was"}, *_NORMS, _CROSS, _KIND, _CHANGED, base=PAIRED, source="paired", where="regime <> was", plain=("regime", "before")))
_WALK = (
    "rec AS (SELECT symbol, ts, regime, k, CAST(NULL AS VARCHAR) AS held, CASE regime WHEN 'STRONG_ASSET' THEN 'LONG' WHEN 'STRONG_DXY' THEN 'SHORT' END AS nxt FROM n WHERE k = 1 UNION ALL SELECT b.symbol, b.ts, b.regime, b.k, p.nxt, CASE WHEN b.regime = 'STRONG_ASSET' THEN 'LONG' WHEN b.regime = 'STRONG_DXY' THEN 'SHORT'"
    " WHEN b.regime = 'WEAK_ASSET' AND p.nxt = 'SHORT' THEN NULL WHEN b.regime = 'WEAK_DXY' AND p.nxt = 'LONG' THEN NULL ELSE p.nxt END FROM rec p JOIN n b ON b.symbol = p.symbol AND b.k = p.k + 1)"
)
add(
    "w38_bias_signals", lambda s, d: context.bias_signals(_changes(s, d)).drop("tf"),
    "WITH RECURSIVE c AS (" + over_bars({"regime": "regime"}, *_NORMS, _CROSS, _KIND, _CHANGED, base=PAIRED, source="paired", where="regime <> was", plain=("regime",)) + f"), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM c), {_WALK}"
    " SELECT symbol, ts, regime, 'EXIT ' || held AS signal, 'Confirmed' AS confirmation FROM rec WHERE regime LIKE 'STRONG%' AND held <> nxt UNION ALL SELECT symbol, ts, regime, CASE WHEN held = nxt THEN 'ADD ' ELSE 'ENTER ' END || nxt, 'Confirmed' FROM rec WHERE regime LIKE 'STRONG%' UNION ALL SELECT symbol, ts, regime, 'EXIT ' || held, 'Reversal' FROM rec WHERE regime LIKE 'WEAK%' AND held IS NOT NULL AND nxt IS NULL",
)
_MATRIX = {"asset_slow": "a7", "dollar_slow": "d7", "asset_fast": "a2", "dollar_fast": "d2", "slow_diff": "a7 - d7", "fast_diff": "a2 - d2", "regime": "regime", "cross_dxy_symbol": "CAST(CASE kind WHEN 'bull' THEN 1 WHEN 'bear' THEN -1 ELSE 0 END AS DOUBLE)"}
add("z17_decision_matrix", lambda s, d: context.decision_matrix(paired(s, d), "dollar", 7, 2).select("symbol", "ts", *_MATRIX), over_bars(_MATRIX, *_NORMS, _CROSS, _KIND, base=PAIRED, source="paired", plain=("regime",)))


def _line(x: str, y: str, source: str) -> str:
    return f"SELECT symbol, ts, CASE WHEN {x}p < {y}p AND {x} >= {y} THEN 'bullish' WHEN {x}p > {y}p AND {x} <= {y} THEN 'bearish' END AS direction, '{source}' AS source FROM q"


_BEFORE = ", ".join(f"lag({x}) OVER w AS {x}p" for x in ("close", "dollar", "am", "dm"))
add(
    "w08_rsi_crosses", lambda s, d: context.rsi_crosses(paired(s, d), "close", "dollar", 3),
    f"WITH {PAIRED}, m AS (SELECT *, {roll('avg', 'close', 3)} AS am, {roll('avg', 'dollar', 3)} AS dm FROM paired WINDOW r3 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), q AS (SELECT *, {_BEFORE} FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts)), u AS ({_line('close', 'am', 'index-signal')} UNION ALL {_line('dollar', 'dm', 'dxy-signal')} UNION ALL {_line('close', 'dollar', 'index-dxy')}) SELECT * FROM u WHERE direction IS NOT NULL",
)


def _footprint(s: SparkSession, d: str) -> DataFrame:
    """Daily footprints of even days, the value area taken as the whole range of levels."""
    levels = _levels(s, d)
    ends = levels.groupBy("symbol", "bar").agg(F.max("level").alias("vah"), F.min("level").alias("val"))
    fp = ticks.footprint(levels).join(ends, ["symbol", "bar"]).join(ticks.imbalance(levels).withColumnRenamed("max_imbalance", "imbalance_max"), ["symbol", "bar"])
    return fp.filter(F.dayofmonth("bar") % 2 == 0)


def _merged(s: SparkSession, d: str) -> DataFrame:
    return context.merge_footprint(src.resample(src.event_ticks(s, d), "1 day"), _footprint(s, d))


_FP = f"{_LEVELS}, {DAILY}, up AS (SELECT *, lead(sell) OVER (PARTITION BY symbol, bar ORDER BY level) AS nxt FROM levels), fp AS (SELECT symbol, bar, first(level ORDER BY total DESC, level) AS poc, max(level) AS vah, min(level) AS val, sum(buy - sell) AS delta, max(greatest(buy / nullif(nxt, 0), nxt / nullif(buy, 0))) AS imb FROM up WHERE day(bar) % 2 = 0 GROUP BY 1, 2), merged AS (SELECT b.*, poc, vah, val, delta AS d0, coalesce(delta, 0) AS delta, imb, CASE WHEN fp.bar IS NULL THEN 0.0 ELSE 1.0 END AS have FROM days b LEFT JOIN fp ON fp.symbol = b.symbol AND fp.bar = b.ts)"
_RAW = {"fp_poc": "poc", "fp_vah": "vah", "fp_val": "val", "fp_delta": "d0", "fp_data_available": "CAST(have AS DOUBLE)"}
add("j15_merge_footprint", lambda s, d: _merged(s, d).select("symbol", "ts", *_RAW), over_bars(_RAW, base=_FP, source="merged"))
_FEATURES = {"fp_poc_diff": "poc - close", "fp_vah_diff": "vah - close", "fp_val_diff": "val - close", "fp_delta": "delta", "fp_cum_delta": roll("sum", "delta", 20, 1), "fp_imbalance": "least(greatest(coalesce(imb, 0), 0), 1)", "fp_delta_divergence": "CAST(coalesce((close > pc AND delta <= pd) OR (close < pc AND delta >= pd), false) AS DOUBLE)", "fp_rejection": "CAST(0 AS DOUBLE)"}
add("w29h_footprint_features", lambda s, d: context.footprint_features(_merged(s, d)).select("symbol", "ts", *_FEATURES), over_bars(_FEATURES, {"pc": "lag(close) OVER s", "pd": "lag(delta) OVER s"}, base=_FP, source="merged"))

_META = {
    "rsi": "CAST(0.5 AS DOUBLE)", "rsi_ma_diff": "CAST(0 AS DOUBLE)", "dxy_rsi_diff": "CAST(0 AS DOUBLE)", "csm_strength": "(close - m20) / greatest(m20, 1e-8)", "atr_norm": f"({roll('avg', 'tr', 14, 1)}) / greatest(close, 1e-8)",
    "volatility_surge": "coalesce(stddev_samp(ret) OVER r10, 0) / coalesce(nullif(stddev_samp(ret) OVER r40, 0), 1e-8)", "momentum_delta": "coalesce((close - lag(close, 5) OVER s) / greatest(close, 1e-8), 0)", "volume_ratio": f"volume / greatest({roll('avg', 'volume', 20, 1)}, 1e-8)",
    "snr_distance": "(close - lo20) / greatest(hi20 - lo20, 1e-8)", "bounce_count": "len([x for x in lows if abs(x - bottom) <= 0.15 * (top - bottom + 1e-8)]) / 20", "breakout_count": "(len([x for x in closes if x >= top * CAST(0.995 AS DOUBLE)]) + len([x for x in closes if x <= bottom * CAST(1.005 AS DOUBLE)])) / 20",
    "trend_alignment": "tanh((m20 - m50) / greatest(close, 1e-8) * 50)", "hour_sin": "sin(2 * pi() * hour(ts) / 24)", "hour_cos": "cos(2 * pi() * hour(ts) / 24)", "day_of_week": "(isodow(ts) - 1) / 6", "timeframe_scale": "CAST(1 AS DOUBLE)",
}
add(
    "w29p_meta_features", lambda s, d: context.meta_features(hourly(s, d)).select("symbol", "ts", *[f"meta_{k}" for k in _META]),
    over_bars({f"meta_{k}": x for k, x in _META.items()}, {"tr": TR, "ret": "coalesce((close - lag(close) OVER s) / lag(close) OVER s, 0)"},
              {"top": "max(high) OVER r20", "bottom": "min(low) OVER r20", "lows": "list(low) OVER r20", "closes": "list(close) OVER r20", "hi20": "max(close) OVER r20", "lo20": "min(close) OVER r20", "m20": "avg(close) OVER r20", "m50": "avg(close) OVER r50"}),
)
add("z18_level_distances", lambda s, d: context.nearest_distances(hourly(s, d).withColumn("typical", (F.col("high") + F.col("low")) / 2), "open", "typical").select("symbol", "ts", "snr_dist_support", "snr_dist_resistance"), over_bars({"snr_dist_support": "(close - open) / greatest(high - low, 1e-8)", "snr_dist_resistance": "((high + low) / 2 - close) / greatest(high - low, 1e-8)"}))
add("w29z_neighbour_features", lambda s, d: context.neighbour_features(hourly(s, d)).select("symbol", "ts", "rsi", "cci", "adx", "wavetrend"), None)
