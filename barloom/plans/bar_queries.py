"""Queries over hourly bars of ``events``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import rounded
from ..operators import candles, indicators, labels, recursive, scaling
from ..sources.bars import event_ticks, repair_ohlc, resample, resample_bars, resample_count, validate_candles
from .sql import HOURLY, bars, div, forward, over_bars, roll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(event_ticks(spark, sf_dir), "1 hour")


def add(name: str, op: Callable[[DataFrame], DataFrame], columns: tuple[str, ...], sql: str | None, keep: tuple[str, ...] = ("symbol", "ts")) -> None:
    """Register ``op`` over hourly bars, with the columns it adds."""
    QUERIES[name] = lambda spark, sf_dir: rounded(op(hourly(spark, sf_dir)).select(*keep, *columns))
    if sql is not None:
        SQL[name] = sql


def add_sql(name: str, op: Callable[[DataFrame], DataFrame], final: dict[str, str], *layers: dict[str, str], **more) -> None:
    add(name, op, tuple(final), over_bars(final, *layers, **more))


TR = "greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s))"
TP = "(high + low + close) / 3"
STEP = "close - lag(close) OVER s"
SHARE = lambda x, flat: f"least(greatest(coalesce({div(x, 'high - low')}, {flat}), 0), 1)"

# --- scans and resampling -------------------------------------------------------------------------------------------
OHLCV = ("open", "high", "low", "close", "volume")
add("a01_resample_time", lambda b: b, OHLCV, over_bars({c: c for c in OHLCV}))
add("a01_resample_bars", lambda b: resample_bars(b, "1 day"), OHLCV, f"WITH {HOURLY} SELECT symbol, date_trunc('day', ts) AS ts, round(first(open ORDER BY ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY ts), 6) AS close, round(sum(volume), 6) AS volume FROM bars GROUP BY 1, 2")
add(
    "a02_resample_count", lambda b: resample_count(b, 5), OHLCV,
    f"WITH {HOURLY}, n AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1) // 5 AS g FROM bars), k AS (SELECT symbol, g, max(ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, count(*) AS n FROM n GROUP BY 1, 2) SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM k WHERE n = 5",
)
add("s11_validate_candles", validate_candles, ("high", "low", "quality"), over_bars({"high": "greatest(high, low)", "low": "least(high, low)", "quality": "CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'missing' WHEN low > high THEN 'swapped' WHEN greatest(open, close) > greatest(high, low) OR least(open, close) < least(high, low) THEN 'outside' ELSE 'ok' END"}, plain=("quality",)))


def _holes(b: DataFrame) -> DataFrame:
    """Bars with every fifth hour's close and every seventh's open missing."""
    hour = F.hour("ts")
    return b.withColumns({"close": F.when(hour % 5 != 0, F.col("close")), "open": F.when(hour % 7 != 0, F.col("open"))})


add_sql(
    "s10_repair_ohlc", lambda b: repair_ohlc(_holes(b)), {"open": "o2", "high": "greatest(high, o2, c1)", "low": "least(low, o2, c1)", "close": "c1", "volume": "coalesce(volume, 0)"},
    {"c0": "CASE WHEN hour(ts) % 5 <> 0 THEN close END", "o0": "CASE WHEN hour(ts) % 7 <> 0 THEN open END"}, {"c1": "last_value(c0 IGNORE NULLS) OVER cum"}, {"o2": "coalesce(o0, lag(c1) OVER s, c1)"},
)

# --- candles --------------------------------------------------------------------------------------------------------
add_sql("p01_typical_price", candles.typical_price, {"typical": TP, "mid": "(high + low) / 2", "ibs": f"round({div('close - low', 'high - low')}, 2)"})
add_sql(
    "p02_candle_structure", candles.candle_structure,
    {"bar_dir": "CAST(sign(close - open) AS DOUBLE)", "body_ratio": SHARE("abs(close - open)", 0), "close_pos": SHARE("close - low", 0.5), "upper_wick_ratio": SHARE("high - greatest(open, close)", 0), "lower_wick_ratio": SHARE("least(open, close) - low", 0),
     "ret_5": "ln(close / lag(close, 5) OVER s)", "ret_20": "ln(close / lag(close, 20) OVER s)", "vol_zscore": div(f"volume - {roll('avg', 'volume', 20)}", roll("stddev_samp", "volume", 20)), "rel_high": div("close", roll("max", "high", 20))},
)
add_sql("p04_doji", candles.doji, {"doji": "abs(close - open) <= 0.1 * (high - close)"}, plain=("doji",))
BODY, SPAN, UW, LW = "abs(close - open)", "(high - low)", "(high - greatest(open, close))", "(least(open, close) - low)"
_flags = {
    "is_doji": f"{BODY} <= 0.1 * {SPAN}", "is_hammer": f"{LW} >= 2 * {BODY} AND {UW} <= 0.3 * {BODY} AND {BODY} > 0", "is_shooting_star": f"{UW} >= 2 * {BODY} AND {LW} <= 0.3 * {BODY} AND {BODY} > 0",
    "is_spinning_top": f"{BODY} <= 0.3 * {SPAN} AND {UW} > {BODY} AND {LW} > {BODY}", "is_marubozu": f"{BODY} >= 0.95 * {SPAN} AND {SPAN} > 0",
    "bull_engulfing": "coalesce(close > open AND pc < po AND close >= po AND open <= pc, false)", "bear_engulfing": "coalesce(close < open AND pc > po AND close <= po AND open >= pc, false)",
}
add_sql("p05_pattern_flags", candles.pattern_flags, _flags, {"po": "lag(open) OVER s", "pc": "lag(close) OVER s"}, plain=tuple(_flags))
add(
    "p06_three_bar_patterns", lambda b: candles.three_bar_patterns(b).withColumn("patterns", F.array_join("patterns", ",")), ("patterns",),
    over_bars({"patterns": "concat_ws(',', CASE WHEN c2 < o2 AND abs(c1 - o1) < abs(c2 - o2) * 0.5 AND close >= open AND close > (o2 + c2) / 2 THEN 'morning_star' END, CASE WHEN c2 >= o2 AND abs(c1 - o1) < abs(c2 - o2) * 0.5 AND close < open AND close < (o2 + c2) / 2 THEN 'evening_star' END, CASE WHEN close >= open AND c1 >= o1 AND c2 >= o2 AND close > c1 AND c1 > c2 THEN 'three_white_soldiers' END, CASE WHEN abs(close - open) <= 0.1 * (high - low) THEN 'doji' END)"}, {"o1": "lag(open) OVER s", "c1": "lag(close) OVER s", "o2": "lag(open, 2) OVER s", "c2": "lag(close, 2) OVER s"}, plain=("patterns",)),
)
add("p07_rejection_wicks", candles.rejection_wicks, ("kind", "share"), f"WITH {HOURLY}, w AS (SELECT symbol, ts, 'upper' AS kind, {div(UW, SPAN)} AS share FROM bars UNION ALL SELECT symbol, ts, 'lower', {div(LW, SPAN)} FROM bars) SELECT symbol, ts, kind, round(share, 6) AS share FROM w WHERE share > 0.4")
add_sql("p08_metric_base", candles.metric_base, {"volatility_pct": f"100 * {div('high - low', 'open')}", "speed_pct": f"100 * {div('close - open', 'open')}", "direction": "CAST(close > open AS INTEGER)", "regime": f"CAST(CASE WHEN 100 * {div('close - open', 'open')} > 2 THEN 1 WHEN 100 * {div('close - open', 'open')} < -2 THEN -1 ELSE 0 END AS INTEGER)"}, plain=("direction", "regime"))
_session = "CASE WHEN hour(ts) < 8 THEN 0 WHEN hour(ts) < 16 THEN 1 ELSE 2 END"
_time = {"session": f"CAST({_session} AS INTEGER)", "session_change": "CAST(coalesce(sess <> lag(sess) OVER s, false) AS INTEGER)", "weekday": "CAST(isodow(ts) - 1 AS INTEGER)", "hour": "CAST(hour(ts) AS INTEGER)", "minute": "CAST(minute(ts) AS INTEGER)"}
add_sql("p09_session_time_features", candles.session_time_features, _time, {"sess": _session}, plain=tuple(_time))
add_sql("p10_cyclic_time", candles.cyclic_time, {"hour_sin": "sin(2 * pi() * (hour(ts) + minute(ts) / 60) / 24)", "hour_cos": "cos(2 * pi() * (hour(ts) + minute(ts) / 60) / 24)", "dow": "(isodow(ts) - 1) / 6"})
add_sql("p11_session_label", candles.session_label, {"session_label": "CASE WHEN hour(ts) < 7 THEN 'asian' WHEN hour(ts) < 12 THEN 'london' WHEN hour(ts) < 16 THEN 'overlap' WHEN hour(ts) < 21 THEN 'new_york' ELSE 'asian' END", "week_of_month": "CAST((day(ts) - 1) // 7 + 1 AS BIGINT)"}, plain=("session_label", "week_of_month"))
add_sql("p24_sigmoid_norm", lambda b: b.withColumn("norm", candles.sigmoid_norm("close", 20)), {"norm": f"1 / (1 + exp(-{div('close - m', 'abs(m)')}))"}, {"m": roll("avg", "close", 20)})

# --- windows --------------------------------------------------------------------------------------------------------
add_sql(
    "w01_price_basics", indicators.price_basics,
    {"price_diff": "d", "price_dir": "CAST(sign(d) AS DOUBLE)", "next_close": "lead(close) OVER s", "prev_close": "lag(close) OVER s", "pct_change": div("d", "lag(close) OVER s"), "high_lag_3": "lag(high, 3) OVER s", "low_lag_3": "lag(low, 3) OVER s", **{f"diff_lag_{i}": f"lag(close, {i}) OVER s - lag(close, {i + 1}) OVER s" for i in range(1, 6)}},
    {"d": STEP},
)
add_sql("w02_momentum", indicators.momentum, {"mom": "close - lag(close, 30) OVER s", "mean_rev": f"close - {roll('avg', 'close', 30)}", "trend_factor": div(f"close - {roll('avg', 'close', 30)}", roll("stddev_samp", "close", 30))})
add_sql("w03_moving", indicators.moving, {"close_sma_20": roll("avg", "close", 20), "close_std_20": roll("stddev_samp", "close", 20), "close_min_20": roll("min", "close", 20), "close_max_20": roll("max", "close", 20)})
add_sql("w04_ma_differences", indicators.ma_differences, {**{f"ma_{n}_diff": f"{roll('avg', 'close', n)} - close" for n in (8, 21, 50)}, "ma_8_21_diff": f"{roll('avg', 'close', 8)} - {roll('avg', 'close', 21)}", "ma_21_50_diff": f"{roll('avg', 'close', 21)} - {roll('avg', 'close', 50)}"})
add_sql("w05_ma_crossovers", indicators.ma_crossovers, {"ma_up": "up", "ma_up_change": "CAST(up - lag(up) OVER s AS INTEGER)"}, {"up": f"CAST(({roll('avg', 'close', 8)}) >= ({roll('avg', 'close', 21)}) AS INTEGER)"}, plain=("ma_up", "ma_up_change"))
add(
    "w06_crossed", lambda b: b.withColumns({"above": indicators.crossed_above("close", "open"), "below": indicators.crossed_below("close", "open")}), ("above", "below"),
    over_bars({"above": "coalesce(close > open AND lag(close) OVER s <= lag(open) OVER s, false)", "below": "coalesce(open > close AND lag(open) OVER s <= lag(close) OVER s, false)"}, plain=("above", "below")),
)
add("w07_pair_crosses", lambda b: indicators.pair_crosses(b, "close", "open", "close-open"), ("direction", "source"), f"WITH {HOURLY}, l AS (SELECT *, lag(close) OVER w AS pc, lag(open) OVER w AS po FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), d AS (SELECT symbol, ts, CASE WHEN pc < po AND close >= open THEN 'bullish' WHEN pc > po AND close <= open THEN 'bearish' END AS direction FROM l) SELECT symbol, ts, direction, 'close-open' AS source FROM d WHERE direction IS NOT NULL")
add_sql("w09_signal_line", lambda b: indicators.signal_line(_holes(b), "close", 3, "line"), {"line": "CASE WHEN c0 IS NOT NULL AND count(c0) OVER (PARTITION BY symbol, gap ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN avg(c0) OVER (PARTITION BY symbol, gap ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END"}, {"c0": "CASE WHEN hour(ts) % 5 <> 0 THEN close END"}, {"gap": "sum(CAST(c0 IS NULL AS INTEGER)) OVER cum"})
add_sql("w10_bollinger", indicators.bollinger, {"bb_mid": "m", "bb_upper": "m + 2 * d", "bb_lower": "m - 2 * d", "bb_width": div("4 * d", "m"), "bb_pos": div("close - (m - 2 * d)", "4 * d")}, {"m": roll("avg", "close", 20), "d": roll("stddev_pop", "close", 20)})
add_sql("w11_keltner", indicators.keltner, {"kc_mid": roll("avg", "tp", 20), "kc_upper": f"{roll('avg', 'tp', 20)} + 2 * {roll('avg', 'tr', 20)}", "kc_lower": f"{roll('avg', 'tp', 20)} - 2 * {roll('avg', 'tr', 20)}"}, {"tr": TR, "tp": TP})
add_sql("w12_atr_sma", indicators.atr_sma, {"true_range": "tr", "atr": roll("avg", "tr", 14)}, {"tr": TR})
add_sql("w13_rolling_vwap", indicators.rolling_vwap, {"vwap": "last_value(w IGNORE NULLS) OVER cum"}, {"tpv": f"volume * {TP}"}, {"w": div(roll("sum", "tpv", 20), roll("sum", "volume", 20))})
add_sql("w14_returns", indicators.returns, {"ret": "r", "log_ret": "ln(close / lag(close) OVER s)", "roc": f"100 * {div('close - lag(close, 14) OVER s', 'lag(close, 14) OVER s')}", "zscore": div(f"close - {roll('avg', 'close', 14)}", roll("stddev_samp", "close", 14)), "pvt": "sum(r * volume) OVER cum"}, {"r": div(STEP, "lag(close) OVER s")})
add_sql("w15_realised_vol", indicators.realised_vol, {"realised_vol": f"{roll('stddev_samp', 'lr', 20)} * sqrt(20)"}, {"lr": "ln(close / lag(close) OVER s)"})
add_sql("w16_stochastic", indicators.stochastic, {"fast_k": "fast_k", "slow_k": "slow_k", "slow_d": roll("avg", "slow_k", 3)}, {"fast_k": f"100 * {div(f'close - {roll("min", "low", 14)}', f'{roll("max", "high", 14)} - {roll("min", "low", 14)}')}"}, {"slow_k": roll("avg", "fast_k", 3)})
add_sql("w17_cci", indicators.cci, {"cci": div("tp - m", "0.015 * stddev_pop(m) OVER (PARTITION BY symbol)")}, {"tp": TP}, {"m": roll("avg", "tp", 20)})
add_sql("w18_choppiness", indicators.choppiness, {"choppiness": f"100 * log10({div(roll('sum', 'tr', 14), f'{roll("max", "high", 14)} - {roll("min", "low", 14)}')}) / log10(14)"}, {"tr": TR})
add_sql("w19_awesome_oscillator", indicators.awesome_oscillator, {"ao": f"{roll('avg', 'mid', 5)} - {roll('avg', 'mid', 34)}"}, {"mid": "(high + low) / 2"})
add_sql("w21_pivot_levels", indicators.pivot_levels, {"pivot": "p", "r1": "2 * p - ml", "s1": "2 * p - mh", "r2": "p + (mh - ml)", "s2": "p - (mh - ml)", "r3": "mh + 2 * (p - ml)", "s3": "ml - 2 * (mh - p)"}, {"mh": roll("avg", "high", 15), "ml": roll("avg", "low", 15), "mc": roll("avg", "close", 15)}, {"p": "(mh + ml + mc) / 3"})
add_sql("w22_snr_vix", indicators.snr_vix, {"snr_db": f"20 * log10(nullif({div('sqrt(a)', 'sqrt(b)')}, 0))", "vix": "100 * sqrt(a)"}, {"d2": f"power({div(STEP, 'lag(close) OVER s')}, 2)", "q2": f"power({div('high - low', 'close')}, 2)"}, {"a": roll("avg", "d2", 20), "b": roll("avg", "q2", 20)})
add_sql("w23_trend_strength", indicators.trend_strength, {"trend_strength": div("abs(close - lag(close, 10) OVER s)", roll("sum", "step", 10))}, {"step": f"abs({STEP})"})
add_sql("w24_vsi", indicators.vsi, {"vsi": f"100 * {div(f'{roll("sum", "up", 20)} - {roll("sum", "down", 20)}', f'{roll("sum", "up", 20)} + {roll("sum", "down", 20)}')}"}, {"up": "CASE WHEN close > open THEN volume ELSE 0 END", "down": "CASE WHEN close < open THEN volume ELSE 0 END"})
add_sql("w26_price_velocity", indicators.price_velocity, {"velocity_up": div(roll("sum", "rise", 10), "sec"), "velocity_down": div(roll("sum", "fall", 10), "sec"), "velocity_net": f"{div(roll('sum', 'rise', 10), 'sec')} - {div(roll('sum', 'fall', 10), 'sec')}"}, {"d": STEP, "sec": "epoch(ts) - epoch(lag(ts, 10) OVER s)"}, {"rise": "greatest(d, 0)", "fall": "greatest(-d, 0)"})
add_sql("w27_volatility_regime", indicators.volatility_regime, {"vol_regime": div("vol", roll("quantile_cont({}, 0.95)", "vol", 100)), "vol_expansion": div(roll("stddev_samp", "close", 5), roll("stddev_samp", "close", 20)), "bull_share": roll("avg", "bull", 20)}, {"lr": "ln(close / lag(close) OVER s)", "bull": "CAST(close > open AS DOUBLE)"}, {"vol": roll("stddev_samp", "lr", 20)})
add_sql("w29e_volume_metrics", indicators.volume_metrics, {"up_volume": roll("sum", "uv", 50), "down_volume": roll("sum", "dv", 50), "up_distance": roll("sum", "ud", 50), "down_distance": roll("sum", "dd", 50)}, {"d": STEP}, {"uv": "CASE WHEN d > 0 THEN volume ELSE 0 END", "dv": "CASE WHEN d < 0 THEN volume ELSE 0 END", "ud": "CASE WHEN d > 0 THEN d ELSE 0 END", "dd": "CASE WHEN d < 0 THEN -d ELSE 0 END"})
add_sql("w29f_obv", indicators.obv, {"obv": "sum(coalesce(sign(d), 0) * volume) OVER cum"}, {"d": STEP})
add_sql("w29g_structural_range", indicators.structural_range, {"range_high": "t", "range_low": "b", "range_width": "t - b", "range_pos": div("close - b", "t - b")}, {"t": roll("max", "high", 50, 20), "b": roll("min", "low", 50, 20)})
add_sql("w29i_metric_momentum", indicators.metric_momentum, {"metric_ratio": "q", "metric_dir": "CAST(CASE WHEN q > 1.2 THEN 1 WHEN q < 0.8 THEN -1 ELSE 0 END AS INTEGER)"}, {"g": f"100 * {div('high - low', 'open')}"}, {"q": div(roll("avg", "g", 5), roll("avg", "g", 20))}, plain=("metric_dir",))
add_sql("w29j_rolling_zscore", lambda b: indicators.rolling_zscore(b, "close", 10, "z"), {"z": f"CASE WHEN count(close) OVER r11 >= 5 THEN coalesce({div('close - avg(close) OVER r11', 'stddev_samp(close) OVER r11')}, 0) END"})
add_sql("w29l_csm", indicators.currency_strength, {"csm": "CASE WHEN z IS NOT NULL THEN least(greatest(z, -3), 3) / 3 END"}, {"pct": div(STEP, "lag(close) OVER s")}, {"z": div(f"pct - {roll('avg', 'pct', 20)}", roll("stddev_samp", "pct", 20))})
add(
    "w29s_prev_period_high_low", indicators.prev_period_high_low, ("prev_high", "prev_low", "broke_high", "broke_low"),
    f"WITH {HOURLY}, p AS (SELECT symbol, date_trunc('day', ts) AS d, max(high) AS h, min(low) AS l FROM bars GROUP BY 1, 2), q AS (SELECT symbol, d, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM p WINDOW w AS (PARTITION BY symbol ORDER BY d)) SELECT b.symbol, b.ts, round(ph, 6) AS prev_high, round(pl, 6) AS prev_low, coalesce(max(high) OVER w > ph, false) AS broke_high, coalesce(min(low) OVER w < pl, false) AS broke_low FROM bars b JOIN q ON q.symbol = b.symbol AND q.d = date_trunc('day', b.ts) WINDOW w AS (PARTITION BY b.symbol, date_trunc('day', b.ts) ORDER BY b.ts ROWS UNBOUNDED PRECEDING)",
)
add_sql(
    "w29t_sessions", lambda b: indicators.session_extremes(b, 22, 3), {"in_session": "a", "session_high": "CASE WHEN a THEN max(high) OVER (PARTITION BY symbol, sid, a ORDER BY ts ROWS UNBOUNDED PRECEDING) END", "session_low": "CASE WHEN a THEN min(low) OVER (PARTITION BY symbol, sid, a ORDER BY ts ROWS UNBOUNDED PRECEDING) END"},
    {"a": "hour(ts) >= 22 OR hour(ts) <= 3"}, {"st": "CAST(a AND NOT coalesce(lag(a) OVER s, false) AS INTEGER)"}, {"sid": "sum(st) OVER cum"}, plain=("in_session",),
)
_before = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
add_sql(
    "w29v_exhaustion", indicators.exhaustion, {"volume_z": "z", "volume_ratio": "q", "exhaustion_score": "sc", "exhausted": "coalesce(sc >= 0.6, false)"},
    {"n": f"count(volume) {_before}", "m": f"avg(volume) {_before}", "sd": f"stddev_pop(volume) {_before}", "uw": div(UW, SPAN), "lw": div(LW, SPAN), "loc": div("close - low", "high - low")},
    {"z": f"CASE WHEN n = 20 THEN {div('volume - m', 'sd')} END", "q": f"CASE WHEN n = 20 THEN {div('volume', 'm')} END"},
    {"sc": "0.4 * CAST(round(z, 9) >= 2 OR round(q, 9) >= 2 AS DOUBLE) + 0.35 * CAST(greatest(uw, lw) >= 0.5 AS DOUBLE) + 0.25 * CAST(loc >= 0.7 OR loc <= 0.3 AS DOUBLE)"}, plain=("exhausted",),
)
add_sql(
    "w29w_fvg", indicators.fair_value_gaps, {"fvg": "CAST(CASE WHEN up THEN 1 WHEN down THEN -1 ELSE 0 END AS INTEGER)", "fvg_top": "CASE WHEN up THEN lead(low) OVER s WHEN down THEN lag(low) OVER s END", "fvg_bottom": "CASE WHEN up THEN lag(high) OVER s WHEN down THEN lead(high) OVER s END"},
    {"up": "lag(high) OVER s < lead(low) OVER s AND close > open", "down": "lag(low) OVER s > lead(high) OVER s AND close < open"}, plain=("fvg",),
)
add_sql(
    "w29x_fractals", indicators.fractals, {"is_support": "coalesce(low < lag(low) OVER s AND low < lead(low) OVER s AND lead(low) OVER s < lead(low, 2) OVER s AND lag(low) OVER s < lag(low, 2) OVER s, false)", "is_resistance": "coalesce(high > lag(high) OVER s AND high > lead(high) OVER s AND lead(high) OVER s > lead(high, 2) OVER s AND lag(high) OVER s > lag(high, 2) OVER s, false)"}, plain=("is_support", "is_resistance"),
)
_around = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
add_sql("w29x_pivots", indicators.pivots, {"is_pivot": "CAST(CASE WHEN n = 11 AND high = mx AND low = mn THEN 3 WHEN n = 11 AND high = mx THEN 1 WHEN n = 11 AND low = mn THEN 2 ELSE 0 END AS INTEGER)"}, {"n": f"count(*) {_around}", "mx": f"max(high) {_around}", "mn": f"min(low) {_around}"}, plain=("is_pivot",))
_dist = lambda x: f"CASE WHEN {div(x, 'u')} IS NOT NULL THEN least(greatest({div(x, 'u')}, 0), 10) END"
add_sql("z04_quantile_zones", indicators.quantile_zones, {"support": "lo", "resistance": "hi", "support_dist": _dist("abs(close - lo)"), "resistance_dist": _dist("abs(hi - close)")}, {"tr": TR}, {"u": roll("avg", "tr", 14), "lo": roll("quantile_cont({}, 0.2)", "close", 50), "hi": roll("quantile_cont({}, 0.8)", "close", 50)})
add_sql("z20_mean_reversion", indicators.mean_reversion, {"mr_z": "z", "mr_state": "CASE WHEN z > 2 THEN 'overbought' WHEN z < -2 THEN 'oversold' WHEN z IS NOT NULL THEN 'neutral' END", "mr_expected": div(f"{roll('avg', 'close', 20)} - close", "close")}, {"z": div(f"close - {roll('avg', 'close', 20)}", roll("stddev_samp", "close", 20))}, plain=("mr_state",))
add_sql("t16_rolling_quantile_norm", lambda b: indicators.rolling_quantile_norm(b, "close", 50, "norm"), {"norm": div("close - a", "b - a")}, {"a": roll("quantile_cont({}, 0.05)", "close", 50), "b": roll("quantile_cont({}, 0.95)", "close", 50)})


# --- recurrences: SQL follows the rows one by one -------------------------------------------------------------------
def _recursive(first: str, step: str, final: dict[str, str], layers: str = "", carry: str = "y") -> str:
    """Rows numbered k from 1; ``first`` gives the carried columns at k = 1, ``step`` at b.k from p (the row before)."""
    cols = ", ".join(f"round({e}, 6) AS {n}" for n, e in final.items())
    return f"WITH RECURSIVE {HOURLY}{layers}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc, (open + high + low + close) / 4 AS hc FROM bars), rec AS (SELECT n.*, {first} FROM n WHERE k = 1 UNION ALL SELECT b.*, {step} FROM rec p JOIN n b ON b.symbol = p.symbol AND b.k = p.k + 1) SELECT symbol, ts, {cols} FROM rec"


add("w30_ema", lambda b: recursive.ema(b, "close", 21), ("ema_21",), _recursive("CAST(close AS DOUBLE) AS y", "b.close * 2 / 22 + p.y * 20 / 22", {"ema_21": "y"}))
add(
    "w32_macd", recursive.macd, ("macd", "macd_signal", "macd_hist"),
    _recursive("CAST(close AS DOUBLE) AS f, CAST(close AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS sg", "b.close * 2 / 13 + p.f * 11 / 13, b.close * 2 / 27 + p.g * 25 / 27, ((b.close * 2 / 13 + p.f * 11 / 13) - (b.close * 2 / 27 + p.g * 25 / 27)) * 2 / 10 + p.sg * 8 / 10", {"macd": "f - g", "macd_signal": "sg", "macd_hist": "f - g - sg"}),
)
_up, _dn = "greatest(b.close - b.pc, 0)", "greatest(b.pc - b.close, 0)"
_wilder = lambda x, y: f"CASE WHEN b.k <= 15 THEN p.{y} + {x} / 14 ELSE p.{y} * 13 / 14 + {x} / 14 END"
add(
    "w33_rsi_wilder", recursive.rsi, ("rsi",),
    _recursive("CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS d", f"{_wilder(_up, 'u')}, {_wilder(_dn, 'd')}", {"rsi": "CASE WHEN k < 15 THEN NULL WHEN u + d = 0 THEN 50 ELSE 100 * u / (u + d) END"}),
)
add("w37_heikin_ashi", recursive.heikin_ashi, ("ha_open", "ha_high", "ha_low", "ha_close"), _recursive("(open + close) / 2 AS y", "(p.y + p.hc) / 2", {"ha_open": "y", "ha_high": "greatest(high, y, hc)", "ha_low": "least(low, y, hc)", "ha_close": "hc"}))
_wma = lambda n: f"({' + '.join(f'{n - i} * ' + (f'lag(close, {i}) OVER s' if i else 'close') for i in range(n))}) / {n * (n + 1) / 2}"
add_sql("w31_hull", lambda b: recursive.hull(b, "close", 9, "hma"), {"hma": "(3 * x + 2 * lag(x) OVER s + lag(x, 2) OVER s) / 6"}, {"x": f"2 * {_wma(4)} - {_wma(9)}"})
for _name, _op, _cols in (
    ("w35_supertrend", recursive.supertrend, ("supertrend", "supertrend_dir")),
    ("w36_psar", recursive.psar, ("psar", "psar_dir")),
    ("w40_zigzag", lambda b: recursive.zigzag(b, 0.5, 0.5), ("zz_pivot", "zz_known")),
    ("w51_tdi", recursive.tdi, ("tdi_rsi", "tdi_upper", "tdi_lower", "tdi_line", "tdi_signal")),
    ("w33b_rsi_features", recursive.rsi_features, ("rsi", "rsi_pct", *(f"rsi_diff_{i}" for i in range(1, 6)))),
):
    add(_name, _op, _cols, None)
add_sql(
    "w47_trendlines", recursive.trendlines, {"line_slope": "sl", "resistance_line": "list_max(list_transform(win, lambda p: p.high - sl * p.x)) + sl * x", "support_line": "list_min(list_transform(win, lambda p: p.low - sl * p.x)) + sl * x"},
    {"x": "CAST(row_number() OVER s AS DOUBLE)"}, {"sl": "CASE WHEN count(close) OVER r50 = 50 THEN regr_slope(close, x) OVER r50 END", "win": "list({'x': x, 'high': high, 'low': low}) OVER r50"},
)

# --- labels ---------------------------------------------------------------------------------------------------------
_fwd = {f"fwd_ret_{n}": f"coalesce({div(f'lead(close, {n}) OVER s - close', 'close')}, 0)" for n in (1, 3, 5)}
add_sql("l01_forward_returns", labels.forward_returns, _fwd | {f"fwd_up_{n}": f"CAST({_fwd[f'fwd_ret_{n}']} > 0 AS INTEGER)" for n in (1, 3, 5)}, plain=tuple(f"fwd_up_{n}" for n in (1, 3, 5)))
add_sql("l03_next_ohlcv", lambda b: labels.next_values(b, OHLCV, 2), {f"{c}_t{i}": f"lead({c}, {i}) OVER s" for c in OHLCV for i in (1, 2)})
add_sql("l05_mfe_mae", labels.mfe_mae, {"mfe": f"coalesce({div(f'{forward("max", "high", 24)} - close', 'close')}, 0)", "mae": f"coalesce({div(f'{forward("min", "low", 24)} - close', 'close')}, 0)"})
add_sql("l06_forward_log_returns", labels.forward_log_returns, {f"fwd_log_ret_{n}": f"coalesce(ln(lead(close, {n}) OVER s / close), 0)" for n in (1, 5, 10, 20)})
_w = [0.8**i for i in range(5)]
add_sql("l07_decayed_forward", lambda b: labels.decayed_forward(b, "close", 5, 0.8, "fwd"), {"fwd": f"({' + '.join(f'lead(close, {i + 1}) OVER s * {w}' for i, w in enumerate(_w))}) / {sum(_w)}"})
add_sql("l13_horizon_moves", labels.horizon_moves, {f"forward_move_{n}": f"lead(close, {n}) OVER s - close" for n in (1, 3, 6, 12)} | {f"target_dir_{n}": f"CAST(lead(close, {n}) OVER s > close AS INTEGER)" for n in (1, 3, 6, 12)}, plain=tuple(f"target_dir_{n}" for n in (1, 3, 6, 12)))
add_sql(
    "l04_dual_head", lambda b: labels.dual_head(b, "close", 50), {"score_rank": "rk", "score_class": "CASE WHEN rk < 0.33 THEN 'BEAR' WHEN rk > 0.67 THEN 'BULL' WHEN rk IS NOT NULL THEN 'WAIT' END"},
    {"win": "list(close) OVER r50"}, {"rk": "CASE WHEN len(win) > 1 THEN (len(list_filter(win, lambda y: y < close)) + (len(list_filter(win, lambda y: y = close)) - 1) / 2) / (len(win) - 1) END"}, plain=("score_class",),
)
_levels = [("r1", "high", ">=", "close * 1.2", 0.996), ("s1", "low", "<=", "close * 0.8", 1.004)]
add(
    "l10_next_zone", lambda b: labels.next_zone(b.withColumns({"r1": F.col("close") * 1.2, "s1": F.col("close") * 0.8}), 20, 0.004, ("r1", "s1")), ("next_zone", "next_zone_bars", "next_zone_dist"),
    over_bars(
        {"next_zone": "CASE WHEN n = 20 THEN CASE WHEN f IS NULL THEN 2 ELSE f.c END END", "next_zone_bars": "CASE WHEN n = 20 THEN coalesce(f.b, 21) END", "next_zone_dist": "CASE WHEN n = 20 THEN f.d END"},
        {"hs": "list(high) OVER f20", "ls": "list(low) OVER f20", "n": "count(*) OVER f20"},
        {"a": "list_position(list_transform(hs, lambda x: x >= close * 1.2 * 0.996), true)", "b0": "list_position(list_transform(ls, lambda x: x <= close * 0.8 * 1.004), true)"},
        {"f": "list_min(list_filter([CASE WHEN a > 0 THEN {'b': CAST(a - 1 AS BIGINT), 'd': abs(close * 1.2 - close), 'c': 0} END, CASE WHEN b0 > 0 THEN {'b': CAST(b0 - 1 AS BIGINT), 'd': abs(close * 0.8 - close), 'c': 1} END], lambda x: x IS NOT NULL))"},
        plain=("next_zone", "next_zone_bars"),
    ),
)

# --- scaling --------------------------------------------------------------------------------------------------------
_split = "CASE WHEN k - 1 < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN k - 1 < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END"
_numbered = {"k": "row_number() OVER s", "n": "count(*) OVER (PARTITION BY symbol)"}
add_sql("t01_split_sequential", scaling.split_sequential, {"split": _split}, _numbered, plain=("split",))
add_sql("t15_training_blocks", lambda b: scaling.training_blocks(b, 7), {"block": "CAST(least((k - 1) // greatest(n // 7, 1), 6) AS BIGINT)"}, _numbered, plain=("block",))
_train = lambda agg: f"{agg} FILTER (WHERE split = 'train') OVER (PARTITION BY symbol)"


def _scaled(b: DataFrame) -> DataFrame:
    b = scaling.split_sequential(b)
    fitted = scaling.fit_scaler(b, ("close", "open", "volume"))
    return scaling.apply_scaler(b, fitted, {"close": "minmax", "open": "standard", "volume": "robust"})


add_sql(
    "t03_scaler", _scaled, {"close": f"coalesce({div('close - mn', 'mx - mn')}, 0)", "open": f"coalesce({div('open - me', 'sd')}, 0)", "volume": f"coalesce({div('volume - q2', 'q3 - q1')}, 0)"},
    _numbered, {"split": _split}, {"mn": _train("min(close)"), "mx": _train("max(close)"), "me": _train("avg(open)"), "sd": _train("stddev_pop(open)"), "q1": _train("quantile_cont(volume, 0.25)"), "q2": _train("quantile_cont(volume, 0.5)"), "q3": _train("quantile_cont(volume, 0.75)")},
)
add_sql("t06_diff_scalers", lambda b: scaling.diff_scalers(scaling.split_sequential(b), ("close",)), {"close": f"1 / (1 + exp(-coalesce({div('close - me', 'sd')}, 0)))"}, _numbered, {"split": _split}, {"me": _train("avg(close)"), "sd": _train("stddev_pop(close)")})
add_sql("t08_returns_transform", scaling.returns_transform, {**{f"{c}_ret": div(f"{c} - lag({c}) OVER s", f"lag({c}) OVER s") for c in ("open", "high", "low", "close")}, "volume_rel": div("volume", roll("avg", "volume", 20))})
add_sql(
    "t11_feature_window", lambda b: scaling.feature_window(b, ("close", "volume"), 5).withColumns({"n": F.size("window"), "total": F.aggregate("window", F.lit(0.0), lambda a, x: a + x), "oldest": F.col("window")[0]}), {"n": "CAST(10 AS INTEGER)", "total": "sum(close + volume) OVER r5", "oldest": "coalesce(lag(close, 4) OVER s, 0)"}, plain=("n",),
)
