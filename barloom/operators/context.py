"""Features that set bars against something else: the dollar, their footprint, their own recent extremes; and what follows from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import KEYS, as_col, clip, diff, lag, last_rows, linear_scan, linear_scans, ratio, roll, series, whole
from . import indicators, recursive
from .candles import tf_regime

#: Raw footprint columns that bars take on, without their prefix fp_.
FOOTPRINT = ("poc", "vah", "val", "delta", "imbalance_max", "high_vol_rejection")


def merge_footprint(bars: DataFrame, footprint: DataFrame) -> DataFrame:
    """Bars with the footprint of their time as fp_*, and ``fp_data_available`` 1 or 0; footprint columns that aren't there are null. J15

    ``footprint`` holds one row for each (symbol, bar). Bars without one stay.
    """
    have = [F.col(c).cast("double").alias(f"fp_{c}") if c in footprint.columns else F.lit(None).cast("double").alias(f"fp_{c}") for c in FOOTPRINT]
    found = footprint.select("symbol", F.col("bar").alias("ts"), *have, F.lit(1.0).alias("fp_data_available"))
    joined = bars.drop(*[f"fp_{c}" for c in FOOTPRINT], "fp_data_available").join(found, ["symbol", "ts"], "left")
    return joined.withColumn("fp_data_available", F.coalesce("fp_data_available", F.lit(0.0)))


def footprint_features(df: DataFrame, n: int = 20, back: int = 1) -> DataFrame:
    """Distances to the point of control and the value area, delta and its sum over n rows, and where delta doesn't follow the price. W29h"""
    c = F.col("close")
    zero = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    df = df.withColumns({f"fp_{k}_diff": F.col(f"fp_{k}") - c for k in ("poc", "vah", "val")} | {"fp_delta": zero("fp_delta")})
    before = lag("fp_delta", back)
    against = ((c > lag("close", back)) & (F.col("fp_delta") <= before)) | ((c < lag("close", back)) & (F.col("fp_delta") >= before))
    return df.withColumns({
        "fp_cum_delta": roll(F.sum, "fp_delta", n, 1), "fp_imbalance": clip(zero("fp_imbalance_max"), 0, 1), "fp_delta_divergence": F.coalesce(against.cast("double"), F.lit(0.0)), "fp_rejection": zero("fp_high_vol_rejection"),
    })


def divergence_scale(df: DataFrame, columns: tuple[str, ...], n: int, most: int = 3000) -> DataFrame:
    """The last ``most`` rows of each series: change over n rows in per cent, its z-score (0 where there is none), and the least and greatest z other than 0. W29k

    A price that isn't positive counts as missing. The extremes are those of the first column.
    """
    newest = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("ts").desc()))
    df = df.withColumn("_r", newest).filter(F.col("_r") <= most).drop("_r")
    price = {c: F.when(F.col(c) > 0, F.col(c)) for c in columns}
    df = df.withColumns({f"{c}_pct": 100 * ratio(price[c] - F.lag(price[c], n).over(series()), F.lag(price[c], n).over(series())) for c in columns})
    for c in columns:
        df = indicators.rolling_zscore(df, f"{c}_pct", n, f"{c}_norm").withColumn(f"{c}_norm", F.coalesce(f"{c}_norm", F.lit(0.0)))
    z = F.nullif(F.col(f"{columns[0]}_norm"), F.lit(0.0))
    bounds = df.groupBy(*KEYS).agg(F.coalesce(F.min(z), F.lit(0.0)).alias("norm_min"), F.coalesce(F.max(z), F.lit(0.0)).alias("norm_max"))
    return df.join(bounds, list(KEYS))


def dollar_crosses(df: DataFrame, dollar_fast: str, asset_fast: str, dollar_slow: str, asset_slow: str) -> DataFrame:
    """Rows where the dollar falls below the asset on both measures (bull) or rises above it (bear), having been otherwise on one. W29m

    The last row of a series is provisional. Rows with a missing value, or after one, give nothing.
    """
    df = df.withColumns({"_f": F.col(dollar_fast) - F.col(asset_fast), "_s": F.col(dollar_slow) - F.col(asset_slow)})
    f, s, pf, ps = F.col("_f"), F.col("_s"), lag("_f"), lag("_s")
    known = f.isNotNull() & s.isNotNull() & pf.isNotNull() & ps.isNotNull()
    kind = F.when(known & ((pf >= 0) | (ps >= 0)) & (f < 0) & (s < 0), "bull").when(known & ((pf <= 0) | (ps <= 0)) & (f > 0) & (s > 0), "bear")
    out = df.withColumns({"kind": kind, "provisional": F.lead(F.lit(True)).over(series()).isNull()})
    return out.filter(F.col("kind").isNotNull()).select(*KEYS, "ts", "kind", F.lit("dxy-symbol").alias("source"), "provisional")


def rsi_crosses(df: DataFrame, asset: str, dollar: str, n: int = 9) -> DataFrame:
    """Crosses of the asset's and the dollar's value with their own signal line, and of the two with each other. W08"""
    df = indicators.signal_line(indicators.signal_line(df, asset, n, "_asset"), dollar, n, "_dollar")
    pairs = ((asset, "_asset", "index-signal"), (dollar, "_dollar", "dxy-signal"), (asset, dollar, "index-dxy"))
    found = [indicators.pair_crosses(df, a, b, source) for a, b, source in pairs]
    return found[0].unionByName(found[1]).unionByName(found[2])


def regime_changes(df: DataFrame, asset_slow: str, dollar_slow: str, asset_fast: str, dollar_fast: str) -> DataFrame:
    """Rows whose regime isn't that of the row before; rows with a missing value don't count. W29y"""
    known = df.withColumn("regime", tf_regime(asset_slow, dollar_slow, asset_fast, dollar_fast)).filter(F.col("regime").isNotNull())
    return known.withColumn("before", F.lag("regime").over(series())).filter(F.col("regime") != F.col("before"))


def bias_signals(changes: DataFrame) -> DataFrame:
    """Enter, add and exit signals of one position that follows regime_changes(). W38

    A strong regime turns the position to its side (after leaving the other one), or adds to it; a weak one of the position's
    other side ends it. The position before a change is the side of the last strong one, unless such a weak one came since: so
    no row-by-row fold is needed.
    """
    side = F.when(F.col("regime") == "STRONG_ASSET", "LONG").when(F.col("regime") == "STRONG_DXY", "SHORT")
    w = series().rowsBetween(Window.unboundedPreceding, -1)
    df = changes.withColumn("_side", side).withColumns({"_last": F.last("_side", ignorenulls=True).over(w), "_phase": F.count("_side").over(w)})
    ends = ((F.col("_last") == "LONG") & (F.col("regime") == "WEAK_DXY")) | ((F.col("_last") == "SHORT") & (F.col("regime") == "WEAK_ASSET"))
    within = Window.partitionBy(*KEYS, "_phase").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_ends", ends & F.col("_side").isNull())
    left = F.coalesce(F.max(F.col("_ends")).over(within), F.lit(False))
    df = df.withColumn("_at", F.when(~left, F.col("_last")))
    at, to = F.col("_at"), F.col("_side")
    leave = F.when(to.isNotNull() & at.isNotNull() & (at != to), F.struct(F.concat(F.lit("EXIT "), at).alias("signal"), F.lit("Confirmed").alias("confirmation")))
    turn = F.when(to.isNotNull(), F.struct(F.concat(F.when(at == to, "ADD ").otherwise("ENTER "), to).alias("signal"), F.lit("Confirmed").alias("confirmation")))
    end = F.when(F.col("_ends") & at.isNotNull(), F.struct(F.concat(F.lit("EXIT "), at).alias("signal"), F.lit("Reversal").alias("confirmation")))
    return df.select(*KEYS, "ts", "regime", F.explode(F.array_compact(F.array(leave, turn, end))).alias("e")).select(*KEYS, "ts", "regime", "e.*")


def meta_features(df: DataFrame, rsi: str | None = None) -> DataFrame:
    """Sixteen features of a signal's row. W29p

    ``rsi`` names a column of 0 to 100 (50 where null, or without one). The change over five rows is 0 on a series' first five.
    """
    c, low, high = F.col("close"), F.col("low"), F.col("high")
    tiny = lambda x: F.greatest(x, F.lit(1e-8))
    r = F.coalesce(F.col(rsi), F.lit(50.0)) / 100 if rsi else F.lit(0.5)
    df = df.withColumns({"_rsi": r, "_tr": indicators.true_range(), "_ret": F.coalesce(ratio(diff("close"), lag("close")), F.lit(0.0))})
    mean = lambda x, n: roll(F.avg, x, n, 1)
    around = last_rows(20)
    df = df.withColumns({
        "_top": F.max("high").over(around), "_bottom": F.min("low").over(around), "_lows": F.collect_list("low").over(around), "_closes": F.collect_list("close").over(around),
        "_high20": roll(F.max, "close", 20, 1), "_low20": roll(F.min, "close", 20, 1), "_sma20": mean("close", 20), "_sma50": mean("close", 50),
    })
    near = 0.15 * (F.col("_top") - F.col("_bottom") + 1e-8)
    at_low = F.size(F.filter("_lows", lambda x: F.abs(x - F.col("_bottom")) <= near))
    beyond = F.size(F.filter("_closes", lambda x: x >= F.col("_top") * 0.995)) + F.size(F.filter("_closes", lambda x: x <= F.col("_bottom") * 1.005))
    swing = F.coalesce(F.stddev_samp("_ret").over(last_rows(10)), F.lit(0.0))
    calm = F.coalesce(F.nullif(F.stddev_samp("_ret").over(last_rows(40)), F.lit(0.0)), F.lit(1e-8))
    turn = 2 * math.pi * F.hour("ts") / 24
    features = {
        "rsi": F.col("_rsi"), "rsi_ma_diff": F.col("_rsi") - mean("_rsi", 14), "dxy_rsi_diff": F.lit(0.0), "csm_strength": (c - F.col("_sma20")) / tiny(F.col("_sma20")), "atr_norm": mean("_tr", 14) / tiny(c), "volatility_surge": swing / calm,
        "momentum_delta": F.coalesce(diff("close", 5) / tiny(c), F.lit(0.0)), "volume_ratio": F.col("volume") / tiny(mean("volume", 20)), "snr_distance": (c - F.col("_low20")) / tiny(F.col("_high20") - F.col("_low20")),
        "bounce_count": at_low / 20, "breakout_count": beyond / 20, "trend_alignment": F.tanh((F.col("_sma20") - F.col("_sma50")) / tiny(c) * 50), "hour_sin": F.sin(turn), "hour_cos": F.cos(turn), "day_of_week": F.weekday("ts") / 6, "timeframe_scale": F.lit(1.0),
    }
    helpers = ("_rsi", "_tr", "_ret", "_top", "_bottom", "_lows", "_closes", "_high20", "_low20", "_sma20", "_sma50")
    return df.withColumns({f"meta_{k}": F.coalesce(x, F.lit(0.0)) for k, x in features.items()}).drop(*helpers)


def directional_index(df: DataFrame, n: int = 14, out: str = "adx") -> DataFrame:
    """Wilder's directional index; its three means share one scan, and each starts with its first value. W29z"""
    up, down = diff("high"), -diff("low")
    df = df.withColumns({"_plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0), "_tr": indicators.true_range()})
    first = F.row_number().over(series()) == 1
    df = df.withColumns({f"_b{k}": F.when(first, F.col(k)).otherwise(F.col(k) / n) for k in ("_plus", "_minus", "_tr")})
    df = linear_scans(df, {f"_m{k}": (f"_b{k}", 1 - 1 / n) for k in ("_plus", "_minus", "_tr")})
    plus, minus = ratio("_m_plus", "_m_tr"), ratio("_m_minus", "_m_tr")
    df = df.withColumn("_dx", F.coalesce(100 * ratio(F.abs(plus - minus), plus + minus), F.lit(0.0)))
    df = df.withColumn("_d", F.when(F.row_number().over(series()) == 1, F.col("_dx")).otherwise(F.col("_dx") / n))
    helpers = [f"{p}{k}" for p in ("", "_b", "_m") for k in ("_plus", "_minus", "_tr")]
    return linear_scan(df, "_d", 1 - 1 / n, out).drop(*helpers, "_dx", "_d")


def wave_trend(df: DataFrame, n: int = 10, smooth: int = 11, out: str = "wavetrend") -> DataFrame:
    """Typical price against its EMA in EMAs of that distance, smoothed. W29z"""
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = recursive.ema(df, "_tp", n, "_esa").withColumn("_far", F.abs(F.col("_tp") - F.col("_esa")))
    df = recursive.ema(df, "_far", n, "_d").withColumn("_ci", (F.col("_tp") - F.col("_esa")) / (0.015 * F.col("_d") + 1e-10))
    return recursive.ema(df, "_ci", smooth, out).drop("_tp", "_esa", "_far", "_d", "_ci")


def neighbour_features(df: DataFrame) -> DataFrame:
    """rsi, cci by the mean absolute deviation of 20 rows, adx and wavetrend: what nearest_history() compares. W29z"""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("_tp", tp).withColumns({"_mean": roll(F.avg, "_tp", 20), "_tps": F.collect_list("_tp").over(last_rows(20))})
    spread = F.aggregate("_tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mean"))) / 20
    df = df.withColumn("cci", F.when(F.col("_mean").isNotNull(), ratio(F.col("_tp") - F.col("_mean"), 0.015 * spread))).drop("_tp", "_mean", "_tps")
    return wave_trend(directional_index(recursive.rsi(df)))


def signal_series(df: DataFrame, signals: DataFrame, source: str, out: str) -> DataFrame:
    """``out``: 1 at rows with a bull signal of ``source``, -1 at those with a bear one, 0 elsewhere; of several the last kind by name. Z17"""
    sign = F.when(F.col("kind").isin("bull", "bullish"), 1.0).otherwise(-1.0)
    at = signals.filter(F.col("source") == source).groupBy(*KEYS, "ts").agg(F.max_by(sign, "kind").alias(out))
    return df.join(at, [*KEYS, "ts"], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def decision_matrix(df: DataFrame, dollar: str, n_slow: int = 50, n_fast: int = 10) -> DataFrame:
    """Change norms of asset and dollar, their differences, regime and crosses, beside the bar's features; nulls 0. Z17"""
    slow = divergence_scale(df, ("close", dollar), n_slow, 2**31 - 1).withColumnsRenamed({"close_norm": "asset_slow", f"{dollar}_norm": "dollar_slow"}).drop("close_pct", f"{dollar}_pct", "norm_min", "norm_max")
    both = divergence_scale(slow, ("close", dollar), n_fast, 2**31 - 1).withColumnsRenamed({"close_norm": "asset_fast", f"{dollar}_norm": "dollar_fast"}).drop("close_pct", f"{dollar}_pct", "norm_min", "norm_max")
    both = both.withColumns({"slow_diff": F.col("asset_slow") - F.col("dollar_slow"), "fast_diff": F.col("asset_fast") - F.col("dollar_fast"), "regime": tf_regime("asset_slow", "dollar_slow", "asset_fast", "dollar_fast")})
    return signal_series(both, dollar_crosses(both, "dollar_fast", "asset_fast", "dollar_slow", "asset_slow"), "dxy-symbol", "cross_dxy_symbol")


def nearest_distances(df: DataFrame, support: Column | str, resistance: Column | str) -> DataFrame:
    """Signed distances to both levels in the bar's own range (at least 1e-8); 0 without a level. Z18"""
    c, span = F.col("close"), F.greatest(F.col("high") - F.col("low"), F.lit(1e-8))
    return df.withColumns({"snr_dist_support": F.coalesce((c - as_col(support)) / span, F.lit(0.0)), "snr_dist_resistance": F.coalesce((as_col(resistance) - c) / span, F.lit(0.0))})




#: Spans of the fast and slow change, of RSI and its mean, of the dollar proxy, and the bars that a cross is remembered.
FAST, SLOW, RSI_BARS, RSI_MEAN, PROXY, MEMORY = 5, 14, 14, 21, 200, 5
#: Bars of the quantile zones by timeframe.
ZONE_BARS = {"15m": 100, "1h": 30, "4h": 10}


def context_features(df: DataFrame) -> DataFrame:
    """Context of a bar against a dollar proxy, its own higher timeframes and quantile zones, 47 columns. W29o

    ``df`` may carry ``close_``, ``high_`` and ``low_`` of ``15m``, ``1h`` and ``4h``, aligned with the bars; a timeframe that isn't there has
    distance 10 and, for RSI, the bar's own close. The proxy is twice the close's EMA less the close. Norms are changes in
    two deviations of the whole series, clipped to [-1, 1], as the published form has it: they look at all of it.
    """
    c, have = F.col("close"), set(df.columns)
    flag = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    df = recursive.exponential(df, "close", 2 / (PROXY + 1), "_proxy").withColumn("dxy_close", 2 * F.col("_proxy") - c)
    sides = {"asset": "close", "dxy": "dxy_close"}
    df = df.withColumns({f"_{side}_{n}": F.coalesce(ratio(F.col(x) - lag(x, n), lag(x, n)), F.lit(0.0)) for side, x in sides.items() for n in (FAST, SLOW)})
    norm = lambda x: clip(F.col(x) / (2 * (F.stddev_pop(x).over(whole()) + 1e-8)), -1.0, 1.0)
    df = df.withColumns({f"{side}_{speed}_norm": norm(f"_{side}_{n}") for side in sides for speed, n in (("fast", FAST), ("slow", SLOW))})
    df = df.withColumns({f"{speed}_diff": F.col(f"asset_{speed}_norm") - F.col(f"dxy_{speed}_norm") for speed in ("slow", "fast")})
    slow, fast = F.col("slow_diff") >= 0, F.col("fast_diff") >= 0
    df = df.withColumns({"regime_strong_asset": flag(slow & fast), "regime_weak_asset": flag(slow & ~fast), "regime_weak_dxy": flag(~slow & fast), "regime_strong_dxy": flag(~slow & ~fast)})

    closes = {"asset": "close", "dxy": "dxy_close", **{tf: f"close_{tf}" if f"close_{tf}" in have else "close" for tf in ("15m", "1h")}}
    moved = {}
    for name, x in closes.items():
        d = F.coalesce(F.col(x) - lag(x), F.lit(0.0))
        moved |= {f"_up_{name}": F.greatest(d, F.lit(0.0)), f"_down_{name}": F.greatest(-d, F.lit(0.0))}
    df = df.withColumns(moved)
    strength = lambda name: F.coalesce(100 - 100 / (1 + roll(F.avg, f"_up_{name}", RSI_BARS) / (roll(F.avg, f"_down_{name}", RSI_BARS) + 1e-8)), F.lit(50.0))
    df = df.withColumns({f"_rsi_{name}": strength(name) for name in closes})
    own, dollar = F.col("_rsi_asset"), F.col("_rsi_dxy")
    df = df.withColumns({"mtf_rsi_asset": 0.5 * own + 0.3 * F.col("_rsi_15m") + 0.2 * F.col("_rsi_1h"), "mtf_rsi_dxy": dollar, "_own_mean": F.avg("_rsi_asset").over(last_rows(RSI_MEAN)), "_dollar_mean": F.avg("_rsi_dxy").over(last_rows(RSI_MEAN))})
    # on the threshold, a last digit shall not decide
    above = lambda x, y: F.round(x - y, 9) > 0
    df = df.withColumns({
        "mtf_rsi_diff": F.col("mtf_rsi_asset") - dollar, "state_asset_above_ma": flag(above(own, F.col("_own_mean"))), "state_dxy_above_ma": flag(above(dollar, F.col("_dollar_mean"))), "state_asset_above_dxy": flag(above(own, dollar)), "state_htf_bullish": flag(above(F.col("_rsi_1h"), F.lit(50.0))),
        "state_asset_ma_spread": clip((own - F.col("_own_mean")) / 50, -1.0, 1.0), "state_dxy_ma_spread": clip((dollar - F.col("_dollar_mean")) / 50, -1.0, 1.0), "state_asset_dxy_spread": clip((own - dollar) / 50, -1.0, 1.0),
    })
    crosses = {"cross_index_signal": "state_asset_above_ma", "cross_dxy_signal": "state_dxy_above_ma", "cross_index_dxy": "state_asset_above_dxy"}
    df = df.withColumns({f"_turn_{s}": F.col(s) - F.coalesce(lag(s), 1 - F.col(s)) for s in crosses.values()})
    recent = lambda s: F.max(F.greatest(F.col(f"_turn_{s}"), F.lit(0.0))).over(last_rows(MEMORY)) + F.min(F.least(F.col(f"_turn_{s}"), F.lit(0.0))).over(last_rows(MEMORY))
    df = df.withColumns({name: recent(s) for name, s in crosses.items()} | {"cross_dxy_symbol": clip(F.avg("fast_diff").over(last_rows(3)), -1.0, 1.0), "_unit": F.coalesce(roll(F.avg, F.col("high") - F.col("low"), 14), c * 0.005)})

    low_of = lambda x, n, least: F.coalesce(roll(lambda y: F.percentile(y, F.lit(0.2)), x, n, least), F.col(x))
    high_of = lambda x, n, least: F.coalesce(roll(lambda y: F.percentile(y, F.lit(0.8)), x, n, least), F.col(x))
    near, far = (f"{x}_15m" if f"{x}_15m" in have else x for x in ("low", "high"))
    df = df.withColumns({"_s": low_of("low", 100, 10), "_r": high_of("high", 100, 10), "_zs": low_of(near, 50, 12), "_zr": high_of(far, 50, 12)})
    away = lambda x: clip(x / (F.col("_unit") + 1e-8), 0.0, 10.0)
    out = {"snr_dist_support": away(c - F.col("_s")), "snr_dist_resistance": away(F.col("_r") - c), "zone_dist_support_atr": away(c - F.col("_zs")), "zone_dist_resistance_atr": away(F.col("_zr") - c)}
    for tf, n in ZONE_BARS.items():
        there = f"high_{tf}" in have and f"low_{tf}" in have
        out |= {f"snr_dist_support_{tf}": away(c - low_of(f"low_{tf}", n, n // 4)) if there else F.lit(10.0), f"snr_dist_resistance_{tf}": away(high_of(f"high_{tf}", n, n // 4) - c) if there else F.lit(10.0)}
    df = df.withColumns(out)
    at = {(side, tf): c + sign * F.col(f"snr_dist_{side}_{tf}") * F.col("_unit") for side, sign in (("support", -1), ("resistance", 1)) for tf in ("15m", "1h")}
    close_by = [F.round(F.abs(at[a, "15m"] - at[b, "1h"]) / (c + 1e-8), 9) <= 0.0015 for a in ("support", "resistance") for b in ("support", "resistance")]
    rising = flag(c >= F.col("open"))
    ds, dr = F.col("zone_dist_support_atr"), F.col("zone_dist_resistance_atr")
    df = df.withColumns({
        "mtf_snr_confluence": flag(close_by[0] | close_by[1] | close_by[2] | close_by[3]), "zone_in_support_zone": flag(F.round(ds, 9) <= 0.5), "zone_in_resistance_zone": flag(F.round(dr, 9) <= 0.5),
        "zone_price_position": clip(ratio(c - F.col("_zs"), F.greatest(F.col("_zr") - F.col("_zs"), F.col("_unit"))), 0.0, 1.0), "zone_approach_direction": clip(F.coalesce(c - lag("close", 3), F.lit(0.0)) / (F.col("_unit") + 1e-8), -3.0, 3.0),
        "_rising": rising, "_at_s": flag(F.round(ds, 9) <= 1.5), "_at_r": flag(F.round(dr, 9) <= 1.5),
    })
    share = lambda x, y: F.sum(x).over(last_rows(20)) / F.greatest(F.sum(y).over(last_rows(20)), F.lit(1.0))
    active = lambda side: sum((flag(F.round(f"snr_dist_{side}_{tf}", 9) <= 1.0) for tf in ZONE_BARS), F.lit(0.0))
    move = F.col("zone_approach_direction") / 3
    df = df.withColumns({
        "zone_support_vol_ratio": share(F.col("_rising") * F.col("_at_s"), F.col("_at_s")), "zone_resistance_vol_ratio": share((1 - F.col("_rising")) * F.col("_at_r"), F.col("_at_r")), "zone_support_confluence": active("support"), "zone_resistance_confluence": active("resistance"),
        "zone_bounce_signal": clip(1 - ds / 2, 0.0, 1.0) * clip(move, 0.0, 1.0) * F.col("_rising"), "zone_rejection_signal": clip(1 - dr / 2, 0.0, 1.0) * clip(-move, 0.0, 1.0) * (1 - F.col("_rising")),
    })
    return df.drop(*[x for x in df.columns if x.startswith("_")])
