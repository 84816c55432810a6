"""Indicators that window expressions state in full. Every function adds columns to bars and keeps the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import KEYS, as_col, clip, diff, ffill, lag, last_rows, lead, ratio, roll, series, so_far, whole


def price_basics(df: DataFrame) -> DataFrame:
    """Change, direction, neighbours, percentage change and the last five changes. W01"""
    d = diff("close")
    more = {f"diff_lag_{i}": lag("close", i) - lag("close", i + 1) for i in range(1, 6)}
    return df.withColumns({"price_diff": d, "price_dir": F.signum(d), "next_close": lead("close"), "prev_close": lag("close"), "pct_change": ratio(d, lag("close")), "high_lag_3": lag("high", 3), "low_lag_3": lag("low", 3), **more})


def momentum(df: DataFrame, n: int = 30) -> DataFrame:
    """Change over n rows, distance from the mean, and that in standard deviations. W02"""
    c = F.col("close")
    mean, sd = roll(F.avg, "close", n), roll(F.stddev_samp, "close", n)
    return df.withColumns({"mom": diff("close", n), "mean_rev": c - mean, "trend_factor": ratio(c - mean, sd)})


def moving(df: DataFrame, x: str = "close", n: int = 20) -> DataFrame:
    """Rolling mean, deviation, minimum and maximum. W03"""
    return df.withColumns({f"{x}_{k}_{n}": roll(f, x, n) for k, f in (("sma", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))})


def ma_differences(df: DataFrame, spans: tuple[int, ...] = (8, 21, 50)) -> DataFrame:
    """Means minus price, and each mean minus the next longer one. W04"""
    c = F.col("close")
    means = {n: roll(F.avg, "close", n) for n in spans}
    out: dict[str, Column] = {f"ma_{n}_diff": m - c for n, m in means.items()}
    out |= {f"ma_{a}_{b}_diff": means[a] - means[b] for a, b in zip(spans, spans[1:], strict=False)}
    return df.withColumns(out)


def ma_crossovers(df: DataFrame, fast: int = 8, slow: int = 21) -> DataFrame:
    """Whether the fast mean is at or above the slow one, and the change of that. W05"""
    df = df.withColumn("ma_up", F.when(roll(F.avg, "close", slow).isNotNull(), (roll(F.avg, "close", fast) >= roll(F.avg, "close", slow)).cast("int")))
    return df.withColumn("ma_up_change", F.col("ma_up") - lag("ma_up"))


def crossed_above(a: Column | str, b: Column | str) -> Column:
    """a over b now, and not the row before. W06"""
    a, b = as_col(a), as_col(b)
    return F.coalesce((a > b) & (lag(a) <= lag(b)), F.lit(False))


def crossed_below(a: Column | str, b: Column | str) -> Column:
    return crossed_above(b, a)


def pair_crosses(df: DataFrame, first: str, second: str, source: str) -> DataFrame:
    """Events where the first value meets or passes the second after strictly lying on the other side. W07"""
    a, b = F.col(first), F.col(second)
    up, down = (lag(a) < lag(b)) & (a >= b), (lag(a) > lag(b)) & (a <= b)
    return df.withColumn("direction", F.when(up, "bullish").when(down, "bearish")).filter("direction is not null").select("symbol", "ts", "direction", F.lit(source).alias("source"))


def signal_line(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Mean of the last n values that starts anew after a missing value. W09"""
    gap = F.sum(F.col(x).isNull().cast("int")).over(so_far())
    df = df.withColumn("_gap", gap)
    w = Window.partitionBy(*KEYS, "_gap").orderBy("ts").rowsBetween(1 - n, 0)
    return df.withColumn(out, F.when(F.col(x).isNotNull() & (F.count(x).over(w) == n), F.avg(x).over(w))).drop("_gap")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, ddof: int = 0) -> DataFrame:
    """Mean and bands of k deviations, width and position in them. W10"""
    c = F.col("close")
    mean, sd = roll(F.avg, "close", n), roll(F.stddev_pop if ddof == 0 else F.stddev_samp, "close", n)
    return df.withColumns({"bb_mid": mean, "bb_upper": mean + k * sd, "bb_lower": mean - k * sd, "bb_width": ratio(2 * k * sd, mean), "bb_pos": ratio(c - (mean - k * sd), 2 * k * sd)})


def true_range() -> Column:
    """Largest of the range and the distances from the close before. W12"""
    h, low = F.col("high"), F.col("low")
    pc = lag("close")
    return F.greatest(h - low, F.abs(h - pc), F.abs(low - pc))


def atr_sma(df: DataFrame, n: int = 14) -> DataFrame:
    """True range and its mean. W12"""
    df = df.withColumn("true_range", true_range())
    return df.withColumn("atr", roll(F.avg, "true_range", n))


def keltner(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Mean typical price and bands of k mean true ranges. W11"""
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    df = df.withColumns({"_tr": true_range(), "_tp": (h + low + c) / 3})
    mid, atr = roll(F.avg, "_tp", n), roll(F.avg, "_tr", n)
    return df.withColumns({"kc_mid": mid, "kc_upper": mid + k * atr, "kc_lower": mid - k * atr}).drop("_tr", "_tp")


def rolling_vwap(df: DataFrame, n: int = 20) -> DataFrame:
    """Volume-weighted typical price of the last n rows, carried on where there is no volume. W13"""
    h, low, c, v = F.col("high"), F.col("low"), F.col("close"), F.col("volume")
    df = df.withColumn("_tpv", v * (h + low + c) / 3)
    df = df.withColumn("_vwap", ratio(roll(F.sum, "_tpv", n), roll(F.sum, "volume", n)))
    return df.withColumn("vwap", ffill("_vwap")).drop("_tpv", "_vwap")


def returns(df: DataFrame, n: int = 14) -> DataFrame:
    """Simple and log return, rate of change, z-score and price-volume trend. W14"""
    c, v = F.col("close"), F.col("volume")
    r = ratio(diff("close"), lag("close"))
    df = df.withColumns({"ret": r, "log_ret": F.log(ratio(c, lag("close"))), "roc": 100 * ratio(diff("close", n), lag("close", n)), "zscore": ratio(c - roll(F.avg, "close", n), roll(F.stddev_samp, "close", n))})
    return df.withColumn("pvt", F.sum(F.col("ret") * v).over(so_far()))


def realised_vol(df: DataFrame, n: int = 20) -> DataFrame:
    """Deviation of log returns over n rows, times the root of n. W15"""
    c = F.col("close")
    df = df.withColumn("_lr", F.log(ratio(c, lag("close"))))
    return df.withColumn("realised_vol", roll(F.stddev_samp, "_lr", n) * F.sqrt(F.lit(float(n)))).drop("_lr")


def stochastic(df: DataFrame, n: int = 14, k: int = 3, d: int = 3) -> DataFrame:
    """Fast and slow %K, and %D. W16"""
    c = F.col("close")
    lowest, highest = roll(F.min, "low", n), roll(F.max, "high", n)
    df = df.withColumn("fast_k", 100 * ratio(c - lowest, highest - lowest))
    df = df.withColumn("slow_k", roll(F.avg, "fast_k", k))
    return df.withColumn("slow_d", roll(F.avg, "slow_k", d))


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    """Typical price against its mean, in 0.015 deviations of the mean over the whole series. W17 (looks ahead, by definition)"""
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    df = df.withColumn("_tp", (h + low + c) / 3)
    df = df.withColumn("_mean", roll(F.avg, "_tp", n))
    return df.withColumn("cci", ratio(F.col("_tp") - F.col("_mean"), 0.015 * F.stddev_pop("_mean").over(whole()))).drop("_tp", "_mean")


def choppiness(df: DataFrame, n: int = 14) -> DataFrame:
    """100 log10 of summed true range over the range of n rows, by log10 n. W18"""
    df = df.withColumn("_tr", true_range())
    spread = roll(F.max, "high", n) - roll(F.min, "low", n)
    return df.withColumn("choppiness", 100 * F.log10(ratio(roll(F.sum, "_tr", n), spread)) / F.log10(F.lit(float(n)))).drop("_tr")


def awesome_oscillator(df: DataFrame, fast: int = 5, slow: int = 34) -> DataFrame:
    """Difference of two means of the mid price. W19"""
    h, low = F.col("high"), F.col("low")
    df = df.withColumn("_mid", (h + low) / 2)
    return df.withColumn("ao", roll(F.avg, "_mid", fast) - roll(F.avg, "_mid", slow)).drop("_mid")


def pivot_levels(df: DataFrame, n: int = 15) -> DataFrame:
    """Pivot and three levels on either side from rolling means of high, low and close. W21"""
    mh, ml, mc = (roll(F.avg, x, n) for x in ("high", "low", "close"))
    p = (mh + ml + mc) / 3
    return df.withColumns({"pivot": p, "r1": 2 * p - ml, "s1": 2 * p - mh, "r2": p + (mh - ml), "s2": p - (mh - ml), "r3": mh + 2 * (p - ml), "s3": ml - 2 * (mh - p)})


def snr_vix(df: DataFrame, n: int = 20) -> DataFrame:
    """Signal to noise in decibels: rms change against rms range share of the close. W22"""
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    df = df.withColumns({"_d2": F.pow(ratio(diff("close"), lag("close")), 2.0), "_r2": F.pow(ratio(h - low, c), 2.0)})
    rms = lambda x: F.sqrt(roll(F.avg, x, n))
    return df.withColumns({"snr_db": 20 * F.log10(F.nullif(ratio(rms("_d2"), rms("_r2")), F.lit(0.0))), "vix": 100 * rms("_d2")}).drop("_d2", "_r2")


def trend_strength(df: DataFrame, n: int = 10) -> DataFrame:
    """Net change over the sum of changes. W23"""
    df = df.withColumn("_step", F.abs(diff("close")))
    return df.withColumn("trend_strength", ratio(F.abs(diff("close", n)), roll(F.sum, "_step", n))).drop("_step")


def vsi(df: DataFrame, n: int = 20) -> DataFrame:
    """Up minus down volume in per cent of both. W24"""
    o, c, v = F.col("open"), F.col("close"), F.col("volume")
    df = df.withColumns({"_up": F.when(c > o, v).otherwise(0.0), "_down": F.when(c < o, v).otherwise(0.0)})
    up, down = roll(F.sum, "_up", n), roll(F.sum, "_down", n)
    return df.withColumn("vsi", 100 * ratio(up - down, up + down)).drop("_up", "_down")


def price_velocity(df: DataFrame, n: int = 10) -> DataFrame:
    """Sum of rises and of falls over n rows, for each second that went by. W26"""
    d = diff("close")
    df = df.withColumns({"_rise": F.greatest(d, F.lit(0.0)), "_fall": F.greatest(-d, F.lit(0.0))})
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(lag("ts", n))
    up, down = ratio(roll(F.sum, "_rise", n), seconds), ratio(roll(F.sum, "_fall", n), seconds)
    return df.withColumns({"velocity_up": up, "velocity_down": down, "velocity_net": up - down}).drop("_rise", "_fall")


def volatility_regime(df: DataFrame, n: int = 20, long: int = 100) -> DataFrame:
    """Volatility against its rolling 95th percentile, short against long deviation, share of rising bars. W27"""
    o, c = F.col("open"), F.col("close")
    df = df.withColumns({"_lr": F.log(ratio(c, lag("close"))), "_bull": (c > o).cast("double")})
    df = df.withColumn("_vol", roll(F.stddev_samp, "_lr", n))
    p95 = roll(lambda x: F.percentile(x, F.lit(0.95)), "_vol", long)
    return df.withColumns({"vol_regime": ratio("_vol", p95), "vol_expansion": ratio(roll(F.stddev_samp, "close", 5), roll(F.stddev_samp, "close", n)), "bull_share": roll(F.avg, "_bull", n)}).drop("_lr", "_bull", "_vol")


def obv(df: DataFrame) -> DataFrame:
    """Running sum of volume signed by the change. W29f"""
    v = F.col("volume")
    return df.withColumn("_sv", F.coalesce(F.signum(diff("close")), F.lit(0.0)) * v).withColumn("obv", F.sum("_sv").over(so_far())).drop("_sv")


def volume_metrics(df: DataFrame, n: int = 50) -> DataFrame:
    """Up and down volume and distance of the last n rows. W29e"""
    v = F.col("volume")
    d = diff("close")
    df = df.withColumns({"_uv": F.when(d > 0, v).otherwise(0.0), "_dv": F.when(d < 0, v).otherwise(0.0), "_ud": F.when(d > 0, d).otherwise(0.0), "_dd": F.when(d < 0, -d).otherwise(0.0)})
    return df.withColumns({"up_volume": roll(F.sum, "_uv", n), "down_volume": roll(F.sum, "_dv", n), "up_distance": roll(F.sum, "_ud", n), "down_distance": roll(F.sum, "_dd", n)}).drop("_uv", "_dv", "_ud", "_dd")


def rolling_zscore(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """z by the sample deviation over the last n + 1 values, from max(2, min(n, 5)) of them on; 0 where they don't vary. W29j"""
    w = last_rows(n + 1)
    n_seen, mean, sd = F.count(x).over(w), F.avg(x).over(w), F.stddev_samp(x).over(w)
    return df.withColumn(out, F.when((n_seen >= max(2, min(n, 5))) & F.col(x).isNotNull(), F.coalesce(ratio(F.col(x) - mean, sd), F.lit(0.0))))


def currency_strength(df: DataFrame, n: int = 20, limit: float = 3.0) -> DataFrame:
    """Percentage change, as a z-score over n rows, clamped and scaled to [-1, 1]. W29l"""
    df = df.withColumn("_pct", ratio(diff("close"), lag("close")))
    z = ratio(F.col("_pct") - roll(F.avg, "_pct", n), roll(F.stddev_samp, "_pct", n))
    return df.withColumn("csm", clip(z, -limit, limit) / limit).drop("_pct")


def structural_range(df: DataFrame, n: int = 50) -> DataFrame:
    """Rolling highest and lowest price, and the close's place between them. W29g"""
    c = F.col("close")
    top, bottom = roll(F.max, "high", n, 20), roll(F.min, "low", n, 20)
    return df.withColumns({"range_high": top, "range_low": bottom, "range_width": top - bottom, "range_pos": ratio(c - bottom, top - bottom)})


def metric_momentum(df: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    """Ratio of a short to a long mean of the range, and its direction beyond 1.2 or under 0.8. W29i"""
    o, h, low = F.col("open"), F.col("high"), F.col("low")
    df = df.withColumn("_range", 100 * ratio(h - low, o))
    q = ratio(roll(F.avg, "_range", short), roll(F.avg, "_range", long))
    return df.withColumns({"metric_ratio": q, "metric_dir": F.when(q > 1.2, 1).when(q < 0.8, -1).otherwise(0)}).drop("_range")


def prev_period_high_low(df: DataFrame, unit: str = "day") -> DataFrame:
    """High and low of the period before the bar's own, and whether the current one has broken them so far. W29s"""
    df = df.withColumn("_period", F.date_trunc(unit, "ts"))
    periods = df.groupBy(*KEYS, "_period").agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
    w = Window.partitionBy(*KEYS).orderBy("_period")
    before = periods.select(*KEYS, "_period", F.lag("_h").over(w).alias("prev_high"), F.lag("_l").over(w).alias("prev_low"))
    inside = Window.partitionBy(*KEYS, "_period").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(before, [*KEYS, "_period"])
    return joined.withColumns({"broke_high": F.coalesce(F.max("high").over(inside) > F.col("prev_high"), F.lit(False)), "broke_low": F.coalesce(F.min("low").over(inside) < F.col("prev_low"), F.lit(False))}).drop("_period")


def session_extremes(df: DataFrame, start: int, end: int) -> DataFrame:
    """Whether the bar's hour lies in [start, end] (across midnight if start > end), and the session's high and low so far. W29t"""
    hour = F.hour("ts")
    active = ((hour >= start) & (hour <= end)) if start <= end else ((hour >= start) | (hour <= end))
    df = df.withColumn("in_session", active)
    df = df.withColumn("_session", F.sum((F.col("in_session") & ~F.coalesce(lag("in_session"), F.lit(False))).cast("int")).over(so_far()))
    w = Window.partitionBy(*KEYS, "_session", "in_session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"session_high": F.when(F.col("in_session"), F.max("high").over(w)), "session_low": F.when(F.col("in_session"), F.min("low").over(w))}).drop("_session")


def exhaustion(df: DataFrame, n: int = 20) -> DataFrame:
    """Volume and wicks against the n rows before this one; score of three parts, event from 0.6. W29v"""
    o, h, low, c, v = F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("volume")
    before = series().rowsBetween(-n, -1)
    full = F.count("volume").over(before) == n
    z = F.when(full, ratio(v - F.avg("volume").over(before), F.stddev_pop("volume").over(before)))
    relative = F.when(full, ratio(v, F.avg("volume").over(before)))
    span = h - low
    upper, lower = ratio(h - F.greatest(o, c), span), ratio(F.least(o, c) - low, span)
    # on the threshold, a last digit shall not decide
    loud = ((F.round(z, 9) >= 2) | (F.round(relative, 9) >= 2)).cast("double")
    score = 0.4 * loud + 0.35 * (F.greatest(upper, lower) >= 0.5).cast("double") + 0.25 * ((ratio(c - low, span) >= 0.7) | (ratio(c - low, span) <= 0.3)).cast("double")
    return df.withColumns({"volume_z": z, "volume_ratio": relative, "exhaustion_score": score, "exhausted": F.coalesce(score >= 0.6, F.lit(False))})


def fair_value_gaps(df: DataFrame) -> DataFrame:
    """Gaps between the bars around a candle (uses the next bar): kind, top, bottom. W29w"""
    o, c = F.col("open"), F.col("close")
    up = (lag("high") < lead("low")) & (c > o)
    down = (lag("low") > lead("high")) & (c < o)
    return df.withColumns({"fvg": F.when(up, 1).when(down, -1).otherwise(0), "fvg_top": F.when(up, lead("low")).when(down, lag("low")), "fvg_bottom": F.when(up, lag("high")).when(down, lead("high"))})


def fractals(df: DataFrame) -> DataFrame:
    """Five-bar support and resistance (uses the two next bars). W29x"""
    h, low = F.col("high"), F.col("low")
    l1, l2, n1, n2 = lag("low", 1), lag("low", 2), lead("low", 1), lead("low", 2)
    h1, h2, m1, m2 = lag("high", 1), lag("high", 2), lead("high", 1), lead("high", 2)
    flag = lambda x: F.coalesce(x, F.lit(False))
    return df.withColumns({"is_support": flag((low < l1) & (low < n1) & (n1 < n2) & (l1 < l2)), "is_resistance": flag((h > h1) & (h > m1) & (m1 > m2) & (h1 > h2))})


def pivots(df: DataFrame, w: int = 5) -> DataFrame:
    """Rows whose high or low is the extreme of w rows on both sides. W29x"""
    h, low = F.col("high"), F.col("low")
    around = series().rowsBetween(-w, w)
    full = F.count(F.lit(1)).over(around) == 2 * w + 1
    return df.withColumn("is_pivot", F.when(full & (h == F.max("high").over(around)) & (low == F.min("low").over(around)), 3).when(full & (h == F.max("high").over(around)), 1).when(full & (low == F.min("low").over(around)), 2).otherwise(0))


def quantile_zones(df: DataFrame, n: int = 50, q_low: float = 0.2, q_high: float = 0.8, atr: int = 14) -> DataFrame:
    """Support and resistance as rolling quantiles of the close, distances in mean true ranges within [0, 10]. Z04"""
    c = F.col("close")
    df = df.withColumn("_tr", true_range())
    unit = roll(F.avg, "_tr", atr)
    df = df.withColumns({"support": roll(lambda x: F.percentile(x, F.lit(q_low)), "close", n), "resistance": roll(lambda x: F.percentile(x, F.lit(q_high)), "close", n), "_unit": unit})
    dist = lambda x: clip(ratio(F.abs(x), "_unit"), 0, 10)
    return df.withColumns({"support_dist": dist(c - F.col("support")), "resistance_dist": dist(F.col("resistance") - c)}).drop("_tr", "_unit")


def rolling_quantile_norm(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Place of x between its rolling 5th and 95th percentiles. T16"""
    q5, q95 = (roll(lambda y, q=q: F.percentile(y, F.lit(q)), x, n) for q in (0.05, 0.95))
    return df.withColumn(out, ratio(F.col(x) - q5, q95 - q5))


def mean_reversion(df: DataFrame, n: int = 20) -> DataFrame:
    """z-score, state beyond two deviations, and the return back to the mean. Z20"""
    c = F.col("close")
    mean, sd = roll(F.avg, "close", n), roll(F.stddev_samp, "close", n)
    z = ratio(c - mean, sd)
    return df.withColumns({"mr_z": z, "mr_state": F.when(z > 2, "overbought").when(z < -2, "oversold").when(z.isNotNull(), "neutral"), "mr_expected": ratio(mean - c, c)})


def momentum_delta(df: DataFrame, x: str = "rsi") -> DataFrame:
    """(x - 50) / 50, less what it was 5, 10 and 20 rows before. W29d"""
    m = (F.col(x) - 50) / 50
    df = df.withColumn("_m", m)
    return df.withColumns({f"momentum_delta_{n}": F.col("_m") - lag("_m", n) for n in (5, 10, 20)}).drop("_m")


def cross_memory(df: DataFrame, a: str, b: str, n: int = 5) -> DataFrame:
    """Whether a crossed over or under b within the last n rows. W29n"""
    df = df.withColumns({"_up": crossed_above(a, b).cast("int"), "_down": crossed_below(a, b).cast("int")})
    return df.withColumns({"recent_up": F.max("_up").over(last_rows(n)) == 1, "recent_down": F.max("_down").over(last_rows(n)) == 1}).drop("_up", "_down")


def confirmed_crossovers(df: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """A cross of two means on the row before, shown on this one: it can't vanish any more. W39"""
    df = df.withColumns({"_f": roll(F.avg, "close", fast), "_s": roll(F.avg, "close", slow)})
    df = df.withColumn("_x", F.when(crossed_above("_f", "_s"), 1).when(crossed_below("_f", "_s"), -1).otherwise(0))
    return df.withColumn("confirmed_cross", F.coalesce(lag("_x"), F.lit(0))).drop("_f", "_s", "_x")


def adaptive_range(df: DataFrame, n: int = 20, factor: float = 1.5) -> DataFrame:
    """Rolling extremes widened by a multiple of the mean true range. W29r"""
    df = df.withColumn("_tr", true_range())
    atr = roll(F.avg, "_tr", n)
    top, bottom = roll(F.max, "high", n) + factor * atr, roll(F.min, "low", n) - factor * atr
    return df.withColumns({"adaptive_high": top, "adaptive_low": bottom, "adaptive_mid": (top + bottom) / 2, "adaptive_width": top - bottom}).drop("_tr")


def regime_context(df: DataFrame, n: int = 20) -> DataFrame:
    """Place in the adaptive range, and changes of its middle and width over 10 and 50 rows. W29q"""
    df = adaptive_range(df, n)
    return df.withColumns({
        "macro_position": ratio(F.col("close") - F.col("adaptive_low"), "adaptive_width"), "mid_roc_10": ratio(diff("adaptive_mid", 10), lag("adaptive_mid", 10)),
        "mid_roc_50": ratio(diff("adaptive_mid", 50), lag("adaptive_mid", 50)), "width_roc": ratio(diff("adaptive_width", 10), lag("adaptive_width", 10)),
    })


def session_trim(df: DataFrame, start: int = 17) -> DataFrame:
    """Rows of each series' current trading session: from hour ``start`` of the last row's day, or of the day before if that is yet to come. W29u"""
    last = F.max("ts").over(whole())
    day = F.date_trunc("day", last)
    opened = F.when(F.hour(last) >= start, day).otherwise(day - F.expr("interval 1 day")) + F.make_interval(hours=F.lit(start))
    return df.withColumn("_opened", opened).filter(F.col("ts") >= F.col("_opened")).drop("_opened")
