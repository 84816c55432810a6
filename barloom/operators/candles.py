"""Row-local features of candles, patterns of two or three bars, and time of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import as_col, clip, lag, ratio, roll


def span_of() -> Column:
    return F.col("high") - F.col("low")


def body_of() -> Column:
    return F.abs(F.col("close") - F.col("open"))


def upper_wick_of() -> Column:
    return F.col("high") - F.greatest("open", "close")


def lower_wick_of() -> Column:
    return F.least("open", "close") - F.col("low")


def typical_price(df: DataFrame) -> DataFrame:
    """typical, mid, and where the close lies in the bar (ibs, two places). P01"""
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    span = span_of()
    return df.withColumns({"typical": (h + low + c) / 3, "mid": (h + low) / 2, "ibs": F.round(ratio(c - low, span), 2)})


def candle_structure(df: DataFrame) -> DataFrame:
    """Direction, body and wick shares of the range (0.5 or 0 for a flat bar), log returns, volume z-score, relative high. P02"""
    o, low, c, v = F.col("open"), F.col("low"), F.col("close"), F.col("volume")
    span, body, upper_wick, lower_wick = span_of(), body_of(), upper_wick_of(), lower_wick_of()
    share = lambda x, flat: clip(F.coalesce(ratio(x, span), F.lit(flat)), 0, 1)
    return df.withColumns({
        "bar_dir": F.signum(c - o), "body_ratio": share(body, 0.0), "close_pos": share(c - low, 0.5),
        "upper_wick_ratio": share(upper_wick, 0.0), "lower_wick_ratio": share(lower_wick, 0.0),
        "ret_5": F.log(ratio(c, lag("close", 5))), "ret_20": F.log(ratio(c, lag("close", 20))),
        "vol_zscore": ratio(v - roll(F.avg, "volume", 20), roll(F.stddev_samp, "volume", 20)), "rel_high": ratio(c, roll(F.max, "high", 20)),
    })


def doji(df: DataFrame, exact: bool = False) -> DataFrame:
    """Open equals close, or lies within a tenth of high - close. P04"""
    o, h, c = F.col("open"), F.col("high"), F.col("close")
    body = body_of()
    return df.withColumn("doji", (o == c) if exact else (body <= 0.1 * (h - c)))


def pattern_flags(df: DataFrame) -> DataFrame:
    """Doji, hammer, shooting star, spinning top, marubozu and engulfing flags, with thresholds as shares of the range. P05"""
    o, c = F.col("open"), F.col("close")
    span, body, upper_wick, lower_wick = span_of(), body_of(), upper_wick_of(), lower_wick_of()
    po, pc = lag("open"), lag("close")
    flag = lambda x: F.coalesce(x, F.lit(False))
    return df.withColumns({
        "is_doji": flag(body <= 0.1 * span), "is_hammer": flag((lower_wick >= 2 * body) & (upper_wick <= 0.3 * body) & (body > 0)),
        "is_shooting_star": flag((upper_wick >= 2 * body) & (lower_wick <= 0.3 * body) & (body > 0)),
        "is_spinning_top": flag((body <= 0.3 * span) & (upper_wick > body) & (lower_wick > body)), "is_marubozu": flag((body >= 0.95 * span) & (span > 0)),
        "bull_engulfing": flag((c > o) & (pc < po) & (c >= po) & (o <= pc)), "bear_engulfing": flag((c < o) & (pc > po) & (c <= po) & (o >= pc)),
    })


def three_bar_patterns(df: DataFrame) -> DataFrame:
    """Names of the patterns that each bar completes. P06"""
    o, c = F.col("open"), F.col("close")
    span, body = span_of(), body_of()
    o1, c1, o2, c2 = lag("open", 1), lag("close", 1), lag("open", 2), lag("close", 2)
    b1, b2 = F.abs(c1 - o1), F.abs(c2 - o2)
    bull, bull1, bull2 = c >= o, c1 >= o1, c2 >= o2
    tests = [
        ("morning_star", ~bull2 & (b1 < b2 * 0.5) & bull & (c > (o2 + c2) / 2)),
        ("evening_star", bull2 & (b1 < b2 * 0.5) & ~bull & (c < (o2 + c2) / 2)),
        ("three_white_soldiers", bull & bull1 & bull2 & (c > c1) & (c1 > c2)),
        ("doji", body <= 0.1 * span),
    ]
    return df.withColumn("patterns", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests])))


def rejection_wicks(df: DataFrame, threshold: float = 0.4) -> DataFrame:
    """A row for each wick that takes more than ``threshold`` of its bar. P07"""
    span, upper_wick, lower_wick = span_of(), upper_wick_of(), lower_wick_of()
    wick = lambda kind, x: F.struct(F.lit(kind).alias("kind"), ratio(x, span).alias("share"))
    return df.select("symbol", "tf", "ts", F.explode(F.array(wick("upper", upper_wick), wick("lower", lower_wick))).alias("w")).select("symbol", "tf", "ts", "w.*").filter(F.col("share") > threshold)


def metric_base(df: DataFrame) -> DataFrame:
    """Range and move in per cent, direction, and regime (1 beyond 2 per cent up, -1 down). P08"""
    o, c = F.col("open"), F.col("close")
    span = span_of()
    move = 100 * ratio(c - o, o)
    return df.withColumns({"volatility_pct": 100 * ratio(span, o), "speed_pct": move, "direction": (c > o).cast("int"), "regime": F.when(move > 2, 1).when(move < -2, -1).otherwise(0)})


def session_id(ts: Column) -> Column:
    """0 to 8 h, 8 to 16 h, and the rest of the day."""
    return F.when(F.hour(ts) < 8, 0).when(F.hour(ts) < 16, 1).otherwise(2)


def session_time_features(df: DataFrame) -> DataFrame:
    """Session, whether it changed with this bar, weekday (Monday 0), hour and minute. P09"""
    s = session_id(F.col("ts"))
    return df.withColumns({"session": s, "session_change": (F.coalesce(s != lag(s), F.lit(False))).cast("int"), "weekday": F.weekday("ts"), "hour": F.hour("ts"), "minute": F.minute("ts")})


def cyclic_time(df: DataFrame) -> DataFrame:
    """Sine and cosine of the hour and the weekday share. P10"""
    angle = 2 * F.pi() * (F.hour("ts") + F.minute("ts") / 60) / 24
    return df.withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "dow": F.weekday("ts") / 6})


def session_label(df: DataFrame) -> DataFrame:
    """Market session by the bar's hour (UTC), and week of the month. P11"""
    hour = F.hour("ts")
    label = F.when(hour < 7, "asian").when(hour < 12, "london").when(hour < 16, "overlap").when(hour < 21, "new_york").otherwise("asian")
    return df.withColumns({"session_label": label, "week_of_month": F.floor((F.dayofmonth("ts") - 1) / 7) + 1})


def pip_size(symbol: Column) -> Column:
    """Smallest quoted step by the symbol's name. P12"""
    s = F.upper(symbol)
    return F.when(s.contains("JPY"), 0.01).when(s.contains("XAU"), 0.1).when(s.contains("BTC") | s.contains("ETH"), 1.0).otherwise(0.0001)


def tf_regime(asset_slow: Column | str, dollar_slow: Column | str, asset_fast: Column | str, dollar_fast: Column | str) -> Column:
    """Which side leads on the slow measure, and whether the fast one agrees (STRONG_*) or not (WEAK_*); null where one is missing. P13"""
    slow, fast = as_col(asset_slow) > as_col(dollar_slow), as_col(asset_fast) > as_col(dollar_fast)
    return F.when(slow & fast, "STRONG_ASSET").when(slow & ~fast, "WEAK_ASSET").when(~slow & fast, "WEAK_DXY").when(~slow & ~fast, "STRONG_DXY")


def sigmoid_norm(x: str, n: int, k: float = 1.0) -> Column:
    """1 / (1 + exp(-k (x - mean) / |mean|)) over the last n rows. P24"""
    mean = roll(F.avg, x, n)
    return 1 / (1 + F.exp(-k * ratio(F.col(x) - mean, F.abs(mean))))


def prediction_confidence(df: DataFrame, probs: str) -> DataFrame:
    """Largest share, margin to the second, and entropy / ln n of an array of shares. P26"""
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    p = F.transform(probs, lambda x: F.try_divide(x, total))
    top = F.sort_array(p, asc=False)
    entropy = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return df.withColumns({"confidence": F.get(top, F.lit(0)), "margin": F.get(top, F.lit(0)) - F.coalesce(F.get(top, F.lit(1)), F.lit(0.0)), "uncertainty": F.try_divide(entropy, F.log(F.size(probs).cast("double")))})


def occ_symbol(root: Column, expiry: Column, kind: Column, strike: Column) -> Column:
    """Option symbol: root, yymmdd, C or P, strike in thousandths on eight places. P19"""
    return F.concat(F.upper(root), F.date_format(expiry, "yyMMdd"), F.upper(F.substring(kind, 1, 1)), F.lpad(F.round(strike * 1000).cast("long").cast("string"), 8, "0"))


def averaged_candle_flags(df: DataFrame) -> DataFrame:
    """Flags of averaged candles (ha_ columns): kind, flat ends, small body, reversal of kind. P03"""
    o, h, low, c = (F.col(f"ha_{x}") for x in ("open", "high", "low", "close"))
    kind = F.when(c > o, 1).when(c < o, -1).otherwise(0)
    df = df.withColumns({"ha_kind": kind, "ha_flat_top": (h == F.greatest(o, c)).cast("int"), "ha_flat_bottom": (low == F.least(o, c)).cast("int"), "ha_body": F.abs(c - o), "ha_small_body": (F.abs(c - o) <= 0.2 * (h - low)).cast("int")})
    return df.withColumn("ha_reversal", F.when(F.col("ha_kind") != lag("ha_kind"), F.col("ha_kind")).otherwise(0))


def binary_to_numeric(df: DataFrame, column: str, yes: tuple[str, ...] = ("yes", "up", "long", "true", "buy"), no: tuple[str, ...] = ("no", "down", "short", "false", "sell"), most: int = 10) -> DataFrame:
    """Yes and no words as 1 and 0; a column of at most ``most`` other values as their alphabetical places, else unchanged. P18"""
    values = [r[0] for r in df.select(F.lower(column)).distinct().orderBy(F.lower(column)).limit(most + 1).collect() if r[0] is not None]
    if all(v in (*yes, *no) for v in values):
        return df.withColumn(column, F.when(F.lower(column).isin(*yes), 1).when(F.lower(column).isin(*no), 0))
    if len(values) > most:
        return df
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.array_position(F.array(*map(F.lit, values)), F.lower(column)).cast("int") - 1))
