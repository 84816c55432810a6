"""Composite scores of bars: weighted sums of shares, each between 0 and 1. All are window columns on the bars' own series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import clip, diff, ffill, lag, ratio, roll
from .candles import body_of, lower_wick_of, span_of, upper_wick_of

#: The least long wick, the largest body and the largest opposite wick of a pin bar, as shares of its range.
WICK, BODY, NOSE = 0.6, 0.3, 0.1
#: Distance from a level in average ranges that counts as near, what it multiplies a pin by, and the weights of the last three bars.
NEAR, AMPLIFIER, RECENT = 1.5, 1.4, (1.0, 0.55, 0.25)
#: Weights of the parts of each score.
CANDLE = {"body": 0.25, "close": 0.20, "wick": 0.15, "drawdown": 0.15, "relative": 0.10, "rsi": 0.10, "change": 0.05}
REVERSAL = {"momentum_div": 0.25, "structure_break": 0.20, "volume_clue": 0.18, "exhaustion": 0.12, "velocity_decay": 0.05, "pin": 0.20}
REVERSION = {"bb_stretch": 0.25, "rsi_extreme": 0.25, "vol_spike": 0.20, "ma_distance": 0.20, "tf_deviation": 0.10}


def _or(x: Column, value: float) -> Column:
    return F.coalesce(x, F.lit(value))


def _unit(x: Column, value: float = 0.0) -> Column:
    """Into [0, 1]; ``value`` where there is none."""
    return _or(clip(x, 0, 1), value)


def _weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, (parts[k] * w for k, w in weights.items()))


def pin_bar(df: DataFrame, levels: tuple[str, ...] = (), atr: str | None = None) -> DataFrame:
    """How much a bar is a pin: long wick, small body, small opposite wick; stronger near a level; and that of the last three bars. W29

    ``levels`` name columns of prices, ``atr`` the average range (0 before there is one). A flat bar is no pin.
    """
    c = F.col("close")
    body, lower, upper = _unit(ratio(body_of(), span_of()), 0.5), _unit(ratio(lower_wick_of(), span_of())), _unit(ratio(upper_wick_of(), span_of()))
    small = clip(1 - body / BODY, 0, 1)
    raw = lambda long, nose: clip((long - WICK) / (1 - WICK), 0, 1) * small * clip(1 - nose / NOSE, 0, 1)
    distance = F.array_min(F.array(*[F.abs(F.col(x) - c) for x in levels])) if levels else F.lit(None).cast("double")
    wide = _or(ffill(atr), 0.0) if atr else F.lit(0.0)
    df = df.withColumn("pin_at_level", _or((distance <= wide * NEAR).cast("double"), 0.0))
    factor = 1 + F.col("pin_at_level") * (AMPLIFIER - 1)
    df = df.withColumns({"pin_bull": clip(raw(lower, upper) * factor, 0, 1), "pin_bear": clip(raw(upper, lower) * factor, 0, 1)})
    recent = lambda x: clip((F.col(x) * RECENT[0] + _or(lag(x), 0.0) * RECENT[1] + _or(lag(x, 2), 0.0) * RECENT[2]) / sum(RECENT), 0, 1)
    return df.withColumns({"pin_score": F.col("pin_bull") - F.col("pin_bear"), "pin_recent_bull": recent("pin_bull"), "pin_recent_bear": recent("pin_bear")})


def candle_scores(df: DataFrame, rsi: str | None = None) -> DataFrame:
    """Conviction of a bar for rises and for falls; the bull score turns over on falling bars, a recent pin against it halves it at most. W25

    Needs pin_bar()'s columns for that last step and leaves it out otherwise; without ``rsi`` that part counts a half.
    """
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    top, bottom = roll(F.max, "high", 20), roll(F.min, "low", 20)
    change = clip(_or(F.log(ratio(F.nullif(c, F.lit(0.0)), F.nullif(lag("close"), F.lit(0.0)))), 0.0) / 0.05, -1, 1)
    parts = {
        "body": _unit(ratio(body_of(), span_of())), "close": _unit(ratio(c - low, span_of()), 0.5), "wick": _unit(ratio(lower_wick_of(), span_of())),
        "drawdown": 1 - _unit(ratio(h - c, span_of()), 0.5), "relative": _unit(ratio(h - bottom, top - bottom), 0.5),
        "rsi": clip(F.col(rsi) / 100, 0, 1) if rsi else F.lit(0.5), "change": change * 0.5 + 0.5,
    }
    up = _weighted(parts, CANDLE)
    down = _weighted({k: x if k == "body" else 1 - x for k, x in parts.items()}, CANDLE)
    bull, bear = _unit(F.when(c < F.col("open"), 1 - up).otherwise(up), 0.5), _unit(down, 0.5)
    if "pin_recent_bear" in df.columns:
        bull, bear = bull * (1 - 0.5 * _unit(F.col("pin_recent_bear"))), bear * (1 - 0.5 * _unit(F.col("pin_recent_bull")))
    return df.withColumns({"candle_bull_score": bull, "candle_bear_score": bear})


def regime_speed(df: DataFrame, n: int = 252, least: int = 20, rising: str | None = None) -> DataFrame:
    """Velocity up and down times trend strength, each against its rolling 95th percentile; that of the trend's side, and their balance. W28

    Needs velocity_up, velocity_down and trend_strength; the side is the boolean ``rising``, or that of the greater velocity.
    """
    gate = clip("trend_strength", 0, 1)
    df = df.withColumns({"_su": F.col("velocity_up") * gate, "_sd": F.col("velocity_down") * gate})
    p95 = lambda x: roll(lambda y: F.percentile(y, F.lit(0.95)), x, n, least)
    df = df.withColumns({"speed_bull": _unit(ratio("_su", p95("_su"))), "speed_bear": _unit(ratio("_sd", p95("_sd")))}).drop("_su", "_sd")
    b, s = F.col("speed_bull"), F.col("speed_bear")
    side = F.col(rising) if rising else F.col("velocity_up") >= F.col("velocity_down")
    return df.withColumns({"speed_aligned": F.when(side, b).otherwise(s), "speed_divergence": _or(clip(ratio(b - s, b + s), -1, 1), 0.0)})


def reversal_score(df: DataFrame, n: int = 5, macd: str | None = None, rsi: str | None = None, upper: str | None = None, lower: str | None = None, atr: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Signs that a move ends, each 0 or 1 but the pins', and their weighted sum. W29b

    Momentum against price (``macd``), a close beyond the bands (by ``threshold`` average ranges, if ``atr`` is given),
    volume far from its mean, an extreme ``rsi``, falling velocity, recent pins. What isn't given counts 0.
    """
    c, v, zero = F.col("close"), F.col("volume"), F.lit(0.0)
    flag = lambda x: _or(x.cast("double"), 0.0)
    mean, sd = roll(F.avg, "volume", 20, 1), roll(F.stddev_samp, "volume", 20, 1)
    df = df.withColumn("_velocity", diff("close", n))
    change = F.col("_velocity")
    beyond = F.col(atr) * threshold if atr else F.lit(0.0)
    parts = {
        "momentum_div": flag(F.signum(change) * F.signum(diff(macd, n)) < 0) if macd else zero,
        "structure_break": flag((c - F.col(upper) > beyond) | (F.col(lower) - c > beyond)) if upper and lower else zero,
        "volume_clue": flag((v > mean + 2 * sd) | (v < mean - 0.5 * sd)),
        "exhaustion": flag((F.col(rsi) > 70) | (F.col(rsi) < 30)) if rsi else zero,
        "velocity_decay": flag((diff("_velocity", n) < 0) & (F.abs(change) > 0)),
        "pin": _or(F.greatest("pin_recent_bull", "pin_recent_bear"), 0.0) if "pin_recent_bull" in df.columns else zero,
    }
    named = {f"reversal_{k}": x for k, x in parts.items()}
    return df.withColumns(named).withColumn("reversal_score", _unit(_weighted({k: F.col(f"reversal_{k}") for k in parts}, REVERSAL))).drop("_velocity")


def mean_reversion_score(df: DataFrame, middle: str = "bb_mid", upper: str = "bb_upper", lower: str = "bb_lower", atr: str | None = "atr", rsi: str | None = None, ma: str | None = None, trend: str | None = "trend_strength") -> DataFrame:
    """Signs that price returns to its mean: distance in the bands, extreme ``rsi``, widening ranges, distance from ``ma`` in ranges, lack of trend. W29c

    A name that is None counts 0.
    """
    c, zero = F.col("close"), F.lit(0.0)
    parts = {
        "bb_stretch": _unit(ratio(F.abs(c - F.col(middle)), F.col(upper) - F.col(lower))),
        "rsi_extreme": _unit(F.abs(F.col(rsi) - 50) / 50) if rsi else zero,
        "vol_spike": _unit(ratio(F.col(atr), roll(F.avg, atr, 20, 1)) - 1) if atr else zero,
        "ma_distance": _unit(ratio(F.abs(c - F.col(ma)), F.col(atr))) if ma and atr else zero,
        "tf_deviation": _unit(1 - F.col(trend)) if trend else zero,
    }
    return df.withColumns({f"reversion_{k}": x for k, x in parts.items()} | {"reversion_score": _unit(_weighted(parts, REVERSION))})
