"""Rules on one row's state: direction, allowed entries, gates, state, quality and reward of an action.

All are column expressions over what a row already holds, so they run inside the stage that made it and cost no shuffle. A
null input never opens a gate: a level that is null isn't there, a flag that is null is false.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import as_col, clip, ratio

#: The numbers of the actions, which are also the places of the mask.
WAIT, CALL, PUT, HALF, FLATTEN = range(5)
#: Nearness of a zone in average ranges and as a share of the price, and the share of volume that confirms.
NEAR_RANGES, NEAR_SHARE, CONFIRM = 0.75, 0.003, 0.8
#: What a move must be to count, the drawdown that takes the whole entry bonus, and the conviction of a setup.
MOVE, DRAWDOWN, CONVICTION = 0.003, 0.005, 0.65
#: Weights of the parts of a signal's quality.
QUALITY = {"conviction": 0.25, "direction": 0.25, "zone": 0.20, "volume": 0.10, "confluence": 0.20}


def _true(x: Column | str) -> Column:
    return F.coalesce(as_col(x).cast("boolean"), F.lit(False))


def _number(x: Column | str, value: float = 0.0) -> Column:
    return F.coalesce(as_col(x).cast("double"), F.lit(value))


def direction_by_crosses(rsi: Column | str, slow_diff: Column | str, *crosses: Column | str) -> Column:
    """Bullish if a cross is positive, else bearish if one is negative, else bullish for an RSI under 40 or a positive difference. P14

    An RSI that is null or 0 counts 50, other nulls 0.
    """
    r = F.coalesce(F.nullif(as_col(rsi).cast("double"), F.lit(0.0)), F.lit(50.0))
    any_of = lambda test: reduce(lambda a, b: a | b, (test(_number(x)) for x in crosses), F.lit(False))
    calm = F.when((r < 40) | (_number(slow_diff) > 0), "bullish").otherwise("bearish")
    return F.when(any_of(lambda x: x > 0), "bullish").when(any_of(lambda x: x < 0), "bearish").otherwise(calm)


def direction_by_trend(rsi: Column | str, trend: Column | str) -> Column:
    """Against an extreme RSI share (under 0.35, over 0.65), with the trend where it contradicts the RSI's half, else with the trend. P14"""
    r, t = _number(rsi, 0.5), _number(trend)
    bull, bear = (r < 0.35) | ((r < 0.5) & (t > 0)), (r > 0.65) | ((r > 0.5) & (t < 0))
    return F.when(bull, "bullish").when(bear, "bearish").when(t >= 0, "bullish").otherwise("bearish")


def entry_mask(df: DataFrame, atr: str = "atr", support: str = "support", resistance: str = "resistance", buys: str = "buys", sells: str = "sells", held: str = "held", support_net: str | None = None, resistance_net: str | None = None, support_gone: str | None = None, resistance_gone: str | None = None) -> DataFrame:
    """``mask``: five 0/1 for wait, call, put, half and flatten. P15

    With an open position only waiting and leaving are allowed. Without one, a call is allowed near a support that stands and
    whose volume confirms it, a put near such a resistance, both where no level is known. ``*_net`` name the net volume of a
    level (0 without), ``*_gone`` whether it is broken.
    """
    c, busy = F.col("close"), _true(held)
    reach = F.greatest(_number(atr) * NEAR_RANGES, c * NEAR_SHARE)
    buy, sell = _number(buys), _number(sells)
    net = lambda name: _number(name) if name else F.lit(0.0)
    gone = lambda name: _true(name) if name else F.lit(False)
    near = lambda level: F.coalesce(F.abs(c - F.col(level)) <= reach, F.lit(False))
    unknown = F.col(support).isNull() & F.col(resistance).isNull()
    call = near(support) & ~gone(support_gone) & ((buy >= sell * CONFIRM) | (net(support_net) >= 0))
    put = near(resistance) & ~gone(resistance_gone) & ((sell >= buy * CONFIRM) | (net(resistance_net) <= 0))
    allowed = (F.lit(True), ~busy & (unknown | call), ~busy & (unknown | put), busy, busy)
    return df.withColumn("mask", F.array(*[x.cast("int") for x in allowed]))


def shaped_reward(action: Column | str, mask: Column | str, pnl: Column | str, drawdown: Column | str, forward: Column | str, strength: Column | str, closed: Column | str, stopped: Column | str, breached: Column | str) -> Column:
    """Reward of an action in [-3, 3]. P17

    An entry costs 0.05 and earns up to 0.35 by the move to come in its direction, less with drawdown. A close earns its result
    over the drawdown (at least 0.01), and 0.2 more if a stop did it. Waiting is judged against the setup that the mask allowed
    at enough conviction: a missed move costs up to 1.5, a loss avoided earns up to 0.3; without a setup waiting earns 0.02.
    """
    a, m, fall, move = as_col(action), as_col(mask), _number(drawdown), _number(forward)
    gain = F.when(a == CALL, move).otherwise(-move)
    bonus = F.when(gain >= MOVE, clip(0.15 * (gain / MOVE) * F.greatest(1 - fall / DRAWDOWN, F.lit(0.0)), 0, 0.35)).otherwise(0.0)
    entry = F.when(a.isin(CALL, PUT), bonus - 0.05).otherwise(0.0)
    leave = F.when(_true(closed), _number(pnl) / F.greatest(F.abs(fall), F.lit(0.01)) + F.when(_true(stopped), 0.2).otherwise(0.0)).otherwise(0.0)
    sure = _number(strength) >= CONVICTION
    side = F.when(sure & (F.get(m, F.lit(CALL)) == 1), 1.0).when(sure & (F.get(m, F.lit(PUT)) == 1), -1.0)
    seen = side * move
    judged = F.when(side.isNull(), 0.02).when(seen >= MOVE, clip(-0.45 * (seen / MOVE), -1.5, 0)).when(seen < 0, clip(0.15 * (F.abs(seen) / MOVE), 0, 0.3)).otherwise(0.0)
    waited = F.when((a == WAIT) & ~_true(closed) & ~_true(breached), judged).otherwise(0.0)
    return clip(entry + leave + waited, -3, 3)


def signal_quality(action: Column | str, strength: Column | str, direction: Column | str, support_dist: Column | str, resistance_dist: Column | str, volume_delta: Column | str, confluence: Column | str | None = None, dollar_support: Column | str | None = None, dollar_resistance: Column | str | None = None, crosses: tuple[Column | str, Column | str] | None = None, regime: tuple[Column | str, Column | str] | None = None, reaction: tuple[Column | str, Column | str] | None = None) -> Column:
    """How well an action fits its signals, 0 to 1: five weighted parts, then what further signals add. P16

    Distances to the levels are in average ranges. ``confluence`` counts agreeing levels, ``dollar_*`` are the dollar's own
    distances, ``crosses`` signed crosses of asset and dollar, ``regime`` and ``reaction`` the signals for a call and a put.
    """
    a = as_col(action)
    by_side = lambda call, put, wait: F.when(a == CALL, call).when(a == PUT, put).otherwise(wait)
    flag, delta = clip(_number(direction), -1, 1), clip(_number(volume_delta), -1, 1)
    near = lambda x: clip(1 - _number(x, 10.0) / 4, 0, 1)
    low, high = near(support_dist), near(resistance_dist)
    agreed = clip(_number(confluence) / 2, 0, 1) if confluence is not None else F.lit(0.5)
    if dollar_support is not None and dollar_resistance is not None:
        agreed = 0.6 * agreed + 0.4 * by_side(near(dollar_resistance), near(dollar_support), 0.5)
    parts = {
        "conviction": clip((_number(strength) - 0.45) / 0.25, 0, 1), "direction": by_side(0.5 + 0.5 * flag, 0.5 - 0.5 * flag, 1 - 0.5 * F.abs(_number(direction))),
        "zone": by_side(low, high, 1 - 0.5 * F.greatest(low, high)), "volume": by_side(0.5 + 0.5 * delta, 0.5 - 0.5 * delta, 0.5), "confluence": agreed,
    }
    quality = reduce(lambda x, y: x + y, (parts[k] * w for k, w in QUALITY.items()))
    if crosses is not None:
        mean = (clip(_number(crosses[0]), -1, 1) + clip(_number(crosses[1]), -1, 1)) / 2
        quality = 0.8 * quality + 0.2 * by_side((1 + mean) / 2, (1 - mean) / 2, 0.5)
    if regime is not None:
        quality = F.when(by_side(_number(regime[0]) > 0.5, _number(regime[1]) > 0.5, False), F.least(quality + 0.08, F.lit(1.0))).otherwise(quality)
    if reaction is not None:
        quality = by_side(0.85 * quality + 0.15 * clip(_number(reaction[0]), 0, 1), 0.85 * quality + 0.15 * clip(_number(reaction[1]), 0, 1), quality)
    return clip(quality, 0, 1)


def risk_gate(drawdown: Column | str, positions: Column | str, most: float = 0.03, cap: int = 4) -> Column:
    """Whether trading may go on: the day's drawdown under ``most`` and fewer than ``cap`` positions. Null: no. P20"""
    return F.coalesce((as_col(drawdown) < most) & (as_col(positions) < cap), F.lit(False))


def reentry_gate(direction: Column | str, strength: Column | str, reversal: Column | str, entries: Column | str, cap: Column | int, support_gone: Column | str, resistance_gone: Column | str) -> Column:
    """Whether a closed position may be taken again: entries under the cap, conviction, little risk of reversal, its level unbroken. P27"""
    d = as_col(direction)
    broken = ((d == "bullish") & _true(support_gone)) | ((d == "bearish") & _true(resistance_gone))
    return F.coalesce((as_col(entries) < cap) & (as_col(strength) >= CONVICTION) & (as_col(reversal) <= 0.35) & ~broken, F.lit(False))


def denormalise(value: Column | str, method: str, low: Column | str = "range_low", width: Column | str = "range_width", close: Column | str = "close", anchor: Column | str | None = None, scale: float = 2.0) -> Column:
    """A model's output back in its own unit. P21

    structural: low + value * width. sigmoid: the logistic of the deviation from ``anchor`` (a mean of normalised prices, the
    close's own place without one), undone and then as structural. range_fraction: times width. return_points: times the close.
    A width that is null or not positive leaves the value as it is.
    """
    v, lo, w = as_col(value), as_col(low), as_col(width)
    if method == "return_points":
        return F.coalesce(v * as_col(close), v)
    if method == "range_fraction":
        out = v * w
    elif method == "structural":
        out = lo + v * w
    elif method == "sigmoid":
        y = clip(v, 1e-7, 1 - 1e-7)
        at = F.greatest(_number(anchor if anchor is not None else ratio(as_col(close) - lo, w), 0.5), F.lit(1e-6))
        out = lo + (at + F.log(y / (1 - y)) / scale * (at + 1e-8)) * w
    else:
        raise ValueError(f"unknown method {method}")
    return F.when(w > 0, out).otherwise(v)


def state_vector(df: DataFrame, named: dict[str, Column | str], hour: Column, weekday: Column, phase: Column | str | None = None) -> DataFrame:
    """The 28 numbers of an execution's state as columns state_*, in order. P25

    ``named`` gives: direction, strength, reversal, q_value, mfe_pips, mae_pips, strength_5m, strength_15m, strength_30m,
    strength_1h, drawdown, position (1 call, -1 put), pnl, wins, losses, quarter_hour (bars of 15 minutes), atr, support,
    resistance, support_delta, resistance_delta, buys, sells, entries, most_entries. What isn't named, or is null, is 0; a level
    that isn't there is at distance 1, a horizon's strength 0.5.
    """
    c = F.col("close")
    get = lambda k, v=0.0: _number(named[k], v) if k in named else F.lit(v)
    away = lambda k: F.coalesce(F.abs(ratio(c - as_col(named[k]), c)), F.lit(1.0)) if k in named else F.lit(1.0)
    turn = 2 * math.pi * hour / 24
    direction = as_col(named["direction"]) if "direction" in named else F.lit(None).cast("string")
    session = as_col(phase) if phase is not None else F.lit(None).cast("string")
    is_in = lambda name: F.coalesce((session == name).cast("double"), F.lit(0.0))
    slots = {
        "direction": F.when(direction == "bullish", 1.0).when(direction == "bearish", -1.0).otherwise(0.0), "strength": get("strength"), "reversal": get("reversal"), "q_value": get("q_value"),
        "mfe": get("mfe_pips") / 100, "mae": get("mae_pips") / 100, **{f"strength_{t}": get(f"strength_{t}", 0.5) for t in ("5m", "15m", "30m", "1h")},
        "drawdown": get("drawdown"), "position": get("position"), "pnl": get("pnl"), "wins": get("wins") / 10, "losses": get("losses") / 10,
        "quarter_hour": get("quarter_hour"), "atr_share": F.coalesce(ratio(get("atr"), c), F.lit(0.0)), "support_dist": away("support"), "resistance_dist": away("resistance"),
        "support_delta": get("support_delta"), "resistance_delta": get("resistance_delta"), "volume_delta": (get("buys") - get("sells")) / (get("buys") + get("sells") + 1e-6),
        "entries": F.coalesce(ratio(get("entries"), get("most_entries", 1.0)), F.lit(0.0)), "hour_sin": F.sin(turn), "hour_cos": F.cos(turn), "weekday": weekday / 6,
        "open": is_in("nyse_open"), "power_hour": is_in("nyse_power_hour"),
    }
    return df.withColumns({f"state_{k}": x.cast("double") for k, x in slots.items()})
