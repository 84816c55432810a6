"""Indicators that feed back on themselves.

Linear recurrences (EMA, Wilder, Heikin-Ashi) run as native block scans, parallel within a series. State machines
(supertrend, parabolic SAR, zigzag, positions) run in blocks that are checked against each other (``block_fold``), parallel
within a series too.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import block_fold
from ..functions.series import KEYS, diff, lag, linear_scan, linear_scans, ratio, roll, series, so_far
from .joins import asof


def exponential(df: DataFrame, x: str, alpha: float, out: str, seed: int = 1) -> DataFrame:
    """y = alpha x + (1 - alpha) y before; starts with the mean of the first ``seed`` values, null before. W30

    seed 1 is the first value itself (adjust=False); seed n the published EMA; alpha 1/n with seed n is Wilder's mean.
    """
    n = F.sum(F.col(x).isNotNull().cast("int")).over(so_far())
    df = df.withColumn("_n", n)
    first = F.avg(x).over(so_far())
    b = F.when(F.col(x).isNotNull() & (F.col("_n") == seed), first).when(F.col(x).isNotNull() & (F.col("_n") > seed), alpha * F.col(x))
    return linear_scan(df.withColumn("_b", b), "_b", 1 - alpha, out).drop("_n", "_b")


def ema(df: DataFrame, x: str, n: int, out: str | None = None, seed: int = 1) -> DataFrame:
    return exponential(df, x, 2 / (n + 1), out or f"ema_{n}", seed)


def emas(df: DataFrame, x: str, spans: tuple[int, ...], prefix: str = "ema_") -> DataFrame:
    """EMAs of x for all spans, in one scan of the series. W30"""
    value, first = F.col(x), F.sum(F.col(x).isNotNull().cast("int")).over(so_far()) == 1
    df = df.withColumns({f"_b{n}": F.when(value.isNotNull(), F.when(first, value).otherwise(value * (2 / (n + 1)))) for n in spans})
    return linear_scans(df, {f"{prefix}{n}": (f"_b{n}", 1 - 2 / (n + 1)) for n in spans}).drop(*[f"_b{n}" for n in spans])


def wilder(df: DataFrame, x: str, n: int, out: str, seed: int | None = None) -> DataFrame:
    return exponential(df, x, 1 / n, out, n if seed is None else seed)


def weighted_mean(x: str, n: int) -> Column:
    """Linearly weighted mean of the last n values, the newest n times the oldest. W30"""
    total = sum((lag(x, i) * (n - i) for i in range(1, n)), F.col(x) * n)
    return total / (n * (n + 1) / 2)


def hull(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Weighted mean over sqrt(n) of twice the half-length mean less the full one. W31"""
    df = df.withColumn("_h", 2 * weighted_mean(x, n // 2) - weighted_mean(x, n))
    return df.withColumn(out, weighted_mean("_h", int(n**0.5))).drop("_h")


def macd(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two EMAs, its EMA, and what is between. W32"""
    both = emas(df, x, (fast, slow), "_ema_")
    df = both.withColumn("macd", F.col(f"_ema_{fast}") - F.col(f"_ema_{slow}")).drop(f"_ema_{fast}", f"_ema_{slow}")
    return ema(df, "macd", signal, "macd_signal").withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def rsi(df: DataFrame, x: str = "close", n: int = 14, out: str = "rsi") -> DataFrame:
    """Wilder's relative strength from the mean of the first n changes on; 50 where nothing moves. W33"""
    d = diff(x)
    df = df.withColumns({"_up": F.greatest(d, F.lit(0.0)), "_down": F.greatest(-d, F.lit(0.0))})
    df = df.withColumns({"_up": F.when(d.isNotNull(), F.col("_up")), "_down": F.when(d.isNotNull(), F.col("_down"))})
    df = wilder(wilder(df, "_up", n, "_gain"), "_down", n, "_loss")
    value = F.when(F.col("_gain") + F.col("_loss") == 0, 50.0).otherwise(100 * F.try_divide("_gain", F.col("_gain") + F.col("_loss")))
    return df.withColumn(out, value).drop("_up", "_down", "_gain", "_loss")


def rsi_states(df: DataFrame, x: str = "close", n: int = 14) -> DataFrame:
    """The RSI's own state at each row: mean gain and loss. W33"""
    d = diff(x)
    df = df.withColumns({"_up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "_down": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))})
    return wilder(wilder(df, "_up", n, "gain"), "_down", n, "loss").drop("_up", "_down")


def mtf_rsi(base: DataFrame, higher: dict[str, tuple[DataFrame, Column, float]], own_weight: float = 0.4, n: int = 14) -> DataFrame:
    """Weighted mean of the bars' RSI and those of higher timeframes, each carried on from its last closed bar with the current close. W34

    ``higher``: name -> (bars, interval after which a bar is closed, weight). Timeframes without state yet don't count.
    """
    df = rsi(base, n=n)
    total, weights = F.coalesce(F.col("rsi") * own_weight, F.lit(0.0)), F.when(F.col("rsi").isNotNull(), own_weight).otherwise(0.0)
    for name, (bars, interval, weight) in higher.items():
        state = rsi_states(bars, n=n).select("symbol", "ts", "close", "gain", "loss")
        df = asof(df, state, ("close", "gain", "loss"), visible_after=interval, suffix=f"_{name}")
        d = F.col("close") - F.col(f"close_{name}")
        gain, loss = (F.col(f"gain_{name}") * (n - 1) + F.greatest(d, F.lit(0.0))) / n, (F.col(f"loss_{name}") * (n - 1) + F.greatest(-d, F.lit(0.0))) / n
        df = df.withColumn(f"rsi_{name}", F.when(gain + loss == 0, 50.0).otherwise(100 * F.try_divide(gain, gain + loss))).drop(f"close_{name}", f"gain_{name}", f"loss_{name}")
        total, weights = total + F.coalesce(F.col(f"rsi_{name}") * weight, F.lit(0.0)), weights + F.when(F.col(f"rsi_{name}").isNotNull(), weight).otherwise(0.0)
    return df.withColumn("mtf_rsi", ratio(total, weights))


def rsi_features(df: DataFrame, n: int = 14) -> DataFrame:
    """RSI, its relative change and its changes over 1 to 5 rows. W33b"""
    df = rsi(df, n=n)
    return df.withColumns({"rsi_pct": ratio(diff("rsi"), lag("rsi")), **{f"rsi_diff_{i}": diff("rsi", i) for i in range(1, 6)}})


def heikin_ashi(df: DataFrame) -> DataFrame:
    """Averaged candles; the open is half of the averaged open and close before. W37"""
    close = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    df = df.withColumn("ha_close", close)
    before = F.lag("ha_close").over(series())
    df = linear_scan(df.withColumn("_b", F.coalesce(before / 2, (F.col("open") + F.col("close")) / 2)), "_b", 0.5, "ha_open").drop("_b")
    return df.withColumns({"ha_high": F.greatest("high", "ha_open", "ha_close"), "ha_low": F.least("low", "ha_open", "ha_close")})


def atr_wilder(df: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))
    return wilder(df.withColumn("_tr", tr), "_tr", n, out).drop("_tr")


def tdi(df: DataFrame, n: int = 13) -> DataFrame:
    """RSI with bands, a smoothed line and a signal line. W51"""
    df = rsi(df, n=n, out="tdi_rsi")
    mid, sd = roll(F.avg, "tdi_rsi", 34), roll(F.stddev_samp, "tdi_rsi", 34)
    return df.withColumns({"tdi_upper": mid + 1.6185 * sd, "tdi_lower": mid - 1.6185 * sd, "tdi_line": roll(F.avg, "tdi_rsi", 2), "tdi_signal": roll(F.avg, "tdi_rsi", 7)})


def supertrend(df: DataFrame, n: int = 10, k: float = 3.0, block: int | None = None, warm: int | None = None) -> DataFrame:
    """Bands around the mid price that only tighten until the close crosses them. W35"""
    df = atr_wilder(df, n, "_atr")

    def step(a: dict[str, np.ndarray], state: list[float], first: int) -> tuple[dict[str, np.ndarray], list[float]]:
        mid, close = (a["high"] + a["low"]) / 2, a["close"]
        line, trend = np.full(len(mid), np.nan), np.zeros(len(mid), np.int32)
        upper, lower, up, before = state
        for i, (m, c, r) in enumerate(zip(mid.tolist(), close.tolist(), (a["_atr"] * k).tolist(), strict=True)):
            if r == r:
                hi, lo = m + r, m - r
                if upper != upper:
                    upper, lower = hi, lo
                else:
                    upper = hi if hi < upper or before > upper else upper
                    lower = lo if lo > lower or before < lower else lower
                    up = (1 if c > upper else -1) if up < 0 else (-1 if c < lower else 1)
                line[i], trend[i] = (lower if up > 0 else upper), up
            before = c
        return {"supertrend": line, "supertrend_dir": trend}, [upper, lower, up, before]

    folded = block_fold(df, ("high", "low", "close", "_atr"), "supertrend double, supertrend_dir int", [math.nan, math.nan, 1, math.nan], step, block, warm)
    return df.drop("_atr").join(folded.drop("_i"), [*KEYS, "ts"])


def psar(df: DataFrame, start: float = 0.02, most: float = 0.2, block: int | None = None, warm: int | None = None) -> DataFrame:
    """Parabolic stop and reverse. W36"""

    def step(a: dict[str, np.ndarray], state: list[float], first: int) -> tuple[dict[str, np.ndarray], list[float]]:
        up, stop, extreme, rate, h1, h2, l1, l2 = state  # the last two highs and lows; up is NaN before the second row
        out, side = np.full(len(a["high"]), np.nan), np.zeros(len(a["high"]), np.int32)
        for i, (h, low) in enumerate(zip(a["high"].tolist(), a["low"].tolist(), strict=True)):
            if h1 == h1:
                if up != up:
                    up = float(h + low >= h1 + l1)
                    stop, extreme, rate = (l1, h1, start) if up else (h1, l1, start)
                stop += rate * (extreme - stop)
                if up:
                    stop = min(stop, l1, l2)
                    if low < stop:
                        up, stop, extreme, rate = 0.0, extreme, low, start
                    elif h > extreme:
                        extreme, rate = h, min(most, rate + start)
                else:
                    stop = max(stop, h1, h2)
                    if h > stop:
                        up, stop, extreme, rate = 1.0, extreme, h, start
                    elif low < extreme:
                        extreme, rate = low, min(most, rate + start)
                out[i], side[i] = stop, 1 if up else -1
                h2, l2 = h1, l1
            else:
                h2, l2 = h, low
            h1, l1 = h, low
        return {"psar": out, "psar_dir": side}, [up, stop, extreme, rate, h1, h2, l1, l2]

    return df.join(block_fold(df, ("high", "low"), "psar double, psar_dir int", [math.nan] * 8, step, block, warm).drop("_i"), [*KEYS, "ts"])


def zigzag(df: DataFrame, rise: float = 0.05, fall: float = 0.05, block: int | None = None, warm: int | None = None) -> DataFrame:
    """Peaks (1) and valleys (-1) that a move of ``fall`` or ``rise`` confirms; ``zz_known`` rows later. The last pivot is open. W40"""

    def step(a: dict[str, np.ndarray], state: list[float], first: int) -> tuple[dict[str, np.ndarray], list[float]]:
        side, top, high, bottom, low = state  # where the last extremes stand, and their closes
        told, back = np.zeros(len(a["close"]), np.int32), np.zeros(len(a["close"]), np.int32)
        for i, c in enumerate(a["close"].tolist()):
            at = first + i
            if top != top:
                top = bottom = at
                high = low = c
                continue
            if side >= 0 and c >= high:
                top, high = at, c
            if side <= 0 and c <= low:
                bottom, low = at, c
            if side >= 0 and c <= high * (1 - fall):
                told[i], back[i] = 1, at - top
                side, bottom, low = -1, at, c
            elif side <= 0 and c >= low * (1 + rise):
                told[i], back[i] = -1, at - bottom
                side, top, high = 1, at, c
        # extremes of the side that is over play no part any more
        if side < 0:
            top, high = 0, 0.0
        elif side > 0:
            bottom, low = 0, 0.0
        return {"_told": told, "_back": back}, [side, top, high, bottom, low]

    folded = block_fold(df, ("close",), "_told int, _back int", [0, math.nan, math.nan, math.nan, math.nan], step, block, warm)
    told = folded.filter("_told <> 0").select(*KEYS, (F.col("_i") - F.col("_back")).alias("_i"), F.col("_told").alias("zz_pivot"), F.col("_back").alias("zz_known"))
    pivots = folded.select(*KEYS, "ts", "_i").join(told, [*KEYS, "_i"], "left").drop("_i").na.fill(0, ["zz_pivot", "zz_known"])
    return df.join(pivots, [*KEYS, "ts"])


def bias_positions(df: DataFrame, enter: str, leave: str, block: int | None = None, warm: int | None = None) -> DataFrame:
    """Position after each row: entered in the sign of ``enter`` when flat, added to when it repeats, left on ``leave``. W38"""

    def step(a: dict[str, np.ndarray], state: list[float], first: int) -> tuple[dict[str, np.ndarray], list[float]]:
        position, events = np.zeros(len(a[enter]), np.int32), []
        at = int(state[0])
        for i, (e, x) in enumerate(zip(np.nan_to_num(a[enter]), np.nan_to_num(a[leave]), strict=True)):
            event = "hold"
            if at and (x or e == -at):
                event, at = "exit", 0
            elif at and e == at:
                event = "add"
            elif not at and e:
                event, at = "enter", int(e)
            position[i] = at
            events.append(event)
        return {"position": position, "event": np.array(events, object)}, [at]

    return df.join(block_fold(df, (enter, leave), "position int, event string", [0], step, block, warm).drop("_i"), [*KEYS, "ts"])


def non_overlapping(df: DataFrame, horizon: int, block: int | None = None, warm: int | None = None) -> DataFrame:
    """Of rows with an action (1 or -1), those taken while no earlier one is open for ``horizon`` rows, and their outcome. L15"""
    df = df.withColumn("_after", F.lead("close", horizon).over(series()))

    def step(a: dict[str, np.ndarray], state: list[float], first: int) -> tuple[dict[str, np.ndarray], list[float]]:
        taken, won = np.zeros(len(a["close"]), np.int32), np.full(len(a["close"]), np.nan)
        free = int(state[0])  # rows until the next may be taken
        for i in np.flatnonzero(np.nan_to_num(a["action"])).tolist():
            if i >= free and not np.isnan(a["_after"][i]):
                taken[i], free = 1, i + horizon
                won[i] = float((a["_after"][i] - a["close"][i]) * a["action"][i] > 0)
        return {"taken": taken, "won": won}, [max(free - len(taken), 0)]

    return block_fold(df, ("close", "action", "_after"), "taken int, won double", [0], step, block, warm).drop("_i")


def trendlines(df: DataFrame, n: int = 50) -> DataFrame:
    """Least-squares line of the last n closes, and its parallels that all highs and lows of the window touch from one side. W47

    The slope is a native regression; the parallels' offsets fold the window's values in an array of n.
    """
    from ..functions.series import last_rows

    w = last_rows(n)
    df = df.withColumn("_x", F.row_number().over(series()).cast("double"))
    slope = F.when(F.count("close").over(w) == n, F.regr_slope("close", "_x").over(w))
    df = df.withColumns({"line_slope": slope, "_win": F.collect_list(F.struct("_x", "high", "low")).over(w)})
    top = F.array_max(F.transform("_win", lambda p: p["high"] - F.col("line_slope") * p["_x"]))
    bottom = F.array_min(F.transform("_win", lambda p: p["low"] - F.col("line_slope") * p["_x"]))
    return df.withColumns({"resistance_line": top + F.col("line_slope") * F.col("_x"), "support_line": bottom + F.col("line_slope") * F.col("_x")}).drop("_x", "_win")


