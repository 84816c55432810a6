"""Forward-looking targets. The last rows, whose future isn't there yet, have null or the fill value that is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import clip, forward, lead, next_rows, ratio


def forward_returns(df: DataFrame, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Simple returns, 0 in the tail, and whether they are positive. L01"""
    c = F.col("close")
    out = {f"fwd_ret_{n}": F.coalesce(ratio(lead("close", n) - c, c), F.lit(0.0)) for n in horizons}
    df = df.withColumns(out)
    return df.withColumns({f"fwd_up_{n}": (F.col(f"fwd_ret_{n}") > 0).cast("int") for n in horizons})


def next_values(df: DataFrame, columns: tuple[str, ...], k: int = 1) -> DataFrame:
    """The next k rows' values as columns x_t1 to x_tk. L02, L03, L09"""
    return df.withColumns({f"{x}_t{i}": lead(x, i) for x in columns for i in range(1, k + 1)})


def mfe_mae(df: DataFrame, n: int = 24) -> DataFrame:
    """Largest rise of the highs and fall of the lows over the next n rows, as shares of the close; 0 in the tail. L05"""
    c = F.col("close")
    return df.withColumns({"mfe": F.coalesce(ratio(forward(F.max, "high", n) - c, c), F.lit(0.0)), "mae": F.coalesce(ratio(forward(F.min, "low", n) - c, c), F.lit(0.0))})


def forward_log_returns(df: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Log ratios, 0 in the tail. L06"""
    c = F.col("close")
    return df.withColumns({f"fwd_log_ret_{n}": F.coalesce(F.log(ratio(lead("close", n), c)), F.lit(0.0)) for n in horizons})


def decayed_forward(df: DataFrame, x: str, n: int, decay: float, out: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Mean of the next n values, weighted decay ** i; null in the tail. L07, L08"""
    weights = [decay**i for i in range(n)]
    total = sum((lead(x, i + 1) * w for i, w in enumerate(weights)), F.lit(0.0)) / sum(weights)
    return df.withColumn(out, total if low is None else clip(total, low, high))


def dual_head(df: DataFrame, score: str, n: int = 200, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """Rank of the score among the last n (average of ties, 0 to 1) and its class. L04

    Counting below and equal needs the window's values: arrays of at most n numbers per row.
    """
    from ..functions.series import last_rows

    w = last_rows(n)
    seen = F.collect_list(score).over(w)
    df = df.withColumn("_seen", seen)
    below = F.size(F.filter("_seen", lambda y: y < F.col(score)))
    equal = F.size(F.filter("_seen", lambda y: y == F.col(score)))
    rank = F.when(F.size("_seen") > 1, (below + (equal - 1) / 2) / (F.size("_seen") - 1))
    return df.withColumn("score_rank", rank).drop("_seen").withColumn("score_class", F.when(F.col("score_rank") < low, "BEAR").when(F.col("score_rank") > high, "BULL").when(F.col("score_rank").isNotNull(), "WAIT"))


def _reached(slot: str, touch: float) -> Column:
    """Which of the next highs reach a resistance, or of the next lows a support, but for the share ``touch``."""
    level = F.col(slot)
    if slot.startswith("r"):
        return F.transform("_hs", lambda x: x >= level * (1 - touch))
    return F.transform("_ls", lambda x: x <= level * (1 + touch))


def next_zone(df: DataFrame, n: int = 20, touch: float = 0.004, slots: tuple[str, ...] = ("r1", "r2", "r3", "s1", "s2", "s3")) -> DataFrame:
    """Which level is touched first within n rows; of one bar's touches the nearest level; class 6: none. L10

    ``next_zone_bars`` counts from 0 at the next bar and is n + 1 without a touch; rows with less than n to come are null.
    """
    c = F.col("close")
    w = next_rows(n)
    df = df.withColumns({"_hs": F.collect_list("high").over(w), "_ls": F.collect_list("low").over(w)})
    hits = []
    for i, s in enumerate(slots):
        level = F.col(s)
        at = F.array_position(_reached(s, touch), True)
        hits.append(F.when(level.isNotNull() & (at > 0), F.struct((at - 1).cast("long").alias("bars"), F.abs(level - c).alias("dist"), F.lit(i).alias("cls"))))
    first = F.array_min(F.array_compact(F.array(*hits)))
    full = F.size("_hs") == n
    return df.withColumn("_first", first).withColumns({"next_zone": F.when(full, F.coalesce("_first.cls", F.lit(len(slots)))), "next_zone_bars": F.when(full, F.coalesce("_first.bars", F.lit(n + 1).cast("long"))), "next_zone_dist": F.when(full, F.col("_first.dist"))}).drop("_hs", "_ls", "_first")


def zone_touch_sequence(df: DataFrame, n: int = 30, touch: float = 0.003, support: str = "support", resistance: str = "resistance") -> DataFrame:
    """``touch_1`` and ``touch_2``: which level the next n rows reach first, and which then: 0 resistance, 1 support, 2 neither. L11

    Levels are those of the next row, and for the second touch those of the row after the first one, so the row's own don't
    give the answer away. A resistance counts while over the close, a support while under it; of both in one row the resistance.
    Near the end of a series fewer rows are looked at; with fewer than two to come nothing is touched.
    """
    ahead = F.collect_list(F.struct("high", "low", "close", F.col(support).alias("s"), F.col(resistance).alias("r"))).over(next_rows(n))
    df = df.withColumn("_ahead", ahead)

    def first(rows: Column, close: Column) -> Column:
        """Kind and place (from 1) of the first touch among ``rows``, by the levels of the first of them."""
        up, down = F.get(rows, F.lit(0))["r"], F.get(rows, F.lit(0))["s"]
        high = F.array_position(F.transform(rows, lambda x: x["high"] >= up * (1 - touch)), True)
        low = F.array_position(F.transform(rows, lambda x: x["low"] <= down * (1 + touch)), True)
        high = F.when((up > close) & (up > 0) & (high > 0), high)
        low = F.when((down < close) & (down > 0) & (low > 0), low)
        return F.when(high.isNotNull() & (low.isNull() | (high <= low)), F.struct(F.lit(0).alias("kind"), high.alias("at"))).when(low.isNotNull(), F.struct(F.lit(1).alias("kind"), low.alias("at")))

    df = df.withColumn("_first", F.when(F.size("_ahead") >= 2, first(F.col("_ahead"), F.col("close"))))
    df = df.withColumn("_rest", F.when(F.col("_first").isNotNull(), F.slice("_ahead", F.col("_first.at").cast("int") + 1, F.lit(n))))
    df = df.withColumn("_second", F.when(F.size("_rest") > 0, first(F.col("_rest"), F.get("_ahead", F.col("_first.at").cast("int") - 1)["close"])))
    return df.withColumns({"touch_1": F.coalesce("_first.kind", F.lit(2)), "touch_2": F.coalesce("_second.kind", F.lit(2))}).drop("_ahead", "_first", "_rest", "_second")


def forward_excursion(df: DataFrame, n: int = 24) -> DataFrame:
    """Move, largest rise of the highs and largest fall of the lows over the next n rows, in price; rows with fewer to come go. L13"""
    c = F.col("close")
    moved = df.withColumns({f"forward_move_{n}": lead("close", n) - c, f"forward_mfe_{n}": forward(F.max, "high", n) - c, f"forward_mae_{n}": c - forward(F.min, "low", n)})
    return moved.filter(F.col(f"forward_move_{n}").isNotNull())


#: Columns that forward targets read; rising, falling and signed ones, and those of the width of a bar.
SOURCES = {"price_velocity_bull": 1, "price_velocity_bear": -1, "price_velocity_net": 0, "volatility_bull": 1, "volatility_bear": -1, "volatility_regime": None, "volatility_expansion": None}


def synthesise_pivots(df: DataFrame, atr: str = "atr", support: str = "support", resistance: str = "resistance") -> DataFrame:
    """Pivots from the nearest levels: r1 and s1 are these, the others one and two ranges further off; and the columns that forward targets need. L16

    A source column that isn't there is made from the next bar's return (its rise, its fall, itself) or from the range's share
    of the close; one that is there stays.
    """
    c, a = F.col("close"), F.col(atr)
    levels = {f"r{i + 1}": F.col(resistance) + i * a for i in range(3)} | {f"s{i + 1}": F.col(support) - i * a for i in range(3)}
    ahead = F.coalesce(ratio(lead("close") - c, c), F.lit(0.0))
    made = {1: F.greatest(ahead, F.lit(0.0)), -1: F.greatest(-ahead, F.lit(0.0)), 0: ahead, None: a / (c + 1e-6)}
    return df.withColumns(levels | {k: made[kind] for k, kind in SOURCES.items() if k not in df.columns})


def horizon_moves(df: DataFrame, horizons: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """Absolute moves and up flags. L13"""
    c = F.col("close")
    return df.withColumns({f"forward_move_{n}": lead("close", n) - c for n in horizons} | {f"target_dir_{n}": (lead("close", n) > c).cast("int") for n in horizons})


def reversal_labels(df: DataFrame, mean: str, n: int = 5, decay: float = 0.8) -> DataFrame:
    """Decayed share of the next n closes on the other side of ``mean`` than this one. L12"""
    c = F.col("close")
    up = c >= F.col(mean)
    weights = [decay**i for i in range(n)]
    other = sum((F.when((lead("close", i + 1) >= lead(mean, i + 1)) != up, w).when(lead("close", i + 1).isNotNull(), 0.0) for i, w in enumerate(weights)), F.lit(0.0))
    return df.withColumn("reversal_share", other / sum(weights))


def forward_reversal(df: DataFrame, trend: Column, n: int = 8, decay: float = 0.85, hold: float = 0.65) -> DataFrame:
    """What the next n bars make of a trend (1, -1; 0 is none): ``reversal_prob``, the decayed share of bars that close against it, each
    against the bar before; ``continuation_prob``, the rest; ``reversal_held``, 1 if the first bar turns and the share is ``hold`` or more. L12

    Where fewer than n bars follow, or there is no trend, the reversal is 0.
    """
    weights = [decay**i for i in range(n)]
    steps = [(lead("close", i + 1) - (lead("close", i) if i else F.col("close"))) * F.signum(trend) < 0 for i in range(n)]
    share = sum((F.when(against, w).otherwise(0.0) for against, w in zip(steps, weights, strict=True)), F.lit(0.0)) / sum(weights)
    known = lead("close", n).isNotNull() & (trend != 0)
    df = df.withColumns({"reversal_prob": F.when(known, F.round(share, 12)).otherwise(0.0), "_turned": known & steps[0]})
    held = F.coalesce(F.col("_turned"), F.lit(False)) & (F.col("reversal_prob") >= hold)
    return df.withColumns({"continuation_prob": 1 - F.col("reversal_prob"), "reversal_held": held.cast("double")}).drop("_turned")


def dual_head_labels(df: DataFrame, score: str, lookahead: int = 1, n: int = 8, base: float = 0.35, regime: float = 0.65, bull: float = 0.65, bear: float = 0.35, window: int = 200, decay: float = 0.85) -> DataFrame:
    """``bull_prob``, ``bull_class`` (2 bull, 1 wait, 0 bear), ``bull_conf`` and ``bear_conf``. L04

    A bar's raw label blends whether the close rises over ``lookahead`` bars (``base``) and the decayed mean of the n scores after
    that (``regime``); its rank among the labels of the last ``window`` bars is the probability, 0.5 for the first. Bars without
    all bars that their label needs have nulls.
    """
    from ..functions.series import last_rows

    weights = [decay**i for i in range(n)]
    ahead = sum((lead(score, lookahead + 1 + i) * w for i, w in enumerate(weights)), F.lit(0.0)) / sum(weights)
    up = F.when(F.col("close") > 0, (lead("close", lookahead) > F.col("close")).cast("double"))
    raw = F.when(lead("close", lookahead + n).isNotNull(), F.round(base * up + regime * ahead, 9))
    df = df.withColumn("_raw", raw).withColumn("_seen", F.collect_list("_raw").over(last_rows(window)))
    size, below, equal = F.size("_seen"), F.size(F.filter("_seen", lambda y: y < F.col("_raw"))), F.size(F.filter("_seen", lambda y: y == F.col("_raw")))
    prob = F.when(F.col("_raw").isNotNull(), F.when(size < 2, 0.5).otherwise((below + (equal - 1) / 2) / (size - 1)))
    df = df.withColumn("bull_prob", prob).drop("_raw", "_seen")
    there = F.col("bull_prob").isNotNull()
    kind = F.when(F.col("bull_prob") <= bear, 0).when(F.col("bull_prob") >= bull, 2).when(there, 1)
    return df.withColumn("bull_class", kind).withColumns({"bull_conf": (F.col("bull_class") == 2).cast("double"), "bear_conf": (F.col("bull_class") == 0).cast("double")})


def forward_outcome(signals: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (3, 6, 12, 24), pip: float = 0.0001) -> DataFrame:
    """Of each signal (symbol, tf, ts, side 1 or -1): best and worst excursion, net move in pips and reward tanh(net / 20) by horizon. L14

    Bars first take their own future in one window pass; signals then join the bar they stand on. Incomplete horizons are null.
    """
    c = F.col("close")
    future = bars.select("symbol", "tf", "ts", "close", *[forward(F.max, "high", n).alias(f"h{n}") for n in horizons], *[forward(F.min, "low", n).alias(f"l{n}") for n in horizons], *[lead("close", n).alias(f"c{n}") for n in horizons])
    j = signals.join(future, ["symbol", "tf", "ts"])
    per = []
    for n in horizons:
        up, down, net = (F.col(f"h{n}") - c) / pip, (c - F.col(f"l{n}")) / pip, (F.col(f"c{n}") - c) / pip
        long = F.col("side") > 0
        per.append(F.struct(F.lit(n).alias("horizon"), F.when(long, up).otherwise(down).alias("mfe_pips"), F.when(long, down).otherwise(up).alias("mae_pips"), (F.col("side") * net).alias("net_pips"), F.tanh(F.col("side") * net / 20).alias("reward")))
    return j.select("symbol", "tf", "ts", "side", F.explode(F.array(*per)).alias("o")).select("symbol", "tf", "ts", "side", "o.*")
