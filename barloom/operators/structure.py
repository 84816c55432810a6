"""Market structure: swings and what follows from them; zones with a life; baskets of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import first_crossing
from ..functions.series import KEYS, ffill, lag, lead, ratio, series, so_far


def swing_points(df: DataFrame, length: int = 5) -> DataFrame:
    """``swing``: 1 at the highest high of ``length`` rows on both sides, -1 at the lowest low, of equal neighbours in a row the extreme one. W41

    Uses the next ``length`` rows: a swing is known that much later. Of equals the first stays.
    """
    around = series().rowsBetween(-length, length)
    top, bottom = F.col("high") == F.max("high").over(around), F.col("low") == F.min("low").over(around)
    df = df.withColumn("_raw", F.when(top & ~bottom, 1).when(bottom & ~top, -1))
    # consecutive swings of one kind are an island: its number counts the changes of kind
    before = F.last("_raw", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.when(F.col("_raw").isNotNull() & (F.coalesce(before, F.lit(0)) != F.col("_raw")), 1).otherwise(0))
    df = df.withColumn("_island", F.sum("_new").over(so_far()))
    best = Window.partitionBy(*KEYS, "_island", "_raw").orderBy(F.when(F.col("_raw") == 1, -F.col("high")).otherwise(F.col("low")), "ts")
    df = df.withColumn("_rank", F.when(F.col("_raw").isNotNull(), F.row_number().over(best)))
    swing = F.when(F.col("_rank") == 1, F.col("_raw")).otherwise(0)
    level = F.when(swing == 1, F.col("high")).when(swing == -1, F.col("low"))
    return df.withColumns({"swing": swing, "swing_level": level}).drop("_raw", "_new", "_island", "_rank")


def retracements(df: DataFrame) -> DataFrame:
    """How far the price has come back from the last swing towards the one before, in per cent, now and at most since then. W45"""
    last_high, last_low = ffill(F.when(F.col("swing") == 1, F.col("swing_level"))), ffill(F.when(F.col("swing") == -1, F.col("swing_level")))
    direction = ffill(F.nullif("swing", F.lit(0)))
    df = df.withColumns({"_h": last_high, "_l": last_low, "_d": direction, "_seg": F.sum(F.abs("swing")).over(so_far())})
    now = F.when(F.col("_d") == 1, 100 * ratio(F.col("_h") - F.col("low"), F.col("_h") - F.col("_l"))).when(F.col("_d") == -1, 100 * ratio(F.col("high") - F.col("_l"), F.col("_h") - F.col("_l")))
    df = df.withColumn("retracement", now)
    deepest = F.max("retracement").over(Window.partitionBy(*KEYS, "_seg").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("deepest_retracement", deepest).drop("_h", "_l", "_d", "_seg")


def structure_breaks(df: DataFrame) -> DataFrame:
    """Rows of swings whose last four make a break of structure (bos) or a change of character (choch): 1 up, -1 down, 0 none. W42

    Of four alternating swings a, b, c, d: rising lows and highs that go on break upwards; a rise after falling ones
    changes the character. Works on the few rows that are swings.
    """
    s = df.filter("swing <> 0").select(*KEYS, "ts", "swing", "swing_level")
    a, b, c, d = lag("swing_level", 3), lag("swing_level", 2), lag("swing_level", 1), F.col("swing_level")
    up, down = F.col("swing") == 1, F.col("swing") == -1
    bos = F.when(up & (a < c) & (c < b) & (b < d), 1).when(down & (a > c) & (c > b) & (b > d), -1).otherwise(0)
    choch = F.when(up & (d > b) & (b > a) & (a > c), 1).when(down & (d < b) & (b < a) & (a < c), -1).otherwise(0)
    return s.withColumns({"bos": bos, "choch": choch, "broken_level": F.when((bos != 0) | (choch != 0), b)})


def first_break(levels: DataFrame, bars: DataFrame) -> DataFrame:
    """When a close first goes beyond each level after its time: levels carry symbol, tf, level_id, ts, price, side (1 up, -1 down)."""
    return first_crossing(levels.withColumn("level_id", F.col("level_id").cast("string")), bars, "close", "close", "broken_at")


def zones_of(levels: DataFrame, width: float = 0.004) -> DataFrame:
    """Levels as zones of a relative half width, with the side whose break ends them. Z05"""
    return levels.withColumns({"lower": F.col("price") * (1 - width), "upper": F.col("price") * (1 + width), "side": F.when(F.col("kind") == "support", -1).otherwise(1)})


def zone_invalidation(zones: DataFrame, bars: DataFrame) -> DataFrame:
    """``invalidated_at``: the first close under a support's lower or over a resistance's upper bound after its creation. Z06"""
    bound = F.when(F.col("side") < 0, F.col("lower")).otherwise(F.col("upper"))
    ids = zones.withColumns({"level_id": F.col("zone_id"), "_price": F.col("price"), "price": bound})
    return first_break(ids, bars).withColumn("price", F.col("_price")).drop("level_id", "_price").withColumnRenamed("broken_at", "invalidated_at")


def active_zones(zones: DataFrame, at: Column) -> DataFrame:
    """Zones that exist and are not invalidated at a time. Z08"""
    return zones.filter((F.col("ts") <= at) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > at)))


def keep_snapshots(zones: DataFrame, n: int = 20) -> DataFrame:
    """The zones of each series' last n snapshot times. Z05"""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("ts"))
    return zones.withColumn("_age", F.dense_rank().over(w)).filter(F.col("_age") <= n).drop("_age")


def currency_index(pairs: DataFrame, weights: dict[str, float], scalar: float, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """scalar * product of pair ** weight at each ts that has all the pairs. Z13

    Pairs stay long (symbol, ts, prices); the product is the exponential of a sum, so it aggregates partially.
    """
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    w = F.try_element_at(weight, F.col("symbol"))
    product = lambda c: (F.exp(F.sum(w * F.log(F.greatest(F.col(c), F.lit(1e-8))))) * scalar).alias(c)
    return pairs.filter(F.col("symbol").isin(*weights)).groupBy("ts").agg(F.count(F.lit(1)).alias("n"), *map(product, columns)).filter(F.col("n") == len(weights)).drop("n")


def mitigated_gaps(gaps: DataFrame, bars: DataFrame) -> DataFrame:
    """Fair value gaps with the time a later close goes through them: under a bullish one's bottom, over a bearish one's top. W29w"""
    g = gaps.filter("fvg <> 0").withColumns({"level_id": F.col("ts").cast("string"), "price": F.when(F.col("fvg") == 1, F.col("fvg_bottom")).otherwise(F.col("fvg_top")), "side": -F.col("fvg")})
    # the gap is complete with the next bar: only closes after that count
    g = g.select(*KEYS, "level_id", F.col("ts").alias("gap_ts"), F.col("known_at").alias("ts"), "fvg", "fvg_top", "fvg_bottom", "price", "side")
    return first_break(g, bars).select("symbol", "tf", F.col("gap_ts").alias("ts"), "fvg", "fvg_top", "fvg_bottom", F.col("broken_at").alias("mitigated_at"))


def known_with_next(df: DataFrame) -> DataFrame:
    """``known_at``: the next bar's time, for features that look one bar ahead."""
    return df.withColumn("known_at", lead("ts"))


def liquidity_pools(df: DataFrame, share: float = 0.01) -> DataFrame:
    """Swings of one kind whose levels lie within ``share`` of the series' range of the one before: pools of two or more. W44

    Sorted by level, a pool ends where the gap to the next level is wider, so one window finds them.
    """
    s = df.filter("swing <> 0").select(*KEYS, "ts", "swing", "swing_level")
    spread = F.max("swing_level").over(Window.partitionBy(*KEYS)) - F.min("swing_level").over(Window.partitionBy(*KEYS))
    s = s.withColumn("_width", spread * share)
    w = Window.partitionBy(*KEYS, "swing").orderBy("swing_level", "ts")
    s = s.withColumn("_new", F.coalesce((F.col("swing_level") - F.lag("swing_level").over(w) > F.col("_width")).cast("int"), F.lit(1)))
    s = s.withColumn("pool", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*KEYS, "swing", "pool").agg(F.count(F.lit(1)).alias("n"), F.avg("swing_level").alias("level"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).filter("n > 1")


def index_candles(pairs: DataFrame, weights: dict[str, float], scalar: float) -> DataFrame:
    """The index of the pairs' closes as flat bars without volume. Z14"""
    close = F.col("close")
    return currency_index(pairs, weights, scalar, ("close",)).select("ts", close.alias("open"), close.alias("high"), close.alias("low"), close, F.lit(0.0).alias("volume"))
