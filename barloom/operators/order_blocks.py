"""Order blocks and their lives, confirmed breaks of structure, and all structure features of a bar in one table.

An order block is an interval that is born when a close breaks the last swing, is mitigated when the price comes back
through it, then is a breaker, and is removed when the price goes through the other side. Each of these events is the
first crossing of a level after a time, so the life of a block is three searches by calendar blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import first_crossing, row_blocks, with_rows_before
from ..functions.series import KEYS, ffill, series, whole
from .indicators import fair_value_gaps
from .structure import known_with_next, liquidity_pools, mitigated_gaps, structure_breaks, swing_points

#: Swing lengths by the number of rows that a series has at least.
SWING_LENGTHS = ((1000, 50), (500, 30), (200, 20), (0, 10))
#: Shares of the range within which levels pool, tried in turn.
POOL_SHARES = (0.01, 0.02, 0.05, 0.10)


def broken_swings(df: DataFrame, bucket: str = "day") -> DataFrame:
    """Swings (ts, side, price) with ``created_at``: the first close beyond, if that comes not later than the next swing of the kind."""
    until = F.lead("ts").over(Window.partitionBy(*KEYS, "side").orderBy("ts"))
    swings = df.filter("swing <> 0").select(*KEYS, "ts", F.col("swing").alias("side"), F.when(F.col("swing") == 1, F.col("high")).otherwise(F.col("low")).alias("price"), "high", "low")
    broken = first_crossing(swings.withColumn("_until", until), df, "close", "close", "created_at", bucket)
    return broken.filter(F.col("created_at").isNotNull() & (F.col("_until").isNull() | (F.col("created_at") <= F.col("_until")))).drop("_until")


def _candles(broken: DataFrame, df: DataFrame, bucket: str) -> DataFrame:
    """The candle of each break: the last lowest low (upwards) or highest high (downwards) between swing and break, else the swing's own.

    The stretches of one kind don't overlap, so all of them together open each block once and twice where they meet.
    """
    blocks = row_blocks(df, {"high": "high", "low": "low"}, bucket)
    spans = broken.withColumn("_block", F.explode(F.sequence(F.date_trunc(bucket, "ts"), F.date_trunc(bucket, "created_at"), F.expr(f"interval 1 {bucket}"))))
    inside = F.filter("_rows", lambda r: (r["ts"] > F.col("ts")) & (r["ts"] < F.col("created_at")))
    key = lambda r: F.when(F.col("side") > 0, r["low"]).otherwise(-r["high"])
    best = F.array_min(F.transform(inside, lambda r: F.struct(key(r).alias("key"), (-F.unix_micros(r["ts"].cast("timestamp"))).alias("late"), r["ts"].alias("ts"), r["high"].alias("high"), r["low"].alias("low"))))
    found = spans.join(blocks, [*KEYS, "_block"]).withColumn("_best", best).groupBy(*KEYS, "side", "ts").agg(F.min("_best").alias("_best"))
    own = broken.join(found, [*KEYS, "side", "ts"], "left")
    pick = lambda c: F.coalesce(F.col(f"_best.{c}"), F.col(c)).alias(c)
    return own.select(*KEYS, "side", "created_at", pick("ts"), pick("high"), pick("low"))


def _volumes(blocks_born: DataFrame, df: DataFrame, bucket: str) -> DataFrame:
    """``ob_volume`` of the three bars up to the break, and how even it lies between the last two and the one before, in per cent."""
    rows = with_rows_before(row_blocks(df, {"volume": "volume"}, bucket), 2)
    born = blocks_born.withColumn("_block", F.date_trunc(bucket, "created_at")).join(rows, [*KEYS, "_block"], "left")
    v = F.transform(F.filter(F.concat("_before", "_rows"), lambda r: r["ts"] <= F.col("created_at")), lambda r: F.coalesce(r["volume"].cast("double"), F.lit(0.0)))
    born = born.withColumn("_v", v).drop("_rows", "_before", "_block")
    last = lambda k: F.when(F.size("_v") >= k, F.try_element_at("_v", F.lit(-k))).otherwise(0.0)
    two, one = last(1) + last(2), last(3)
    share = F.when(F.greatest(two, one) != 0, 100 * F.least(two, one) / F.greatest(two, one)).otherwise(100.0)
    return born.withColumns({"ob_volume": two + one, "ob_percentage": share}).drop("_v")


def order_blocks(df: DataFrame, close_mitigation: bool = False, bucket: str = "day") -> DataFrame:
    """Order blocks with their lives, by the ts of their candle: ``ob`` (1 up, -1 down), ``ob_top``, ``ob_bottom``, ``ob_volume``,
    ``ob_percentage``, ``created_at``, ``mitigated_at``, ``removed_at``. W43

    ``df`` has swing columns (``swing_points``). A block upwards is born at the first close over the last swing high; its
    candle is the last lowest low since that swing. It is mitigated when a later low (with ``close_mitigation`` the body's)
    is under its bottom, and removed when after that a high is over its top; downwards likewise. A candle holds one block:
    one downwards takes the place of one upwards, and if that was mitigated, stands as mitigated from its birth.
    """
    born = _volumes(_candles(broken_swings(df, bucket), df, bucket), df, bucket).withColumnsRenamed({"ts": "candle_ts"})
    side, up = F.col("_side"), F.col("_side") > 0
    born = born.withColumnRenamed("side", "_side")
    high, low = (F.greatest("open", "close"), F.least("open", "close")) if close_mitigation else (F.col("high"), F.col("low"))
    asked = born.withColumns({"ts": F.col("created_at"), "price": F.when(up, F.col("low")).otherwise(F.col("high")), "side": -side})
    born = first_crossing(asked, df, high, low, "mitigated_at", bucket)
    here = Window.partitionBy(*KEYS, "candle_ts")
    born = born.withColumn("_earlier", F.when(~up, F.max(F.when(up, F.col("mitigated_at"))).over(here)))
    breaker_from = F.when(F.col("_earlier").isNotNull(), F.col("created_at")).otherwise(F.col("mitigated_at"))
    asked = born.withColumns({"ts": breaker_from, "price": F.when(up, F.col("high")).otherwise(F.col("low")), "side": side})
    born = first_crossing(asked, df, "high", "low", "removed_at", bucket)
    born = born.withColumns({"_upwards_gone": F.max(F.when(up, F.col("removed_at"))).over(here), "_replaced": up & (F.min(side).over(here) < 0)})
    mitigated = F.when(F.col("_earlier").isNull(), F.col("mitigated_at")).when(F.col("_upwards_gone").isNull(), F.col("_earlier"))
    return born.filter(~F.col("_replaced")).select(*KEYS, F.col("candle_ts").alias("ts"), side.alias("ob"), F.col("high").alias("ob_top"), F.col("low").alias("ob_bottom"), "ob_volume", "ob_percentage", "created_at", mitigated.alias("mitigated_at"), "removed_at")


def confirmed_breaks(df: DataFrame, bucket: str = "day") -> DataFrame:
    """Breaks of structure and changes of character by the ts of the swing before the last, with ``broken_at``: the first close beyond the
    level, two bars after that swing or later. Breaks that never come, or not before one that belongs to a later swing, are left out. W42

    ``df`` has swing columns.
    """
    swings = df.withColumn("_next", F.lead("ts").over(series()))
    at = swings.filter("swing <> 0").select(*KEYS, F.lead("ts").over(series()).alias("ts"), F.col("ts").alias("swing_ts"), F.col("_next").alias("known"))
    events = structure_breaks(df).filter((F.col("bos") != 0) | (F.col("choch") != 0)).join(at, [*KEYS, "ts"])
    asked = events.select(*KEYS, "swing_ts", F.col("known").alias("ts"), F.col("broken_level").alias("price"), F.when(F.col("bos") != 0, F.col("bos")).otherwise(F.col("choch")).alias("side"), "bos", "choch")
    broken = first_crossing(asked, df, "close", "close", "broken_at", bucket)
    later = F.min("broken_at").over(Window.partitionBy(*KEYS).orderBy("swing_ts").rowsBetween(1, Window.unboundedFollowing))
    kept = broken.withColumn("_later", later).filter(F.col("broken_at").isNotNull() & (F.col("_later").isNull() | (F.col("_later") > F.col("broken_at"))))
    return kept.select(*KEYS, F.col("swing_ts").alias("ts"), "bos", "choch", F.col("price").alias("broken_level"), "broken_at")


def swings_by_size(df: DataFrame) -> DataFrame:
    """swing_points() with the length that fits the number of a series' rows."""
    sized = df.withColumn("_n", F.count(F.lit(1)).over(whole()))
    parts, below = [], None
    for least, length in SWING_LENGTHS:
        here = (F.col("_n") >= least) if below is None else (F.col("_n") >= least) & (F.col("_n") < below)
        parts.append(swing_points(sized.filter(here).drop("_n"), length))
        below = least
    return reduce(DataFrame.unionByName, parts)


def _first_pools(df: DataFrame) -> DataFrame:
    """Pools of each series' narrowest share that finds any, at the ts of their first swing."""
    found = reduce(DataFrame.unionByName, (liquidity_pools(df, share).withColumn("_share", F.lit(share)) for share in POOL_SHARES))
    found = found.withColumn("_least", F.min("_share").over(whole())).filter(F.col("_share") == F.col("_least"))
    return found.select(*KEYS, F.col("first_ts").alias("ts"), (-F.col("swing")).alias("liquidity"), F.col("level").alias("liquidity_level"))


def smc_features(df: DataFrame, price: Column | str = "close", bucket: str = "day") -> DataFrame:
    """Each bar with its swing, gap, live order block, confirmed break and liquidity pool, null where there is none, and the distances
    of the last known levels to ``price`` (``*_diff``). W46

    Swings are as long as the series allows. Features at a bar may come of later bars, as the operators state.
    """
    s = swings_by_size(df)
    marked = s.withColumns({"swing": F.nullif("swing", F.lit(0))})
    gaps = mitigated_gaps(known_with_next(fair_value_gaps(df)), df).withColumnRenamed("mitigated_at", "fvg_mitigated_at")
    live = order_blocks(s, bucket=bucket).filter("removed_at is null").select(*KEYS, "ts", "ob", "ob_top", "ob_bottom", "ob_volume", "ob_percentage", F.col("mitigated_at").alias("ob_mitigated_at"))
    breaks = confirmed_breaks(s, bucket).withColumns({"bos": F.nullif("bos", F.lit(0)), "choch": F.nullif("choch", F.lit(0))})
    for events in (gaps, live, breaks, _first_pools(s)):
        marked = marked.join(events, [*KEYS, "ts"], "left")
    p = F.col(price) if isinstance(price, str) else price
    levels = ("fvg", "fvg_top", "fvg_bottom", "ob_top", "ob_bottom", "swing_level", "liquidity_level")
    return marked.withColumns({f"{c}_diff": ffill(c) - p for c in levels})
