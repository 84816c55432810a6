"""As-of, range and matching joins on series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(base: DataFrame, other: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ("symbol",), strict: bool = False, visible_after: Column | None = None, suffix: str = "", fill: bool = False) -> DataFrame:
    """For each row of ``base`` the latest row of ``other`` at or before its ts (before it, if ``strict``). J01 to J04

    ``visible_after`` is an interval by which the other rows' ts moves on: a higher timeframe's bar shows once it has
    closed. Of equal times the last in column order wins. Union and last(), so one shuffle by ``by`` and no pair is made.
    With ``fill`` a null column takes the last value that was not null.
    """
    at = F.col("ts") if visible_after is None else F.col("ts") + visible_after
    # at equal times other rows come first, or last if they have to be strictly earlier
    o = other.select(*by, at.alias("ts"), F.lit(1 if strict else -1).alias("_side"), F.struct(*columns).alias("_seen"))
    b = base.select(*by, "ts", F.lit(0).alias("_side"), F.struct(*base.columns).alias("_row"))
    both = o.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("ts", "_side", F.col("_seen").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    if fill:
        seen = [F.last(f"_seen.{c}", ignorenulls=True).over(w).alias(f"{c}{suffix}") for c in columns]
    else:
        latest = F.last("_seen", ignorenulls=True).over(w)
        both = both.withColumn("_latest", latest)
        seen = [F.col(f"_latest.{c}").alias(f"{c}{suffix}") for c in columns]
    return both.select("_side", "_row", *seen).filter(F.col("_side") == 0).select("_row.*", *[f"{c}{suffix}" for c in columns])


def event_pairing(h1: DataFrame, h4: DataFrame, hours: int = 4) -> DataFrame:
    """Each event of h1 with the latest one of h4 of its symbol and direction in the ``hours`` before; unmatched h4 events stay. J05

    Every h1 event gives one row, also where several have equal times. Composite strength: 0.7 and 0.3 parts. Events carry symbol, direction, ts, strength. The interval join is an equi join
    on buckets of its width, so no symbol's events are paired in full.
    """
    width = hours * 3600
    bucket = lambda c: F.floor(F.unix_timestamp(c) / width)
    # what is near depends on these three alone, so events of equal time share it and none is paired twice
    left = h1.select("symbol", "direction", "ts").distinct().select("*", F.explode(F.array(bucket("ts"), bucket("ts") - 1)).alias("b"))
    right = h4.select("symbol", "direction", F.col("ts").alias("h4_ts"), F.col("strength").alias("h4_strength"), bucket("ts").alias("b"))
    near = left.join(right, ["symbol", "direction", "b"]).filter((F.col("h4_ts") <= F.col("ts")) & (F.col("h4_ts") >= F.col("ts") - F.make_interval(hours=F.lit(hours))))
    best = near.groupBy("symbol", "direction", "ts").agg(F.max(F.struct("h4_ts", "h4_strength")).alias("m")).select("symbol", "direction", "ts", "m.h4_ts", "m.h4_strength")
    paired = h1.join(best, ["symbol", "direction", "ts"], "left").select("symbol", "direction", "ts", "strength", "h4_ts", "h4_strength")
    paired = paired.withColumn("composite", F.when(F.col("h4_ts").isNull(), F.col("strength")).otherwise(0.7 * F.col("strength") + 0.3 * F.col("h4_strength")))
    used = best.select("symbol", "direction", F.col("h4_ts").alias("ts")).distinct()
    alone = h4.join(used, ["symbol", "direction", "ts"], "left_anti").select("symbol", "direction", "ts", F.lit(None).cast("double").alias("strength"), F.col("ts").alias("h4_ts"), F.col("strength").alias("h4_strength"), F.col("strength").alias("composite"))
    return paired.unionByName(alone)


def peer_merge(older: DataFrame, newer: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Full outer merge; where both have a column, the newer value wins unless it is null. J06"""
    both = [c for c in older.columns if c in newer.columns and c not in on]
    n = newer.select(*on, *[F.col(c).alias(f"_new_{c}" if c in both else c) for c in newer.columns if c not in on])
    merged = older.join(n, list(on), "full_outer")
    return merged.select(*on, *[F.coalesce(f"_new_{c}", c).alias(c) if c in both else F.col(c) for c in [*[x for x in older.columns if x not in on], *[x for x in newer.columns if x not in on and x not in both]]])


def price_bucket(price: Column, tolerance: float) -> Column:
    """Buckets of relative width: prices within the tolerance lie in the same or neighbouring ones."""
    return F.floor(F.log(price) / F.log(F.lit(1 + tolerance)))


def confluence(zones: DataFrame, tolerance: float = 0.0015, across: str | None = "tf") -> DataFrame:
    """Zones with the number of others of their symbol (of other timeframes, if ``across``) within the tolerance. J09, Z07

    Zones carry symbol, tf, zone_id, price > 0. An equi join on price buckets and their neighbours, never all pairs.
    """
    b = price_bucket(F.col("price"), tolerance)
    near = zones.select("symbol", F.col("tf").alias("o_tf"), F.col("zone_id").alias("o_id"), F.col("price").alias("o_price"), F.explode(F.array(b - 1, b, b + 1)).alias("b"))
    test = (F.abs(F.col("price") - F.col("o_price")) <= tolerance * F.col("price")) & (F.col("zone_id") != F.col("o_id"))
    if across:
        test = test & (F.col("tf") != F.col("o_tf"))
    counts = zones.withColumn("b", b).join(near, ["symbol", "b"]).filter(test).groupBy("symbol", "zone_id").agg(F.count(F.lit(1)).alias("hits"))
    return zones.join(counts, ["symbol", "zone_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def nearest_levels(points: DataFrame, levels: DataFrame) -> DataFrame:
    """Nearest support at or under and resistance at or over each point's price. J07, J08

    Points carry symbol, id, price; levels symbol, kind (support or resistance), level. Both are sorted by price once, and
    the last level before and the first one after each point is taken: no pair of point and level is made.
    """
    p = points.select("symbol", "id", "price", F.lit(1).alias("_side"))
    lv = levels.select("symbol", F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.col("level").alias("price"), F.lit(0).alias("_side"), "kind")
    both = p.withColumn("kind", F.lit(None).cast("string")).unionByName(lv)
    up = Window.partitionBy("symbol").orderBy("price", "_side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("symbol").orderBy(F.desc("price"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    support = F.last(F.when(F.col("kind") == "support", F.col("price")), ignorenulls=True).over(up)
    resistance = F.last(F.when(F.col("kind") == "resistance", F.col("price")), ignorenulls=True).over(down)
    out = both.withColumns({"support": support, "resistance": resistance}).filter("_side = 1").select("symbol", "id", "price", "support", "resistance")
    return out.withColumn("distance", F.try_divide(F.least(F.col("price") - F.col("support"), F.col("resistance") - F.col("price")), F.col("price")))


def _open_balance(fills: DataFrame, buy: Column, bucket: str = "day") -> DataFrame:
    """Fills with ``_buys`` and ``_sells`` so far, ``_lost``, how far under 0 the balance of both has been, and ``_alone``, where that grows.

    A day's fills are counted in its own order; days add up by one row each, so a symbol's fills spread over tasks.
    """
    inside = Window.partitionBy("symbol", "_day").orderBy("ts", "id")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = fills.withColumn("_day", F.date_trunc(bucket, "ts")).withColumns({"_balance": F.sum(F.when(buy, 1).otherwise(-1)).over(upto), "_buys": F.count(F.when(buy, 1)).over(upto), "_sells": F.count(F.when(~buy, 1)).over(upto)})
    rows = rows.withColumn("_low", F.min("_balance").over(upto))
    days = rows.groupBy("symbol", "_day").agg(F.count(F.when(buy, 1)).alias("_b"), F.count(F.when(~buy, 1)).alias("_s"), F.min("_balance").alias("_l"))
    before = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({f"{c}0": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("_b", "_s")})
    days = days.withColumn("_l0", F.least(F.coalesce(F.min(F.col("_b0") - F.col("_s0") + F.col("_l")).over(before), F.lit(0)), F.lit(0))).drop("_b", "_s", "_l")
    rows = rows.join(days, [rows["symbol"] == days["symbol"], rows["_day"].eqNullSafe(days["_day"])]).drop(days["symbol"], days["_day"])
    rows = rows.withColumns({"_buys": F.col("_buys") + F.col("_b0"), "_sells": F.col("_sells") + F.col("_s0"), "_lost": -F.least("_l0", F.col("_b0") - F.col("_s0") + F.col("_low"))})
    return rows.withColumn("_alone", F.col("_lost") > F.coalesce(F.lag("_lost").over(inside), -F.col("_l0"))).drop("_day", "_balance", "_low", "_b0", "_s0", "_l0")


def fifo_match(fills: DataFrame, fee: float = 0.9975) -> DataFrame:
    """Each sell closes the oldest buy that is still open then; one without an open buy stands alone, with pnl 0. J13

    Fills carry symbol, side (buy or sell), price, qty, ts, id. The pnl is what the sale brings (its own quantity, times
    ``fee`` for pairs, whose symbol has a slash, and for BTC) less the buy's cost; per cent of that, which counts 0.01 at least.

    A sell is unmatched where the balance of buys and sells reaches a new low under 0; the n-th matched one closes buy n.
    """
    buy, qty = F.col("side") == "buy", F.col("qty").cast("double")
    counted = _open_balance(fills.filter(F.col("side").isin("buy", "sell")), buy)
    buys = counted.filter(buy).select("symbol", F.col("_buys").alias("_n"), F.col("ts").alias("opened"), F.col("price").alias("paid"), qty.alias("bought"))
    sells = counted.filter(~buy).select("symbol", F.when(~F.col("_alone"), F.col("_sells") - F.col("_lost")).alias("_n"), "ts", "id", "price", qty.alias("sold"))
    matched = sells.join(buys, ["symbol", "_n"], "left")
    factor = F.when(F.col("symbol").contains("/") | F.col("symbol").contains("BTC"), fee).otherwise(1.0)
    cost = F.col("paid") * F.col("bought")
    pnl = F.col("price") * F.col("sold") * factor - cost
    alone = F.col("_n").isNull()
    return matched.select(
        "symbol", "id", F.when(alone, "sell").otherwise("buy").alias("side"), F.coalesce("bought", "sold").alias("qty"), F.coalesce("opened", "ts").alias("start_time"), F.col("ts").alias("end_time"),
        F.coalesce("paid", "price").alias("entry_price"), F.col("price").alias("exit_price"), F.when(alone, 0.0).otherwise(pnl).alias("pnl"), F.when(alone, 0.0).otherwise(100 * pnl / F.greatest(cost, F.lit(0.01))).alias("pnl_pct"),
    )


def ensure_completeness(result: DataFrame, original: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """A row for each of the original's, its own columns where the result lacks them, original columns first. J12"""
    lost = [c for c in original.columns if c not in result.columns]
    joined = original.select(*key, *[F.col(c).alias(f"_o_{c}") for c in original.columns if c not in key]).join(result, list(key), "left")
    first = [F.coalesce(c, f"_o_{c}").alias(c) if c not in lost else F.col(f"_o_{c}").alias(c) for c in original.columns if c not in key]
    return joined.select(*key, *first, *[c for c in result.columns if c not in original.columns])


def entity_context(links: DataFrame, messages: DataFrame, entities: list[str], k: int = 10) -> DataFrame:
    """The latest k messages of each session that mention any of the entities. J14

    ``links`` carry session, turn, entity; ``messages`` session, turn, text. The limit is the feature.
    """
    asked = links.filter(F.col("entity").isin(*entities)).select("session", "turn").distinct()
    w = Window.partitionBy("session").orderBy(F.desc("turn"))
    return messages.join(asked, ["session", "turn"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def event_union(*lists: DataFrame) -> DataFrame:
    """All events of the lists, a column that a list lacks null; repeated events stay. O06"""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)
