"""Support and resistance levels as snapshots, zones clustered from them, and what bars make of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import KEYS, lag, lead, next_rows, ratio, series
from .indicators import fractals, pivots

#: Order in which kinds of levels are accepted.
ORDER = {"support": 0, "resistance": 1, "pivot_high": 2, "pivot_low": 3}
LEVELS = "array<struct<kind:string,price:double>>"


def level_candidates(df: DataFrame, w: int = 5) -> DataFrame:
    """Five-bar fractals and pivots of w bars on both sides: kind, price, ts, and ``known_at``, when the bars they need are there. Z01"""
    f = pivots(fractals(df), w)
    known_2, known_w = lead("ts", 2), lead("ts", w)
    f = f.withColumns({"_k2": known_2, "_kw": known_w})
    one = lambda test, kind, price, known: F.when(test, F.struct(F.lit(kind).alias("kind"), F.col(price).alias("price"), F.col(known).alias("known_at")))
    found = F.array_compact(F.array(one(F.col("is_support"), "support", "low", "_k2"), one(F.col("is_resistance"), "resistance", "high", "_k2"), one(F.col("is_pivot").isin(1, 3), "pivot_high", "high", "_kw"), one(F.col("is_pivot").isin(2, 3), "pivot_low", "low", "_kw")))
    return f.select(*KEYS, "ts", F.explode(found).alias("l")).select(*KEYS, "ts", "l.*")


def level_snapshots(df: DataFrame, unit: str = "day", keep: int = 10, min_distance: float = 0.002) -> DataFrame:
    """At the start of each period the levels of the last ``keep`` periods, taken in ORDER and then by time, none nearer than the share to one already taken. Z01

    A level is only in snapshots after it was known, so nothing looks ahead. Each goes to the ``keep`` next snapshots, and
    the greedy choice folds one snapshot's array: no series is gathered whole.
    """
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY"}[unit]
    c = level_candidates(df).withColumn("_p", F.date_trunc(unit, "known_at"))
    order = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])
    spread = c.select(*KEYS, "ts", "kind", "price", F.explode(F.sequence(F.lit(1), F.lit(keep))).alias("i"), "_p").withColumn("period", F.col("_p") + F.col("i") * F.expr(step))
    listed = spread.groupBy(*KEYS, "period").agg(F.sort_array(F.collect_list(F.struct(order[F.col("kind")].alias("o"), "ts", "kind", "price"))).alias("all"))

    def accept(taken: Column, x: Column) -> Column:
        near = F.exists(taken, lambda t: F.abs(t["price"] - x["price"]) < min_distance * x["price"])
        return F.when(near, taken).otherwise(F.concat(taken, F.array(F.struct(x["kind"].alias("kind"), x["price"].alias("price")))))

    return listed.select(*KEYS, "period", F.aggregate("all", F.array().cast(LEVELS), accept).alias("levels"))


def cluster_zones(snapshots: DataFrame, k: int = 8, rounds: int = 20) -> DataFrame:
    """Each snapshot's levels in at most k zones: mean price, bounds, members, the more frequent side. Z02

    One-dimensional Lloyd steps from quantile seeds: the same result on every run. One snapshot is one small array.
    """

    def run(batches):
        for p in batches:
            out = []
            for r in p.itertuples(index=False):
                price = np.array([x["price"] for x in r.levels])
                side = np.array([1 if x["kind"] in ("resistance", "pivot_high") else -1 for x in r.levels])
                if not len(price):
                    continue
                centre = np.unique(np.quantile(price, (np.arange(min(k, len(price))) + 0.5) / min(k, len(price))))
                for _ in range(rounds):
                    at = np.abs(price[:, None] - centre).argmin(axis=1)
                    moved = np.array([price[at == i].mean() for i in np.unique(at)])
                    if len(moved) == len(centre) and np.allclose(moved, centre):
                        break
                    centre = moved
                at = np.abs(price[:, None] - centre).argmin(axis=1)
                for n, i in enumerate(np.unique(at)):
                    own = price[at == i]
                    out.append((r.symbol, r.tf, r.period, n, float(own.mean()), float(own.min()), float(own.max()), len(own), "resistance" if side[at == i].sum() > 0 else "support"))
            yield pd.DataFrame(out, columns=["symbol", "tf", "period", "zone", "price", "lower", "upper", "members", "kind"])

    kind = snapshots.schema["period"].dataType.simpleString()
    return snapshots.mapInPandas(run, f"symbol string, tf string, period {kind}, zone int, price double, lower double, upper double, members int, kind string")


def with_zones(df: DataFrame, zones: DataFrame, unit: str = "day") -> DataFrame:
    """Bars with ``zones``, the array of their period's zones (empty, if there are none)."""
    listed = zones.groupBy(*KEYS, "period").agg(F.sort_array(F.collect_list(F.struct("price", "lower", "upper", "kind"))).alias("zones"))
    j = df.withColumn("period", F.date_trunc(unit, "ts")).join(listed, [*KEYS, "period"], "left").drop("period")
    return j.withColumn("zones", F.coalesce("zones", F.array().cast("array<struct<price:double,lower:double,upper:double,kind:string>>")))


def snr_features(df: DataFrame, none: float = 99_999.0) -> DataFrame:
    """Nearest zone under and over the close, how many lie on each side, whether the close lies in one. Z03

    Uses with_zones()' column; ``none`` stands for a side without zones.
    """
    c = F.col("close")
    under, over = F.filter("zones", lambda z: z["price"] <= c), F.filter("zones", lambda z: z["price"] > c)
    below, above = F.array_max(F.transform(under, lambda z: z["price"])), F.array_min(F.transform(over, lambda z: z["price"]))
    return df.withColumns({
        "zones_below": F.size(under), "zones_above": F.size(over), "support_price": F.coalesce(below, F.lit(none)), "resistance_price": F.coalesce(above, F.lit(none)),
        "support_distance": F.coalesce(ratio(c - below, c), F.lit(none)), "resistance_distance": F.coalesce(ratio(above - c, c), F.lit(none)), "in_zone": F.exists("zones", lambda z: (z["lower"] <= c) & (c <= z["upper"])),
    })


def zone_signals(df: DataFrame, width: float = 0.01, confirm: int = 3, share: float = 0.8) -> DataFrame:
    """Bars whose close lies within ``width`` of a zone and whose next bars bounce from it or break through it. Z09, Z10

    Bounce: at least ``share`` of the next ``confirm`` closes stay on the zone's good side, and the last one too; break: all
    of them are on the other side. ``share`` 1 is the strict form. Signals are known ``confirm`` bars later.
    """
    c = F.col("close")
    touched = F.filter("zones", lambda z: F.abs(z["price"] - c) <= width * c)
    nearest = F.array_min(F.transform(touched, lambda z: F.struct(F.abs(z["price"] - c).alias("d"), z["price"].alias("price"), z["kind"].alias("kind"))))
    df = df.withColumns({"_z": nearest, "_next": F.collect_list("close").over(next_rows(confirm))})
    level, up = F.col("_z.price"), F.col("_z.kind") == "support"
    good = F.size(F.filter("_next", lambda x: F.when(up, x > level).otherwise(x < level)))
    last = F.element_at("_next", -1)
    last_good = F.when(up, last > level).otherwise(last < level)
    full = (F.size("_next") == confirm) & F.col("_z").isNotNull()
    signal = F.when(full & (good >= share * confirm) & last_good, "bounce").when(full & (good == 0), "breakout")
    side = F.when(signal == "bounce", F.when(up, 1).otherwise(-1)).when(signal == "breakout", F.when(up, -1).otherwise(1))
    return df.withColumns({"zone_price": level, "zone_kind": F.col("_z.kind"), "signal": signal, "signal_side": side}).drop("_z", "_next")


def signal_bundle(df: DataFrame) -> DataFrame:
    """Trend by the last two closes, as rows. Z16"""
    trend = F.when(F.col("close") > lag("close"), "up").when(F.col("close") < lag("close"), "down").otherwise("flat")
    return df.withColumn("trend", trend).select(*KEYS, "ts", "trend")


def nearest_history(df: DataFrame, features: tuple[str, ...], horizon: int = 5, k: int = 8) -> DataFrame:
    """By series, for its last bar: the k nearest earlier bars by summed log(1 + |difference|), and their majority label. Z19

    Labels: the move over ``horizon`` beyond half a deviation of such moves. One query per series meets its own rows only.
    """
    move = lead("close", horizon) - F.col("close")
    d = df.withColumn("_move", move)
    stats = d.groupBy(*KEYS).agg(F.stddev_samp("_move").alias("_sd"), F.max("ts").alias("_last"), *[F.min(f).alias(f"_lo_{f}") for f in features], *[F.max(f).alias(f"_hi_{f}") for f in features])
    d = d.join(stats, list(KEYS))
    d = d.withColumn("_v", F.array(*[F.coalesce(ratio(F.col(f) - F.col(f"_lo_{f}"), F.col(f"_hi_{f}") - F.col(f"_lo_{f}")), F.lit(0.0)) for f in features]))
    query = d.filter(F.col("ts") == F.col("_last")).select(*KEYS, F.col("_v").alias("_q"))
    label = F.when(F.col("_move") > 0.5 * F.col("_sd"), 1).when(F.col("_move") < -0.5 * F.col("_sd"), -1).otherwise(0)
    history = d.filter("_move is not null").withColumn("label", label).join(query, list(KEYS))
    distance = F.aggregate(F.zip_with("_v", "_q", lambda a, b: F.log1p(F.abs(a - b))), F.lit(0.0), lambda s, x: s + x)
    near = history.withColumn("distance", distance).withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy("distance", "ts"))).filter(F.col("rank") <= k)
    return near.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"), F.sum("label").alias("votes"), F.when(F.sum("label") > 0, "up").when(F.sum("label") < 0, "down").otherwise("flat").alias("outlook"))


def last_known(df: DataFrame, column: str, rows: int) -> Column:
    """The column as it was ``rows`` rows ago: what a feature that looks ahead may show now."""
    return F.lag(column, rows).over(series())
