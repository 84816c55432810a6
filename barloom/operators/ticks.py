"""Trades inside bars: aggressor side, footprint levels, point of control and value area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR = ("symbol", "bar")


def classify(ticks: DataFrame) -> DataFrame:
    """Buy and sell volume by the tick rule: the sign of the last price change, a buy before the first one. A03"""
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    sign = F.signum(F.col("price") - F.lag("price").over(w))
    side = F.coalesce(F.last(F.nullif("_sign", F.lit(0.0)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    out = ticks.withColumn("_sign", sign).withColumn("side", side).drop("_sign")
    return out.withColumns({"buy_volume": F.when(F.col("side") > 0, F.col("volume")).otherwise(0.0), "sell_volume": F.when(F.col("side") < 0, F.col("volume")).otherwise(0.0)})


def assign_to_bars(ticks: DataFrame, freq: str) -> DataFrame:
    """The calendar bar that each tick lies in. J11 (for bars without a grid, joins.asof)"""
    return ticks.withColumn("bar", F.window("ts", freq)["start"])


def footprint_levels(ticks: DataFrame, freq: str, step: float) -> DataFrame:
    """Buy, sell and total volume at each price level of each bar; levels are multiples of ``step``. A04"""
    level = F.round(F.floor(F.col("price") / step + 1e-9) * step, 8)
    return assign_to_bars(classify(ticks), freq).withColumn("level", level).groupBy(*BAR, "level").agg(F.sum("buy_volume").alias("buy"), F.sum("sell_volume").alias("sell"), F.sum("volume").alias("total"))


def footprint(levels: DataFrame) -> DataFrame:
    """By bar: point of control (lowest of equals), delta, volume, levels. A04"""
    return levels.groupBy(*BAR).agg(F.max_by("level", F.struct("total", -F.col("level"))).alias("poc"), F.sum(F.col("buy") - F.col("sell")).alias("delta"), F.sum("total").alias("volume"), F.count(F.lit(1)).alias("n_levels"))


def imbalance(levels: DataFrame) -> DataFrame:
    """By bar: the largest ratio of buys at a level to sells at the next one up, or the inverse. A06"""
    w = Window.partitionBy(*BAR).orderBy("level")
    up = F.lead("sell").over(w)
    diagonal = F.greatest(F.try_divide("buy", F.nullif(up, F.lit(0.0))), F.try_divide(up, F.nullif("buy", F.lit(0.0))))
    return levels.withColumn("d", diagonal).groupBy(*BAR).agg(F.max("d").alias("max_imbalance"))


def value_area(levels: DataFrame, share: float = 0.7) -> DataFrame:
    """By bar: lowest and highest level around the point of control that hold ``share`` of the volume. A05

    From the point of control the area grows by two levels at a time on the side where they hold more, upwards on a tie.
    One fold over the sorted levels of a bar, inside the executor's code.
    """
    ordered = levels.groupBy(*BAR).agg(F.sort_array(F.collect_list(F.struct("level", "total"))).alias("ls"))
    total = F.aggregate("ls", F.lit(0.0), lambda a, x: a + x["total"])
    peak = F.aggregate("ls", F.struct(F.lit(-1.0).alias("t"), F.lit(0.0).alias("l")), lambda a, x: F.when(x["total"] > a["t"], F.struct(x["total"].alias("t"), x["level"].alias("l"))).otherwise(a))
    rows = ordered.withColumns({"want": total * share, "poc": peak["l"]}).withColumn("p", F.array_position(F.transform("ls", lambda x: x["level"]), F.col("poc")).cast("int"))
    n = F.size("ls")
    at = lambda i: F.when((i >= 1) & (i <= n), F.try_element_at(F.col("ls"), i)["total"]).otherwise(0.0)
    start = F.struct(F.col("p").alias("lo"), F.col("p").alias("hi"), at(F.col("p")).alias("v"))

    def grow(a: Column, _: Column) -> Column:
        above, below = at(a["hi"] + 1) + at(a["hi"] + 2), at(a["lo"] - 1) + at(a["lo"] - 2)
        open_up, open_down = a["hi"] < n, a["lo"] > 1
        done = (a["v"] >= F.col("want")) | ~(open_up | open_down)
        up = F.struct(a["lo"].alias("lo"), F.least(a["hi"] + 2, n).alias("hi"), (a["v"] + above).alias("v"))
        down = F.struct(F.greatest(a["lo"] - 2, F.lit(1)).alias("lo"), a["hi"].alias("hi"), (a["v"] + below).alias("v"))
        return F.when(done, a).when(open_up & (~open_down | (above >= below)), up).otherwise(down)

    area = F.aggregate("ls", start, grow)
    return rows.withColumn("a", area).select(*BAR, "poc", F.element_at("ls", F.col("a.lo"))["level"].alias("val"), F.element_at("ls", F.col("a.hi"))["level"].alias("vah"), F.col("a.v").alias("area_volume"))


def volume_at_levels(bars: DataFrame, levels: DataFrame, step: float) -> DataFrame:
    """By level: total, up, down and net volume of the bars whose range holds it. A07

    Levels carry symbol, level_id, price. Bars and levels meet in price cells of width ``step``, then the range is tested.
    """
    cell = lambda x: F.floor(x / step)
    b = bars.select("symbol", "low", "high", "open", "close", "volume", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    met = levels.withColumn("cell", cell(F.col("price"))).join(b, ["symbol", "cell"]).filter((F.col("low") <= F.col("price")) & (F.col("price") <= F.col("high")))
    up, down = F.when(F.col("close") > F.col("open"), F.col("volume")).otherwise(0.0), F.when(F.col("close") < F.col("open"), F.col("volume")).otherwise(0.0)
    sums = met.groupBy("symbol", "level_id", "price").agg(F.sum("volume").alias("total_volume"), F.sum(up).alias("up_volume"), F.sum(down).alias("down_volume"))
    return sums.withColumn("net_volume", F.col("up_volume") - F.col("down_volume"))
