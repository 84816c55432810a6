"""Search in long series by calendar blocks: no series is folded row by row, and none ends in one task.

A series is cut into blocks (a day of bars, say). Blocks keep their rows in order and their extremes; months keep the
extremes of their blocks, a series those of its months. What a level looks for is found by going down these: only blocks
that hold the answer are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import KEYS, as_col, clean


def row_blocks(bars: DataFrame, values: dict[str, Column | str], bucket: str = "day") -> DataFrame:
    """(symbol, tf, ``_block``) with ``_rows``: the block's ts and ``values``, in order of time."""
    rows = bars.select(*KEYS, "ts", *[as_col(c).alias(n) for n, c in values.items()]).withColumn("_block", F.date_trunc(bucket, "ts"))
    return rows.groupBy(*KEYS, "_block").agg(F.array_sort(F.collect_list(F.struct("ts", *values))).alias("_rows"))


def with_rows_before(blocks: DataFrame, n: int) -> DataFrame:
    """``_before``: the last n rows ahead of each block. Every block has a row at least, so n blocks hold them."""
    ahead = Window.partitionBy(*KEYS).orderBy("_block").rowsBetween(-n, -1)
    tails = F.flatten(F.collect_list(F.slice("_rows", -F.least(F.size("_rows"), F.lit(n)), n)).over(ahead))
    return blocks.withColumn("_before", F.slice(tails, F.greatest(F.size(tails) - n + 1, F.lit(1)), n))


def first_crossing(levels: DataFrame, bars: DataFrame, above: Column | str = "high", below: Column | str = "low", out: str = "crossed_at", bucket: str = "day") -> DataFrame:
    """``out``: when a level is first crossed after its ts. Levels carry symbol, tf, ts, price and side.

    Side 1 asks for the first later bar whose ``above`` is over the price, side -1 for the first whose ``below`` is under
    it. Null where there is none, or where ts or price is null; null and NaN values cross nothing. Every level keeps its
    row, equal ones too.
    """
    rows = row_blocks(bars, {"_a": clean(above), "_b": clean(below)}, bucket)
    days = rows.select(*KEYS, F.date_trunc("month", "_block").alias("_month"), "_block", F.array_max("_rows._a").alias("_a"), F.array_min("_rows._b").alias("_b"))
    days = days.groupBy(*KEYS, "_month").agg(F.array_sort(F.collect_list(F.struct("_block", "_a", "_b"))).alias("_days"), F.max("_a").alias("_a"), F.min("_b").alias("_b"))
    months = days.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("_month", "_a", "_b"))).alias("_months"))
    days = days.drop("_a", "_b")

    def first(found_in: str, field: str, after: Column | None = None) -> Column:
        def fits(x: Column) -> Column:
            beyond = F.when(F.col("side") > 0, x["_a"] > F.col("price")).otherwise(x["_b"] < F.col("price"))
            return beyond if after is None else beyond & (x[field] > after)

        return F.get(F.filter(found_in, fits), F.lit(0))[field]

    lv = levels.withColumn("_block", F.date_trunc(bucket, "ts")).withColumn("_month", F.date_trunc("month", "_block"))
    lv = lv.join(rows, [*KEYS, "_block"], "left").withColumn("_hit", first("_rows", "ts", F.col("ts"))).drop("_rows")
    lv = lv.join(days, [*KEYS, "_month"], "left").withColumn("_day", F.when(F.col("_hit").isNull(), first("_days", "_block", F.col("_block")))).drop("_days")
    lv = lv.join(months, [*KEYS], "left").withColumn("_far", F.when(F.coalesce("_hit", "_day").isNull(), first("_months", "_month", F.col("_month")))).drop("_months", "_block", "_month")
    lv = lv.join(days.withColumnRenamed("_month", "_far"), [*KEYS, "_far"], "left").withColumn("_block", F.coalesce("_day", first("_days", "_block"))).drop("_days", "_day", "_far")
    lv = lv.join(rows, [*KEYS, "_block"], "left").withColumn(out, F.coalesce("_hit", first("_rows", "ts"))).drop("_rows", "_block", "_hit")
    return lv
