"""Column helpers for ordered series: one series per (symbol, tf), ascending ts.

Missing is null, never NaN. A rolling value is null until ``least`` non-null values lie in its window (default: all n).
All helpers of one family share a window specification, so Spark plans one window operator for each frame and no extra
shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol", "tf")


def series(keys: tuple[str, ...] = KEYS) -> WindowSpec:
    """The series in order of time; frameless, for lag and lead."""
    return Window.partitionBy(*keys).orderBy("ts")


def last_rows(n: int, keys: tuple[str, ...] = KEYS) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return series(keys).rowsBetween(1 - n, 0)


def next_rows(n: int, keys: tuple[str, ...] = KEYS) -> WindowSpec:
    """The n rows after the current one."""
    return series(keys).rowsBetween(1, n)


def so_far(keys: tuple[str, ...] = KEYS) -> WindowSpec:
    return series(keys).rowsBetween(Window.unboundedPreceding, 0)


def whole(keys: tuple[str, ...] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys)


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(as_col(x), n).over(series())


def lead(x: Column | str, n: int = 1) -> Column:
    return F.lead(as_col(x), n).over(series())


def diff(x: Column | str, n: int = 1) -> Column:
    return as_col(x) - lag(x, n)


def roll(agg: Callable[[Column], Column], x: Column | str, n: int, least: int | None = None) -> Column:
    """``agg`` over the last n rows, null while fewer than ``least`` values are there."""
    w = last_rows(n)
    return F.when(F.count(as_col(x)).over(w) >= (n if least is None else least), agg(as_col(x)).over(w))


def forward(agg: Callable[[Column], Column], x: Column | str, n: int) -> Column:
    """``agg`` over the next n rows, null where fewer than n follow."""
    w = next_rows(n)
    return F.when(F.count(as_col(x)).over(w) == n, agg(as_col(x)).over(w))


def ffill(x: Column | str) -> Column:
    return F.last(as_col(x), ignorenulls=True).over(so_far())


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(as_col(a), as_col(b))


def clean(x: Column | str) -> Column:
    """NaN and infinities as null."""
    c = as_col(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clip(x: Column | str, low: float, high: float) -> Column:
    """Into [low, high]; null stays null."""
    c = as_col(x)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded, other columns as they are."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def linear_scan(df: DataFrame, b: str, decay: float, out: str, bucket: str = "day", block: int = 128, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``out``_t = decay * out_(t-1) + b_t over each series, rows with null ``b`` skipped (null there): exact, and parallel within a series.

    Rows are folded inside blocks of a calendar bucket (at most ``block`` rows), and only one row per block takes part in
    the series-wide step, so one very long series doesn't end in one task.
    """
    return linear_scans(df, {out: (b, decay)}, bucket, block, keys)


def _carried(decay: float) -> Callable[[Column, Column], Column]:
    """The value at a block's end from that at the end of the one before."""
    return lambda y, e: F.pow(F.lit(decay), e["size"]) * y + e["end"]


def linear_scans(df: DataFrame, scans: dict[str, tuple[str, float]], bucket: str = "day", block: int = 128, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """linear_scan() of several (b, decay) by their ``out``, with the shuffles of one. All ``b`` have to be null in the same rows."""
    if not all(0 < decay < 1 for _, decay in scans.values()):
        raise ValueError("decay must lie between 0 and 1")
    have = F.col(next(iter(scans.values()))[0]).isNotNull()
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy("ts")
    numbered = df.withColumn("_bucket", F.date_trunc(bucket, "ts")).withColumn("_n", F.sum(have.cast("int")).over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    placed = numbered.withColumn("_block", F.floor(F.greatest("_n", F.lit(0)) / block)).withColumn("_pos", (F.greatest("_n", F.lit(0)) % block).cast("double"))
    in_block = Window.partitionBy(*keys, "_bucket", "_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    folded = {f"_local{i}": F.pow(F.lit(decay), "_pos") * F.sum(F.when(have, F.col(b) * F.pow(F.lit(1 / decay), "_pos"))).over(in_block) for i, (b, decay) in enumerate(scans.values())}
    local = placed.withColumns(folded)
    ends = local.filter(have).groupBy(*keys, "_bucket", "_block").agg(*[F.max_by(x, "ts").alias(f"{x}_end") for x in folded], F.count(F.lit(1)).cast("double").alias("_size"))
    carries = []
    for i, (_, decay) in enumerate(scans.values()):
        # blocks before these no longer show in a double: decay ** rows < 2 ** -60
        reach = max(1, min(4096, math.ceil(60 * math.log(2) / -math.log(decay))))
        before = Window.partitionBy(*keys).orderBy("_bucket", "_block").rowsBetween(-reach, -1)
        seen = F.collect_list(F.struct(F.col(f"_local{i}_end").alias("end"), F.col("_size").alias("size"))).over(before)
        carries.append(F.aggregate(seen, F.lit(0.0), _carried(decay)).alias(f"_carry{i}"))
    joined = local.join(ends.select(*keys, "_bucket", "_block", *carries), [*keys, "_bucket", "_block"], "left")
    values = {out: F.when(have, F.col(f"_local{i}") + F.col(f"_carry{i}") * F.pow(F.lit(decay), F.col("_pos") + 1)) for i, (out, (_, decay)) in enumerate(scans.items())}
    return joined.withColumns(values).drop("_bucket", "_n", "_block", "_pos", *folded, *[f"_carry{i}" for i in range(len(scans))])
