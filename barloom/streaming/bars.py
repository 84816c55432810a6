"""Structured Streaming forms of the batch operators: the same names, on unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def timed(df: DataFrame, late: str, column: str = "ts") -> DataFrame:
    """Event time as a timestamp with a watermark; times without a zone are taken in the session's."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


STATE = "n long, value double, last_ts timestamp"


def stream_bars(ticks: DataFrame, freq: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Ticks as bars of a calendar width (overlapping, with ``slide``); later ticks than ``late`` are dropped. R01, R02

    In append mode a bar comes once, when it is final; in update mode it is provisional until then.
    """
    order = F.struct("ts", "seq")
    w = F.window("ts", freq, slide) if slide else F.window("ts", freq)
    return timed(ticks, late).groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume")
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that a gap ends: first and last price, extremes, ticks. R03"""
    order = F.struct("ts", "seq")
    return timed(ticks, late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(
        F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("last_price"), F.max("price").alias("high"), F.min("price").alias("low"), F.count(F.lit(1)).alias("n")
    ).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "first_price", "last_price", "high", "low", "n")


def stream_dedup(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first of events that are equal in the keys and arrive within ``late``. R08"""
    return timed(events, late).dropDuplicatesWithinWatermark(keys)


def stream_ema(bars: DataFrame, alpha: float) -> DataFrame:
    """EMA of the close of each symbol over all batches; a batch's bars are taken in order of time. R04

    State is one number per symbol. Bars older than the last one seen are left out: they are settled.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, value, last = state.get if state.exists else (0, 0.0, pd.Timestamp.min)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, close in zip(rows["ts"], rows["close"], strict=True):
            if n and ts <= last:
                continue
            value = close if n == 0 else alpha * close + (1 - alpha) * value
            n, last = n + 1, ts
            out.append((key[0], ts, close, value))
        if n:
            state.update((n, value, last))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "ema"])

    return bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close").groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, close double, ema double", STATE, "append", GroupStateTimeout.NoTimeout)


def stream_pairing(h1: DataFrame, h4: DataFrame, hours: int = 4) -> DataFrame:
    """h1 events with the h4 events of their symbol and direction in the ``hours`` before. R07"""
    a = timed(h1, f"{hours} hours").alias("a")
    b = timed(h4.withColumnRenamed("ts", "h4_ts").withColumnRenamed("strength", "h4_strength"), f"{hours} hours", "h4_ts").alias("b")
    near = (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.direction") == F.col("b.direction")) & (F.col("h4_ts") <= F.col("ts")) & (F.col("h4_ts") >= F.col("ts") - F.expr(f"interval {hours} hours"))
    return a.join(b, near).select("a.symbol", "a.direction", "ts", "strength", "h4_ts", "h4_strength", (0.7 * F.col("strength") + 0.3 * F.col("h4_strength")).alias("composite"))


def upsert_latest(path: str, keys: list[str], order: str):
    """A foreachBatch sink: each batch's last row by key, written under its number, so a repeated batch replaces itself. R10"""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(upserts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What upsert_latest() has stored, each key once: the last row over all batches."""
    return upserts.groupBy(*keys).agg(F.max_by(F.struct(*upserts.columns), order).alias("r")).select("r.*")
