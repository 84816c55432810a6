"""Streams give what the batch operators give on the same rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.plans.bar_queries import hourly
from barloom.sources.bars import event_ticks, resample
from barloom.streaming import bars as live

from .conftest import DATA


@pytest.fixture()
def ticks(spark, tmp_path):
    """Events as a stream of three files in order of time."""
    df = event_ticks(spark, DATA).orderBy("ts").persist()
    for i in range(3):
        df.filter(F.floor((F.dayofmonth("ts") - 1) / 11) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    yield spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    df.unpersist()


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_bars(spark, ticks):
    cols = ("symbol", "ts", "open", "high", "low", "close", "volume")
    got = rows(drain(live.stream_bars(ticks, "1 day"), "bars_out"), *cols)
    want = rows(resample(event_ticks(spark, DATA), "1 day"), *cols)
    last = max(r[1] for r in got)
    assert got == [r for r in want if r[1] <= last] and len(got) > 100
    assert rows(drain(live.stream_bars(ticks, "1 day"), "bars_all", "complete"), *cols) == want


def test_sessions(spark, ticks):
    got = drain(live.stream_sessions(ticks, "6 hours"), "sessions_out", "complete")
    assert got.agg(F.sum("n")).first()[0] == event_ticks(spark, DATA).count()


def test_dedup(spark, ticks):
    doubled = ticks.unionByName(ticks)
    assert drain(live.stream_dedup(doubled, ["symbol", "seq"], "60 days"), "dedup_out").count() == event_ticks(spark, DATA).count()


def test_ema_state(spark, tmp_path):
    bars = hourly(spark, DATA).select("symbol", "ts", "close").orderBy("ts")
    for i in range(3):
        bars.filter(F.floor((F.dayofmonth("ts") - 1) / 11) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/b{i}")
    stream = spark.readStream.schema(bars.schema).parquet(f"{tmp_path}/b*")
    got = {(r.symbol, r.ts): r.ema for r in drain(live.stream_ema(stream, 0.2), "ema_out").collect()}
    value = {}
    for r in bars.collect():
        y = value.get(r.symbol)
        value[r.symbol] = r.close if y is None else 0.2 * r.close + 0.8 * y
        assert got[r.symbol, r.ts] == pytest.approx(value[r.symbol])


def test_upsert(spark, ticks, tmp_path):
    q = ticks.writeStream.foreachBatch(live.upsert_latest(f"{tmp_path}/out", ["symbol"], "seq")).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = rows(live.latest(spark.read.parquet(f"{tmp_path}/out").drop("batch"), ["symbol"], "seq"), "symbol", "seq")
    assert got == rows(event_ticks(spark, DATA).groupBy("symbol").agg(F.max("seq").alias("seq")), "symbol", "seq")
