"""Shuffled streams give the batch result behind the watermark, also when the query starts again from its checkpoint."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import recursive
from barloom.plans.bar_queries import hourly
from barloom.streaming import event_time

from .conftest import DATA


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get(event_time.STORE[0], None)
    spark.conf.set(*event_time.STORE)
    yield
    if before is None:
        spark.conf.unset(event_time.STORE[0])
    else:
        spark.conf.set(event_time.STORE[0], before)


def files(spark, df, path, late_hours, seed=3):
    """Rows in files, each at most so many hours out of order."""
    rows = df.collect()
    rnd = random.Random(seed)
    rows.sort(key=lambda r: r.ts.timestamp() + rnd.random() * 3600 * late_hours)
    for i in range(4):
        part = rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        rnd.shuffle(part)
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{path}/part{i}")


def run(stream, path, name, mode="append"):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out-{name}").option("checkpointLocation", f"{path}/check-{name}").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out-{name}")


def near(x):
    return None if x is None else pytest.approx(x, rel=1e-9, abs=1e-9)


def test_indicators_in_order(spark, tmp_path):
    bars = hourly(spark, DATA).filter("symbol in ('click', 'view')").select("symbol", "tf", F.col("ts").cast("timestamp").alias("ts"), "high", "low", "close").persist()
    path = str(tmp_path)
    files(spark, bars.filter("day(ts) <= 12"), f"{path}/in", 6)
    source = lambda: spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    stream = lambda: event_time.stream_indicators(source(), "200 days")
    first = run(stream(), path, "indicators").count()
    assert first == 0  # nothing is behind the watermark yet
    # later files, then one far ahead that moves the watermark past all: the query goes on from its checkpoint
    files(spark, bars.filter("day(ts) > 12"), f"{path}/in", 6, 4)
    run(stream(), path, "indicators")
    ahead = [(s, "1h", r.ts.replace(year=2030), 1.0, 1.0, 1.0) for s in ("click", "view") for r in bars.limit(1).collect()]
    spark.createDataFrame(ahead, bars.schema).write.mode("append").parquet(f"{path}/in/ahead")
    run(stream(), path, "indicators")
    spark.createDataFrame([(*a[:2], a[2].replace(year=2032), *a[3:]) for a in ahead], bars.schema).write.mode("append").parquet(f"{path}/in/later")
    got = run(stream(), path, "indicators").filter("year(ts) < 2030").collect()
    batch = recursive.atr_wilder(recursive.rsi(recursive.ema(bars, "close", 9), n=14), 10, "atr")
    batch = recursive.supertrend(batch, 10, 3.0)
    want = {(r.symbol, r.ts): r for r in batch.collect()}
    assert len(got) == len(want) > 100
    for r in got:
        w = want[r.symbol, r.ts]
        assert (r.close, r.ema, r.rsi, r.atr, r.supertrend, r.supertrend_dir) == (w.close, near(w.ema_9), near(w.rsi), near(w.atr), near(w.supertrend), w.supertrend_dir)


def test_zone_lives_in_order(spark, tmp_path):
    path = str(tmp_path)
    at = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    zones = spark.createDataFrame([("a", at(h), f"z{h}", "support" if h % 2 else "resistance", 9.0 - h / 20, 11.0 + h / 20) for h in range(0, 40, 4)] + [("a", at(3), "s", "support", 9.0, 9.5)], "symbol string, ts string, zone_id string, kind string, lower double, upper double").withColumn("ts", F.to_timestamp("ts"))
    rnd = random.Random(2)
    closes = [("a", at(h), 10 + rnd.gauss(0, 0.9)) for h in range(48)] + [("a", at(5), None)]
    bars = spark.createDataFrame(closes, "symbol string, ts string, close double").withColumn("ts", F.to_timestamp("ts"))
    files(spark, zones, f"{path}/z", 9)
    files(spark, bars, f"{path}/b", 9)
    for year in (2030, 2032):
        spark.createDataFrame([("a", f"{year}-01-01 00:00:00", 10.0)], "symbol string, ts string, close double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{path}/b/ahead{year}")
        spark.createDataFrame([("x", f"{year}-01-01 00:00:00", "q", "support", 0.0, 1.0)], "symbol string, ts string, zone_id string, kind string, lower double, upper double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{path}/z/ahead{year}")
    read = lambda df, p: spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{path}/{p}")
    got = sorted((str(r.ts), r.zone_id, r.event) for r in run(event_time.stream_zone_lives(read(zones, "z"), read(bars, "b"), 4, "200 days"), path, "zones").filter("symbol = 'a' and year(ts) = 2024").collect())
    live, seen, want, snapshot = {}, 0, [], None
    for r in sorted([(z.ts, 0, z) for z in zones.collect()] + [(b.ts, 1, b) for b in bars.collect()], key=lambda e: (e[0], e[1])):
        ts, is_bar, row = r
        if is_bar:
            for i in [i for i, z in live.items() if row.close is not None and (row.close < z[0].lower if z[0].kind == "support" else row.close > z[0].upper)]:
                want.append((str(ts), i, "broken"))
                del live[i]
            continue
        if ts != snapshot:
            snapshot, seen = ts, seen + 1
            for i in [i for i, z in live.items() if z[1] <= seen - 4]:
                want.append((str(ts), i, "expired"))
                del live[i]
        live[row.zone_id] = (row, seen)
        want.append((str(ts), row.zone_id, "made"))
    assert got == sorted(want) and {e for *_, e in want} == {"made", "broken", "expired"}
