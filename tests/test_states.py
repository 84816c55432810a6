"""Keyed streams give what the batch operators, or a plain walk over the rows, give; so do stored splits and the suite."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.operators import context, preparation, scaling, suite
from barloom.plans.bar_queries import hourly
from barloom.plans.context_queries import _normed
from barloom.streaming import bars as live
from barloom.streaming import states

from .conftest import DATA
from .test_streaming import drain, rows


def stored(df, path, parts=3):
    """``df`` as a stream of files in order of time."""
    for i in range(parts):
        df.filter(F.least(F.floor((F.dayofmonth("ts") - 1) / 11), F.lit(parts - 1)) == i).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_positions_follow_the_batch(spark, tmp_path):
    from barloom.operators.candles import tf_regime

    df = _normed(spark, DATA).withColumn("regime", tf_regime("a7", "d7", "a2", "d2")).select("symbol", "tf", "ts", "regime").persist()
    got = drain(states.stream_positions(stored(df, f"{tmp_path}/r")), "positions_out")
    want = context.bias_signals(context.regime_changes(_normed(spark, DATA), "a7", "d7", "a2", "d2"))
    cols = ("symbol", "regime", "signal", "confirmation")
    assert rows(got, F.col("ts").cast("string"), *cols) == rows(want, F.col("ts").cast("string"), *cols) and got.count() > 10


def test_zones_break_and_expire(spark, tmp_path):
    b = hourly(spark, DATA).select("symbol", "ts", "close").persist()
    days = b.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.min("close").alias("lo"), F.max("close").alias("hi"), F.max("ts").alias("ts"))
    z = days.select("symbol", "ts", F.explode(F.array(F.struct(F.lit("support").alias("kind"), F.col("lo").alias("lower"), (F.col("lo") + 1).alias("upper")), F.struct(F.lit("resistance").alias("kind"), (F.col("hi") - 1).alias("lower"), F.col("hi").alias("upper")))).alias("z"), "day")
    z = z.select("symbol", "ts", F.concat_ws(":", "z.kind", F.col("day").cast("string")).alias("zone_id"), "z.kind", "z.lower", "z.upper").persist()
    got = sorted(map(tuple, drain(states.stream_zones(stored(z, f"{tmp_path}/z"), stored(b, f"{tmp_path}/b"), 3), "zones_out").select("symbol", F.col("ts").cast("string"), "zone_id", "event").collect()))
    want = []
    events = sorted([(r.symbol, str(r.ts), 0, r.zone_id, r) for r in z.collect()] + [(r.symbol, str(r.ts), 1, "", r) for r in b.collect()], key=lambda e: e[:4])
    open_, seen, at, symbol = {}, 0, None, None
    for s, ts, is_bar, _, r in events:
        if s != symbol:
            open_, seen, at, symbol = {}, 0, None, s
        if is_bar:
            for i in [i for i, (q, _) in open_.items() if (r.close < q.lower if q.kind == "support" else r.close > q.upper)]:
                want.append((s, ts, i, "broken"))
                del open_[i]
            continue
        if ts != at:
            at, seen = ts, seen + 1
            for i in [i for i, (_, n) in open_.items() if n <= seen - 3]:
                want.append((s, ts, i, "expired"))
                del open_[i]
        open_[r.zone_id] = (r, seen)
        want.append((s, ts, r.zone_id, "made"))
    assert got == sorted(want) and {e for *_, e in got} == {"made", "broken", "expired"}


def test_outcomes(spark, tmp_path):
    b = hourly(spark, DATA).select("symbol", "ts", "high", "low", "close").persist()
    s = b.filter(F.hour("ts") % 6 == 0).select("symbol", "ts", F.concat_ws(":", "symbol", F.col("ts").cast("string")).alias("signal_id"), F.when(F.col("close") > 50, 1.0).otherwise(-1.0).alias("side"), F.col("close").alias("entry")).persist()
    got = {r.signal_id: (r.n_bars, r.mfe, r.mae, r.net) for r in drain(states.stream_outcomes(stored(s, f"{tmp_path}/s"), stored(b, f"{tmp_path}/b"), "12 hours"), "outcomes_out").collect()}
    bars, want = b.orderBy("ts").collect(), {}
    for x in s.collect():
        ahead = [r for r in bars if r.symbol == x.symbol and 0 < (r.ts - x.ts).total_seconds() <= 12 * 3600]
        if ahead:
            up, down = max(r.high for r in ahead) - x.entry, x.entry - min(r.low for r in ahead)
            want[x.signal_id] = (len(ahead), *((up, down) if x.side > 0 else (down, up)), x.side * (ahead[-1].close - x.entry))
    assert len(got) > len(want) / 2
    for k, v in got.items():
        assert v == pytest.approx(want[k])


def test_pairing(spark, tmp_path):
    b = hourly(spark, DATA)
    e = b.select("symbol", F.when(F.col("close") > F.col("open"), "up").otherwise("down").alias("direction"), "ts", F.col("close").alias("strength")).persist()
    h1, h4 = e.filter(F.hour("ts") % 2 == 1), e.filter(F.hour("ts") % 4 == 0)
    got = drain(live.stream_pairing(stored(h1, f"{tmp_path}/h1"), stored(h4, f"{tmp_path}/h4")), "pairs_out")
    a, c = h1.alias("a"), h4.withColumnsRenamed({"ts": "h4_ts", "strength": "h4_strength"}).alias("c")
    want = a.join(c, (F.col("a.symbol") == F.col("c.symbol")) & (F.col("a.direction") == F.col("c.direction")) & (F.col("h4_ts") <= F.col("ts")) & (F.col("h4_ts") >= F.col("ts") - F.expr("interval 4 hours"))).select("a.symbol", "ts", "h4_ts")
    key = (F.col("symbol"), F.col("ts").cast("string"), F.col("h4_ts").cast("string"))
    assert rows(got, *key) == rows(want, *key) and got.count() > 10


def test_stored_splits(spark, tmp_path):
    df = scaling.split_sequential(hourly(spark, DATA))
    preparation.write_splits(df, f"{tmp_path}/splits")
    back = preparation.read_splits(spark, f"{tmp_path}/splits")
    assert back.count() == df.count()
    part = preparation.windowed_read(back, "val", 5, 10)
    assert sorted(r.row for r in part.collect()) == list(range(5, 15))
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().toString()


def test_suite_leaves_no_holes_and_keeps_each_indicator(spark):
    b = hourly(spark, DATA)
    got = suite.indicator_suite(b.withColumn("Next_Close", F.col("close")), ("means", "bollinger", "rsi", "delta", "letters"), inference=True, sentinel=-1.0)
    assert "Next_Close" not in got.columns and got.columns[: len(suite.BASE)] == list(suite.BASE)
    assert got.columns[len(suite.BASE) :] == sorted(got.columns[len(suite.BASE) :])
    extra = got.columns[len(suite.BASE) :]
    assert got.filter(" or ".join(f"`{c}` is null" for c in extra)).count() == 0 and got.count() == b.count()
    with pytest.raises(ValueError):
        suite.indicator_suite(b, ("nothing",))


def test_chosen_indicators_are_checked():
    assert suite.required_rows([("sma", {}), ("macd", {"slow": 30}), ("rsi", {"length": 7})]) == 39
    for bad in (("vwma", {}), ("sma", {"span": 3}), ("rsi", {"length": 0}), ("sma", {"length": 2.5})):
        with pytest.raises(ValueError):
            suite.checked([bad])
