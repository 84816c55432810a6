"""State machines in blocks: the same rows whatever the block and warm-up, and as a plain loop over the series gives them."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions import folds
from barloom.operators import joins, recursive

from .test_zone_bars import FIELDS, walk


@pytest.fixture(scope="module")
def bars(spark):
    df = spark.createDataFrame([r for s, n in (("a", 700), ("b", 31), ("c", 1)) for r in walk(n, n, s)], FIELDS).repartition(3).persist()
    yield df
    df.unpersist()


MACHINES = {
    "supertrend": (recursive.supertrend, ("supertrend", "supertrend_dir")),
    "psar": (recursive.psar, ("psar", "psar_dir")),
    "zigzag": (lambda b, **k: recursive.zigzag(b, 0.03, 0.03, **k), ("zz_pivot", "zz_known")),
    "slow_zigzag": (lambda b, **k: recursive.zigzag(b, 0.3, 0.3, **k), ("zz_pivot", "zz_known")),
    "positions": (lambda b, **k: recursive.bias_positions(b.withColumns({"e": F.signum(F.when(F.hour("ts") % 5 == 0, F.col("close") - F.col("open"))), "x": F.hour("ts") == 7}), "e", "x", **k), ("position", "event")),
    "actions": (lambda b, **k: recursive.non_overlapping(b.withColumn("action", F.when(F.hour("ts") % 3 == 0, 1.0)), 7, **k), ("taken", "won")),
}


@pytest.mark.parametrize("name", MACHINES)
def test_blocks_make_no_difference(bars, name):
    run, columns = MACHINES[name]
    rows = lambda **k: sorted((r.symbol, r.ts, *[None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for c in columns]) for r in run(bars, **k).collect())
    whole = rows(block=100_000)
    assert len(whole) == 732
    assert rows(block=64, warm=1) == whole
    assert rows(block=50, warm=120) == whole


def test_states_that_never_forget(spark):
    """A running sum depends on all rows before it: every round puts one block more right."""
    df = spark.createDataFrame([("a", "1h", datetime(2024, 1, 1) + timedelta(hours=k), float(k)) for k in range(60)] + [("b", "1h", datetime(2024, 1, 1), None)], "symbol string, tf string, ts timestamp, x double")

    def step(a, state, first):
        out, total = [], state[0]
        for x in a["x"]:
            total += 0 if math.isnan(x) else x
            out.append(total)
        return {"total": out}, [total]

    got = {(r.symbol, r._i): r.total for r in folds.block_fold(df, ("x",), "total double", [0.0], step, 10, 3).collect()}
    assert got == {("a", k): k * (k + 1) / 2 for k in range(60)} | {("b", 0): 0.0}
    assert folds.block_fold(df.limit(0), ("x",), "total double", [0.0], step).count() == 0


def test_zigzag_by_loop(bars):
    for r in recursive.zigzag(bars, 0.03, 0.03, block=40, warm=5).filter("zz_pivot <> 0 and symbol = 'a'").collect():
        assert r.zz_known > 0
    closes = [r.close for r in bars.filter("symbol = 'a'").orderBy("ts").collect()]
    pivots, side, top, bottom = {}, 0, 0, 0
    for i in range(1, len(closes)):
        if side >= 0 and closes[i] >= closes[top]:
            top = i
        if side <= 0 and closes[i] <= closes[bottom]:
            bottom = i
        if side >= 0 and closes[i] <= closes[top] * 0.97:
            pivots[top], side, bottom = (1, i - top), -1, i
        elif side <= 0 and closes[i] >= closes[bottom] * 1.03:
            pivots[bottom], side, top = (-1, i - bottom), 1, i
    got = recursive.zigzag(bars, 0.03, 0.03, block=40, warm=5).filter("symbol = 'a'").orderBy("ts").collect()
    assert {i: (r.zz_pivot, r.zz_known) for i, r in enumerate(got) if r.zz_pivot} == pivots and len(pivots) > 10


def test_fifo_by_loop(spark):
    rnd = random.Random(4)
    rows = [(s, rnd.choice(["buy", "sell", "sell", "hold"] if k % 40 < 20 else ["buy", "buy", "sell"]), float(rnd.randrange(1, 9)), 1.0, datetime(2024, 1, 1) + timedelta(hours=5 * rnd.randrange(60)), k) for s in "ab" for k in range(150)]
    df = spark.createDataFrame(rows, "symbol string, side string, price double, qty double, ts timestamp, id long").repartition(4)
    want = {}
    for s in "ab":
        held = []
        for _, side, price, _, ts, k in sorted((r for r in rows if r[0] == s), key=lambda r: (r[4], r[5])):
            if side == "buy":
                held.append((price, ts))
            elif side == "sell":
                want[s, k] = held.pop(0) if held else None
    got = {(r.symbol, r.id): r for r in joins.fifo_match(df).collect()}
    assert got.keys() == want.keys() and any(want.values()) and not all(want.values())
    assert all((got[k].side == "sell") if w is None else (got[k].entry_price, got[k].start_time) == w for k, w in want.items())
