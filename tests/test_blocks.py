"""First crossings against a plain search, order blocks on hand-made bars, lineage with cycles and missing parents."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions.blocks import first_crossing
from barloom.operators import order_blocks, preparation
from barloom.operators.structure import swing_points

from .test_zone_bars import FIELDS, walk


@pytest.mark.parametrize("bucket", ["day", "hour"])
def test_first_crossing(spark, bucket):
    rnd = random.Random(1)
    rows = [(s, "1h", datetime(2024, 1, 1) + timedelta(hours=9 * k), 0.0, 10 + rnd.gauss(0, 2), 10 + rnd.gauss(0, 2), 0.0, 0.0) for s in "ab" for k in range(200)]
    rows += [("a", "1h", datetime(2024, 1, 5, 1), 0.0, None, float("nan"), 0.0, 0.0)]
    levels = [(s, "1h", rnd.choice([None, datetime(2023, 1, 1), datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(2000))]), rnd.choice([None, 10 + rnd.gauss(0, 4)]), rnd.choice([1, -1]), i) for i, s in enumerate("abc" * 60)]
    levels += levels[:3]
    bars = spark.createDataFrame(rows, FIELDS).repartition(3)
    asked = spark.createDataFrame(levels, "symbol string, tf string, ts timestamp, price double, side int, id int")
    got = sorted(((r.id, r.crossed_at) for r in first_crossing(asked, bars, bucket=bucket).collect()), key=lambda x: (x[0], x[1] is None, x[1]))

    def search(s, ts, price, side):
        if ts is None or price is None:
            return None
        found = [r[2] for r in rows if r[0] == s and r[2] > ts and (r[4] is not None and r[4] > price if side > 0 else r[5] == r[5] and r[5] < price)]
        return min(found, default=None)

    want = sorted(((i, search(s, ts, p, side)) for s, _, ts, p, side, i in levels), key=lambda x: (x[0], x[1] is None, x[1]))
    assert got == want and sum(x is not None for _, x in want) > 20


def naive_blocks(rows, swings, body):
    """All blocks by walking over the bars, a dict by candle as the last word."""
    held = {}
    for side in (1, -1):
        marks = [i for i, s in enumerate(swings) if s == side]
        alive, crossed = [], set()
        for i, r in enumerate(rows):
            high, low = r[4], r[5]
            for c in list(alive):
                b = held[c]
                if b["broken"]:
                    if (high > b["top"]) if side > 0 else (low < b["bottom"]):
                        b["gone"] = True
                        alive.remove(c)
                else:
                    h, lo = (max(r[3], r[6]), min(r[3], r[6])) if body else (high, low)
                    if (lo < b["bottom"]) if side > 0 else (h > b["top"]):
                        b["broken"], b["at"] = True, i
            last = max((m for m in marks if m < i), default=None)
            if last is None or last in crossed or not ((r[6] > rows[last][4]) if side > 0 else (r[6] < rows[last][5])):
                continue
            crossed.add(last)
            inside = range(last + 1, i)
            c = (min(inside, key=lambda j: (rows[j][5], -j)) if side > 0 else max(inside, key=lambda j: (rows[j][4], j))) if inside else i - 1
            v = [rows[j][7] or 0.0 if j >= 0 else 0.0 for j in (i, i - 1, i - 2)]
            two, one = v[0] + v[1], v[2]
            before = held.get(c)
            held[c] = {"side": side, "top": rows[c][4], "bottom": rows[c][5], "volume": two + one, "share": 100 * min(two, one) / max(two, one) if max(two, one) else 100.0, "born": i, "broken": bool(before and before["broken"]), "at": before["at"] if before and not before["gone"] else None, "gone": False}
            alive.append(c)
    return {c: b for c, b in held.items() if not b["gone"]}


@pytest.mark.parametrize("body", [False, True])
def test_order_blocks(spark, body):
    data = {s: walk(n, n, s) for s, n in (("a", 500), ("b", 90), ("c", 4))}
    df = swing_points(spark.createDataFrame([r for rows in data.values() for r in rows], FIELDS).repartition(3), 3).persist()
    got = {(r.symbol, r.ts): r for r in order_blocks.order_blocks(df, body).filter("removed_at is null").collect()}
    want = {}
    for s, rows in data.items():
        swings = [r.swing for r in df.filter(F.col("symbol") == s).orderBy("ts").collect()]
        want |= {(s, rows[c][2]): (b, rows) for c, b in naive_blocks(rows, swings, body).items()}
    assert got.keys() == want.keys() and len(want) > 5
    for key, (b, rows) in want.items():
        r = got[key]
        assert (r.ob, r.ob_top, r.ob_bottom, r.ob_volume, r.created_at) == (b["side"], b["top"], b["bottom"], b["volume"], rows[b["born"]][2])
        assert r.ob_percentage == pytest.approx(b["share"]) and r.mitigated_at == (None if b["at"] is None else rows[b["at"]][2])
    assert order_blocks.order_blocks(df.limit(0)).count() == 0


def test_smc_features(spark):
    bars = spark.createDataFrame(walk(250, 2, "a") + walk(40, 3, "b"), FIELDS)
    got = order_blocks.smc_features(bars)
    assert got.count() == 290 and got.filter("swing is not null").count() > 0
    assert {"fvg_mitigated_at", "ob_mitigated_at", "broken_at", "liquidity_level_diff", "ob_top_diff"} <= set(got.columns)
    assert order_blocks.smc_features(bars.limit(0)).count() == 0


def test_lineage(spark):
    rows = [(0, i, i - 1 if i > 1 else None) for i in range(1, 40)] + [(1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 4, 1), (1, 9, 99), (1, 5, 5), (2, 8, 7)]
    c = spark.createDataFrame(rows, "session_id int, dataset_id int, parent_id int")
    got = {(r[0], r[1]): (r[2], r[3]) for r in preparation.dataset_lineage(c).groupBy("session_id", "start_id").agg(F.first("ended"), F.sort_array(F.collect_list(F.struct("depth", "dataset_id")))["dataset_id"]).collect()}
    assert got[0, 39] == ("root", list(range(39, 0, -1))) and got[0, 1] == ("root", [1])
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {1: ("cycle", [1, 2, 3]), 2: ("cycle", [2, 3]), 3: ("cycle", [3, 2]), 4: ("cycle", [4, 1, 2, 3]), 9: ("missing", [9]), 5: ("cycle", [5])}
    assert got[2, 8] == ("missing", [8])
    assert preparation.dataset_lineage(c.limit(0)).count() == 0
