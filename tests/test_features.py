"""Features without SQL against plain numpy on the same rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import context, models, stats
from barloom.plans.bar_queries import hourly
from barloom.plans.preparation_queries import _orders

from .conftest import DATA


def smooth(x, alpha):
    out = [x[0]]
    for v in x[1:]:
        out.append(alpha * v + (1 - alpha) * out[-1])
    return np.array(out)


def test_neighbour_features(spark):
    got = context.neighbour_features(hourly(spark, DATA)).toPandas()
    assert len(got) == hourly(spark, DATA).count()
    for _, p in got.groupby("symbol"):
        p = p.sort_values("ts")
        high, low, close = (p[c].to_numpy() for c in ("high", "low", "close"))
        tp = (high + low + close) / 3
        esa = smooth(tp, 2 / 11)
        wave = smooth((tp - esa) / (0.015 * smooth(np.abs(tp - esa), 2 / 11) + 1e-10), 2 / 12)
        np.testing.assert_allclose(p["wavetrend"], wave, rtol=1e-6, atol=1e-6)
        up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        before = np.concatenate([[close[0]], close[:-1]])
        tr = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
        tr[0] = high[0] - low[0]
        a, b, t = (smooth(x, 1 / 14) for x in (plus, minus, tr))
        with np.errstate(divide="ignore", invalid="ignore"):
            dx = np.nan_to_num(100 * np.abs(a / t - b / t) / (a / t + b / t))
        np.testing.assert_allclose(p["adx"], smooth(dx, 1 / 14), rtol=1e-6, atol=1e-6)
        for i in range(19, len(tp), 17):
            w = tp[i - 19 : i + 1]
            assert p["cci"].iloc[i] == pytest.approx((tp[i] - w.mean()) / (0.015 * np.abs(w - w.mean()).mean()), rel=1e-6, abs=1e-6)


def test_quantiles_of_awkward_columns(spark):
    rows = [("hot", 1.0)] * 5000 + [("hot", float(i)) for i in range(100)] + [("one", 7.0)] + [("none", None)] * 3
    long = spark.createDataFrame(rows, "column string, x double")
    got = {r.column: (r.low, r.mid, r.high) for r in stats.quantiles(long, {"low": 0.0, "mid": 0.5, "high": 0.999}).collect()}
    hot = np.array([x for c, x in rows if c == "hot"])
    assert got == {"hot": (0.0, 1.0, pytest.approx(np.quantile(hot, 0.999))), "one": (7.0, 7.0, 7.0)}
    assert stats.quantiles(long.filter("false"), {"q": 0.5}).collect() == []
    ranks = {(r.column, r.x): r["rank"] for r in stats.mean_ranks(long).collect()}
    assert ranks["hot", 0.0] == 1 and ranks["hot", 1.0] == 2 + 5000 / 2 and ranks["hot", 2.0] == 5003


def test_forest_reads_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(models, "TREE_ROWS", 100)
    rows = spark.range(2000).coalesce(1).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), (3.0 * (F.col("id") % 7)).alias("y"))
    sizes = models._in_parts(rows).groupBy(F.spark_partition_id()).count()
    assert sizes.agg(F.max("count"), F.sum("count")).first()[:] == (100, 2000)
    got = {r["column"]: r.importance for r in models.forest_importance(rows, ("a", "b"), "y").collect()}
    assert got["a"] > 0.9 and sum(got.values()) == pytest.approx(1)
