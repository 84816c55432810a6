"""Tests, bootstrap, dependence and unit roots against plain numpy over small tables with ties, nulls and frequent values."""

from __future__ import annotations

import math
import random
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import distributions as dist
from barloom.operators import dependence, inference, stats

COLUMNS = ("u", "v", "k", "w")


@pytest.fixture(scope="module")
def data():
    rng, rnd = np.random.default_rng(5), random.Random(5)
    n = 600
    u = rng.normal(size=n)
    cols = {"u": u, "v": rng.integers(0, 5, n).astype(float), "k": np.where(rng.random(n) < 0.4, 1.0, rng.normal(size=n) * 3), "w": u**2 + 0.1 * rng.normal(size=n)}
    return [(i, *[None if rnd.random() < 0.05 else float(cols[c][i]) for c in COLUMNS]) for i in range(n)]


@pytest.fixture(scope="module")
def df(spark, data):
    frame = spark.createDataFrame(data, "id long, u double, v double, k double, w double").repartition(3).persist()
    yield frame
    frame.unpersist()


def column(data, c):
    return np.array([r[1 + COLUMNS.index(c)] for r in data if r[1 + COLUMNS.index(c)] is not None])


def both(data, a, b):
    rows = [(r[1 + COLUMNS.index(a)], r[1 + COLUMNS.index(b)]) for r in data]
    return tuple(np.array(x) for x in zip(*[r for r in rows if None not in r], strict=True))


def mean_rank(x):
    order, ranks = np.sort(x), None
    ranks = (np.searchsorted(order, x, side="left") + np.searchsorted(order, x, side="right") + 1) / 2
    return ranks


# --- tail probabilities -----------------------------------------------------------------------------------------------


def test_tails(spark):
    z = spark.createDataFrame([(x,) for x in (0.0, 0.3, 1.96, 6.0, 12.0)] + [(None,), (math.nan,)], "z double")
    for r in z.select("z", dist.normal_two_sided(F.col("z")).alias("p"), dist.normal_cdf(-F.col("z")).alias("c")).collect():
        if r.z is None or math.isnan(r.z):
            assert r.p is None
        else:
            assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-10) and r.c == pytest.approx(r.p / 2, rel=1e-10)
    t = spark.createDataFrame([(x, n) for x in (0.1, 1.0, 7.0) for n in (1, 2)], "t double, n int")
    for r in t.select("t", "n", dist.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect():
        assert r.p == pytest.approx(1 - 2 / math.pi * math.atan(r.t) if r.n == 1 else 1 - r.t / math.sqrt(2 + r.t**2), rel=1e-10)
    near = spark.range(1).select(*[dist.t_two_sided(F.lit(2.5), F.lit(n)).alias(f"n{n}") for n in (9_999, 10_000, 10_001, 10_002)]).first()
    assert near[2] - near[1] == pytest.approx(near[1] - near[0], rel=1e-3)  # both forms meet
    f = spark.createDataFrame([(x, n) for x in (0.5, 20.0) for n in (5, 100, 60_000)], "f double, n int")
    for r in f.select("f", "n", dist.f_tail(F.col("f"), F.lit(2), F.col("n")).alias("p")).collect():
        assert r.p == pytest.approx((1 + 2 * r.f / r.n) ** (-r.n / 2), rel=1e-8)
    c = spark.createDataFrame([(x,) for x in (0.5, 3.0, 40.0)], "x double")
    for r in c.select("x", dist.chi2_tail(F.col("x"), 4).alias("p")).collect():
        assert r.p == pytest.approx(math.exp(-r.x / 2) * (1 + r.x / 2), rel=1e-10)


def test_histogram_shuffles_counts_only(spark, df):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        h = stats.histogram(df, COLUMNS)
        assert sum(r.n for r in h.collect()) == df.select([F.count(c).alias(c) for c in COLUMNS]).select(sum(F.col(c) for c in COLUMNS)).first()[0]
        plan = h._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


# --- dependence -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("halvings", [2, 8])
def test_pair_dependence(df, data, monkeypatch, halvings):
    monkeypatch.setattr(dependence, "HALVINGS", halvings)
    pairs = (("u", "w"), ("u", "v"), ("v", "k"), ("u", "u"))
    got = {(r.a, r.b): r for r in dependence.pair_dependence(df, pairs).collect()}
    assert len(got) == 4
    for a, b in pairs:
        x, y = both(data, a, b)
        dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
        cx, cy = (d - d.mean(0) - d.mean(1)[:, None] + d.mean() for d in (dx, dy))
        assert got[a, b].n == len(x)
        assert got[a, b].dcor == pytest.approx(math.sqrt((cx * cy).mean() / math.sqrt((cx * cx).mean() * (cy * cy).mean())), abs=1e-9)
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        assert got[a, b].tau_b == pytest.approx((sx * sy).sum() / math.sqrt((sx != 0).sum() * (sy != 0).sum()), abs=1e-12)


def test_ranges_hold_equal_shares(spark):
    """Whatever the mean: no range but that of one value holds much more than its share of the rows."""
    rows = spark.range(4096).select((F.col("id") + 10_000.0).alias("p"), ((F.col("id") * 37) % 4096 - 9_000.0).alias("q"))
    placed, _ = dependence._placed(rows, (("p", "q"),))
    for r, x in (("rx", "x"), ("ry", "y")):
        sizes = placed.groupBy(r).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(x).alias("values")).filter("values > 1")
        assert sizes.agg(F.max("n")).first()[0] <= 3 * 4096 / 2**dependence.HALVINGS


def test_dominated_takes_a_column_at_a_time():
    """The same sums as the plain count, with less in memory than four columns of temporary arrays."""
    rng = np.random.default_rng(3)
    rank, values = rng.integers(0, 40, 300), rng.normal(size=(300, 4))
    plain = np.array([values[:i][rank[:i] < rank[i]].sum(0) for i in range(300)])
    assert np.allclose(dependence.dominated(rank, values), plain)
    rank, values = rng.permutation(1 << 16), np.ones((1 << 16, 4))
    tracemalloc.start()
    dependence.dominated(rank, values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * values.nbytes  # 6.4 with four columns at once


def test_dependence_of_constants(spark):
    made = spark.createDataFrame([(1.0, float(i), None) for i in range(5)], "c double, x double, z double")
    r = dependence.pair_dependence(made, (("c", "x"), ("x", "z"))).collect()
    assert [(x.a, x.b, x.dcor, x.tau_b, x.tau_p) for x in r] == [("c", "x", 0.0, None, None)]
    assert dependence.pair_dependence(made.limit(0), (("c", "x"),)).count() == 0


def test_significant_pairs(df, data):
    for method in ("pearson", "kendall"):
        tests = inference.correlation_tests(df, COLUMNS, method)
        every = tests.collect()
        assert len(every) == 6
        kept = {(r.a, r.b) for r in inference.significant_pairs(tests, 0.2).collect()}
        assert kept == {(r.a, r.b) for r in every if r.p_value < 0.2 / 6}


# --- tests of samples -------------------------------------------------------------------------------------------------


def test_pairwise(df, data):
    got = {(r.a, r.b): r for r in inference.pairwise_tests(df, ("u", "k", "v")).collect()}
    assert set(got) == {("u", "k"), ("u", "v"), ("k", "v")}
    for (a, b), r in got.items():
        x, y = column(data, a), column(data, b)
        n, m = len(x), len(y)
        pooled = ((n - 1) * x.var(ddof=1) + (m - 1) * y.var(ddof=1)) / (n + m - 2)
        assert (r.n_a, r.n_b) == (n, m) and r.t == pytest.approx((x.mean() - y.mean()) / math.sqrt(pooled * (1 / n + 1 / m)))
        u = sum(float((v > y).sum() + 0.5 * (v == y).sum()) for v in x)
        assert r.u == pytest.approx(u)
        ties = sum(c**3 - c for c in np.unique(np.concatenate([x, y]), return_counts=True)[1].tolist())
        z = (max(u, n * m - u) - n * m / 2 - 0.5) / math.sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1))))
        assert r.u_p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-8)


def test_counts_whose_cubes_are_no_longs(spark):
    n = 1_100_000
    frame = spark.range(n).select(F.lit(1.0).alias("p"), F.when(F.col("id") < 10, 2.0).otherwise(1.0).alias("q"))
    got = inference.pairwise_tests(frame, ("p", "q")).first()
    assert got.u == pytest.approx(n * (n - 10) / 2, rel=1e-12) and 0 < got.u_p < 0.01
    by_test = {r.test: r.statistic for r in inference.group_tests(stats.unpivot(frame, ("p", "q"))).collect()}
    ones, total = 2 * n - 10, 2 * n
    r_p, r_q = n * (ones + 1) / 2, (n - 10) * (ones + 1) / 2 + 10 * (ones + 5.5)
    h = (12 / (total * (total + 1)) * (r_p**2 + r_q**2) / n - 3 * (total + 1)) / (1 - (ones**3 - ones + 990) / (total**3 - total))
    assert by_test["kruskal"] == pytest.approx(h, abs=1e-2)


def test_groups(df, data):
    got = {r.test: r for r in inference.group_tests(stats.unpivot(df, ("u", "k", "v"))).collect()}
    samples = [column(data, c) for c in ("u", "k", "v")]

    def anova(groups):
        n, k, grand = sum(map(len, groups)), len(groups), np.concatenate(groups).mean()
        return sum(len(g) * (g.mean() - grand) ** 2 for g in groups) / (k - 1) / (sum(((g - g.mean()) ** 2).sum() for g in groups) / (n - k))

    assert got["anova"].statistic == pytest.approx(anova(samples)) and got["levene"].statistic == pytest.approx(anova([np.abs(g - np.median(g)) for g in samples]))
    d = np.array([len(g) - 1 for g in samples])
    v = np.array([g.var(ddof=1) for g in samples])
    bartlett = (d.sum() * math.log((d * v).sum() / d.sum()) - (d * np.log(v)).sum()) / (1 + ((1 / d).sum() - 1 / d.sum()) / 6)
    assert got["bartlett"].statistic == pytest.approx(bartlett) and got["bartlett"].p_value == pytest.approx(math.exp(-bartlett / 2), rel=1e-8)
    pooled = np.concatenate(samples)
    ranks, n = mean_rank(pooled), len(pooled)
    parts = np.split(ranks, np.cumsum([len(g) for g in samples])[:-1])
    ties = sum(c**3 - c for c in np.unique(pooled, return_counts=True)[1].tolist())
    h = (12 / (n * (n + 1)) * sum(p.sum() ** 2 / len(p) for p in parts) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    assert got["kruskal"].statistic == pytest.approx(h) and got["kruskal"].p_value == pytest.approx(math.exp(-h / 2), rel=1e-8)
    assert inference.group_tests(stats.unpivot(df.limit(0), ("u", "k"))).filter("statistic is not null").count() == 0


def test_normality(df, data):
    for r in inference.normality(df, ("u", "k")).collect():
        x = np.sort(column(data, r["column"]))
        n = len(x)
        phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
        cdf = np.array([phi(z) for z in (x - x.mean()) / x.std(ddof=1)])
        i = np.arange(1, n + 1)
        assert r.d == pytest.approx(max((np.searchsorted(x, x, side="right") / n - cdf).max(), (cdf - np.searchsorted(x, x, side="left") / n).max()))
        assert r.a2 == pytest.approx(-n - ((2 * i - 1) / n * (np.log(cdf) + np.log(1 - cdf[::-1]))).sum(), rel=1e-7)
        assert 0 <= r.k2_p <= 1 and r.k2_p == pytest.approx(math.exp(-r.k2 / 2))
    # D'Agostino's z is about normal for normal samples, far out for a spike with tails
    told = {r["column"]: r for r in inference.normality(df, ("u", "k")).collect()}
    assert told["u"].k2_p > 0.01 and told["k"].k2_p < 1e-6 and told["u"].d_p > told["k"].d_p


def test_bootstrap(spark, df, data):
    got = {(r["column"], r.replicate): r.median for r in inference.bootstrap_medians(df, ("u", "v"), "id", 60).collect()}
    keys = {r.id: r.k for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    for c in ("u", "v"):
        at = 1 + COLUMNS.index(c)
        kept = [r for r in data if r[at] is not None]
        w = inference._poisson(np.array([keys[r[0]] for r in kept]), np.arange(60))
        assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
        for b in range(60):
            assert got[c, b] == pytest.approx(np.median(np.repeat([r[at] for r in kept], w[:, b])))
    low, high = inference.median_interval(df.repartition(7), ("u",), "id", replicates=60).select("low", "high").first()
    own = np.array([got["u", b] for b in range(60)])
    assert (low, high) == (pytest.approx(np.quantile(own, 0.025)), pytest.approx(np.quantile(own, 0.975)))
    assert inference.bootstrap_medians(df.limit(0), ("u",), "id", 10).count() == 0


# --- unit roots -------------------------------------------------------------------------------------------------------


def test_unit_root(spark):
    rng = np.random.default_rng(2)
    noise = rng.normal(size=300)
    ar = [0.0]
    for e in noise:
        ar.append(0.5 * ar[-1] + 0.3 * (ar[-2] if len(ar) > 1 else 0) + e)
    made = {"walk": np.cumsum(noise), "still": np.array(ar), "short": noise[:4], "flat": np.ones(50)}
    rows = [(s, "1h", datetime(2024, 1, 1) + timedelta(hours=i), float(x)) for s, v in made.items() for i, x in enumerate(v)] + [("walk", "1h", datetime(2025, 1, 1), None)]
    df = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp, close double").repartition(4)
    got = {r.symbol: r for r in inference.unit_root_selected(df).collect()}

    def fit(x, lags, trim):
        d = np.diff(x)
        y = d[trim:]
        columns = [np.ones(len(y)), x[trim:-1], *[d[trim - j : -j] for j in range(1, lags + 1)]]
        m = np.stack([columns[1], columns[0], *columns[2:]], axis=1)
        beta, *_ = np.linalg.lstsq(m, y, rcond=None)
        rest = ((y - m @ beta) ** 2).sum()
        n = len(y)
        se = math.sqrt(rest / (n - m.shape[1]) * np.linalg.inv(m.T @ m)[0, 0])
        return beta[0], beta[0] / se, n * (math.log(2 * math.pi * rest / n) + 1) + 2 * m.shape[1], n

    for s in ("walk", "still"):
        x = made[s]
        most = min(math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 2)
        best = min(range(most + 1), key=lambda k: fit(x, k, most)[2])
        gamma, t, _, n = fit(x, best, best)
        assert (got[s].lags, got[s].n) == (best, n)
        assert got[s].gamma == pytest.approx(gamma, rel=1e-6) and got[s].t == pytest.approx(t, rel=1e-6)
    assert got["still"].stationary and not got["walk"].stationary and got["walk"].p_value > 0.05 > got["still"].p_value
    assert got["flat"].t is None and got["flat"].stationary is None


def test_robust_outliers_with_nulls(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.gauss(0, 1) if i % 10 else rnd.gauss(50, 1), rnd.gauss(0, 1) if i < 40 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    kept = [r for r in rows if r[2] is not None]
    x, y = (np.array([r[k] for r in kept]) for k in (1, 2))
    z = [0.6745 * (v - np.median(v)) / np.median(np.abs(v - np.median(v))) for v in (x, y)]
    want = {r[0]: math.sqrt((a * a + b * b) / 2) for r, a, b in zip(kept, *z, strict=True)}
    got = {r.id: r.score for r in stats.robust_outliers(df, ("x", "y"), "id").collect()}
    assert got == pytest.approx(want)
    assert stats.robust_outliers(df.limit(0), ("x", "y"), "id").count() == 0


def test_adaptive_information(spark):
    rng = np.random.default_rng(3)
    n = 20_000
    x = rng.normal(size=n)
    cols = {"x": x, "half": 0.6 * x + 0.8 * rng.normal(size=n), "close": 0.95 * x + math.sqrt(1 - 0.95**2) * rng.normal(size=n), "none": rng.normal(size=n), "few": rng.integers(0, 5, n).astype(float)}
    cols["near"] = (cols["few"] + rng.integers(0, 2, n)) % 5
    df = spark.createDataFrame([tuple(float(v[i]) if i % 50 or c != "none" else None for c, v in cols.items()) for i in range(n)], ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = {(r.a, r.b): r for r in dependence.adaptive_mutual_information(df, (("x", "half"), ("x", "close"), ("x", "none"), ("few", "near"), ("few", "x"))).collect()}
    assert got["x", "none"].n == n - n // 50 and got["x", "half"].n == n
    want = {("x", "half"): -0.5 * math.log(1 - 0.36), ("x", "close"): -0.5 * math.log(1 - 0.95**2), ("x", "none"): 0.0, ("few", "near"): math.log(5 / 2), ("few", "x"): 0.0}
    for pair, value in want.items():
        assert got[pair].mi == pytest.approx(value, abs=0.03), pair
    assert dependence.adaptive_mutual_information(df.limit(0), (("x", "half"),)).count() == 0
