"""Hypothesis tests with p-values, normality, bootstrap intervals and unit roots over columns of any length.

Samples are long (column, x) rows. Moments come from one aggregation, ranks from ordered ranges of distinct values, tail
probabilities from column expressions; a frequent value is one row with its count everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_tail, f_tail, normal_cdf, normal_two_sided, t_two_sided
from ..functions.folds import numbered, stored
from ..functions.series import KEYS, clean, ratio
from .dependence import pair_dependence
from .stats import _placed, correlation_pairs, mean_ranks, quantiles, spearman_pairs, unpivot


def correlation_tests(df: DataFrame, columns: tuple[str, ...], method: str = "pearson", key: str | None = None) -> DataFrame:
    """Each pair's ``r``, ``n`` and two-sided ``p_value`` by Pearson's, Spearman's (needs ``key``) or Kendall's coefficient. A11

    |r| = 1 has p-value 0; fewer than three rows have none.
    """
    if method == "kendall":
        pairs = tuple((a, b) for i, a in enumerate(columns) for b in columns[i + 1 :])
        return pair_dependence(df, pairs).select("a", "b", F.col("tau_b").alias("r"), "n", F.col("tau_p").alias("p_value"))
    found = correlation_pairs(df, columns) if method == "pearson" else spearman_pairs(df, columns, key)
    p = F.when(F.abs("r") >= 1, 0.0).otherwise(t_two_sided(F.col("t"), F.col("n") - 2))
    return found.select("a", "b", "r", "n", F.when(F.col("n") > 2, p).alias("p_value"))


def significant_pairs(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pairs whose p-value is under ``alpha`` over the number of pairs (Bonferroni), with that bound. A12"""
    bound = alpha / F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return tests.withColumn("corrected_alpha", bound).filter(F.col("p_value") < F.col("corrected_alpha"))


def _moments(long: DataFrame) -> DataFrame:
    return long.filter("x is not null").groupBy("column").agg(F.count("x").cast("double").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))


def _two(moments: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pairs of columns in their given order, with both sides' moments; one row a column meets itself."""
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column"))
    both = F.collect_list(F.struct(place.alias("at"), "column", "n", "m", "v"))
    pair = F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: y["at"] > x["at"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    p = moments.agg(both.alias("all")).select(F.explode(pair).alias("p"))
    return p.select(F.col("p.x.column").alias("a"), F.col("p.y.column").alias("b"), *(F.col(f"p.{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "x"), (2, "y")) for c in "nmv"))


def pairwise_tests(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each pair of columns as two samples: Student's ``t`` (pooled variance) and Mann and Whitney's ``u`` of the first, with p-values. A22

    ``u_p`` is the normal approximation with ties and continuity. A column with fewer than two values is in no pair.
    """
    long = unpivot(df, columns)
    two = _two(_moments(long).filter("n > 1"), columns)
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    t = ratio(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    two = two.withColumn("t", t).withColumn("t_p", t_two_sided(F.col("t"), F.col("n1") + F.col("n2") - 2))

    counts = long.filter("x is not null").groupBy("column", "x").agg(F.count(F.lit(1)).alias("w"))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    member = F.filter(F.array(*[F.struct(F.lit(f"{i}").alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(pairs)]), lambda p: (p["a"] == F.col("column")) | (p["b"] == F.col("column")))
    sides = counts.select("column", "x", "w", F.explode(member).alias("p"))
    merged = sides.groupBy(F.col("p.pair").alias("pair"), F.col("p.a").alias("a"), F.col("p.b").alias("b"), "x").agg(F.sum(F.when(F.col("column") == F.col("p.a"), F.col("w")).otherwise(0)).alias("wa"), F.sum("w").alias("w"))
    merged = stored(merged, "merged")
    ranks = _weighted_ranks(merged.select(F.col("pair").alias("column"), "x", F.col("w").alias("n")))
    ranked = merged.join(ranks.withColumnRenamed("column", "pair"), ["pair", "x"])
    w = F.col("w").cast("double")  # the cube of a count over 2 million is no long
    cubes = F.sum(w * w * w - w)
    sums = ranked.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("rank")).alias("r1"), cubes.alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = ratio(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, sd)
    return two.join(sums, ["a", "b"]).select("a", "b", n1.cast("long").alias("n_a"), n2.cast("long").alias("n_b"), "t", "t_p", u.alias("u"), F.when(z > 0, normal_two_sided(z)).when(z <= 0, 1.0).alias("u_p"))


def _weighted_ranks(counts: DataFrame) -> DataFrame:
    """mean_ranks() of distinct values that come with their counts ``n``."""
    placed, starts = _placed(counts, counted=True)
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("column", "range").orderBy("x"))
    return placed.join(F.broadcast(starts.select("column", "range", "start")), ["column", "range"]).select("column", "x", (upto - (F.col("n") - 1) / 2).alias("rank"))


def _analysis(moments: DataFrame) -> tuple[Column, DataFrame]:
    """F statistic of one-way variance analysis of samples given by moments, and the frame of its sums."""
    s = moments.agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within"), F.collect_list(F.struct("n", "m", "v")).alias("all"))
    between = F.aggregate("all", F.lit(0.0), lambda acc, g: acc + g["n"] * (g["m"] - F.col("grand")) * (g["m"] - F.col("grand")))
    return ratio(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))), s


def group_tests(long: DataFrame) -> DataFrame:
    """Samples (column, x) compared all at once: ``anova``, ``levene`` (about medians), ``bartlett``, ``kruskal`` (``test``, ``statistic``, ``p_value``). A22

    Nulls are left out. With fewer than two samples statistics are null.
    """
    long = stored(long.filter("x is not null").groupBy("column", "x").agg(F.count(F.lit(1)).alias("w")), "samples")
    rows = lambda values: values.groupBy("column").agg(F.sum("w").cast("double").alias("n"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("q"))
    centre = rows(long)

    def moments(values: DataFrame, means: DataFrame) -> DataFrame:
        off = values.join(F.broadcast(means.select("column", "n", "m")), "column")
        return off.groupBy("column").agg(F.first("n").alias("n"), F.first("m").alias("m"), (F.sum(F.col("w") * (F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))) / (F.first("n") - 1)).alias("v"))

    plain = moments(long, centre)
    tested = lambda name, x, p, s: s.select(F.lit(name).alias("test"), x.alias("statistic"), p.alias("p_value"))
    f, s = _analysis(plain)
    s = s.withColumn("f", f)
    anova = tested("anova", F.col("f"), f_tail(F.col("f"), F.col("k") - 1, F.col("n") - F.col("k")), s)
    far = long.join(F.broadcast(_weighted_quantile(long)), "column").select("column", F.abs(F.col("x") - F.col("median")).alias("x"), "w")
    f, s = _analysis(moments(far, rows(far)))
    s = s.withColumn("f", f)
    levene = tested("levene", F.col("f"), f_tail(F.col("f"), F.col("k") - 1, F.col("n") - F.col("k")), s)
    free = plain.filter("n > 1").select((F.col("n") - 1).alias("d"), "v")
    b = free.agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("d").alias("d"), (F.sum(F.col("d") * F.col("v")) / F.sum("d")).alias("v"), F.sum(F.col("d") * F.log("v")).alias("logs"), F.sum(1 / F.col("d")).alias("inverse"))
    bart = ratio(F.col("d") * F.log("v") - F.col("logs"), 1 + (F.col("inverse") - 1 / F.col("d")) / (3 * (F.col("k") - 1)))
    bartlett = tested("bartlett", bart, chi2_tail(bart, F.col("k") - 1), b.filter("k > 1"))
    pooled = long.groupBy("x").agg(F.sum("w").alias("n")).select(F.lit("all").alias("column"), "x", "n")
    ranks = _weighted_ranks(pooled).drop("column")
    w = F.col("n").cast("double")  # the cube of a count over 2 million is no long
    ties = pooled.agg(F.sum(w * w * w - w).alias("ties"))
    r = long.join(ranks, "x").groupBy("column").agg(F.sum("w").cast("double").alias("n"), F.sum(F.col("w") * F.col("rank")).alias("r"))
    k = r.agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("squares"), F.lit(1).alias("one")).join(ties.withColumn("one", F.lit(1)), "one")
    n = F.col("n")
    h = ratio(12 / (n * (n + 1)) * F.col("squares") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    kruskal = tested("kruskal", h, chi2_tail(h, F.col("k") - 1), k.filter("k > 1"))
    return anova.unionByName(levene).unionByName(bartlett).unionByName(kruskal)


def _weighted_quantile(counts: DataFrame) -> DataFrame:
    """Exact medians of (column, x, w)."""
    placed, starts = _placed(counts.select("column", "x", F.col("w").alias("n")), counted=True)
    middle = starts.filter((F.col("start") <= F.ceil((F.col("total") - 1) / 2)) & (F.floor((F.col("total") - 1) / 2) < F.col("start") + F.col("size")))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("column", "range").orderBy("x"))
    held = placed.join(F.broadcast(middle), ["column", "range"]).withColumn("upto", upto)
    at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("x")))
    return held.groupBy("column").agg(((at(F.floor((F.col("total") - 1) / 2)) + at(F.ceil((F.col("total") - 1) / 2))) / 2).alias("median"))


def normality(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """By column: Jarque-Bera ``jb``, D'Agostino and Pearson's ``k2``, Kolmogorov and Smirnov's ``d`` against the fitted normal, Anderson and Darling's ``a2``; p-values of the first three. A19

    The p-value of ``d`` is Kolmogorov's limit. Statistics of a column that doesn't vary, or of fewer than 8 values, are null.
    """
    long = unpivot(df, columns)
    g = long.groupBy("column").agg(F.count("x").cast("double").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.skewness("x").alias("s"), F.kurtosis("x").alias("k"))
    g = g.withColumns({c: F.when((F.col("n") >= 8) & (F.col("sd") > 0), F.col(c)) for c in ("s", "k", "sd")})
    n, s, b2 = F.col("n"), F.col("s"), F.col("k") + 3
    # fixed values: the moments that D'Agostino (1970) and Anscombe and Glynn (1983) give
    y = s * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    alpha = F.sqrt(2 / (w2 - 1))
    z1 = 1 / F.sqrt(F.log(w2) / 2) * F.log(y / alpha + F.sqrt(y * y / (alpha * alpha) + 1))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    skew = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew * (2 / skew + F.sqrt(1 + 4 / (skew * skew)))
    root = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(root) * F.pow(F.abs(root), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    jb = n / 6 * (s * s + F.col("k") * F.col("k") / 4)
    g = g.withColumns({"jb": jb, "k2": z1 * z1 + z2 * z2})
    ranks = mean_ranks(long).join(F.broadcast(g.select("column", "n", "m", "sd")), "column")
    counts = long.filter("x is not null").groupBy("column", "x").agg(F.count(F.lit(1)).alias("w"))
    z = (F.col("x") - F.col("m")) / F.col("sd")
    ranks = ranks.join(counts, ["column", "x"]).filter("sd is not null").withColumns({"low": normal_cdf(z), "high": normal_cdf(-z), "upto": F.col("rank") + (F.col("w") - 1) / 2})
    before = F.col("upto") - F.col("w")
    rest = lambda v: (F.col("n") - v) * (F.col("n") - v)
    parts = (F.col("upto") * F.col("upto") - before * before) * F.log("low") + (rest(before) - rest(F.col("upto"))) * F.log("high")
    ordered = ranks.groupBy("column").agg(F.max(F.greatest(F.col("upto") / F.col("n") - F.col("low"), F.col("low") - before / F.col("n"))).alias("d"), (-F.first("n") - F.sum(parts) / F.first("n")).alias("a2"))
    root_n = F.sqrt("n") * F.col("d")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * root_n * root_n))
    out = g.join(ordered, "column", "left")
    return out.select("column", n.cast("long").alias("n"), "jb", F.exp(-F.col("jb") / 2).alias("jb_p"), "k2", F.exp(-F.col("k2") / 2).alias("k2_p"), "d", F.when(root_n < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))).alias("d_p"), "a2")


def _poisson(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of keys (rows) in replicates (columns), from 64-bit digests of both."""
    x = keys.view(np.uint64)[:, None] + (replicates.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(steps, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(np.int32)


#: Rows whose weights a task has in memory at once.
_ROWS_AT_ONCE = 2048


def bootstrap_medians(df: DataFrame, columns: tuple[str, ...], key: str, replicates: int = 1000) -> DataFrame:
    """(column, replicate, median) of Poisson resamples: each row counts in each as often as the digest of its key and the replicate says.

    One pass counts rows by range of values and replicate; then only the ranges that hold a median are ordered, and only for
    the replicates whose median they hold. Weights come of keys, so a rerun gives the same medians. A replicate that draws
    no row has none. Keys should be unique: rows that share one are drawn together.
    """
    long = df.select(F.xxhash64(key).alias("k"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), clean(c).alias("x")) for c in columns])).alias("e")).select("k", "e.*").filter("x is not null")
    cuts = long.select("column", "x").distinct().groupBy("column").agg(F.percentile_approx("x", [i / 256 for i in range(1, 256)], 10_000).alias("cuts"))
    steps = F.array(*[F.lit(2**i) for i in reversed(range(8))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("cuts", at + step - 1) < F.col("x"), step).otherwise(0))
    placed = stored(long.join(F.broadcast(cuts), "column").select("column", "x", "k", below.alias("range")), "ranges")
    every = np.arange(replicates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            names, at, keys = np.array(b.column("column").to_pylist(), object), b.column("range").to_numpy(), b.column("k").to_numpy()
            for i in range(0, len(keys), _ROWS_AT_ONCE):
                part = slice(i, i + _ROWS_AT_ONCE)
                w = _poisson(keys[part], every)
                for name in set(names[part]):
                    mine = names[part] == name
                    order = np.argsort(at[part][mine], kind="stable")
                    r = at[part][mine][order]
                    starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                    for k, row in zip(r[starts].tolist(), np.add.reduceat(w[mine][order], starts, axis=0, dtype=np.int64), strict=True):
                        if (name, k) in sums:
                            sums[name, k] += row
                        else:
                            sums[name, k] = row.copy()
        if sums:
            yield pa.RecordBatch.from_pydict({"column": [c for c, _ in sums], "range": pa.array([r for _, r in sums], pa.int32()), "drawn": pa.array(list(sums.values()), pa.list_(pa.int64()))})

    def add(p: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x) for x in p["drawn"].to_pylist()], axis=0)
        return pa.table({"column": p["column"][:1], "range": p["range"][:1], "drawn": pa.array([total.tolist()], pa.list_(pa.int64()))})

    drawn = placed.select("column", "range", "k").mapInArrow(count, "column string, range int, drawn array<long>").groupBy("column", "range").applyInArrow(add, "column string, range int, drawn array<long>")
    by = drawn.select("column", "range", F.posexplode("drawn").alias("replicate", "n"))
    upto = F.sum("n").over(Window.partitionBy("column", "replicate").orderBy("range"))
    total = F.sum("n").over(Window.partitionBy("column", "replicate"))
    by = by.withColumns({"start": upto - F.col("n"), "total": total}).filter("total > 0")
    asks = F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))
    asks = F.filter(asks, lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
    wanted = by.select("column", "range", "replicate", F.transform(asks, lambda r: (r - F.col("start")).cast("long")).alias("ranks")).filter(F.size("ranks") > 0)
    wanted = stored(wanted.groupBy("column", "range").agg(F.sort_array(F.collect_list(F.struct("replicate", "ranks"))).alias("asks")), "wanted")

    def order(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.sort_by([("x", "ascending"), ("k", "ascending")])
        asked = right["asks"][0].as_py() if len(right) else []
        x, keys = rows["x"].to_numpy(), rows["k"].to_numpy()
        values, names = [], []
        for i in range(0, len(asked), 64):
            some = asked[i : i + 64]
            upto = np.cumsum(_poisson(keys, np.array([a["replicate"] for a in some])), axis=0)
            for j, a in enumerate(some):
                for rank in a["ranks"]:
                    values.append(float(x[np.searchsorted(upto[:, j], rank, side="right")]))
                    names.append(a["replicate"])
        return pa.table({"column": pa.array([left["column"][0].as_py()] * len(names), pa.string()), "replicate": pa.array(names, pa.int32()), "x": pa.array(values, pa.float64())})

    held = placed.join(F.broadcast(wanted.select("column", "range")), ["column", "range"], "left_semi")
    found = held.groupBy("column", "range").cogroup(wanted.groupBy("column", "range")).applyInArrow(order, "column string, replicate int, x double")
    # one value stands for both ranks where they are the same
    return found.groupBy("column", "replicate").agg(F.avg("x").alias("median"))


def median_interval(df: DataFrame, columns: tuple[str, ...], key: str, level: float = 0.95, replicates: int = 1000) -> DataFrame:
    """By column the bootstrap interval of the median: quantiles of ``bootstrap_medians``. A23"""
    medians = bootstrap_medians(df, columns, key, replicates).select("column", F.col("median").alias("x"))
    return quantiles(medians, {"low": (1 - level) / 2, "high": (1 + level) / 2})


#: MacKinnon's (1994) response surface for a constant and one series: bounds, and coefficients below and above -1.61.
SURFACE = {"low": -18.83, "high": 2.74, "turn": -1.61, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)}


def _grams(lagged: DataFrame, width: int, keep: Column) -> DataFrame:
    """By series n and the sums of products of the columns y, 1, level and ``width`` lagged changes, over the rows that ``keep`` allows.

    A task adds its rows up before anything is shuffled; columns beyond a series' own lags are 0.
    """
    side = width + 3
    rows = lagged.filter(keep).select(*KEYS, "lags", F.col("v").alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            v = np.array(b.column("v").to_pylist(), float).reshape(len(names), side)
            index = {n: i for i, n in enumerate(dict.fromkeys(names))}
            which = np.array([index[n] for n in names])
            for n, i in index.items():
                own = v[which == i]
                total[n] = total.get(n, 0) + own.T @ own
        if total:
            yield pa.RecordBatch.from_pydict({"symbol": [n[0] for n in total], "tf": [n[1] for n in total], "gram": pa.array([g.ravel().tolist() for g in total.values()], pa.list_(pa.float64()))})

    def add(p: pa.Table) -> pa.Table:
        return pa.table({"symbol": p["symbol"][:1], "tf": p["tf"][:1], "gram": pa.array([np.sum(p["gram"].to_pylist(), axis=0).tolist()], pa.list_(pa.float64()))})

    return rows.mapInArrow(sums, "symbol string, tf string, gram array<double>").groupBy(*KEYS).applyInArrow(add, "symbol string, tf string, gram array<double>")


def _fit(gram: np.ndarray, lags: int) -> tuple[float, float, float]:
    """Level coefficient, its t, and Akaike's criterion of the regression with so many lagged changes, from the leading part of the sums."""
    g = gram[: lags + 3, : lags + 3]
    n, xx, xy = g[1, 1], g[1:, 1:], g[1:, 0]
    inverse = np.linalg.pinv(xx, hermitian=True)
    beta = inverse @ xy
    rest = max(g[0, 0] - beta @ xy, 0.0)
    free = n - lags - 2
    if free <= 0 or rest <= 0 or inverse[1, 1] <= 0:
        return float(beta[1]), math.nan, math.inf
    criterion = n * (math.log(2 * math.pi * rest / n) + 1) + 2 * (lags + 2)
    return float(beta[1]), float(beta[1] / math.sqrt(rest / free * inverse[1, 1])), criterion


def unit_root_selected(df: DataFrame, value: str = "close", most: int | None = None) -> DataFrame:
    """By series the augmented Dickey-Fuller test with a constant, as many lagged changes as Akaike's criterion takes, and MacKinnon's p-value. A28

    All numbers of lags up to 12 (n / 100) ** 0.25 (or ``most``) are compared on the same rows from one matrix of sums; the
    chosen one is fitted again on all its rows. Gives ``n``, ``lags``, ``gamma``, ``t``, ``p_value``, ``stationary``. Series that
    are too short or don't vary have nulls. Nulls are left out before all else.
    """
    rows = numbered(df.select(*KEYS, "ts", clean(value).alias("x")).filter("x is not null"), "x")
    sizes = rows.groupBy(*KEYS).agg((F.max("_i") + 1).alias("n"))
    bound = F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))).cast("int") if most is None else F.lit(most), F.floor(F.col("n") / 2).cast("int") - 2)
    sizes = stored(sizes.withColumn("lags", F.greatest(bound, F.lit(0))), "sizes")
    width = sizes.agg(F.max("lags")).first()[0] or 0
    last = Window.partitionBy(*KEYS).orderBy("_i").rowsBetween(-(width + 1), 0)
    seen = F.reverse(F.collect_list("x").over(last))  # latest first
    changes = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda j: F.when(j < F.size("s") - 1, F.get("s", j) - F.get("s", j + 1)).otherwise(0.0)) if width else F.array().cast("array<double>")
    lagged = rows.withColumn("s", seen).filter("size(s) > 1").join(F.broadcast(sizes), [*KEYS])
    own = F.transform(changes, lambda x, j: F.when(j < F.col("lags"), x).otherwise(0.0))
    lagged = stored(lagged.select(*KEYS, "_i", "lags", F.concat(F.array(F.col("s")[0] - F.col("s")[1], F.lit(1.0), F.col("s")[1]), own).alias("v")), "lagged")

    def choose(p: pa.Table) -> pa.Table:
        side = width + 3
        gram = np.array(p["gram"][0].as_py()).reshape(side, side)
        most_lags = p["lags"][0].as_py()
        best = min(range(most_lags + 1), key=lambda k: _fit(gram, k)[2])
        return pa.table({"symbol": p["symbol"], "tf": p["tf"], "n": p["n"], "lags": pa.array([best], pa.int32())})

    chosen = stored(_grams(lagged, width, F.col("_i") > F.col("lags")).join(sizes, [*KEYS]).groupBy(*KEYS).applyInArrow(choose, "symbol string, tf string, n long, lags int"), "chosen")

    def fit(p: pa.Table) -> pa.Table:
        side, lags = width + 3, p["lags"][0].as_py()
        gram = np.array(p["gram"][0].as_py()).reshape(side, side)
        gamma, t, _ = _fit(gram, lags)
        told = None if math.isnan(t) else t
        return pa.table({"symbol": p["symbol"], "tf": p["tf"], "n": pa.array([int(gram[1, 1])], pa.int64()), "lags": p["lags"], "gamma": pa.array([gamma if told is not None else None], pa.float64()), "t": pa.array([told], pa.float64())})

    again = lagged.drop("lags").join(F.broadcast(chosen.select(*KEYS, "lags")), [*KEYS])
    fitted = _grams(again, width, F.col("_i") > F.col("lags")).join(chosen.drop("n"), [*KEYS]).groupBy(*KEYS).applyInArrow(fit, "symbol string, tf string, n long, lags int, gamma double, t double")
    t = F.col("t")
    polynomial = lambda c: sum((F.lit(x) * F.pow(t, F.lit(float(i))) for i, x in enumerate(c)), F.lit(0.0))
    p = F.when(t < SURFACE["low"], 0.0).when(t > SURFACE["high"], 1.0).when(t <= SURFACE["turn"], normal_cdf(polynomial(SURFACE["small"]))).otherwise(normal_cdf(polynomial(SURFACE["large"])))
    return fitted.withColumn("p_value", F.when(t.isNotNull(), p)).withColumn("stationary", F.col("p_value") < 0.05)
