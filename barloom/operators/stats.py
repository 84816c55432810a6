"""Descriptive and multivariate statistics of numeric columns.

Frames are long where columns are compared: (column, x) rows come from one unpivot, so the number of columns doesn't
change the plan. Exact quantiles and ranks order distinct values in ranges that a sketch cuts, never a column in one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import clean, ratio


def unpivot(df: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, column, x), NaN and infinities as null."""
    return df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), clean(c).alias("x")) for c in columns])).alias("e")).select(*by, "e.column", "e.x")


#: Halvings that find a value's range: the distinct values of a column are ordered in 2 ** HALVINGS ranges.
HALVINGS = 8


def _placed(long: DataFrame, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct values with their counts and range, and by range the rows before it (``start``), in it, and of the column.

    ``counted`` values are distinct already and come with their counts ``n``.

    Cuts are approximate quantiles of the distinct values, so a frequent value is one row and ranges hold about equally many;
    where they fall changes no result. What is broadcast has one row, or a row for each range, for each column.
    """
    counts = long if counted else long.filter("x is not null").groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    ranges = 2**HALVINGS
    cuts = counts.groupBy("column").agg(F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 10_000).alias("cuts"))
    steps = F.array(*[F.lit(2**i) for i in reversed(range(HALVINGS))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("cuts", at + step - 1) < F.col("x"), step).otherwise(0))
    placed = counts.join(F.broadcast(cuts), "column").withColumn("range", below).drop("cuts")
    sizes = placed.groupBy("column", "range").agg(F.sum("n").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("column").orderBy("range"))
    return placed, sizes.select("column", "range", "size", (upto - F.col("size")).alias("start"), F.sum("size").over(Window.partitionBy("column")).alias("total"))


def quantiles(long: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """By column exact quantiles, linear between neighbours; a column without values has no row. Only ranges that hold one are ordered. A08"""
    placed, starts = _placed(long)
    ask = lambda name, q, side: F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), side_of[side](q * (F.col("total") - 1)).cast("long").alias("rank"))
    side_of = {"low": F.floor, "high": F.ceil}
    asked = starts.withColumn("ask", F.explode(F.array(*[ask(name, q, side) for name, q in wanted.items() for side in side_of])))
    asked = asked.filter((F.col("ask.rank") >= F.col("start")) & (F.col("ask.rank") < F.col("start") + F.col("size")))
    asked = asked.groupBy("column", "range").agg(F.first("start").alias("start"), F.first("total").alias("total"), F.collect_list("ask").alias("asks"))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("column", "range").orderBy("x"))
    held = placed.join(F.broadcast(asked), ["column", "range"]).withColumn("upto", upto).withColumn("ask", F.explode("asks"))
    held = held.filter((F.col("ask.rank") < F.col("upto")) & (F.col("ask.rank") >= F.col("upto") - F.col("n")))
    value = lambda name, side: F.max(F.when((F.col("ask.name") == name) & (F.col("ask.side") == side), F.col("x")))
    share = lambda q: q * (F.first("total") - 1) - F.floor(q * (F.first("total") - 1))
    return held.groupBy("column").agg(*[(value(name, "low") * (1 - share(q)) + value(name, "high") * share(q)).alias(name) for name, q in wanted.items()])


def mean_ranks(long: DataFrame) -> DataFrame:
    """By column each distinct value's rank from 1, equal values sharing their mean rank."""
    placed, starts = _placed(long)
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("column", "range").orderBy("x"))
    return placed.join(F.broadcast(starts.select("column", "range", "start")), ["column", "range"]).select("column", "x", (upto - (F.col("n") - 1) / 2).alias("rank"))


def describe(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """By column: counts, means of several kinds, spread, shape, fences and percentiles. A08, A09"""
    n, mean, sd = F.count("x"), F.avg("x"), F.stddev_samp("x")
    positive = F.when(F.col("x") > 0, F.col("x"))
    long = unpivot(df, columns)
    out = long.groupBy("column").agg(
        n.alias("count"), (100 * (1 - n / F.count(F.lit(1)))).alias("missing_pct"), mean.alias("mean"), sd.alias("std"), F.var_samp("x").alias("variance"),
        F.min("x").alias("min"), F.max("x").alias("max"), ratio(sd, F.abs(mean)).alias("cv"), ratio(sd, F.sqrt(n.cast("double"))).alias("sem"),
        F.exp(F.avg(F.log(positive))).alias("geometric_mean"), (1 / F.avg(1 / positive)).alias("harmonic_mean"), F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis"),
    ).join(quantiles(long, {"median": 0.5, "q1": 0.25, "q3": 0.75} | {f"p{p}": p / 100 for p in (1, 5, 95, 99)}), "column", "left")
    iqr = F.col("q3") - F.col("q1")
    return out.withColumns({"range": F.col("max") - F.col("min"), "iqr": iqr, "lower_fence": F.col("q1") - 1.5 * iqr, "upper_fence": F.col("q3") + 1.5 * iqr})


def mode(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """By column the most frequent value, the least of equals, and how often it occurs. A08"""
    counts = unpivot(df, columns).filter("x is not null").groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(F.max(F.struct("n", (-F.col("x")).alias("least"))).alias("m")).select("column", (-F.col("m.least")).alias("mode"), F.col("m.n").alias("times"))


def mad(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """By column the median absolute deviation from the median; a second pass against one row per column. A08"""
    long = unpivot(df, columns)
    centre = quantiles(long, {"m": 0.5})
    return quantiles(long.join(F.broadcast(centre), "column").select("column", F.abs(F.col("x") - F.col("m")).alias("x")), {"mad": 0.5})


def trimmed_mean(df: DataFrame, columns: tuple[str, ...], share: float = 0.1) -> DataFrame:
    """By column the mean without the lowest and highest share (by quantile, bounds kept), and with those set to the bounds. A08"""
    long = unpivot(df, columns)
    j = long.join(F.broadcast(quantiles(long, {"lo": share, "hi": 1 - share})), "column").filter("x is not null")
    return j.groupBy("column").agg(F.avg(F.when(F.col("x").between(F.col("lo"), F.col("hi")), F.col("x"))).alias("trimmed_mean"), F.avg(F.least(F.greatest("x", "lo"), "hi")).alias("winsorised_mean"))


def histogram(df: DataFrame, columns: tuple[str, ...], bins: int = 20) -> DataFrame:
    """By column and bin between minimum and maximum: rows. A10"""
    long = unpivot(df, columns).filter("x is not null")
    edges = long.groupBy("column").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.least(F.floor(F.coalesce(ratio((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1))
    # a row for each column: rows stay where they are, and each task counts its own first
    return long.join(F.broadcast(edges), "column").groupBy("column", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, columns: tuple[str, ...], bins: int = 20) -> DataFrame:
    """By column the entropy of its histogram and the number of its local peaks (over 1 means multimodal). A10"""
    h = histogram(df, columns, bins)
    total = F.sum("n").over(Window.partitionBy("column"))
    w = Window.partitionBy("column").orderBy("bin")
    p = F.col("n") / total
    peak = (F.col("n") > F.coalesce(F.when(F.lag("bin").over(w) == F.col("bin") - 1, F.lag("n").over(w)), F.lit(0))) & (F.col("n") > F.coalesce(F.when(F.lead("bin").over(w) == F.col("bin") + 1, F.lead("n").over(w)), F.lit(0)))
    return h.withColumns({"e": -p * F.log(p), "peak": peak}).groupBy("column").agg(F.sum("e").alias("entropy"), F.count_if("peak").alias("peaks"))


def correlation_pairs(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pearson r, n and t of each pair of columns, over the rows that have both; one pass. A11

    The pairs are columns of one aggregation, which partial sums reduce to a row per task.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b, x: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(x))
    got = df.select(*[clean(c).alias(c) for c in columns]).agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(both(a, b, a), both(a, b, b)).alias("r"), F.count(both(a, b, a)).alias("n")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    long = got.select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")
    return long.withColumn("t", F.col("r") * F.sqrt(ratio((F.col("n") - 2).cast("double"), 1 - F.col("r") * F.col("r"))))


def spearman_pairs(df: DataFrame, columns: tuple[str, ...], key: str) -> DataFrame:
    """Rank correlation of each pair of columns, equal values sharing their mean rank. A11

    Ranks come from counts of distinct values, ordered in ranges; then one join by value for each column.
    """
    ranked = df.select(key, *[clean(c).alias(c) for c in columns]).na.drop()
    ranks = mean_ranks(unpivot(ranked, columns))
    for c in columns:
        ranked = ranked.join(ranks.filter(F.col("column") == c).select(F.col("x").alias(c), F.col("rank").alias(f"_r_{c}")), c)
    return correlation_pairs(ranked.select(*[F.col(f"_r_{c}").alias(c) for c in columns]), columns)


def strong_pairs(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of |r| beyond the threshold, with a label. A12"""
    r = F.abs("r")
    return pairs.filter(r > threshold).withColumn("strength", F.when(r > 0.9, "very strong").when(r > 0.7, "strong").otherwise("moderate"))


def correlation_matrix(df: DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    """Pearson matrix over the rows that have all columns; columns x columns numbers reach the driver."""
    rows = df.select(*[clean(c).alias(c) for c in columns]).na.drop()
    pairs = correlation_pairs(rows, columns).collect()
    out = np.eye(len(columns))
    at = {c: i for i, c in enumerate(columns)}
    for p in pairs:
        out[at[p["a"]], at[p["b"]]] = out[at[p["b"]], at[p["a"]]] = p["r"] if p["r"] is not None else 0.0
    return out


def partial_correlations(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Correlation of each pair given all other columns, from the inverse of the correlation matrix. A14"""
    inv = np.linalg.pinv(correlation_matrix(df, columns))
    rows = [(a, b, float(-inv[i, j] / math.sqrt(inv[i, i] * inv[j, j]))) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def vif(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Variance inflation of each column, and the condition number of the correlation matrix. A15"""
    m = correlation_matrix(df, columns)
    values = np.linalg.eigvalsh(m)
    condition = float(np.sqrt(values[-1] / max(values[0], 1e-300)))
    return df.sparkSession.createDataFrame([(c, float(x), condition) for c, x in zip(columns, np.diag(np.linalg.pinv(m)), strict=True)], "column string, vif double, condition double")


def outliers(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """By column: rows beyond 1.5 and 3 interquartile ranges, 3 deviations, and modified z over 3.5. A16"""
    long = unpivot(df, columns)
    moments = long.groupBy("column").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    j = long.join(F.broadcast(moments.join(quantiles(long, {"q1": 0.25, "q2": 0.5, "q3": 0.75}), "column").join(mad(df, columns), "column")), "column")
    iqr = F.col("q3") - F.col("q1")
    beyond = lambda k: (F.col("x") < F.col("q1") - k * iqr) | (F.col("x") > F.col("q3") + k * iqr)
    return j.groupBy("column").agg(F.count("x").alias("n"), F.count_if(beyond(1.5)).alias("iqr"), F.count_if(beyond(3.0)).alias("tukey"), F.count_if(F.abs(ratio(F.col("x") - F.col("m"), "sd")) > 3).alias("z"), F.count_if(F.abs(ratio(0.6745 * (F.col("x") - F.col("q2")), "mad")) > 3.5).alias("modified_z"))


def mahalanobis(df: DataFrame, columns: tuple[str, ...], key: str) -> DataFrame:
    """Distance of each row with all columns from the mean, in the covariance's metric. A17

    The inverse of a columns x columns matrix is made on the driver; the distances are column arithmetic.
    """
    rows = df.select(key, *[clean(c).alias(c) for c in columns]).na.drop()
    n = len(columns)
    got = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]).first()
    cov = np.array([[got[f"c{i}_{j}"] or 0.0 for j in range(n)] for i in range(n)])
    inv = np.linalg.pinv(cov)
    dev = [F.col(c) - F.lit(got[f"m{i}"]) for i, c in enumerate(columns)]
    square = sum((dev[i] * dev[j] * float(inv[i, j]) for i in range(n) for j in range(n)), F.lit(0.0))
    return rows.select(key, F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance"))


def robust_outliers(df: DataFrame, columns: tuple[str, ...], key: str, threshold: float = 3.5) -> DataFrame:
    """Rows with all columns by their root mean square of modified z-scores, and whether it is over the threshold. A18

    Scores are 0.6745 deviations from the median in median absolute deviations, both of these rows; a column that doesn't
    vary adds nothing. Two numbers a column reach the driver; rows aren't shuffled for their scores.
    """
    rows = df.select(key, *[clean(c).alias(c) for c in columns]).na.drop()
    centre = {r["column"]: r for r in quantiles(unpivot(rows, columns), {"m": 0.5}).join(mad(rows, columns), "column").collect()}
    z = [0.6745 * (F.col(c) - centre[c]["m"]) / centre[c]["mad"] if c in centre and centre[c]["mad"] else F.lit(0.0) for c in columns]
    return rows.select(key, F.sqrt(sum((x * x for x in z), F.lit(0.0)) / len(columns)).alias("score")).withColumn("outlier", F.col("score") > threshold)


def jarque_bera(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """By column the statistic n / 6 (skew² + kurtosis² / 4) and its p-value, which is exp(-jb / 2) at two degrees. A19"""
    g = unpivot(df, columns).groupBy("column").agg(F.count("x").alias("n"), F.skewness("x").alias("s"), F.kurtosis("x").alias("k"))
    jb = F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)
    return g.select("column", "n", jb.alias("jb"), F.exp(-jb / 2).alias("p_value"))


def anova(df: DataFrame, group: str, x: str) -> DataFrame:
    """F statistic of one-way variance analysis, from one row of sums per group. A22"""
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"))
    between = F.col("squares") - F.col("n") * F.col("grand") * F.col("grand")
    return t.select("n", "k", ((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f_statistic"))


def cohens_d(df: DataFrame, group: str, x: str) -> DataFrame:
    """Effect size of each pair of groups, deviations pooled with equal weight. A24"""
    g = df.groupBy(group).agg(F.avg(x).alias("m"), F.var_samp(x).alias("v"))
    a, b = g.select(F.col(group).alias("a"), F.col("m").alias("ma"), F.col("v").alias("va")), g.select(F.col(group).alias("b"), F.col("m").alias("mb"), F.col("v").alias("vb"))
    d = ratio(F.col("ma") - F.col("mb"), F.sqrt((F.col("va") + F.col("vb")) / 2))
    label = F.when(F.abs("d") < 0.2, "negligible").when(F.abs("d") < 0.5, "small").when(F.abs("d") < 0.8, "medium").otherwise("large")
    # one row per group on both sides
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", d.alias("d")).withColumn("effect", label)


def mean_interval(df: DataFrame, group: str, x: str, t: float = 1.96) -> DataFrame:
    """Mean and t standard errors on both sides. A23"""
    half = t * F.stddev_samp(x) / F.sqrt(F.count(x).cast("double"))
    return df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.avg(x) - half).alias("low"), (F.avg(x) + half).alias("high"))


def breusch_pagan(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """By group n R² of the squared residuals of y on x, regressed on x. A26"""
    fit = df.groupBy(group).agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    r2 = F.pow(F.col(y) - F.col("a") - F.col("b") * F.col(x), F.lit(2.0))
    return df.join(fit, group).withColumn("e2", r2).groupBy(group).agg((F.regr_r2("e2", x) * F.count(x)).alias("bp"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two columns of few values, in nats. A21"""
    joint = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pa, pb, whole = (F.sum("n").over(Window.partitionBy(*x)) for x in ((a,), (b,), (F.lit(1),)))
    j = joint.withColumns({"na": pa, "nb": pb, "nt": whole})
    return j.agg(F.sum(F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("na") * F.col("nb")))).alias("mi"))


def data_quality(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """By column: rows, missing, distinct values, whether constant or mostly missing. A30"""
    got = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_distinct(c).alias("distinct")).alias(f"q{i}") for i, c in enumerate(columns)])
    long = got.select(F.explode(F.array(*[f"q{i}" for i in range(len(columns))])).alias("q")).select("q.*")
    return long.withColumns({"constant": F.col("distinct") <= 1, "mostly_missing": F.col("missing") > 0.5 * F.col("n")})


def duplicate_rows(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """How many rows repeat another one in all the columns. A30"""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))


def audit(df: DataFrame, required: tuple[str, ...], targets: tuple[str, ...], least_filled: float = 0.95) -> DataFrame:
    """A row per failed check: sparse required columns, targets that aren't binary or don't vary. A32, A33"""
    n = F.count(F.lit(1))
    tests = [F.when(F.count(clean(c)) < least_filled * n, F.concat(F.lit("sparse: "), F.lit(c))) for c in required]
    tests += [F.when(F.count_if(~F.col(t).isin(0, 1)) > 0, F.lit(f"not binary: {t}")) for t in targets]
    tests += [F.when(F.min(t) == F.max(t), F.lit(f"constant: {t}")) for t in targets]
    return df.agg(F.array_compact(F.array(*tests)).alias("failures")).select(F.explode("failures").alias("failure"))


def class_imbalance(df: DataFrame, label: str) -> DataFrame:
    """Rows by label, the ratio of the largest to the smallest class, and how grave it is. A34"""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))
    out = counts.withColumn("ratio", F.max("n").over(w) / F.min("n").over(w))
    return out.withColumn("severity", F.when(F.col("ratio") < 1.5, "balanced").when(F.col("ratio") < 3, "mild").when(F.col("ratio") < 10, "moderate").otherwise("severe"))


def risk_metrics(bars: DataFrame, periods: float = 24 * 365) -> DataFrame:
    """By series: annualised volatility and the largest fall from a running high. A36"""
    from ..functions.series import lag, so_far

    r = F.log(ratio("close", lag("close")))
    df = bars.withColumns({"_r": r, "_top": F.max("close").over(so_far())})
    return df.groupBy("symbol").agg((F.stddev_samp("_r") * F.sqrt(F.lit(periods))).alias("annual_vol"), F.min(ratio(F.col("close") - F.col("_top"), "_top")).alias("max_drawdown"))


def horizon_distribution(bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """By series and horizon: rises, falls, mean and deviation of the moves. A40"""
    from ..functions.series import lead

    moved = bars.select("symbol", *[(lead("close", n) - F.col("close")).alias(f"m{n}") for n in horizons])
    long = moved.select("symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("horizon"), F.col(f"m{n}").alias("move")) for n in horizons])).alias("e")).select("symbol", "e.*")
    return long.groupBy("symbol", "horizon").agg(F.count_if(F.col("move") > 0).alias("bull"), F.count_if(F.col("move") < 0).alias("bear"), F.avg("move").alias("mean_move"), F.stddev_samp("move").alias("std_move"))


def power_transform_hint(df: DataFrame, columns: tuple[str, ...], limit: float = 1.0) -> DataFrame:
    """Skewness (of the population) of each column, and whether a logarithm or Box-Cox transformation is worth a try. A31"""
    skews = F.array(*[F.struct(F.lit(c).alias("column"), F.skewness(c).alias("skew")) for c in columns])
    hint = F.when(F.abs("skew") > limit, "log or Box-Cox")
    return df.agg(skews.alias("all")).select(F.inline("all")).withColumn("hint", hint)
