"""Statistics that fit a model: components, importance, interactions, predictive power, unit roots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import KEYS, clean, diff, lag, ratio, roll, series


def assembled(df: DataFrame, columns: tuple[str, ...], *others: str) -> DataFrame:
    """Rows that have all the columns, as a vector ``features`` beside ``others``."""
    rows = df.select(*others, *[clean(c).alias(c) for c in columns if c not in others]).na.drop()
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)


def principal_components(df: DataFrame, columns: tuple[str, ...], k: int) -> DataFrame:
    """Component, share of variance explained, its running sum, and loadings of the standardised columns. A29"""
    v = assembled(df, columns)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(v).transform(v)
    model = PCA(k=k, inputCol="scaled", outputCol="pc").fit(scaled)
    shares, loadings = model.explainedVariance.toArray(), model.pc.toArray()
    rows = [(i, float(s), float(shares[: i + 1].sum()), [float(x) for x in loadings[:, i]]) for i, s in enumerate(shares)]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double, loadings array<double>")


def component_scores(df: DataFrame, columns: tuple[str, ...], k: int, key: str) -> DataFrame:
    """Each row's scores on the first k components of the standardised columns. A29"""
    v = assembled(df, columns, key)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(v).transform(v)
    return PCA(k=k, inputCol="scaled", outputCol="pc").fit(scaled).transform(scaled).select(key, vector_to_array("pc").alias("scores"))


#: Rows of a part that trees are grown on: in each round a task reads one, at about 200 bytes a row with 20 trees.
TREE_ROWS = 250_000


def _in_parts(df: DataFrame) -> DataFrame:
    """Rows in parts of about ``TREE_ROWS``, as many as there are rows for; few rows stay as they are."""
    parts = -(-df.count() // TREE_ROWS)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism)) if parts > 1 else df


def forest_importance(df: DataFrame, columns: tuple[str, ...], target: str, trees: int = 20, depth: int = 5, seed: int = 7) -> DataFrame:
    """Share of impurity that a random forest takes out by each column. A20"""
    rows = assembled(_in_parts(df.select(*dict.fromkeys((*columns, target)))), columns, target)
    model = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    return df.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(columns, model.featureImportances.toArray(), strict=True)], "column string, importance double")


def linear_importance(df: DataFrame, columns: tuple[str, ...], target: str, l1: float = 0.0) -> DataFrame:
    """Coefficients of a linear model on standardised columns; with ``l1`` a lasso. A20"""
    model = LinearRegression(featuresCol="features", labelCol=target, regParam=l1, elasticNetParam=1.0 if l1 else 0.0, standardization=True).fit(assembled(df, columns, target))
    sd = df.agg(*[F.stddev_samp(clean(c)).alias(c) for c in columns]).first()
    return df.sparkSession.createDataFrame([(c, float(w), float(w * (sd[c] or 0.0))) for c, w in zip(columns, model.coefficients.toArray(), strict=True)], "column string, coefficient double, standardised double")


def f_statistics(df: DataFrame, columns: tuple[str, ...], target: str) -> DataFrame:
    """F of each column's one-variable regression: r² (n - 2) / (1 - r²). A20"""
    got = df.select(clean(target).alias("_y"), *[clean(c).alias(c) for c in columns]).agg(*[F.struct(F.lit(c).alias("column"), F.regr_r2("_y", c).alias("r2"), F.regr_count("_y", c).alias("n")).alias(f"s{i}") for i, c in enumerate(columns)])
    long = got.select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")).select("s.*")
    return long.withColumn("f", ratio(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")))


def interactions(df: DataFrame, columns: tuple[str, ...], target: str, top: int = 10) -> DataFrame:
    """Linear coefficients of the columns' pairwise products, the ``top`` by absolute value. A25, O03"""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    names = [f"{a} x {b}" for a, b in pairs]
    wide = df.withColumns({n: clean(a) * clean(b) for n, (a, b) in zip(names, pairs, strict=True)})
    return linear_importance(wide, (*columns, *names), target).filter(F.col("column").isin(*names)).select("column", "coefficient").orderBy(F.desc(F.abs("coefficient")), "column").limit(top)


def predictive_power(df: DataFrame, columns: tuple[str, ...], target: str, order: str, folds: int = 5) -> DataFrame:
    """r² of a linear model on each of consecutive folds, fitted on the others. A27

    Folds are equal ranges of ``order``'s quantiles, so no global sort numbers the rows.
    """
    cuts = df.approxQuantile(order, [i / folds for i in range(1, folds)], 0.001)
    fold = sum((F.col(order) > c).cast("int") for c in cuts) if cuts else F.lit(0)
    v = assembled(df.withColumn("_fold", fold), columns, target, "_fold").persist()
    rows = []
    for k in range(folds):
        test = v.filter(F.col("_fold") == k)
        model = LinearRegression(featuresCol="features", labelCol=target).fit(v.filter(F.col("_fold") != k))
        rows.append((k, float(model.evaluate(test).r2)))
    v.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, r2 double")


def kpss(df: DataFrame) -> DataFrame:
    """By series the KPSS level statistic without lags: summed squares of partial sums over n² times the variance. A28"""
    mean = F.avg("close").over(Window.partitionBy(*KEYS))
    e = df.withColumn("_e", F.col("close") - mean)
    s = e.withColumn("_s", F.sum("_e").over(series().rowsBetween(Window.unboundedPreceding, 0)))
    n = F.count(F.lit(1))
    return s.groupBy("symbol").agg((F.sum(F.col("_s") * F.col("_s")) / (n * n) / F.avg(F.col("_e") * F.col("_e"))).alias("kpss"))


def bar_outlook(df: DataFrame, n: int = 20) -> DataFrame:
    """By series over the last n bars: rises and falls, volume class, volume slope, speed and its change. A41"""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("ts"))
    tail = df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
    mean = F.avg("volume").over(Window.partitionBy(*KEYS))
    tail = tail.withColumns({"_cls": F.when(F.col("volume") > 1.5 * mean, "high").when(F.col("volume") < 0.5 * mean, "low").otherwise("medium"), "_move": F.col("close") - F.col("open"), "_t": -F.col("_k").cast("double")})
    return tail.groupBy("symbol").agg(F.count_if(F.col("close") >= F.col("open")).alias("bull"), F.count_if(F.col("close") < F.col("open")).alias("bear"), *[F.count_if(F.col("_cls") == c).alias(f"volume_{c}") for c in ("high", "medium", "low")], F.regr_slope("volume", "_t").alias("volume_slope"), F.avg("_move").alias("speed"), (F.avg(F.when(F.col("_k") <= n // 2, F.col("_move"))) - F.avg(F.when(F.col("_k") > n // 2, F.col("_move")))).alias("acceleration"))


def recommend(df: DataFrame) -> DataFrame:
    """By series at its last bar: trend of two means, mean-based strength, risk, a class and stops from the mean change. Z21"""
    up, down = F.greatest(diff("close"), F.lit(0.0)), F.greatest(-diff("close"), F.lit(0.0))
    df = df.withColumns({"_up": up, "_down": down, "_abs": F.abs(diff("close"))})
    df = df.withColumns({"sma_20": roll(F.avg, "close", 20), "sma_50": roll(F.avg, "close", 50), "strength": 100 * ratio(roll(F.avg, "_up", 14), roll(F.avg, "_up", 14) + roll(F.avg, "_down", 14)), "step": roll(F.avg, "_abs", 14)})
    last = df.groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "sma_20", "sma_50", "strength", "step"), "ts").alias("r")).select("symbol", "r.*")
    score = F.coalesce(F.signum(F.col("sma_20") - F.col("sma_50")), F.lit(0.0)) * 0.5 + F.coalesce((F.col("strength") - 50) / 100, F.lit(0.0))
    side = F.when(F.col("score") >= 0, 1.0).otherwise(-1.0)
    return last.withColumn("score", score).withColumns({
        "action": F.when(F.col("score") > 0.6, "strong_buy").when(F.col("score") > 0.2, "buy").when(F.col("score") < -0.6, "strong_sell").when(F.col("score") < -0.2, "sell").otherwise("hold"),
        "stop": F.col("close") - 2 * side * F.col("step"), "take_profit": F.col("close") + 3 * side * F.col("step"),
    }).drop("step")
