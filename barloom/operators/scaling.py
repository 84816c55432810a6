"""Ordered splits, scaling that is fitted on the training rows alone, and windows of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import KEYS, clip, last_rows, ratio, roll, series


def split_sequential(df: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """``split`` by place in the series, boundaries rounded down. T01"""
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    at = F.row_number().over(series()) - 1
    return df.withColumn("split", F.when(at < F.floor(n * train), "train").when(at < F.floor(n * train) + F.floor(n * val), "val").otherwise("test"))


def training_blocks(df: DataFrame, blocks: int) -> DataFrame:
    """``block`` of floor(n / blocks) rows; the last takes the remainder. T15"""
    base = F.greatest(F.floor(F.count(F.lit(1)).over(Window.partitionBy(*KEYS)) / blocks), F.lit(1))
    return df.withColumn("block", F.least(F.floor((F.row_number().over(series()) - 1) / base), F.lit(blocks - 1)))


def fit_scaler(df: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row by key: minimum, maximum, mean, deviation (n), quartiles and median of each column over the training rows. T03"""
    aggs = []
    for c in columns:
        x = F.when(F.col("split") == "train", F.col(c))
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs += [F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_sd"), q.alias(f"{c}_q")]
    return df.groupBy(*by).agg(*aggs)


def apply_scaler(df: DataFrame, fitted: DataFrame, columns: dict[str, str], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Columns scaled by kind: minmax, standard, robust or none; a column that doesn't vary becomes 0. T03"""
    j = df.join(fitted, list(by))

    def scaled(c: str, kind: str):
        x = F.col(c)
        if kind == "minmax":
            return F.coalesce(ratio(x - F.col(f"{c}_min"), F.col(f"{c}_max") - F.col(f"{c}_min")), x * 0)
        if kind == "standard":
            return F.coalesce(ratio(x - F.col(f"{c}_mean"), f"{c}_sd"), x * 0)
        if kind == "robust":
            return F.coalesce(ratio(x - F.col(f"{c}_q")[1], F.col(f"{c}_q")[2] - F.col(f"{c}_q")[0]), x * 0)
        return x

    return j.select(*[scaled(c, columns[c]).alias(c) if c in columns else F.col(c) for c in df.columns])


def invert_scaler(df: DataFrame, fitted: DataFrame, columns: dict[str, str], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The values before apply_scaler(). T03"""
    j = df.join(fitted, list(by))

    def back(c: str, kind: str):
        x = F.col(c)
        if kind == "minmax":
            return x * (F.col(f"{c}_max") - F.col(f"{c}_min")) + F.col(f"{c}_min")
        if kind == "standard":
            return x * F.col(f"{c}_sd") + F.col(f"{c}_mean")
        if kind == "robust":
            return x * (F.col(f"{c}_q")[2] - F.col(f"{c}_q")[0]) + F.col(f"{c}_q")[1]
        return x

    return j.select(*[back(c, columns[c]).alias(c) if c in columns else F.col(c) for c in df.columns])


def diff_scalers(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """z-score by the training rows' mean and deviation, then sigmoid into (0, 1). T06"""
    fitted = fit_scaler(df, columns)
    z = apply_scaler(df, fitted, dict.fromkeys(columns, "standard"))
    return z.withColumns({c: 1 / (1 + F.exp(-F.col(c))) for c in columns})


def fit_range(df: DataFrame, columns: tuple[str, ...], headroom: float = 1.2) -> DataFrame:
    """By symbol: headroom times the training rows' 95th percentile of |x|. T05"""
    return df.filter("split = 'train'").groupBy("symbol").agg(*[(headroom * F.percentile(F.abs(c), F.lit(0.95))).alias(f"{c}_top") for c in columns])


def apply_range(df: DataFrame, fitted: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """x over the fitted bound; values beyond it stay beyond 1. T05"""
    return df.join(fitted, "symbol").select(*[F.coalesce(ratio(c, f"{c}_top"), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def range_drift(df: DataFrame, columns: tuple[str, ...], threshold: float = 0.02) -> DataFrame:
    """By symbol and split: share of values outside [0, 1], the largest overshoot, and whether the share is over the threshold. A44"""
    long = df.select("symbol", "split", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns])).alias("e")).select("symbol", "split", "e.*")
    over = F.greatest(F.col("x") - 1, -F.col("x"), F.lit(0.0))
    out = long.groupBy("symbol", "split", "column").agg(F.try_divide(F.count_if((F.col("x") > 1) | (F.col("x") < 0)), F.count("x")).alias("share_outside"), F.max(over).alias("max_overshoot"))
    return out.withColumn("drifted", F.coalesce(F.col("share_outside") > threshold, F.lit(False)))


def returns_transform(df: DataFrame, prices: tuple[str, ...] = ("open", "high", "low", "close"), n: int = 20) -> DataFrame:
    """Prices as relative changes, volume over its mean of n rows. T08"""
    before = {c: F.lag(c).over(series()) for c in prices}
    return df.withColumns({**{f"{c}_ret": ratio(F.col(c) - b, b) for c, b in before.items()}, "volume_rel": ratio("volume", roll(F.avg, "volume", n))})


def feature_window(df: DataFrame, columns: tuple[str, ...], n: int) -> DataFrame:
    """The last n rows' features as one flat array, zeros in front while there are less. T11"""
    rows = F.collect_list(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])).over(last_rows(n))
    df = df.withColumn("_rows", rows)
    pad = F.array_repeat(F.lit(0.0), (F.lit(n) - F.size("_rows")) * len(columns))
    return df.withColumn("window", F.concat(pad, F.flatten("_rows"))).drop("_rows")


def make_sequences(df: DataFrame, columns: tuple[str, ...], n: int, wanted: str) -> DataFrame:
    """Windows that end at the rows where ``wanted`` holds and that n rows fill. T10"""
    full = F.count(F.lit(1)).over(last_rows(n)) == n
    return feature_window(df.withColumn("_full", full), columns, n).filter(F.col("_full") & F.col(wanted)).drop("_full")


def serving_align(df: DataFrame, contract: tuple[str, ...], most_missing: float = 0.5) -> DataFrame:
    """Contract columns in order; missing ones 0, ValueError if more than the share is missing. T12"""
    missing = [c for c in contract if c not in df.columns]
    if len(missing) > most_missing * len(contract):
        raise ValueError(f"{len(missing)} of {len(contract)} contract columns are missing")
    return df.select(*[F.lit(0.0).alias(c) if c in missing else F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in contract])


def clip_columns(df: DataFrame, columns: tuple[str, ...], low: float = 0.0, high: float = 1.0) -> DataFrame:
    return df.withColumns({c: clip(c, low, high) for c in columns})
