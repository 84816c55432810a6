"""What stands between features and training: choosing columns, ranges fitted on training rows, the chain that applies them, stored splits."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.folds import stored
from ..functions.series import KEYS, clip, ratio, roll, series
from . import indicators, recursive, scaling

#: Words in a name that mark a price, and words that mark a difference or an oscillator.
PRICE_WORDS = ("close", "open", "high", "low", "price", "vwap", "sma", "ema", "wma", "hma", "bband", "upper", "lower", "middle", "channel", "pivot", "sup", "res", "support", "resistance", "level", "highs", "lows", "target", "mid", "volume", "tickvolume", "spread", "atr")
DIFF_WORDS = ("diff", "osc", "macd", "rsi", "momentum", "change", "velocity", "roc", "speed", "slope", "delta", "return", "derivative", "signal", "csm_")
#: Columns that name a row, and names and beginnings of names of columns that look ahead.
STRUCTURAL = ("symbol", "tf", "ts", "date", "index", "timestamp", "userid", "time", "time_unix", "datetime", "timestamp_unix", "snr_signals", "signal_type", "time_index")
AHEAD = ("price_change", "direction", "target_close", "close_next", "target_signal", "next_day_return", "next_3_day_return", "next_5_day_return", "next_day_direction", "target_direction", "candle_range", "signal_bounce_support", "signal_bounce_resistance", "signal_breakout_support", "signal_breakout_resistance")
AHEAD_STARTS = ("next_", "target_", "adv_target_")


def select_features(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The row's own key columns and all numeric columns that neither name a row nor look ahead nor are excluded. P28"""
    drop = {x.lower() for x in (*STRUCTURAL, *AHEAD, *exclude)}
    numeric = lambda t: t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")
    kept = [c for c, t in df.dtypes if numeric(t) and c.lower() not in drop and not c.lower().startswith(AHEAD_STARTS)]
    return df.select(*[c for c in (*KEYS, "ts") if c in df.columns], *kept)


def partition_columns(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Group of each column, from one aggregate: price by its name, diff by its name or by values on both sides of 0, else other. T02"""
    ends = df.agg(*[F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in columns])
    long = ends.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.low").alias("low"), F.col(f"`{c}`.high").alias("high")) for c in columns])).alias("e")).select("e.*")
    named = lambda words: reduce(lambda a, b: a | b, (F.contains(F.lower("column"), F.lit(w)) for w in words))
    price = named(PRICE_WORDS)
    signed = F.coalesce((F.col("low") < -1e-5) & (F.col("high") > 1e-5), F.lit(False))
    return long.select("column", F.when(named(DIFF_WORDS) | (signed & ~price), "diff").when(price, "price").otherwise("other").alias("group"))


def fit_structural_range(df: DataFrame, n: int = 252, least: float = 28.0, most: float = 100.0) -> DataFrame:
    """By symbol, from training rows: the highest rolling high and lowest rolling low, widened by a multiple of the mean range. T04

    The multiple is half the span of the closes in mean ranges, between ``least`` and ``most`` (``least`` if nothing moves). The
    range is the mean of 14 true ranges, smoothed by an EMA of 14. Rolling values count from max(20, n // 8) rows on.
    """
    train = df.filter("split = 'train'").withColumn("_tr", indicators.true_range()).withColumn("_mean", roll(F.avg, "_tr", 14, 1))
    train = recursive.ema(train, "_mean", 14, "_atr")
    seen = max(20, n // 8)
    train = train.withColumns({"_high": roll(F.max, "high", n, seen), "_low": roll(F.min, "low", n, seen)})
    factor = F.coalesce(clip(ratio(0.5 * (F.max("close") - F.min("close")), F.avg("_atr")), least, most), F.lit(least))
    factors = train.groupBy("symbol").agg(factor.alias("_factor"))
    wide = train.select("symbol", "_high", "_low", "_atr").join(factors, "symbol")
    out = wide.groupBy("symbol").agg(F.max(F.col("_high") + F.col("_factor") * F.col("_atr")).alias("range_high"), F.min(F.col("_low") - F.col("_factor") * F.col("_atr")).alias("range_low"), F.first("_factor").alias("range_factor"))
    return out.withColumn("range_width", F.col("range_high") - F.col("range_low"))


def normalise_levels(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Price levels by their place in the fitted range (range_low, range_width); null where it has no width. T07"""
    return df.withColumns({c: ratio(F.col(c) - F.col("range_low"), "range_width") for c in columns})


def normalise_differences(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Differences in price as shares of the fitted range, from [-1, 1] into [0, 1]: a half is no difference. T07"""
    return df.withColumns({c: (clip(ratio(c, "range_width"), -1, 1) + 1) / 2 for c in columns})


class Columns(NamedTuple):
    """Which columns the chain treats as what."""

    volumes: tuple[str, ...] = ("volume",)
    scaled: tuple[str, ...] = ()
    prices: tuple[str, ...] = ("open", "high", "low", "close")
    differences: tuple[str, ...] = ()


class Fitted(NamedTuple):
    """What the chain has learned from training rows: one row for each symbol and table."""

    volumes: DataFrame
    scaled: DataFrame | None
    ranges: DataFrame


def fit_normalisation(df: DataFrame, columns: Columns, n: int = 252) -> Fitted:
    """Learn ranges and scalers from the rows of split 'train'. T09"""
    return Fitted(scaling.fit_range(df, columns.volumes), scaling.fit_scaler(df, columns.scaled) if columns.scaled else None, fit_structural_range(df, n))


def apply_normalisation(df: DataFrame, fitted: Fitted, columns: Columns) -> DataFrame:
    """Volumes by their range, scaled columns by z and sigmoid, then prices and differences by the fitted range; prices cut to [0, 1]. T09, T13

    Each step is a join with one row for each symbol. Symbols that weren't fitted get nulls.
    """
    df = scaling.apply_range(df, fitted.volumes, columns.volumes)
    if fitted.scaled is not None:
        df = scaling.apply_scaler(df, fitted.scaled, dict.fromkeys(columns.scaled, "standard")).withColumns({c: 1 / (1 + F.exp(-F.col(c))) for c in columns.scaled})
    df = df.join(fitted.ranges.select("symbol", "range_low", "range_width"), "symbol", "left")
    df = normalise_differences(normalise_levels(df, columns.prices), columns.differences).drop("range_low", "range_width")
    return scaling.clip_columns(df, columns.prices)


def split_pipeline(df: DataFrame, columns: Columns, n: int = 252) -> DataFrame:
    """Split each series by time, learn from its training rows, apply to all. T09"""
    split = scaling.split_sequential(df)
    return apply_normalisation(split, fit_normalisation(split, columns, n), columns)


def inference_window(df: DataFrame, fitted: Fitted, columns: Columns, contract: tuple[str, ...], n: int) -> DataFrame:
    """The last n rows of each series, normalised as in training, as one flat array of the contract's columns. T17

    Columns that aren't there are 0; a series of fewer rows has zeros in front.
    """
    ready = apply_normalisation(df, fitted, columns)
    missing = {c: F.lit(0.0) for c in contract if c not in ready.columns}
    windows = scaling.feature_window(ready.withColumns(missing) if missing else ready, contract, n)
    newest = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("ts").desc()))
    return windows.withColumn("_r", newest).filter("_r = 1").select(*KEYS, "ts", "window")


def numbered(df: DataFrame, by: str = "split", bucket: str = "day") -> DataFrame:
    """``row``: place from 0 among the rows of ``by`` in order of (ts, symbol, tf), and ``total``, that group's rows. S17

    Rows are numbered inside calendar buckets, and buckets by a running count, so no group is ordered in one task.
    """
    df = df.withColumn("_bucket", F.date_trunc(bucket, "ts"))
    counts = df.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(by).orderBy("_bucket")
    starts = counts.select(by, "_bucket", (F.sum("_n").over(w) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy(by)).alias("total"))
    place = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy("ts", "symbol", "tf")) - 1
    return df.withColumn("_place", place).join(starts, [by, "_bucket"]).withColumn("row", F.col("_start") + F.col("_place")).drop("_bucket", "_start", "_place")


def write_splits(df: DataFrame, path: str) -> None:
    """Rows with their numbers, a folder for each split: a slice of one is read by its numbers without sorting. S14"""
    numbered(df).repartitionByRange("split", "row").sortWithinPartitions("split", "row").write.mode("overwrite").partitionBy("split").parquet(path)


def windowed_read(stored: DataFrame, split: str, offset: int, limit: int) -> DataFrame:
    """The slice [offset, offset + limit) of a split, with ``total``; both filters reach the files. S17"""
    return stored.filter((F.col("split") == split) & (F.col("row") >= offset) & (F.col("row") < offset + limit))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shuffle_batches(df: DataFrame, key: tuple[str, ...], batches: int, seed: int = 0, holdback: float = 0.1) -> DataFrame:
    """``batch`` by a digest of seed and key, ``place`` in it, and whether the row is held back: the same on every run and partitioning. T14

    Batches are of about equal size; each is ordered in a task of its own, so choose as many as keep one small.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    part = lambda i: F.conv(F.substring("_digest", i, 8), 16, 10).cast("long")
    df = df.withColumn("_digest", digest).withColumns({"batch": part(1) % batches, "held_back": part(9) < int(holdback * 2**32)})
    return df.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("_digest"))).drop("_digest")


def sequence_refs(df: DataFrame, signal: Column, lookback: int) -> DataFrame:
    """Rows where ``signal`` holds, with the numbers [start, end) of the rows before and at it instead of copies of them. Z12"""
    at = F.row_number().over(series())
    return df.withColumn("_at", at).filter(signal).select(*KEYS, "ts", F.greatest(F.col("_at") - lookback, F.lit(0)).alias("start"), F.col("_at").alias("end"))


def reconstruct_sequences(refs: DataFrame, bars: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows of each reference as an ordered array. Z12

    References and bars meet on (series, row number), each reference opened to at most its lookback.
    """
    rows = bars.withColumn("row", F.row_number().over(series()) - 1).select(*KEYS, "row", F.struct("row", *columns).alias("bar"))
    opened = refs.filter("end > start").withColumn("row", F.explode(F.sequence("start", F.col("end") - 1)))
    return opened.join(rows, [*KEYS, "row"]).groupBy(*KEYS, "ts", "start", "end").agg(F.sort_array(F.collect_list("bar")).alias("sequence"))


def list_datasets(catalog: DataFrame, session: str | None = None, source: str | None = None, parent: str | None = None) -> DataFrame:
    """A catalog's rows of a session, a source step or a parent, newest first. S18"""
    for column, value in (("session_id", session), ("source_step", source), ("parent_id", parent)):
        if value is not None:
            catalog = catalog.filter(F.col(column) == value)
    return catalog.orderBy(F.col("created_at").desc(), "dataset_id")


def dataset_lineage(catalog: DataFrame) -> DataFrame:
    """Every dataset (``session_id``, ``start_id``) with its ancestors: ``depth`` from 0, ``dataset_id``, and how the chain ``ended``. S18

    A chain follows ``parent_id`` within its session up to a ``root`` without parent, a ``missing`` parent, or before it comes
    back to a dataset that it holds (``cycle``). Paths double in length each round, so the rounds are the logarithm of the
    longest chain. Ids are unique in a session; runs jobs when called.
    """
    known = catalog.select("session_id", "dataset_id", "parent_id")
    parents = known.select("session_id", F.col("dataset_id").alias("parent_id"), F.lit(True).alias("_there")).distinct()
    ended = F.when(F.col("parent_id").isNull(), "root").when(F.col("parent_id") == F.col("dataset_id"), "cycle").when(F.col("_there").isNull(), "missing")
    paths = stored(known.join(parents, ["session_id", "parent_id"], "left").select("session_id", F.col("dataset_id").alias("start_id"), F.array("dataset_id").alias("path"), F.col("parent_id").alias("next"), ended.alias("ended")), "paths")
    while not paths.filter("ended is null").isEmpty():
        further = paths.select("session_id", F.col("start_id").alias("next"), F.col("path").alias("_path"), F.col("next").alias("_next"), F.col("ended").alias("_ended"))
        met = paths.filter("ended is null").join(further, ["session_id", "next"])
        # where the chain comes back to itself, if it does
        back = F.array_min(F.transform(F.array_intersect("path", "_path"), lambda x: F.array_position("_path", x)))
        one = met.select("session_id", "start_id", F.concat("path", F.slice("_path", F.lit(1), F.coalesce((back - 1).cast("int"), F.size("_path")))).alias("path"), F.col("_next").alias("next"), F.when(back.isNotNull(), "cycle").otherwise(F.col("_ended")).alias("ended"))
        paths = stored(paths.filter("ended is not null").unionByName(one), "paths")
    return paths.select("session_id", "start_id", "ended", F.posexplode("path").alias("depth", "dataset_id"))


def old_sessions(sessions: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Sessions older than ``days`` that aren't archived; null counts as not archived. O04"""
    return sessions.filter((F.col("created_at") < now - F.make_dt_interval(F.lit(days))) & ~F.coalesce(F.col("archived"), F.lit(False)))


def merge_signal_chunks(*parts: DataFrame) -> DataFrame:
    """Signals of overlapping chunks, each (series, ts, type, direction, price to six places) once: the earliest chunk's. A43"""
    numbered_parts = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered_parts)
    same = Window.partitionBy(*KEYS, "ts", "type", "direction", F.round("price", 6)).orderBy("_part")
    return every.withColumn("_k", F.row_number().over(same)).filter("_k = 1").drop("_k", "_part")


