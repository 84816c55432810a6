"""Scans of bars and ticks, and what every scan has to do before other operators may run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import KEYS, clean, ffill, series, so_far

PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume")
BAR_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("tf", T.StringType()), T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in FIELDS)])
#: Other names of the bar columns, lower case.
ALIASES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "t": "ts", "time": "ts", "timestamp": "ts", "date": "ts", "datetime": "ts", "0": "open", "1": "high", "2": "low", "3": "close", "4": "volume"}


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ticks: one series per event type; ``seq`` breaks ties in time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"))


def trade_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as trades: one series per return flag and line status."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").alias("ts"), F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("volume"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def normalise_columns(df: DataFrame) -> DataFrame:
    """Bar columns under their own names, by alias and without regard to case; of several candidates the first stays. S05"""
    taken, out = set(), []
    for c in df.columns:
        name = ALIASES.get(c.lower(), c.lower() if c.lower() in (*FIELDS, "ts", "symbol", "tf") else c)
        if name.lower() not in taken:
            taken.add(name.lower())
            out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The same rows; ValueError if a column is missing. S12"""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def scan_bars_csv(spark: SparkSession, path: str, symbol: str, tf: str) -> DataFrame:
    """Bars of one CSV file or folder with a header; text columns, so that no pass infers types. S01"""
    raw = normalise_columns(spark.read.csv(path, header=True, inferSchema=False))
    require(raw, ("ts", *PRICES))
    volume = F.col("volume") if "volume" in raw.columns else F.lit(None)
    return raw.select(F.lit(symbol).alias("symbol"), F.lit(tf).alias("tf"), F.coalesce(F.try_to_timestamp("ts"), epoch(F.expr("try_cast(ts as double)"))).alias("ts"), *[clean(F.expr(f"try_cast({c} as double)")).alias(c) for c in PRICES], clean(F.coalesce(F.try_to_number(volume.cast("string"), F.lit("999999999999999.999999")).cast("double"), F.lit(1.0))).alias("volume"))


def epoch(seconds: Column) -> Column:
    """Epoch numbers as timestamps; beyond 1e11 they are milliseconds."""
    return F.timestamp_micros((F.when(F.abs(seconds) > 1e11, seconds * 1000).otherwise(seconds * 1_000_000)).cast("long"))


def scan_bars_table(spark: SparkSession, path: str, symbol: str | None = None, tf: str | None = None, start=None, end=None, **between: tuple[float | None, float | None]) -> DataFrame:
    """Stored bars, filtered by series, time and value ranges (close=(low, high)); all filters reach the scan. S02"""
    df = spark.read.parquet(path)
    tests = [(symbol, F.col("symbol") == symbol), (tf, F.col("tf") == tf), (start, F.col("ts") >= F.lit(start)), (end, F.col("ts") < F.lit(end))]
    for c, (low, high) in between.items():
        tests += [(low, F.col(c) >= F.lit(low)), (high, F.col(c) <= F.lit(high))]
    for given, test in tests:
        if given is not None:
            df = df.filter(test)
    return df


def scan_bars_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """Bars from JSON text with short or long keys (t, o, h, l, c, v). S03"""
    keys = "t string, time string, o double, open double, h double, high double, l double, low double, c double, close double, v double, volume double, symbol string, tf string"
    j = raw.select(F.from_json(F.col(column), keys).alias("j"))
    ts = F.coalesce("j.t", "j.time")
    pick = lambda a, b: clean(F.coalesce(f"j.{a}", f"j.{b}")).alias(b)
    return j.select("j.symbol", "j.tf", F.coalesce(epoch(ts.try_cast("double")), F.try_to_timestamp(ts)).alias("ts"), pick("o", "open"), pick("h", "high"), pick("l", "low"), pick("c", "close"), pick("v", "volume"))


def date_extent(df: DataFrame) -> DataFrame:
    """By series: first and last ts, rows, and rows that stand before their predecessor in ``seq`` order. S04"""
    w = Window.partitionBy("symbol").orderBy("seq")
    late = df.withColumn("late", F.col("ts") < F.lag("ts").over(w))
    return late.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"))


def dedup_bars(df: DataFrame, order: str, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """One row per key: the last in ``order``. S07"""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def resample(ticks: DataFrame, freq: str, tf: str | None = None) -> DataFrame:
    """Ticks as bars of a calendar width; empty buckets have no bar. A01

    One shuffle after partial aggregation; a hot symbol is spread over its buckets.
    """
    order = F.struct("ts", "seq")
    return ticks.groupBy("symbol", F.window("ts", freq).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume")
    ).select("symbol", F.lit(tf or freq).alias("tf"), F.col("w.start").alias("ts"), *FIELDS)


def resample_bars(bars: DataFrame, freq: str, tf: str | None = None) -> DataFrame:
    """Bars as wider bars. A01"""
    return bars.groupBy("symbol", F.window("ts", freq).alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).select("symbol", F.lit(tf or freq).alias("tf"), F.col("w.start").alias("ts"), *FIELDS)


def resample_count(bars: DataFrame, k: int) -> DataFrame:
    """Every k bars as one, dated by its last; an incomplete tail is left out. A02"""
    numbered = bars.withColumn("g", F.floor((F.row_number().over(series()) - 1) / k))
    return numbered.groupBy(*KEYS, "g").agg(
        F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") == k).select(*KEYS, "ts", *FIELDS)


def ensure_volume(df: DataFrame) -> DataFrame:
    """volume, or tick_volume, or 1. S06"""
    have = [F.col(c) for c in ("volume", "tick_volume") if c in df.columns]
    return df.withColumn("volume", F.coalesce(*have, F.lit(1.0)))


def repair_ohlc(df: DataFrame) -> DataFrame:
    """Missing close from the bar before, open from the close before; high and low widened to hold both; missing volume 0. S10"""
    df = df.select(*KEYS, "ts", *[clean(c).alias(c) for c in FIELDS])
    df = df.withColumn("close", ffill("close"))
    df = df.withColumn("open", F.coalesce("open", F.lag("close").over(series()), "close"))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return df.select(*KEYS, "ts", "open", F.greatest("high", top).alias("high"), F.least("low", bottom).alias("low"), "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def validate_candles(df: DataFrame) -> DataFrame:
    """high and low in order, and ``quality``: ok, swapped, outside (open or close beyond high or low) or missing. S11"""
    missing = F.lit(False)
    for c in PRICES:
        missing = missing | F.col(c).isNull()
    high, low = F.greatest("high", "low"), F.least("high", "low")
    outside = (F.greatest("open", "close") > high) | (F.least("open", "close") < low)
    quality = F.when(missing, "missing").when(F.col("low") > F.col("high"), "swapped").when(outside, "outside").otherwise("ok")
    return df.withColumn("quality", quality).withColumns({"high": high, "low": low})


def fill_numeric(df: DataFrame, columns: tuple[str, ...], fill: float = 0.0) -> DataFrame:
    """Infinities and NaN as null, then the last value, then the next, then ``fill``. S08 (the next value looks ahead)"""
    after = series().rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(clean(c), ignorenulls=True).over(so_far()), F.first(clean(c), ignorenulls=True).over(after), F.lit(fill)) for c in columns})


def restore_numeric_types(df: DataFrame) -> DataFrame:
    """Text columns of which any value parses become doubles; one pass finds them. S09"""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    parses = df.agg(*[F.count(F.col(c).try_cast("double")).alias(c) for c in texts]).first().asDict()
    return df.withColumns({c: F.col(c).try_cast("double") for c in texts if parses[c]})


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text; NaN and infinities are left out. S13"""
    return df.select(F.to_json(F.struct(*[clean(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])).alias("json"))


def manifest(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: rows, and for each column the share that is not null. S15"""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.try_divide(F.count(c), F.count(F.lit(1))).alias(f"{c}_filled") for c in columns])


def append_new(batch: DataFrame, seen: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of the batch whose keys' hash isn't among the seen ones, each once. S16"""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]), 256)
    return batch.withColumn("digest", digest).join(seen.select(digest.alias("digest")).distinct(), "digest", "left_anti").dropDuplicates(["digest"])
