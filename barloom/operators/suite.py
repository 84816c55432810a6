"""The indicator suite: ordered steps over bars, chosen indicators with parameters, and the final form of a feature table."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import ffill, ratio, roll
from . import indicators, recursive

#: Columns of a bar, which come first in a finished table.
BASE = ("symbol", "tf", "ts", "open", "high", "low", "close", "volume")
#: Words in a name that mark a price level, which is carried forward, and endings that mark a difference.
LEVELS = ("level", "price", "top", "bottom", "trendline_value", "pivot", "sar", "sma_", "ema_", "ma_")
DIFFERENCES = ("_diff",)
#: Means minus price by letter, and EMAs set against the one of 8.
LETTERS = {"a": ("sma", 25), "b": ("sma", 50), "c": ("sma", 100), "d": ("sma", 200), "e": ("ema", 8), "f": ("ema", 10), "g": ("ema", 12), "h": ("ema", 24), "i": ("ema", 32)}
CHANGES = (64, 32, 24, 21, 18)


def mean_letters(df: DataFrame) -> DataFrame:
    """Columns a to i: means and EMAs of nine spans minus the close, and ma_change0 to 4: longer EMAs minus that of 8. P23"""
    spans = tuple(dict.fromkeys([n for kind, n in LETTERS.values() if kind == "ema"] + list(CHANGES)))
    df = recursive.emas(df, "close", spans)
    value = {x: (roll(F.avg, "close", n) if kind == "sma" else F.col(f"ema_{n}")) - F.col("close") for x, (kind, n) in LETTERS.items()}
    return df.withColumns(value | {f"ma_change{i}": F.col(f"ema_{n}") - F.col("ema_8") for i, n in enumerate(CHANGES)})


def legacy_aliases(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns again under other names (``names``: new to present name); one that is missing, or taken already, is left out. P22"""
    have = set(df.columns)
    return df.select("*", *[F.col(old).alias(new) for new, old in names.items() if old in have and new not in have])


def other_indicators(df: DataFrame, n: int = 20, atr: int = 14, sar: bool = True) -> DataFrame:
    """Deviation of the close, parabolic SAR and its distance, Wilder's mean range and its per cent of price, size and body of a bar. W20

    The deviation, the SAR and the range are carried forward over gaps.
    """
    df = recursive.atr_wilder(df, atr, "_atr")
    if sar:
        df = recursive.psar(df).withColumn("psar", ffill("psar")).withColumn("psar_diff", F.col("psar") - F.col("close")).drop("psar_dir")
    df = df.withColumns({"_dev": roll(F.stddev_samp, "close", n)})
    df = df.withColumns({f"historical_volatility_{n}": ffill("_dev"), "atr": ffill("_atr"), "candle_size": F.col("high") - F.col("low"), "candle_range": F.coalesce(F.col("close") - F.col("open"), F.lit(0.0))})
    return df.withColumn("atr_pct", 100 * ratio("atr", "close")).drop("_atr", "_dev")


class Step(NamedTuple):
    """One step of the suite: the columns it needs beyond a bar's own, and what it does."""

    run: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()


#: The suite's steps in order. Window steps share one partitioning; each scan of recurrences adds one shuffle and a join.
STEPS: dict[str, Step] = {
    "price": Step(indicators.price_basics), "momentum": Step(indicators.momentum), "means": Step(indicators.ma_differences), "bollinger": Step(indicators.bollinger), "keltner": Step(indicators.keltner),
    "vwap": Step(indicators.rolling_vwap), "returns": Step(indicators.returns), "realised": Step(indicators.realised_vol), "stochastic": Step(indicators.stochastic), "choppiness": Step(indicators.choppiness),
    "awesome": Step(indicators.awesome_oscillator), "pivots": Step(indicators.pivot_levels), "trend": Step(indicators.trend_strength), "vsi": Step(indicators.vsi), "velocity": Step(indicators.price_velocity),
    "obv": Step(indicators.obv), "range": Step(indicators.structural_range), "letters": Step(mean_letters), "macd": Step(recursive.macd), "rsi": Step(recursive.rsi), "delta": Step(indicators.momentum_delta, ("rsi",)),
    "other": Step(other_indicators), "supertrend": Step(recursive.supertrend),
}


def indicator_suite(df: DataFrame, steps: tuple[str, ...] | None = None, inference: bool = False, sentinel: float | None = None) -> DataFrame:
    """The named steps (default: all) in the suite's order, then finalize(). W48

    A step whose columns aren't there is left out, so a bar without volume still gets what needs none; an unknown step is an
    error. Of columns that two steps make the first stays. ``inference`` leaves out columns that look ahead (next_*).
    """
    unknown = set(steps or ()) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}")
    for name, step in STEPS.items():
        if steps is not None and name not in steps or not set(step.needs) <= set(df.columns):
            continue
        before = df.columns
        made = step.run(df)
        df = made.select(*before, *[c for c in made.columns if c not in before])
    if inference:
        df = df.drop(*[c for c in df.columns if c.lower().startswith("next_")])
    return finalize(df, sentinel)


def finalize(df: DataFrame, sentinel: float | None = 99_999.0) -> DataFrame:
    """A table without holes: differences at the sentinel, levels carried forward, then 0; base columns first, then by name. W50

    Numbers only besides the bar's own columns: truth values become 0 and 1, others go. Of names that differ by case alone the
    first stays. Without a sentinel differences are 0 where there are none.
    """
    kinds = {}
    for c, t in df.dtypes:
        if c.lower() not in {k.lower() for k in kinds}:
            kinds[c] = t
    numeric = lambda t: t in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean") or t.startswith("decimal")
    base = [c for c in BASE if c in kinds]
    out = []
    for c in sorted(c for c, t in kinds.items() if c not in base and numeric(t)):
        x = F.col(f"`{c}`").cast("double")
        low = c.lower()
        if low.endswith(DIFFERENCES) or low.startswith("diff_"):
            x = F.coalesce(x, F.lit(0.0 if sentinel is None else float(sentinel)))
        else:
            x = F.coalesce(ffill(x) if any(w in low for w in LEVELS) else x, F.lit(0.0))
        out.append(x.alias(c))
    return df.select(*base, *out)


class Prebuilt(NamedTuple):
    """An indicator that can be chosen by name: its default parameters, how many rows it needs, and what it does."""

    defaults: dict[str, float]
    rows: Callable[[dict[str, float]], int]
    run: Callable[[DataFrame, dict[str, float]], DataFrame]


def _sma(df: DataFrame, p: dict[str, float]) -> DataFrame:
    return df.withColumn(f"sma_{p['length']}", roll(F.avg, "close", p["length"]))


def _bands(df: DataFrame, p: dict[str, float]) -> DataFrame:
    return indicators.bollinger(df, p["length"], p["std"])


#: The default parameters, and the rows beyond them that an indicator needs.
PREBUILT: dict[str, Prebuilt] = {
    "sma": Prebuilt({"length": 20}, lambda p: p["length"], _sma),
    "ema": Prebuilt({"length": 20}, lambda p: p["length"], lambda df, p: recursive.ema(df, "close", p["length"])),
    "rsi": Prebuilt({"length": 14}, lambda p: p["length"] + 10, lambda df, p: recursive.rsi(df, n=p["length"], out=f"rsi_{p['length']}")),
    "macd": Prebuilt({"fast": 12, "slow": 26, "signal": 9}, lambda p: max(p["fast"], p["slow"]) + p["signal"], lambda df, p: recursive.macd(df, fast=p["fast"], slow=p["slow"], signal=p["signal"])),
    "bollinger_bands": Prebuilt({"length": 20, "std": 2.0}, lambda p: p["length"] + 10, _bands),
}


def checked(wanted: list[tuple[str, dict[str, float]]]) -> list[tuple[Prebuilt, dict[str, float]]]:
    """Chosen indicators with their full parameters; ValueError for an unknown one, an unknown parameter, or a length under 1."""
    out = []
    for name, given in wanted:
        kind = PREBUILT.get(name)
        if kind is None or not set(given) <= set(kind.defaults):
            raise ValueError(f"unknown indicator or parameter: {name} {sorted(given)}")
        p = kind.defaults | given
        if any(v <= 0 or k != "std" and v != int(v) for k, v in p.items()):
            raise ValueError(f"{name}: {p}")
        out.append((kind, p))
    return out


def required_rows(wanted: list[tuple[str, dict[str, float]]]) -> int:
    """How many rows of a series the chosen indicators need."""
    return max((kind.rows(p) for kind, p in checked(wanted)), default=0)


def prebuilt(df: DataFrame, wanted: list[tuple[str, dict[str, float]]]) -> DataFrame:
    """Chosen indicators (name, parameters) beside the bars; EMAs of all lengths in one scan. W49"""
    chosen = checked(wanted)
    spans = tuple(dict.fromkeys(int(p["length"]) for kind, p in chosen if kind is PREBUILT["ema"]))
    if spans:
        df = recursive.emas(df, "close", spans)
    for kind, p in chosen:
        if kind is not PREBUILT["ema"]:
            df = kind.run(df, p)
    return df


def index_indicators(df: DataFrame, indices: tuple[str, ...], steps: tuple[str, ...], inference: bool = True) -> DataFrame:
    """The suite on each index, its columns under the index's name, in one row for each (tf, ts). Z15

    An index is one more series, so all are computed together; then one aggregate lays them side by side. A time at which an
    index has no bar has nulls for it.
    """
    made = indicator_suite(df.filter(F.col("symbol").isin(*indices)), steps, inference)
    columns = [c for c in made.columns if c not in ("symbol", "tf", "ts")]
    pick = lambda index, c: F.max(F.when(F.col("symbol") == index, F.col(c))).alias(f"{index}_{c}")
    return made.groupBy("tf", "ts").agg(*[pick(i, c) for i in indices for c in columns])
