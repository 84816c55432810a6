"""Streams that keep a state by symbol: zones and what breaks them, positions that follow regimes; and outcomes of signals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .bars import timed

ZONES = "ids array<string>, kinds array<string>, lows array<double>, highs array<double>, born array<long>, seen long"
POSITION = "regime string, position string, last_ts timestamp"


def stream_zones(zones: DataFrame, bars: DataFrame, keep: int = 20) -> DataFrame:
    """Zones from their making to the close that breaks them, or until ``keep`` later snapshots push them out. R05

    ``zones``: symbol, ts, zone_id, kind (support or resistance), lower, upper; rows of one ts are one snapshot. ``bars``:
    symbol, ts, close. Comes out: symbol, ts, zone_id, event (made, broken, expired). A support breaks by a close under its
    lower bound, a resistance by one over its upper bound. Within a batch rows go in order of time, zones before bars. State is
    the open zones of the last snapshots.
    """
    none = lambda t: F.lit(None).cast(t)
    a = zones.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "zone_id", "kind", "lower", "upper", none("double").alias("close"))
    b = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), none("string").alias("zone_id"), none("string").alias("kind"), none("double").alias("lower"), none("double").alias("upper"), "close")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, kinds, lows, highs, born, seen = state.get if state.exists else ([], [], [], [], [], 0)
        live = {i: (k, lo, hi, at) for i, k, lo, hi, at in zip(ids, kinds, lows, highs, born, strict=True)}
        rows = pd.concat(list(batches))
        rows = rows.assign(is_bar=rows["zone_id"].isna()).sort_values(["ts", "is_bar", "zone_id"], kind="stable")
        out, snapshot = [], None
        for r in rows.itertuples(index=False):
            if r.is_bar:
                broken = [i for i, (kind, lo, hi, _) in live.items() if (kind == "support" and r.close < lo) or (kind == "resistance" and r.close > hi)]
                out += [(key[0], r.ts, i, "broken") for i in broken]
                for i in broken:
                    del live[i]
                continue
            if r.ts != snapshot:
                snapshot, seen = r.ts, seen + 1
                old = [i for i, z in live.items() if z[3] <= seen - keep]
                out += [(key[0], r.ts, i, "expired") for i in old]
                for i in old:
                    del live[i]
            if r.zone_id not in live:
                live[r.zone_id] = (r.kind, r.lower, r.upper, seen)
                out.append((key[0], r.ts, r.zone_id, "made"))
        cols = list(zip(*live.values(), strict=True)) or [(), (), (), ()]
        state.update((list(live), list(cols[0]), list(cols[1]), list(cols[2]), list(cols[3]), seen))
        yield pd.DataFrame(out, columns=["symbol", "ts", "zone_id", "event"])

    return a.unionByName(b).groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, zone_id string, event string", ZONES, "append", GroupStateTimeout.NoTimeout)


def stream_outcomes(signals: DataFrame, bars: DataFrame, horizon: str, late: str = "1 hour") -> DataFrame:
    """Signals with the best, worst and last price of the bars within ``horizon`` after them, once no such bar can come any more. R06

    ``signals``: symbol, ts, signal_id, side (1 or -1), entry. ``bars``: symbol, ts, high, low, close. A signal without a bar in
    its horizon gives nothing. mfe and mae are in price, in the signal's direction.
    """
    s = timed(signals, late).alias("s")
    b = timed(bars.withColumnRenamed("ts", "bar_ts"), late, "bar_ts").alias("b")
    ahead = (F.col("s.symbol") == F.col("b.symbol")) & (F.col("bar_ts") > F.col("ts")) & (F.col("bar_ts") <= F.col("ts") + F.expr(f"interval {horizon}"))
    met = s.join(b, ahead).select("s.symbol", "ts", "signal_id", "side", "entry", "bar_ts", "high", "low", "close")
    up, down = F.max("high") - F.col("entry"), F.col("entry") - F.min("low")
    out = met.groupBy("symbol", "ts", "signal_id", "side", "entry").agg(
        F.count(F.lit(1)).alias("n_bars"), F.when(F.col("side") > 0, up).otherwise(down).alias("mfe"), F.when(F.col("side") > 0, down).otherwise(up).alias("mae"), (F.col("side") * (F.max_by("close", "bar_ts") - F.col("entry"))).alias("net")
    )
    return out


def stream_positions(regimes: DataFrame) -> DataFrame:
    """Enter, add and exit signals of one position for each symbol that follows its regime, over all batches. R09

    ``regimes``: symbol, ts, regime (as tf_regime() names them; null doesn't count). The same rules as bias_signals(): a strong
    regime turns the position to its side or adds to it, a weak one of the other side ends it. Rows older than the last one
    seen are left out. State is one row for each symbol.
    """
    side_of = {"STRONG_ASSET": "LONG", "STRONG_DXY": "SHORT"}
    ended_by = {"WEAK_ASSET": "SHORT", "WEAK_DXY": "LONG"}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, position, last = state.get if state.exists else (None, "FLAT", pd.Timestamp.min)
        rows = pd.concat(list(batches)).dropna(subset=["regime"]).sort_values("ts", kind="stable")
        out = []
        for ts, regime in zip(rows["ts"], rows["regime"], strict=True):
            if before is not None and ts <= last:
                continue
            if before is not None and regime != before:
                side = side_of.get(regime)
                if side:
                    if position not in ("FLAT", side):
                        out.append((key[0], ts, regime, f"EXIT {position}", "Confirmed"))
                    out.append((key[0], ts, regime, f"{'ADD' if position == side else 'ENTER'} {side}", "Confirmed"))
                    position = side
                elif position == ended_by.get(regime):
                    out.append((key[0], ts, regime, f"EXIT {position}", "Reversal"))
                    position = "FLAT"
            before, last = regime, ts
        if before is not None:
            state.update((before, position, last))
        yield pd.DataFrame(out, columns=["symbol", "ts", "regime", "signal", "confirmation"])

    rows = regimes.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "regime")
    return rows.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, regime string, signal string, confirmation string", POSITION, "append", GroupStateTimeout.NoTimeout)
