"""Keyed streams in event time: rows wait for the watermark and then go in order of time, however they came.

Rows wait in a map state by the millisecond of their time; a timer just after it fires when the watermark has passed, and
then all rows that are due go through the machine, oldest first. A key that hears nothing for ``idle`` after its last row
gives its state up. State lives in the session's RocksDB state store, so it may outgrow memory, and a query that starts
again from its checkpoint goes on where it was.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .bars import timed

#: The state store that these operators need, as a setting of the session.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: From a key, rows in order (of time in microseconds, then their values) and the state (JSON, empty at first): rows out, and the state after.
Machine = Callable[[str, list[list[Any]], dict], tuple[list[tuple], dict]]


class InOrder(StatefulProcessor):
    """Runs a machine over each key's rows in order of event time, behind the watermark."""

    def __init__(self, machine: Machine, fields: list[str], out: list[str], idle_ms: int) -> None:
        self.machine, self.fields, self.out, self.idle_ms = machine, fields, out, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "rows string")
        self.state = handle.getValueState("state", "json string, last_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new: dict[int, list] = {}
        for part in rows:
            stamps = part["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            values = [part[f].astype(object).where(part[f].notna(), None).tolist() for f in self.fields]
            for stamp, *row in zip(stamps, *values, strict=True):
                new.setdefault(stamp // 1000, []).append([stamp, *row])
        for ms, added in new.items():
            held = json.loads(self.waiting.getValue((ms,))[0]) if self.waiting.containsKey((ms,)) else []
            self.waiting.updateValue((ms,), (json.dumps(held + added),))
            if not held:
                self.handle.registerTimer(ms + 1)
        yield self._frame(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        due = sorted(ms for (ms,) in self.waiting.keys() if ms < now)
        text, last = self.state.get() if self.state.exists() else ("{}", 0)
        rows = []
        for ms in due:
            rows += json.loads(self.waiting.getValue((ms,))[0])
            self.waiting.removeKey((ms,))
        if rows:
            rows.sort(key=lambda r: [r[0], *((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r[1:])])
            out, after = self.machine(key[0], rows, json.loads(text))
            self.state.update((json.dumps(after), due[-1]))
            self.handle.registerTimer(due[-1] + self.idle_ms)
            yield self._frame(key, out)
            return
        if self.state.exists() and now >= last + self.idle_ms:
            self.state.clear()
        yield self._frame(key, [])

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        p = pd.DataFrame([(key[0], *r) for r in rows], columns=["symbol", "ts", *self.out])
        return p.assign(ts=pd.to_datetime(p["ts"], unit="us"), symbol=p["symbol"].astype(object))

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, machine: Machine, fields: list[str], out: str, late: str, idle: str) -> DataFrame:
    """(symbol, ts, the DDL columns ``out``) of a machine over the rows of each symbol; rows later than ``late`` are left out."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    names = [f.split()[0] for f in out.split(", ")]
    typed = timed(rows, late).select("symbol", "ts", *fields)
    return typed.groupBy("symbol").transformWithStateInPandas(InOrder(machine, fields, names, idle_ms), f"symbol string, ts timestamp, {out}", "Append", "EventTime")


def _mean(s: dict, name: str, x: float | None, n: int) -> float | None:
    """Wilder's mean, from the mean of the first n values on."""
    if x is not None:
        count, value = s.get(name, (0, 0.0))
        count, value = count + 1, value + x if count < n else value + (x - value) / n
        if count == n:
            value /= n
        s[name] = (count, value)
    count, value = s.get(name, (0, 0.0))
    return value if count >= n else None


def stream_indicators(bars: DataFrame, late: str = "1 hour", idle: str = "365 days", span: int = 9, n: int = 14, atr: int = 10, width: float = 3.0) -> DataFrame:
    """Bars (symbol, ts, high, low, close) with their EMA, Wilder's RSI and ATR, and supertrend, as the batch operators give them. R04

    Bars come out once, in order, when the watermark has passed them. A bar with a null price changes nothing and has nulls.
    """

    def machine(symbol: str, rows: list[list[Any]], s: dict) -> tuple[list[tuple], dict]:
        out = []
        for stamp, high, low, close in rows:
            if high is None or low is None or close is None:
                out.append((stamp, None, None, None, None, None, 0))
                continue
            before = s.get("close")
            s["ema"] = close if "ema" not in s else s["ema"] + 2 / (span + 1) * (close - s["ema"])
            change = None if before is None else close - before
            gain, loss = _mean(s, "gain", None if change is None else max(change, 0.0), n), _mean(s, "loss", None if change is None else max(-change, 0.0), n)
            strength = None if gain is None or loss is None else 50.0 if gain + loss == 0 else 100 * gain / (gain + loss)
            reach = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
            mean = _mean(s, "atr", reach, atr)
            line, side = None, 0
            if mean is not None:
                hi, lo = (high + low) / 2 + width * mean, (high + low) / 2 - width * mean
                if "upper" not in s:
                    s |= {"upper": hi, "lower": lo, "side": 1}
                else:
                    s["upper"] = hi if hi < s["upper"] or before > s["upper"] else s["upper"]
                    s["lower"] = lo if lo > s["lower"] or before < s["lower"] else s["lower"]
                    s["side"] = (1 if close > s["upper"] else -1) if s["side"] < 0 else (-1 if close < s["lower"] else 1)
                side = s["side"]
                line = s["lower"] if side > 0 else s["upper"]
            s["close"] = close
            out.append((stamp, close, s["ema"], strength, mean, line, side))
        return out, s

    return in_order(bars, machine, ["high", "low", "close"], "close double, ema double, rsi double, atr double, supertrend double, supertrend_dir int", late, idle)


def stream_zone_lives(zones: DataFrame, bars: DataFrame, keep: int = 20, late: str = "1 hour", idle: str = "365 days") -> DataFrame:
    """Zones from their making to the close that breaks them, or until ``keep`` later snapshots push them out, in order of event time. R05

    ``zones``: symbol, ts, zone_id, kind (support or resistance), lower, upper; rows of one ts are one snapshot and go before
    bars of that time. ``bars``: symbol, ts, close. Comes out: symbol, ts, zone_id, event (made, broken, expired).
    """
    none = lambda t: F.lit(None).cast(t)
    a = zones.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("is_bar"), "zone_id", "kind", "lower", "upper", none("double").alias("close"))
    b = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("is_bar"), none("string").alias("zone_id"), none("string").alias("kind"), none("double").alias("lower"), none("double").alias("upper"), "close")

    def machine(symbol: str, rows: list[list[Any]], s: dict) -> tuple[list[tuple], dict]:
        live, seen, snapshot, out = s.get("live", {}), s.get("seen", 0), s.get("snapshot"), []
        for stamp, is_bar, zone, kind, lower, upper, close in rows:
            if is_bar:
                if close is not None:
                    for i in [i for i, (k, lo, hi, _) in live.items() if (close < lo if k == "support" else close > hi)]:
                        out.append((stamp, i, "broken"))
                        del live[i]
                continue
            if stamp != snapshot:
                snapshot, seen = stamp, seen + 1
                for i in [i for i, z in live.items() if z[3] <= seen - keep]:
                    out.append((stamp, i, "expired"))
                    del live[i]
            if zone not in live:
                live[zone] = (kind, -math.inf if lower is None else lower, math.inf if upper is None else upper, seen)
                out.append((stamp, zone, "made"))
        return out, {"live": live, "seen": seen, "snapshot": snapshot}

    return in_order(a.unionByName(b), machine, ["is_bar", "zone_id", "kind", "lower", "upper", "close"], "zone_id string, event string", late, idle)
