"""Queries over swings, zones, gaps and baskets of hourly bars, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import rounded
from ..operators import indicators, recursive, structure, zones
from ..sources.bars import event_ticks, resample
from .bar_queries import hourly
from .sql import HOURLY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


def swings_sql(length: int = 5, by_size: bool = False) -> str:
    """Swings of a length, or of the lengths that fit the series' sizes."""
    around = lambda n: f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING)"
    top, bottom = f"high = max(high) {around(length)}", f"low = min(low) {around(length)}"
    if by_size:
        sizes = "CASE WHEN {n} >= 1000 THEN {50} WHEN {n} >= 500 THEN {30} WHEN {n} >= 200 THEN {20} ELSE {10} END"
        n = "count(*) OVER (PARTITION BY symbol)"
        top, bottom = (sizes.replace("{n}", n).replace("{50}", f"{x} = {f}({x}) {around(50)}").replace("{30}", f"{x} = {f}({x}) {around(30)}").replace("{20}", f"{x} = {f}({x}) {around(20)}").replace("{10}", f"{x} = {f}({x}) {around(10)}") for x, f in (("high", "max"), ("low", "min")))
    return (
        f"WITH {HOURLY}, t AS (SELECT *, {top} AS top, {bottom} AS bot FROM bars), r AS (SELECT *, CASE WHEN top AND NOT bot THEN 1 WHEN bot AND NOT top THEN -1 END AS raw FROM t),"
        " q AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),"
        " i AS (SELECT *, sum(CASE WHEN raw IS NOT NULL AND coalesce(prev, 0) <> raw THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM q),"
        " k AS (SELECT *, CASE WHEN raw IS NOT NULL THEN row_number() OVER (PARTITION BY symbol, island, raw ORDER BY CASE WHEN raw = 1 THEN -high ELSE low END, ts) END AS k FROM i),"
        " swings AS (SELECT *, CASE WHEN k = 1 THEN raw ELSE 0 END AS swing, CASE WHEN k = 1 AND raw = 1 THEN high WHEN k = 1 AND raw = -1 THEN low END AS lvl FROM k)"
    )


_SWINGS = swings_sql()
add("w41_swing_points", lambda s, d: structure.swing_points(hourly(s, d)).select("symbol", "ts", "swing", "swing_level"), _SWINGS + " SELECT symbol, ts, CAST(swing AS INTEGER) AS swing, round(lvl, 6) AS swing_level FROM swings")
add(
    "w42_bos_choch", lambda s, d: structure.structure_breaks(structure.swing_points(hourly(s, d))).select("symbol", "ts", "swing", "bos", "choch", "broken_level"),
    _SWINGS + ", z AS (SELECT symbol, ts, swing, lvl AS d, lag(lvl, 3) OVER w AS a, lag(lvl, 2) OVER w AS b, lag(lvl, 1) OVER w AS c FROM swings WHERE swing <> 0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)), y AS (SELECT *, CASE WHEN swing = 1 AND a < c AND c < b AND b < d THEN 1 WHEN swing = -1 AND a > c AND c > b AND b > d THEN -1 ELSE 0 END AS bos, CASE WHEN swing = 1 AND d > b AND b > a AND a > c THEN 1 WHEN swing = -1 AND d < b AND b < a AND a < c THEN -1 ELSE 0 END AS choch FROM z) SELECT symbol, ts, CAST(swing AS INTEGER) AS swing, CAST(bos AS INTEGER) AS bos, CAST(choch AS INTEGER) AS choch, round(CASE WHEN bos <> 0 OR choch <> 0 THEN b END, 6) AS broken_level FROM y",
)
_CUM = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
add(
    "w45_retracements", lambda s, d: structure.retracements(structure.swing_points(hourly(s, d))).select("symbol", "ts", "retracement", "deepest_retracement"),
    _SWINGS + f", f AS (SELECT *, last_value(CASE WHEN swing = 1 THEN lvl END IGNORE NULLS) {_CUM} AS h, last_value(CASE WHEN swing = -1 THEN lvl END IGNORE NULLS) {_CUM} AS l, last_value(nullif(swing, 0) IGNORE NULLS) {_CUM} AS dir, sum(abs(swing)) {_CUM} AS seg FROM swings), n AS (SELECT *, CASE WHEN dir = 1 THEN 100 * (h - low) / nullif(h - l, 0) WHEN dir = -1 THEN 100 * (high - l) / nullif(h - l, 0) END AS now FROM f) SELECT symbol, ts, round(now, 6) AS retracement, round(max(now) OVER (PARTITION BY symbol, seg ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS deepest_retracement FROM n",
)
add(
    "w44_liquidity", lambda s, d: structure.liquidity_pools(structure.swing_points(hourly(s, d))).select("symbol", "swing", "n", "level", "first_ts", "last_ts"),
    _SWINGS + ", s AS (SELECT symbol, ts, swing, lvl, (max(lvl) OVER (PARTITION BY symbol) - min(lvl) OVER (PARTITION BY symbol)) * 0.01 AS width FROM swings WHERE swing <> 0), g AS (SELECT *, coalesce(CAST(lvl - lag(lvl) OVER w > width AS INTEGER), 1) AS nw FROM s WINDOW w AS (PARTITION BY symbol, swing ORDER BY lvl, ts)), p AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, swing ORDER BY lvl, ts ROWS UNBOUNDED PRECEDING) AS pool FROM g) SELECT symbol, CAST(swing AS INTEGER) AS swing, count(*) AS n, round(avg(lvl), 6) AS level, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY symbol, swing, pool HAVING count(*) > 1",
)


def _zones(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = hourly(s, d)
    f = indicators.fractals(b).filter("is_support or is_resistance")
    kind = F.when(F.col("is_support"), "support").otherwise("resistance")
    levels = f.select("symbol", "tf", "ts", kind.alias("kind"), F.when(F.col("is_support"), F.col("low")).otherwise(F.col("high")).alias("price"), F.date_format("ts", "yyyyMMddHH").alias("zone_id"))
    return structure.zones_of(levels, 0.05), b


_FR = f"WITH {HOURLY}, f AS (SELECT *, coalesce(low < lag(low) OVER s AND low < lead(low) OVER s AND lead(low) OVER s < lead(low, 2) OVER s AND lag(low) OVER s < lag(low, 2) OVER s, false) AS sup, coalesce(high > lag(high) OVER s AND high > lead(high) OVER s AND lead(high) OVER s > lead(high, 2) OVER s AND lag(high) OVER s > lag(high, 2) OVER s, false) AS res FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)), z AS (SELECT symbol, ts, CASE WHEN sup THEN 'support' ELSE 'resistance' END AS kind, CASE WHEN sup THEN low ELSE high END AS price FROM f WHERE sup OR res)"
add(
    "z06_zone_invalidation", lambda s, d: structure.zone_invalidation(*_zones(s, d)).select("symbol", "ts", "kind", "price", "invalidated_at"),
    _FR + " SELECT z.symbol, z.ts, z.kind, round(z.price, 6) AS price, (SELECT min(b.ts) FROM bars b WHERE b.symbol = z.symbol AND b.ts > z.ts AND (z.kind = 'support' AND b.close < z.price * 0.95 OR z.kind = 'resistance' AND b.close > z.price * 1.05)) AS invalidated_at FROM z",
)
add(
    "w29w_fvg_mitigation", lambda s, d: structure.mitigated_gaps(structure.known_with_next(indicators.fair_value_gaps(hourly(s, d))), hourly(s, d)).drop("tf"),
    f"WITH {HOURLY}, g AS (SELECT *, lag(high) OVER s < lead(low) OVER s AND close > open AS up, lag(low) OVER s > lead(high) OVER s AND close < open AS dn, lag(high) OVER s AS ph, lag(low) OVER s AS pl, lead(high) OVER s AS nh, lead(low) OVER s AS nl, lead(ts) OVER s AS kt FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)), k AS (SELECT symbol, ts, kt, CASE WHEN up THEN 1 ELSE -1 END AS fvg, CASE WHEN up THEN nl ELSE pl END AS top, CASE WHEN up THEN ph ELSE nh END AS bot FROM g WHERE up OR dn)"
    " SELECT symbol, ts, CAST(fvg AS INTEGER) AS fvg, round(top, 6) AS fvg_top, round(bot, 6) AS fvg_bottom, (SELECT min(b.ts) FROM bars b WHERE b.symbol = k.symbol AND b.ts > k.kt AND (fvg = 1 AND b.close < bot OR fvg = -1 AND b.close > top)) AS mitigated_at FROM k",
)
_BASKET = {"click": -0.5, "view": 0.3, "purchase": 0.2}
add(
    "z13_currency_index", lambda s, d: structure.currency_index(hourly(s, d), _BASKET, 50.0, ("open", "close")),
    f"WITH {HOURLY}, w(symbol, w) AS (VALUES ('click', -0.5), ('view', 0.3), ('purchase', 0.2)), i AS (SELECT ts, count(*) AS n, exp(sum(w * ln(greatest(open, 1e-8)))) * 50 AS open, exp(sum(w * ln(greatest(close, 1e-8)))) * 50 AS close FROM bars JOIN w USING (symbol) GROUP BY 1) SELECT ts, round(open, 6) AS open, round(close, 6) AS close FROM i WHERE n = 3",
)
add(
    "z14_index_candles", lambda s, d: structure.index_candles(hourly(s, d), _BASKET, 50.0),
    f"WITH {HOURLY}, w(symbol, w) AS (VALUES ('click', -0.5), ('view', 0.3), ('purchase', 0.2)), i AS (SELECT ts, count(*) AS n, round(exp(sum(w * ln(greatest(close, 1e-8)))) * 50, 6) AS c FROM bars JOIN w USING (symbol) GROUP BY 1) SELECT ts, c AS open, c AS high, c AS low, c AS close, CAST(0 AS DOUBLE) AS volume FROM i WHERE n = 3",
)
add(
    "w29u_session_trim", lambda s, d: indicators.session_trim(hourly(s, d)).select("symbol", "ts", "close"),
    f"WITH {HOURLY}, l AS (SELECT symbol, max(ts) AS last FROM bars GROUP BY 1), o AS (SELECT symbol, CASE WHEN hour(last) >= 17 THEN date_trunc('day', last) ELSE date_trunc('day', last) - INTERVAL 1 DAY END + INTERVAL 17 HOURS AS opened FROM l) SELECT symbol, ts, round(close, 6) AS close FROM bars JOIN o USING (symbol) WHERE ts >= opened",
)


def _zoned(s: SparkSession, d: str) -> DataFrame:
    b = hourly(s, d)
    return zones.with_zones(b, zones.cluster_zones(zones.level_snapshots(b)))


add("z01_detect_levels", lambda s, d: zones.level_snapshots(hourly(s, d)).select("symbol", "period", F.explode("levels").alias("l")).select("symbol", "period", "l.kind", "l.price"), None)
add("z02_cluster_zones", lambda s, d: zones.cluster_zones(zones.level_snapshots(hourly(s, d))).drop("tf"), None)
add("z03_snr_features", lambda s, d: zones.snr_features(_zoned(s, d)).select("symbol", "ts", "zones_below", "zones_above", "support_price", "resistance_price", "support_distance", "resistance_distance", "in_zone"), None)
add("z09_generate_signals", lambda s, d: zones.zone_signals(_zoned(s, d), 0.1).filter("signal is not null").select("symbol", "ts", "zone_price", "zone_kind", "signal", "signal_side"), None)
add("z16_signal_bundle", lambda s, d: zones.signal_bundle(hourly(s, d)).drop("tf"), f"WITH {HOURLY} SELECT symbol, ts, CASE WHEN close > lag(close) OVER w THEN 'up' WHEN close < lag(close) OVER w THEN 'down' ELSE 'flat' END AS trend FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
add("z19_knn_classify", lambda s, d: zones.nearest_history(indicators.returns(indicators.snr_vix(hourly(s, d))).na.drop(), ("zscore", "roc", "vix")).drop("tf"), None)
add("w34_mtf_rsi", lambda s, d: recursive.mtf_rsi(hourly(s, d), {"1d": (resample(event_ticks(s, d), "1 day"), F.expr("interval 1 day"), 0.6)}).select("symbol", "ts", "rsi", "rsi_1d", "mtf_rsi"), None)
