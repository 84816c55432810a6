"""Queries that fit models or compare bars with their nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import rounded
from ..operators import models
from .bar_queries import hourly
from .event_queries import lineitem
from .sql import HOURLY, roll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


def _keyed(s: SparkSession, d: str) -> DataFrame:
    return lineitem(s, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


add("a29_pca", lambda s, d: models.principal_components(lineitem(s, d), COLS, 3), None)
add("a29_pca_scores", lambda s, d: models.component_scores(_keyed(s, d), COLS, 2, "id"), None)
add("a20_forest_importance", lambda s, d: models.forest_importance(lineitem(s, d), ("l_quantity", "l_discount", "l_tax"), "l_extendedprice"), None)
add("a20_linear_importance", lambda s, d: models.linear_importance(lineitem(s, d), ("l_quantity", "l_discount", "l_tax"), "l_extendedprice"), None)
_F = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", regr_r2(l_extendedprice, {c}) AS r2, regr_count(l_extendedprice, {c}) AS n FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax"))
add("a20_f_statistics", lambda s, d: models.f_statistics(lineitem(s, d), ("l_quantity", "l_discount", "l_tax"), "l_extendedprice"), f'WITH s AS ({_F}) SELECT "column", round(r2, 6) AS r2, CAST(n AS BIGINT) AS n, round(r2 * (n - 2) / (1 - r2), 6) AS f FROM s')
add("a25_interactions", lambda s, d: models.interactions(lineitem(s, d), ("l_quantity", "l_discount", "l_tax"), "l_extendedprice"), None)
add("a27_predictive_power", lambda s, d: models.predictive_power(lineitem(s, d), ("l_quantity", "l_discount"), "l_extendedprice", "l_orderkey"), None)
add(
    "a28_kpss", lambda s, d: models.kpss(hourly(s, d)),
    f"WITH {HOURLY}, e AS (SELECT symbol, ts, close - avg(close) OVER (PARTITION BY symbol) AS e FROM bars), p AS (SELECT *, sum(e) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT symbol, round(sum(s * s) / (count(*) * count(*)) / avg(e * e), 6) AS kpss FROM p GROUP BY 1",
)
add(
    "a41_bar_outlook", lambda s, d: models.bar_outlook(hourly(s, d)),
    f"WITH {HOURLY}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars), t AS (SELECT *, avg(volume) OVER (PARTITION BY symbol) AS mv FROM k WHERE k <= 20) SELECT symbol, count(*) FILTER (WHERE close >= open) AS bull, count(*) FILTER (WHERE close < open) AS bear, count(*) FILTER (WHERE volume > 1.5 * mv) AS volume_high, count(*) FILTER (WHERE volume <= 1.5 * mv AND volume >= 0.5 * mv) AS volume_medium, count(*) FILTER (WHERE volume < 0.5 * mv) AS volume_low, round(regr_slope(volume, -k), 6) AS volume_slope, round(avg(close - open), 6) AS speed, round(avg(close - open) FILTER (WHERE k <= 10) - avg(close - open) FILTER (WHERE k > 10), 6) AS acceleration FROM t GROUP BY 1",
)
add(
    "z21_recommend", lambda s, d: models.recommend(hourly(s, d)),
    f"WITH {HOURLY}, g AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars), u AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn, abs(d) AS ab FROM g), m AS (SELECT symbol, ts, close, {roll('avg', 'close', 20)} AS sma_20, {roll('avg', 'close', 50)} AS sma_50, 100 * ({roll('avg', 'up', 14)}) / nullif(({roll('avg', 'up', 14)}) + ({roll('avg', 'dn', 14)}), 0) AS strength, {roll('avg', 'ab', 14)} AS step, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM u"
    " WINDOW r14 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), r20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), r50 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)), s AS (SELECT *, coalesce(sign(sma_20 - sma_50), 0) * 0.5 + coalesce((strength - 50) / 100, 0) AS score FROM m WHERE k = 1)"
    " SELECT symbol, ts, round(close, 6) AS close, round(sma_20, 6) AS sma_20, round(sma_50, 6) AS sma_50, round(strength, 6) AS strength, round(score, 6) AS score, CASE WHEN score > 0.6 THEN 'strong_buy' WHEN score > 0.2 THEN 'buy' WHEN score < -0.6 THEN 'strong_sell' WHEN score < -0.2 THEN 'sell' ELSE 'hold' END AS action, round(close - 2 * CASE WHEN score >= 0 THEN 1 ELSE -1 END * step, 6) AS stop, round(close + 3 * CASE WHEN score >= 0 THEN 1 ELSE -1 END * step, 6) AS take_profit FROM s",
)
