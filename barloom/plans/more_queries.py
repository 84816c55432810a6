"""Further queries over bars, orders and labels, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import rounded
from ..operators import backtest, candles, indicators, joins, labels, recursive, scaling
from ..sources.bars import event_ticks, json_rows
from .bar_queries import hourly
from .event_queries import outcomes, read
from .sql import HOURLY, div, over_bars, roll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TR = "greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s))"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


def on_bars(name: str, op: Callable[[DataFrame], DataFrame], final: dict[str, str], *layers: dict[str, str], **more) -> None:
    add(name, lambda s, d: op(hourly(s, d)).select("symbol", "ts", *final), over_bars(final, *layers, **more))


on_bars("w29n_cross_memory", lambda b: indicators.cross_memory(b, "close", "open"), {"recent_up": "max(up) OVER r5 = 1", "recent_down": "max(dn) OVER r5 = 1"}, {"up": "CAST(coalesce(close > open AND lag(close) OVER s <= lag(open) OVER s, false) AS INTEGER)", "dn": "CAST(coalesce(open > close AND lag(open) OVER s <= lag(close) OVER s, false) AS INTEGER)"}, plain=("recent_up", "recent_down"))
on_bars(
    "w39_crossovers", indicators.confirmed_crossovers, {"confirmed_cross": "CAST(coalesce(lag(x) OVER s, 0) AS INTEGER)"},
    {"f": roll("avg", "close", 5), "w": roll("avg", "close", 20)}, {"x": "CASE WHEN coalesce(f > w AND lag(f) OVER s <= lag(w) OVER s, false) THEN 1 WHEN coalesce(w > f AND lag(w) OVER s <= lag(f) OVER s, false) THEN -1 ELSE 0 END"}, plain=("confirmed_cross",),
)
_RANGE = ({"tr": TR}, {"t": f"({roll('max', 'high', 20)}) + 1.5 * ({roll('avg', 'tr', 20)})", "b": f"({roll('min', 'low', 20)}) - 1.5 * ({roll('avg', 'tr', 20)})"}, {"m": "(t + b) / 2", "w": "t - b"})
on_bars("w29r_adaptive_range", indicators.adaptive_range, {"adaptive_high": "t", "adaptive_low": "b", "adaptive_mid": "m", "adaptive_width": "w"}, *_RANGE)
on_bars("w29q_regime_context", indicators.regime_context, {"macro_position": div("close - b", "w"), "mid_roc_10": div("m - lag(m, 10) OVER s", "lag(m, 10) OVER s"), "mid_roc_50": div("m - lag(m, 50) OVER s", "lag(m, 50) OVER s"), "width_roc": div("w - lag(w, 10) OVER s", "lag(w, 10) OVER s")}, *_RANGE)
add("w29d_momentum_delta", lambda s, d: indicators.momentum_delta(recursive.rsi(hourly(s, d))).select("symbol", "ts", *[f"momentum_delta_{n}" for n in (5, 10, 20)]), None)
add("p03_candle_flags", lambda s, d: candles.averaged_candle_flags(recursive.heikin_ashi(hourly(s, d))).select("symbol", "ts", "ha_kind", "ha_flat_top", "ha_flat_bottom", "ha_body", "ha_small_body", "ha_reversal"), None)
_rev = " + ".join(f"CASE WHEN lead(up, {i + 1}) OVER s <> up THEN {0.8**i} WHEN lead(up, {i + 1}) OVER s IS NOT NULL THEN 0 END" for i in range(5))
on_bars("l12_reversal_labels", lambda b: labels.reversal_labels(b.withColumn("m", F.col("open")), "m"), {"reversal_share": f"({_rev}) / {sum(0.8**i for i in range(5))}"}, {"up": "close >= open"})
_split = "CASE WHEN k - 1 < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN k - 1 < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END"
_SPLIT = f"WITH {HOURLY}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars), sp AS (SELECT *, {_split} AS split FROM k)"


def _ranged(s: SparkSession, d: str) -> DataFrame:
    b = scaling.split_sequential(hourly(s, d))
    return scaling.apply_range(b, scaling.fit_range(b, ("close", "volume")), ("close", "volume"))


_RANGED = _SPLIT + ", f AS (SELECT symbol, 1.2 * quantile_cont(abs(close), 0.95) AS c, 1.2 * quantile_cont(abs(volume), 0.95) AS v FROM sp WHERE split = 'train' GROUP BY 1), g AS (SELECT sp.symbol, sp.ts, sp.split, coalesce(close / nullif(c, 0), 0) AS close, coalesce(volume / nullif(v, 0), 0) AS volume FROM sp JOIN f USING (symbol))"
add("t05_fit_range", lambda s, d: _ranged(s, d).select("symbol", "ts", "split", "close", "volume"), _RANGED + " SELECT symbol, ts, split, round(close, 6) AS close, round(volume, 6) AS volume FROM g")
add(
    "a44_range_drift", lambda s, d: scaling.range_drift(_ranged(s, d), ("close", "volume")),
    _RANGED + ", u AS (SELECT symbol, split, 'close' AS \"column\", close AS x FROM g UNION ALL SELECT symbol, split, 'volume', volume FROM g), a AS (SELECT symbol, split, \"column\", count(*) FILTER (WHERE x > 1 OR x < 0) / count(x) AS sh, max(greatest(x - 1, -x, 0)) AS mo FROM u GROUP BY 1, 2, 3) SELECT symbol, split, \"column\", round(sh, 6) AS share_outside, round(mo, 6) AS max_overshoot, sh > 0.02 AS drifted FROM a",
)
add("a35_dataset_metrics", lambda s, d: scaling.split_sequential(hourly(s, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean"), F.stddev_samp("close").alias("std"), F.min("close").alias("min"), F.max("close").alias("max"), F.percentile("close", F.lit(0.5)).alias("median")), _SPLIT + " SELECT split, count(*) AS n, round(avg(close), 6) AS mean, round(stddev_samp(close), 6) AS std, round(min(close), 6) AS min, round(max(close), 6) AS max, round(median(close), 6) AS median FROM sp GROUP BY 1")
add("a37_consensus", lambda s, d: outcomes(s, d).groupBy("symbol").agg(F.avg("win").alias("share")).select("symbol", F.when(F.col("share") >= 0.5, 1).otherwise(0).alias("majority"), F.greatest("share", 1 - F.col("share")).alias("agreement")), "WITH g AS (SELECT o_orderpriority AS symbol, avg(CAST(o_totalprice > 240000 AS INTEGER)) AS s FROM orders GROUP BY 1) SELECT symbol, CAST(CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS majority, round(greatest(s, 1 - s), 6) AS agreement FROM g")


def _period_pnl(s: SparkSession, d: str) -> DataFrame:
    """By symbol and month the last equity, and what the month brought. A42"""
    e = backtest.equity_curve(outcomes(s, d)).withColumn("period", F.date_trunc("month", "ts"))
    last = e.groupBy("symbol", "period").agg(F.max_by("equity", F.struct("ts", "seq")).alias("equity"))
    before = F.lag("equity").over(Window.partitionBy("symbol").orderBy("period"))
    return last.withColumn("pnl", F.col("equity") - F.coalesce(before, F.lit(0.0)))


add("a42_multi_period_pnl", _period_pnl, "WITH g AS (SELECT o_orderpriority AS symbol, date_trunc('month', o_orderdate) AS period, sum(CASE WHEN o_totalprice > 240000 THEN 1.0 ELSE -1.0 END) AS pnl FROM orders GROUP BY 1, 2) SELECT symbol, period, round(CAST(sum(pnl) OVER (PARTITION BY symbol ORDER BY period) AS DOUBLE), 6) AS equity, round(CAST(pnl AS DOUBLE), 6) AS pnl FROM g")
add(
    "a39_eval_summary", lambda s, d: backtest.eval_summary(labels.mfe_mae(hourly(s, d), 6).withColumn("reward", F.col("mfe") + F.col("mae"))),
    f"WITH {HOURLY}, m AS (SELECT symbol, coalesce((CASE WHEN count(high) OVER f6 = 6 THEN max(high) OVER f6 END - close) / close, 0) AS mfe, coalesce((CASE WHEN count(low) OVER f6 = 6 THEN min(low) OVER f6 END - close) / close, 0) AS mae FROM bars WINDOW f6 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)) SELECT symbol, count(*) AS n, round(avg(mfe + mae), 6) AS avg_reward, round(avg(CAST(mfe + mae > 0 AS DOUBLE)), 6) AS win_rate, round(avg(mfe), 6) AS avg_mfe, round(avg(mae), 6) AS avg_mae, round(avg(mfe / nullif(abs(mae), 0)), 6) AS avg_ratio FROM m GROUP BY 1",
)
add(
    "p26_prediction_confidence", lambda s, d: candles.prediction_confidence(hourly(s, d).select("symbol", "ts", F.array("open", "high", "close").alias("p")), "p").drop("p"),
    f"WITH {HOURLY}, t AS (SELECT symbol, ts, open / (open + high + close) AS a, high / (open + high + close) AS b, close / (open + high + close) AS c FROM bars), q AS (SELECT *, list_sort([a, b, c], 'DESC') AS l FROM t) SELECT symbol, ts, round(l[1], 6) AS confidence, round(l[1] - l[2], 6) AS margin, round(-(a * ln(a) + b * ln(b) + c * ln(c)) / ln(3), 6) AS uncertainty FROM q",
)
add("s13_json_rows", lambda s, d: json_rows(read(s, d, "orders").select("o_orderkey", "o_orderstatus")), "SELECT '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS json FROM orders")
add(
    "j12_ensure_completeness", lambda s, d: joins.ensure_completeness(hourly(s, d).filter("volume > 2").select("symbol", "ts", (F.col("close") * 2).alias("close"), "high"), hourly(s, d).select("symbol", "ts", "close", "volume"), ("symbol", "ts")),
    f"WITH {HOURLY} SELECT symbol, ts, round(CASE WHEN volume > 2 THEN close * 2 ELSE close END, 6) AS close, round(volume, 6) AS volume, round(CASE WHEN volume > 2 THEN high END, 6) AS high FROM bars",
)
add(
    "j10_pair_merge", lambda s, d: hourly(s, d).groupBy("ts").pivot("symbol", ["click", "view"]).agg(F.first("close")).filter("click is not null").select("ts", F.col("click").alias("close_click"), F.col("view").alias("close_view")),
    f"WITH {HOURLY} SELECT c.ts, round(c.close, 6) AS close_click, round(v.close, 6) AS close_view FROM (SELECT * FROM bars WHERE symbol = 'click') c LEFT JOIN (SELECT * FROM bars WHERE symbol = 'view') v ON v.ts = c.ts",
)
add(
    "r02_sliding_bars", lambda s, d: event_ticks(s, d).groupBy("symbol", F.window("ts", "1 day", "12 hours").alias("w")).agg(F.max("price").alias("high"), F.min("price").alias("low"), F.sum("volume").alias("volume")).select("symbol", F.col("w.start").alias("ts"), "high", "low", "volume"),
    "WITH w AS (SELECT event_type AS symbol, unnest([time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOURS]) AS ts, value FROM events) SELECT symbol, ts, round(max(value), 6) AS high, round(min(value), 6) AS low, round(CAST(count(*) AS DOUBLE), 6) AS volume FROM w GROUP BY 1, 2",
)
add(
    "r03_session_bars", lambda s, d: event_ticks(s, d).groupBy("symbol", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("high")).select("symbol", F.col("w.start").alias("ts"), "n", "high"),
    "WITH g AS (SELECT event_type AS symbol, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), i AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT symbol, min(ts) AS ts, count(*) AS n, round(max(value), 6) AS high FROM i GROUP BY symbol, sid",
)
add("o08_except_previous", lambda s, d: read(s, d, "events").select("user_id").distinct().join(read(s, d, "events").filter("event_type = 'error'").select("user_id").distinct(), "user_id", "left_anti"), "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
