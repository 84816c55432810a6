"""Queries over ticks, trades, orders, labels and conversations: joins, footprints, statistics, outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import rounded
from ..operators import backtest, indicators, joins, labels, recursive, scaling, stats, ticks
from ..sources import bars as src
from .bar_queries import hourly
from .sql import HOURLY, TICKS, TRADES, bars, div, roll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


# --- scans ----------------------------------------------------------------------------------------------------------
add("s04_date_extent", lambda s, d: src.date_extent(src.event_ticks(s, d)), f"WITH {TICKS}, l AS (SELECT *, ts < lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS late FROM ticks) SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, count(*) FILTER (WHERE late) AS n_late FROM l GROUP BY 1")
add("s07_dedup_bars", lambda s, d: src.dedup_bars(src.trade_ticks(s, d), "seq").select("symbol", "ts", "price", "volume"), f"WITH {TRADES}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS k FROM trades) SELECT symbol, ts, round(price, 6) AS price, round(volume, 6) AS volume FROM r WHERE k = 1")
add("s15_manifest", lambda s, d: src.manifest(indicators.moving(hourly(s, d)), ("close", "close_sma_20")), f"WITH {HOURLY}, m AS (SELECT close, {roll('avg', 'close', 20)} AS ma FROM bars WINDOW r20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT count(*) AS n_rows, round(count(close) / count(*), 6) AS close_filled, round(count(ma) / count(*), 6) AS close_sma_20_filled FROM m")
add(
    "s16_append_dedup_batch", lambda s, d: src.append_new(read(s, d, "events").filter("event_id % 2 = 0").select("user_id", "event_type"), read(s, d, "events").filter("event_id % 2 = 1").select("user_id", "event_type"), ("user_id", "event_type")).drop("digest"),
    "SELECT DISTINCT user_id, event_type FROM events a WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 2 = 1 AND b.user_id = a.user_id AND b.event_type = a.event_type)",
)
add("s19_json_features", lambda s, d: read(s, d, "events").select("event_id", F.from_json("props", "map<string,double>")["k"].alias("k")), "SELECT event_id, round(CAST(json_extract(props, '$.k') AS DOUBLE), 6) AS k FROM events")


# --- joins ----------------------------------------------------------------------------------------------------------
DAILY = bars("days", "day", "1 day")


def _daily(s: SparkSession, d: str) -> DataFrame:
    return src.resample(src.event_ticks(s, d), "1 day")


add(
    "j01_asof_align", lambda s, d: joins.asof(hourly(s, d).select("symbol", "ts", "close"), _daily(s, d), ("open", "close"), visible_after=F.expr("interval 1 day"), suffix="_1d"),
    f"WITH {HOURLY}, {DAILY} SELECT b.symbol, b.ts, round(b.close, 6) AS close, round(d.open, 6) AS open_1d, round(d.close, 6) AS close_1d FROM bars b ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 1 DAY AS ts, open, close FROM days) d ON d.symbol = b.symbol AND b.ts >= d.ts",
)
add(
    "j03_latest_state_before", lambda s, d: joins.asof(hourly(s, d).select("symbol", "ts", "close"), hourly(s, d).select("symbol", "ts", "close"), ("close",), strict=True, suffix="_before"),
    f"WITH {HOURLY} SELECT symbol, ts, round(close, 6) AS close, round(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 6) AS close_before FROM bars",
)
add(
    "j02_ffill_join", lambda s, d: joins.asof(hourly(s, d).filter("symbol = 'view'").select("symbol", "ts", "close"), hourly(s, d).filter("symbol = 'click'").withColumn("close", F.when(F.hour("ts") % 3 != 0, F.col("close"))).select(F.lit("view").alias("symbol"), "ts", "close"), ("close",), suffix="_other", fill=True),
    f"WITH {HOURLY} SELECT b.symbol, b.ts, round(b.close, 6) AS close, round(o.close, 6) AS close_other FROM (SELECT * FROM bars WHERE symbol = 'view') b ASOF LEFT JOIN (SELECT ts, close FROM bars WHERE symbol = 'click' AND hour(ts) % 3 <> 0) o ON b.ts >= o.ts",
)


def _direction_events(b: DataFrame) -> DataFrame:
    move = F.col("close") - F.col("open")
    return b.filter(F.abs(move) > 20).select("symbol", F.when(move > 0, "bullish").otherwise("bearish").alias("direction"), "ts", F.abs(move).alias("strength"))


_ev = lambda t: f"(SELECT symbol, CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END AS direction, ts, abs(close - open) AS strength FROM {t} WHERE abs(close - open) > 20)"
add(
    "j05_event_pairing", lambda s, d: joins.event_pairing(_direction_events(hourly(s, d)), _direction_events(src.resample(src.event_ticks(s, d), "4 hours"))),
    f"WITH {HOURLY}, four AS (SELECT symbol, '4 hours' AS tf, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '2000-01-01') AS ts, first(price ORDER BY ts, seq) AS open, last(price ORDER BY ts, seq) AS close FROM ticks GROUP BY 1, 2, 3), a AS {_ev('bars')}, b AS {_ev('four')}, "
    "n AS (SELECT *, row_number() OVER () AS one FROM a), m AS (SELECT a.*, b.ts AS h4_ts, b.strength AS h4_strength, row_number() OVER (PARTITION BY a.one ORDER BY b.ts DESC NULLS LAST) AS k FROM n a LEFT JOIN b ON b.symbol = a.symbol AND b.direction = a.direction AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 4 HOURS), p AS (SELECT * FROM m WHERE k = 1) "
    "SELECT symbol, direction, ts, round(strength, 6) AS strength, h4_ts, round(h4_strength, 6) AS h4_strength, round(CASE WHEN h4_ts IS NULL THEN strength ELSE 0.7 * strength + 0.3 * h4_strength END, 6) AS composite FROM p "
    "UNION ALL SELECT b.symbol, b.direction, b.ts, NULL, b.ts, round(b.strength, 6), round(b.strength, 6) FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.symbol = b.symbol AND p.direction = b.direction AND p.h4_ts = b.ts)",
)
add(
    "o06_event_union", lambda s, d: joins.event_union(_direction_events(hourly(s, d)).withColumn("source", F.lit("hour")), _direction_events(_daily(s, d)).drop("strength").withColumn("source", F.lit("day"))),
    f"WITH {HOURLY}, {DAILY}, a AS {_ev('bars')}, b AS {_ev('days')} SELECT symbol, direction, ts, round(strength, 6) AS strength, 'hour' AS source FROM a UNION ALL SELECT symbol, direction, ts, NULL, 'day' FROM b",
)
add(
    "j06_peer_merge", lambda s, d: joins.peer_merge(_daily(s, d).select("symbol", "ts", "open", "close"), hourly(s, d).select("symbol", "ts", F.when(F.col("volume") > 3, F.col("close")).alias("close"), "volume"), ("symbol", "ts")),
    f"WITH {HOURLY}, {DAILY} SELECT coalesce(d.symbol, b.symbol) AS symbol, coalesce(d.ts, b.ts) AS ts, round(d.open, 6) AS open, round(coalesce(CASE WHEN b.volume > 3 THEN b.close END, d.close), 6) AS close, round(b.volume, 6) AS volume FROM days d FULL JOIN bars b ON b.symbol = d.symbol AND b.ts = d.ts",
)


def _zone_levels(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = hourly(s, d)
    points = b.select("symbol", F.col("ts").alias("id"), F.col("close").alias("price"))
    f = indicators.fractals(b)
    levels = f.filter("is_support").select("symbol", F.lit("support").alias("kind"), F.col("low").alias("level")).unionByName(f.filter("is_resistance").select("symbol", F.lit("resistance").alias("kind"), F.col("high").alias("level")))
    return points, levels


_FRACTALS = f"WITH {HOURLY}, f AS (SELECT *, coalesce(low < lag(low) OVER s AND low < lead(low) OVER s AND lead(low) OVER s < lead(low, 2) OVER s AND lag(low) OVER s < lag(low, 2) OVER s, false) AS sup, coalesce(high > lag(high) OVER s AND high > lead(high) OVER s AND lead(high) OVER s > lead(high, 2) OVER s AND lag(high) OVER s > lag(high, 2) OVER s, false) AS res FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts))"
add(
    "j07_nearest_zone", lambda s, d: joins.nearest_levels(*_zone_levels(s, d)),
    _FRACTALS + ", g AS (SELECT b.symbol, b.ts AS id, b.close AS price, (SELECT max(low) FROM f WHERE sup AND f.symbol = b.symbol AND f.low <= b.close) AS support, (SELECT min(high) FROM f WHERE res AND f.symbol = b.symbol AND f.high >= b.close) AS resistance FROM bars b) SELECT symbol, id, round(price, 6) AS price, round(support, 6) AS support, round(resistance, 6) AS resistance, round(least(price - support, resistance - price) / price, 6) AS distance FROM g",
)


def _zones(s: SparkSession, d: str) -> DataFrame:
    one = lambda b, tf: b.select("symbol", F.lit(tf).alias("tf"), F.concat(F.lit(tf + "-"), F.col("ts").cast("string")).alias("zone_id"), F.col("high").alias("price"))
    return one(_daily(s, d), "d").unionByName(one(hourly(s, d), "h"))


add(
    "j09_confluence", lambda s, d: joins.confluence(_zones(s, d)).groupBy("symbol", "tf").agg(F.count(F.lit(1)).alias("zones"), F.sum("hits").alias("hits"), F.max("hits").alias("most")),
    f"WITH {HOURLY}, {DAILY}, z AS (SELECT symbol, 'd' AS tf, ts, high AS price FROM days UNION ALL SELECT symbol, 'h', ts, high FROM bars), c AS (SELECT a.symbol, a.tf, a.ts, (SELECT count(*) FROM z b WHERE b.symbol = a.symbol AND b.tf <> a.tf AND abs(a.price - b.price) <= 0.0015 * a.price) AS hits FROM z a) SELECT symbol, tf, count(*) AS zones, CAST(sum(hits) AS BIGINT) AS hits, max(hits) AS most FROM c GROUP BY 1, 2",
)


def _fills(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders")
    return o.select(F.when(F.col("o_orderpriority") == "1-URGENT", "BTC/USD").otherwise(F.col("o_orderpriority")).alias("symbol"), F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"), F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 7 + 1).alias("qty"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"))


add(
    "j13_fifo_match", lambda s, d: joins.fifo_match(_fills(s, d)),
    "WITH f AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'BTC/USD' ELSE o_orderpriority END AS symbol, o_orderstatus = 'F' AS sell, o_totalprice AS price, CAST(o_custkey % 7 + 1 AS DOUBLE) AS qty, o_orderdate AS ts, o_orderkey AS id FROM orders), "
    "c AS (SELECT *, sum(CASE WHEN sell THEN -1 ELSE 1 END) OVER w AS bal, count(*) FILTER (WHERE sell) OVER w AS sells, count(*) FILTER (WHERE NOT sell) OVER w AS buys FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING)), "
    "l AS (SELECT *, greatest(0, -min(bal) OVER (PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) AS lost FROM c), a AS (SELECT *, lost > coalesce(lag(lost) OVER (PARTITION BY symbol ORDER BY ts, id), 0) AS alone FROM l), "
    "m AS (SELECT s.symbol, s.id, s.ts AS end_time, s.price, s.qty AS sold, b.ts AS opened, b.price AS paid, b.qty AS bought, CASE WHEN contains(s.symbol, '/') THEN 0.9975 ELSE 1.0 END AS fee FROM a s LEFT JOIN a b ON b.symbol = s.symbol AND NOT b.sell AND NOT s.alone AND b.buys = s.sells - s.lost WHERE s.sell) "
    "SELECT symbol, id, CASE WHEN paid IS NULL THEN 'sell' ELSE 'buy' END AS side, coalesce(bought, sold) AS qty, coalesce(opened, end_time) AS start_time, end_time, round(coalesce(paid, price), 6) AS entry_price, round(price, 6) AS exit_price, round(CASE WHEN paid IS NULL THEN 0 ELSE price * sold * fee - paid * bought END, 6) AS pnl, round(CASE WHEN paid IS NULL THEN 0 ELSE 100 * (price * sold * fee - paid * bought) / greatest(paid * bought, 0.01) END, 6) AS pnl_pct FROM m",
)


def _entities(s: SparkSession, d: str) -> DataFrame:
    c = read(s, d, "conversations").select(F.col("conv_id").alias("session"), "turn", "text")
    links = c.select("session", "turn", F.explode(F.split(F.lower("text"), " ")).alias("entity"))
    return joins.entity_context(links, c, ["the", "la", "de"], 3).select("session", "turn", F.length("text").alias("n_chars"), "rank")


add("j14_entity_context", _entities, "WITH c AS (SELECT conv_id AS session, turn, text FROM conversations), a AS (SELECT * FROM c WHERE list_has_any(string_split(lower(text), ' '), ['the', 'la', 'de'])), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS k FROM a) SELECT session, turn, CAST(length(text) AS INTEGER) AS n_chars, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 3")

# --- ticks ----------------------------------------------------------------------------------------------------------
_SIDES = f"{TICKS}, g AS (SELECT *, sign(price - lag(price) OVER w) AS sg FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)), sides AS (SELECT *, coalesce(last_value(nullif(sg, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 1) AS side FROM g)"
_LEVELS = f"{_SIDES}, levels AS (SELECT symbol, date_trunc('day', ts) AS bar, floor(price / 5 + 1e-9) * 5 AS level, sum(CASE WHEN side > 0 THEN volume ELSE 0 END) AS buy, sum(CASE WHEN side < 0 THEN volume ELSE 0 END) AS sell, sum(volume) AS total FROM sides GROUP BY 1, 2, 3)"


def _levels(s: SparkSession, d: str) -> DataFrame:
    return ticks.footprint_levels(src.event_ticks(s, d), "1 day", 5.0)


add("a03_classify_ticks", lambda s, d: ticks.classify(src.event_ticks(s, d)).groupBy("symbol").agg(F.sum("buy_volume").alias("buy"), F.sum("sell_volume").alias("sell")), f"WITH {_SIDES} SELECT symbol, round(sum(CASE WHEN side > 0 THEN volume ELSE 0 END), 6) AS buy, round(sum(CASE WHEN side < 0 THEN volume ELSE 0 END), 6) AS sell FROM sides GROUP BY 1")
add("a04_footprint", lambda s, d: ticks.footprint(_levels(s, d)), f"WITH {_LEVELS} SELECT symbol, bar, round(first(level ORDER BY total DESC, level), 6) AS poc, round(sum(buy - sell), 6) AS delta, round(sum(total), 6) AS volume, count(*) AS n_levels FROM levels GROUP BY 1, 2")
add("a05_value_area", lambda s, d: ticks.value_area(_levels(s, d)), None)
add("a06_imbalance", lambda s, d: ticks.imbalance(_levels(s, d)), f"WITH {_LEVELS}, n AS (SELECT *, lead(sell) OVER (PARTITION BY symbol, bar ORDER BY level) AS up FROM levels) SELECT symbol, bar, round(max(greatest(buy / nullif(up, 0), up / nullif(buy, 0))), 6) AS max_imbalance FROM n GROUP BY 1, 2")


def _profile(s: SparkSession, d: str) -> DataFrame:
    b = hourly(s, d)
    levels = _daily(s, d).select("symbol", F.col("ts").alias("level_id"), F.col("close").alias("price"))
    return ticks.volume_at_levels(b, levels, 10.0)


add("a07_volume_profile_at_level", _profile, f"WITH {HOURLY}, {DAILY} SELECT d.symbol, d.ts AS level_id, round(d.close, 6) AS price, round(sum(b.volume), 6) AS total_volume, round(sum(CASE WHEN b.close > b.open THEN b.volume ELSE 0 END), 6) AS up_volume, round(sum(CASE WHEN b.close < b.open THEN b.volume ELSE 0 END), 6) AS down_volume, round(sum(CASE WHEN b.close > b.open THEN b.volume WHEN b.close < b.open THEN -b.volume ELSE 0 END), 6) AS net_volume FROM days d JOIN bars b ON b.symbol = d.symbol AND b.low <= d.close AND d.close <= b.high GROUP BY 1, 2, 3")

# --- statistics -----------------------------------------------------------------------------------------------------
COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LONG = f"u AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS col, {c} AS x FROM lineitem' for c in COLS)})"
_LONG2 = _LONG.replace(" AS col,", ' AS "column",')
add(
    "a08_describe", lambda s, d: stats.describe(lineitem(s, d), COLS),
    f'WITH {_LONG2}, g AS (SELECT "column", count(x) AS n, count(*) AS r, avg(x) AS m, stddev_samp(x) AS sd, var_samp(x) AS v, min(x) AS mn, max(x) AS mx, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, exp(avg(CASE WHEN x > 0 THEN ln(x) END)) AS gm, 1 / avg(CASE WHEN x > 0 THEN 1 / x END) AS hm, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4, quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99 FROM u GROUP BY 1) '
    'SELECT "column", n AS count, round(100 * (1 - n / r), 6) AS missing_pct, round(m, 6) AS mean, round(q2, 6) AS median, round(sd, 6) AS std, round(v, 4) AS variance, round(mn, 6) AS min, round(mx, 6) AS max, round(q1, 6) AS q1, round(q3, 6) AS q3, round(sd / abs(m), 6) AS cv, round(sd / sqrt(n), 6) AS sem, round(gm, 6) AS geometric_mean, round(hm, 6) AS harmonic_mean, round(p1, 6) AS p1, round(p5, 6) AS p5, round(p95, 6) AS p95, round(p99, 6) AS p99, round(mx - mn, 6) AS "range", round(q3 - q1, 6) AS iqr, round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence FROM g',
)
QUERIES["a08_describe"] = lambda s, d: rounded(stats.describe(lineitem(s, d), COLS).drop("skewness", "kurtosis").withColumn("variance", F.round("variance", 4)))
add("a08_mode", lambda s, d: stats.mode(lineitem(s, d), COLS), f'WITH {_LONG2}, c AS (SELECT "column", x, count(*) AS n FROM u GROUP BY 1, 2) SELECT "column", round(first(x ORDER BY n DESC, x), 6) AS mode, max(n) AS times FROM c GROUP BY 1')
add("a08_mad", lambda s, d: stats.mad(lineitem(s, d), COLS), f'WITH {_LONG2} SELECT "column", round(mad(x), 6) AS mad FROM u GROUP BY 1')
add("a08_trimmed_mean", lambda s, d: stats.trimmed_mean(lineitem(s, d), COLS), f'WITH {_LONG2}, b AS (SELECT "column", quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM u GROUP BY 1) SELECT "column", round(avg(CASE WHEN x BETWEEN lo AND hi THEN x END), 6) AS trimmed_mean, round(avg(least(greatest(x, lo), hi)), 6) AS winsorised_mean FROM u JOIN b USING ("column") GROUP BY 1')
_HIST = f'{_LONG2}, e AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM u GROUP BY 1), h AS (SELECT "column", CAST(least(floor((x - lo) * 20 / (hi - lo)), 19) AS BIGINT) AS bin, count(*) AS n FROM u JOIN e USING ("column") GROUP BY 1, 2)'
add("a10_histogram", lambda s, d: stats.histogram(lineitem(s, d), COLS), f"WITH {_HIST} SELECT * FROM h")
add("a10_distribution", lambda s, d: stats.distribution(lineitem(s, d), COLS).select("column", "entropy"), f'WITH {_HIST}, t AS (SELECT "column", n / sum(n) OVER (PARTITION BY "column") AS p FROM h) SELECT "column", round(sum(-p * ln(p)), 6) AS entropy FROM t GROUP BY 1')
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM lineitem" for i, a in enumerate(COLS) for b in COLS[i + 1 :])
add("a11_correlation", lambda s, d: stats.correlation_pairs(lineitem(s, d), COLS), f"WITH p AS ({_PAIRS}) SELECT a, b, round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM p")
add("a12_strong_pairs", lambda s, d: stats.strong_pairs(stats.correlation_pairs(lineitem(s, d), COLS)).select("a", "b", "r", "strength"), f"WITH p AS ({_PAIRS}) SELECT a, b, round(r, 6) AS r, CASE WHEN abs(r) > 0.9 THEN 'very strong' WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM p WHERE abs(r) > 0.5")
add("a14_partial_correlation", lambda s, d: stats.partial_correlations(lineitem(s, d), COLS), None)
add("a15_vif", lambda s, d: stats.vif(lineitem(s, d), COLS), None)
add(
    "a16_outliers", lambda s, d: stats.outliers(lineitem(s, d), COLS),
    f'WITH {_LONG2}, g AS (SELECT "column", avg(x) AS m, stddev_pop(x) AS sd, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, mad(x) AS md FROM u GROUP BY 1) SELECT "column", count(x) AS n, count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS iqr, count(*) FILTER (WHERE x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1)) AS tukey, count(*) FILTER (WHERE abs((x - m) / nullif(sd, 0)) > 3) AS z, count(*) FILTER (WHERE abs(0.6745 * (x - q2) / nullif(md, 0)) > 3.5) AS modified_z FROM u JOIN g USING ("column") GROUP BY 1',
)
add("a17_mahalanobis", lambda s, d: stats.mahalanobis(lineitem(s, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), COLS, "id"), None)
add("a19_jarque_bera", lambda s, d: stats.jarque_bera(lineitem(s, d), COLS), None)
add(
    "a22_anova", lambda s, d: stats.anova(lineitem(s, d), "l_returnflag", "l_extendedprice"),
    "WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS grand, sum((n - 1) * v) AS w FROM g), b AS (SELECT sum(g.n * (m - grand) * (m - grand)) AS b FROM g, t) SELECT CAST(n AS BIGINT) AS n, k, round((b / (k - 1)) / (w / (n - k)), 4) AS f_statistic FROM t, b",
)
QUERIES["a22_anova"] = lambda s, d: stats.anova(lineitem(s, d), "l_returnflag", "l_extendedprice").withColumn("f_statistic", F.round("f_statistic", 4))
add("a23_mean_interval", lambda s, d: stats.mean_interval(lineitem(s, d), "l_returnflag", "l_quantity"), "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS low, round(avg(l_quantity) + 1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS high FROM lineitem GROUP BY 1")
add("a24_cohens_d", lambda s, d: stats.cohens_d(lineitem(s, d), "l_returnflag", "l_quantity"), "WITH g AS (SELECT l_returnflag AS k, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), p AS (SELECT a.k AS a, b.k AS b, (a.m - b.m) / sqrt((a.v + b.v) / 2) AS d FROM g a JOIN g b ON a.k < b.k) SELECT a, b, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM p")
add("a21_mutual_information", lambda s, d: stats.mutual_information(read(s, d, "lineitem"), "l_returnflag", "l_linestatus"), "WITH j AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS nt FROM j) SELECT round(sum(n / nt * ln(n * nt / (na * nb))), 6) AS mi FROM k")
add(
    "a26_breusch_pagan", lambda s, d: stats.breusch_pagan(lineitem(s, d), "l_returnflag", "l_discount", "l_tax"),
    "WITH f AS (SELECT l_returnflag AS g, regr_slope(l_tax, l_discount) AS b, regr_intercept(l_tax, l_discount) AS a FROM lineitem GROUP BY 1), e AS (SELECT l_returnflag, l_discount AS x, power(l_tax - a - b * l_discount, 2) AS e2 FROM lineitem JOIN f ON g = l_returnflag) SELECT l_returnflag, round(regr_r2(e2, x) * count(*), 6) AS bp FROM e GROUP BY 1",
)
_Q = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\" FROM lineitem" for c in COLS)
add("a30_data_quality", lambda s, d: stats.data_quality(lineitem(s, d), COLS), f'WITH q AS ({_Q}) SELECT *, "distinct" <= 1 AS constant, missing > 0.5 * n AS mostly_missing FROM q')
add("a30_duplicate_rows", lambda s, d: stats.duplicate_rows(read(s, d, "lineitem"), ("l_quantity", "l_discount", "l_tax")), "WITH g AS (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity, l_discount, l_tax) SELECT CAST(sum(c - 1) AS BIGINT) AS duplicates FROM g")
add("a34_class_imbalance", lambda s, d: stats.class_imbalance(read(s, d, "labels"), "toxic"), "WITH g AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), r AS (SELECT *, max(n) OVER () / min(n) OVER () AS ratio FROM g) SELECT toxic, n, round(ratio, 6) AS ratio, CASE WHEN ratio < 1.5 THEN 'balanced' WHEN ratio < 3 THEN 'mild' WHEN ratio < 10 THEN 'moderate' ELSE 'severe' END AS severity FROM r")
add("a36_risk_metrics", lambda s, d: stats.risk_metrics(hourly(s, d)), f"WITH {HOURLY}, r AS (SELECT symbol, close, ln(close / lag(close) OVER w) AS r, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS top FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, round(stddev_samp(r) * sqrt(8760), 6) AS annual_vol, round(min((close - top) / top), 6) AS max_drawdown FROM r GROUP BY 1")
_MOVES = " UNION ALL ".join(f"SELECT symbol, {n} AS horizon, lead(close, {n}) OVER (PARTITION BY symbol ORDER BY ts) - close AS move FROM bars" for n in (1, 3, 6, 12))
add("a40_horizon_distribution", lambda s, d: stats.horizon_distribution(hourly(s, d)), f"WITH {HOURLY}, m AS ({_MOVES}) SELECT symbol, horizon, count(*) FILTER (WHERE move > 0) AS bull, count(*) FILTER (WHERE move < 0) AS bear, round(avg(move), 6) AS mean_move, round(stddev_samp(move), 6) AS std_move FROM m GROUP BY 1, 2")


# --- outcomes -------------------------------------------------------------------------------------------------------
def outcomes(s: SparkSession, d: str) -> DataFrame:
    """``orders`` as trades: won where the total price is over 240000."""
    o = read(s, d, "orders")
    return o.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus").alias("horizon"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") > 240_000).cast("int").alias("win"))


_OUT = "o AS (SELECT o_orderpriority AS symbol, o_orderstatus AS horizon, o_orderdate AS ts, o_orderkey AS seq, CAST(o_totalprice > 240000 AS INTEGER) AS win FROM orders)"
_RUNS = f"{_OUT}, c AS (SELECT *, coalesce(CAST(win <> lag(win) OVER w AS INTEGER), 1) AS ch FROM o WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)), runs AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM c)"
add("b01_streak_stats", lambda s, d: backtest.streak_stats(outcomes(s, d)), f"WITH {_RUNS}, e AS (SELECT symbol, run, first(win) AS win, count(*) AS n FROM runs GROUP BY 1, 2) SELECT symbol, max(n) FILTER (WHERE win = 1) AS max_win_run, round(avg(n) FILTER (WHERE win = 1), 6) AS avg_win_run, count(*) FILTER (WHERE win = 1) AS n_win_runs, max(n) FILTER (WHERE win = 0) AS max_loss_run, round(avg(n) FILTER (WHERE win = 0), 6) AS avg_loss_run, count(*) FILTER (WHERE win = 0) AS n_loss_runs, arg_max(CASE WHEN win = 1 THEN n ELSE -n END, run) AS last_run FROM e GROUP BY 1")
add("b02_rolling_win_rate", lambda s, d: backtest.rolling_win_rate(outcomes(s, d)), f"WITH {_OUT}, r AS (SELECT symbol, CASE WHEN count(win) OVER w = 20 THEN avg(win) OVER w END AS rate FROM o WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT symbol, round(min(rate), 6) AS min_rate, round(avg(rate), 6) AS mean_rate, round(max(rate), 6) AS max_rate FROM r GROUP BY 1")
add("b03_quartile_win_rate", lambda s, d: backtest.block_win_rate(outcomes(s, d)), f"WITH {_OUT}, k AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // (count(*) OVER (PARTITION BY symbol) // 4) AS block FROM o) SELECT symbol, block, round(avg(win), 6) AS win_rate, count(*) AS n FROM k WHERE block < 4 GROUP BY 1, 2")
_EQ = "sum(CASE WHEN win = 1 THEN size ELSE -size END) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"
add(
    "b04_equity_curve", lambda s, d: backtest.equity_curve(outcomes(s, d), step=True).select("symbol", "seq", "size", "equity", "drawdown"),
    f"WITH {_RUNS}, l AS (SELECT *, CASE WHEN win = 0 THEN row_number() OVER (PARTITION BY symbol, run ORDER BY ts, seq) ELSE 0 END AS losses FROM runs), z AS (SELECT *, power(2, coalesce(lag(losses) OVER (PARTITION BY symbol ORDER BY ts, seq), 0) % 4) AS size FROM l), e AS (SELECT *, {_EQ} AS equity FROM z) SELECT symbol, seq, round(size, 6) AS size, round(equity, 6) AS equity, round(equity - greatest(max(equity) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0), 6) AS drawdown FROM e",
)
add("b05_portfolio_report", lambda s, d: backtest.portfolio_report(outcomes(s, d)), f"WITH {_OUT} SELECT symbol, horizon, count(*) AS trades, CAST(sum(win) AS BIGINT) AS wins, round(100 * avg(win), 6) AS win_pct, grouping(symbol, horizon) AS level FROM o GROUP BY ROLLUP (symbol, horizon)")
add("b06_win_loss_by_key", lambda s, d: backtest.win_loss_by_key(outcomes(s, d), ("symbol", "horizon")), f"WITH {_OUT} SELECT symbol, horizon, count(*) FILTER (WHERE win = 1) AS wins, count(*) FILTER (WHERE win = 0) AS losses FROM o GROUP BY 1, 2")
add(
    "a38_performance_summary", lambda s, d: backtest.performance_summary(read(s, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") - 240_000).alias("reward"))),
    "WITH o AS (SELECT o_orderpriority AS symbol, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice - 240000 END AS reward FROM orders) SELECT symbol, count(*) AS trades, count(*) FILTER (WHERE reward > 0) AS wins, count(*) FILTER (WHERE reward <= 0) AS losses, round(100 * count(*) FILTER (WHERE reward > 0) / count(*), 6) AS win_pct FROM o GROUP BY 1",
)
_ACTIONS = lambda b: b.withColumn("action", F.when(F.hour("ts") % 5 == 0, 1).when(F.hour("ts") % 7 == 0, -1).otherwise(0))
add("l15_expiry_outcome", lambda s, d: recursive.non_overlapping(_ACTIONS(hourly(s, d)), 6).select("symbol", "ts", "taken", "won"), None)
add("l14_forward_outcome", lambda s, d: labels.forward_outcome(_ACTIONS(hourly(s, d)).filter("action <> 0").select("symbol", "tf", "ts", F.col("action").alias("side")), hourly(s, d), (3, 6), 1.0).drop("tf"), f"WITH {HOURLY}, f AS (SELECT *, CASE WHEN hour(ts) % 5 = 0 THEN 1 WHEN hour(ts) % 7 = 0 THEN -1 ELSE 0 END AS side, " + ", ".join(f"CASE WHEN count(high) OVER f{n} = {n} THEN max(high) OVER f{n} END AS h{n}, CASE WHEN count(low) OVER f{n} = {n} THEN min(low) OVER f{n} END AS l{n}, lead(close, {n}) OVER s AS c{n}" for n in (3, 6)) + " FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts), f3 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), f6 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)) " + " UNION ALL ".join(f"SELECT symbol, ts, CAST(side AS INTEGER) AS side, {n} AS horizon, round(CASE WHEN side > 0 THEN h{n} - close ELSE close - l{n} END, 6) AS mfe_pips, round(CASE WHEN side > 0 THEN close - l{n} ELSE h{n} - close END, 6) AS mae_pips, round(side * (c{n} - close), 6) AS net_pips, round(tanh(side * (c{n} - close) / 20), 6) AS reward FROM f WHERE side <> 0" for n in (3, 6)))

# --- sorts and limits -----------------------------------------------------------------------------------------------
add("o02_latest_trades", lambda s, d: outcomes(s, d).orderBy(F.desc("ts"), F.desc("seq")).limit(50).select("symbol", "ts", "seq", "win"), f"WITH {_OUT} SELECT symbol, ts, seq, win FROM o ORDER BY ts DESC, seq DESC LIMIT 50")
add("o05_session_messages", lambda s, d: read(s, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n_chars")).orderBy("conv_id", "turn"), "SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS n_chars FROM conversations ORDER BY conv_id, turn")


# --- the flagship: ticks, two timeframes as-of, indicators, labels, split, summary ------------------------------------
def flagship_rows(s: SparkSession, d: str) -> DataFrame:
    b = indicators.returns(indicators.bollinger(indicators.price_basics(hourly(s, d))))
    b = joins.asof(b, _daily(s, d), ("close",), visible_after=F.expr("interval 1 day"), suffix="_1d")
    return scaling.split_sequential(labels.mfe_mae(b, 24))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """By symbol and split: rows, and means of features, of the higher timeframe's distance and of labels."""
    m = lambda c, n: F.avg(c).alias(n)
    return rounded(flagship_rows(s, d).groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n"), m("bb_width", "bb_width"), m("zscore", "zscore"), m(F.col("close") - F.col("close_1d"), "above_day"), m("mfe", "mfe"), m("mae", "mae")))


QUERIES["flagship_dataset"] = flagship
SQL["flagship_dataset"] = (
    f"WITH {HOURLY}, {DAILY}, f AS (SELECT *, {div('4 * (' + roll('stddev_pop', 'close', 20) + ')', roll('avg', 'close', 20))} AS bb, {div('close - (' + roll('avg', 'close', 14) + ')', roll('stddev_samp', 'close', 14))} AS zs, coalesce((CASE WHEN count(high) OVER f24 = 24 THEN max(high) OVER f24 END - close) / close, 0) AS mfe, coalesce((CASE WHEN count(low) OVER f24 = 24 THEN min(low) OVER f24 END - close) / close, 0) AS mae, row_number() OVER s AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars"
    " WINDOW s AS (PARTITION BY symbol ORDER BY ts), r14 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), r20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f24 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)), "
    "a AS (SELECT f.*, d.close AS close_1d FROM f ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 1 DAY AS ts, close FROM days) d ON d.symbol = f.symbol AND f.ts >= d.ts), g AS (SELECT *, CASE WHEN k - 1 < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN k - 1 < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM a) "
    "SELECT symbol, split, count(*) AS n, round(avg(bb), 6) AS bb_width, round(avg(zs), 6) AS zscore, round(avg(close - close_1d), 6) AS above_day, round(avg(mfe), 6) AS mfe, round(avg(mae), 6) AS mae FROM g GROUP BY 1, 2"
)
_SKEWED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
add(
    "a31_power_transform_hint", lambda s, d: stats.power_transform_hint(lineitem(s, d), _SKEWED),
    "WITH m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS x FROM lineitem" for c in _SKEWED) + "), a AS (SELECT *, avg(x) OVER (PARTITION BY name) AS mean FROM m), k AS (SELECT name, avg(power(x - mean, 3)) / power(avg(power(x - mean, 2)), 1.5) AS skew FROM a GROUP BY 1) SELECT name AS column, round(skew, 6) AS skew, CASE WHEN abs(skew) > 1 THEN 'log or Box-Cox' END AS hint FROM k",
)
