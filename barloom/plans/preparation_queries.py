"""Queries of training preparation and forward labels over hourly bars and orders, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import rounded
from ..operators import decisions, labels, preparation, scaling, stats
from .bar_queries import hourly
from .decision_queries import STATE, state
from .event_queries import read
from .sql import HOURLY, div, over_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


# --- labels ---------------------------------------------------------------------------------------------------------
_NEXT = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)"


def _touch(rows: str, close: str, out: str) -> tuple[dict[str, str], dict[str, str]]:
    """Layers that give kind and place of the first touch among ``rows``: by the levels of their first row."""
    return (
        {f"{out}r": f"{rows}[1].r", f"{out}s": f"{rows}[1].s", f"{out}c": close},
        {f"{out}h": f"CASE WHEN {out}r > {out}c AND {out}r > 0 THEN nullif(coalesce(list_position([x.h >= {out}r * CAST(0.997 AS DOUBLE) for x in {rows}], true), 0), 0) END", f"{out}l": f"CASE WHEN {out}s < {out}c AND {out}s > 0 THEN nullif(coalesce(list_position([x.l <= {out}s * CAST(1.003 AS DOUBLE) for x in {rows}], true), 0), 0) END"},
    )


_KIND = lambda x: f"CASE WHEN {x}h IS NOT NULL AND ({x}l IS NULL OR {x}h <= {x}l) THEN 0 WHEN {x}l IS NOT NULL THEN 1 ELSE 2 END"
_A, _B = _touch("ahead2", "close", "p1"), _touch("rest", "mid", "p2")
add(
    "l11_zone_touch_sequence", lambda s, d: labels.zone_touch_sequence(state(hourly(s, d))).select("symbol", "ts", "touch_1", "touch_2"),
    over_bars({"touch_1": "first", "touch_2": _KIND("p2")}, *STATE[:2], {"ahead": f"list({{'h': high, 'l': low, 'c': close, 'r': hi, 's': lo}}) OVER {_NEXT}"}, {"ahead2": "CASE WHEN len(ahead) >= 2 THEN ahead END"}, *_A,
              {"first": _KIND("p1")}, {"place": "CASE first WHEN 0 THEN p1h WHEN 1 THEN p1l END"}, {"rest": "CASE WHEN place IS NOT NULL AND place < len(ahead2) THEN ahead2[place + 1:] END", "mid": "ahead2[place].c"}, *_B, plain=("touch_1", "touch_2")),
)
_F24 = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)"
add("l13_forward_excursion", lambda s, d: labels.forward_excursion(hourly(s, d)).select("symbol", "ts", "forward_move_24", "forward_mfe_24", "forward_mae_24"), over_bars({"forward_move_24": "ahead - close", "forward_mfe_24": "top - close", "forward_mae_24": "close - bottom"}, {"ahead": "lead(close, 24) OVER s", "top": f"max(high) OVER {_F24}", "bottom": f"min(low) OVER {_F24}"}, where="ahead IS NOT NULL"))
_PIVOTS = {f"r{i + 1}": f"hi + {i} * atr" for i in range(3)} | {f"s{i + 1}": f"lo - {i} * atr" for i in range(3)} | {"price_velocity_bull": "greatest(nxt, 0)", "price_velocity_bear": "greatest(-nxt, 0)", "price_velocity_net": "nxt", "volatility_regime": "atr / (close + 1e-6)"}
add("l16_synthesise_pivots", lambda s, d: labels.synthesise_pivots(state(hourly(s, d))).select("symbol", "ts", *_PIVOTS), over_bars(_PIVOTS, *STATE[:2], {"nxt": "coalesce((lead(close) OVER s - close) / close, 0)"}))

# --- columns --------------------------------------------------------------------------------------------------------
_WIDE = ("close", "volume", "gap", "ret_rate", "body_diff", "share")


def _wide(s: SparkSession, d: str) -> DataFrame:
    c, o = F.col("close"), F.col("open")
    return hourly(s, d).withColumns({"gap": c - o, "ret_rate": (c - o) / c, "body_diff": F.abs(c - o), "share": F.abs(c - o) / c, "next_close": c, "note": F.lit("x")})


add("t02_partition_columns", lambda s, d: preparation.partition_columns(_wide(s, d), _WIDE), f"WITH {HOURLY}, e AS (SELECT min(close - open) < -1e-5 AND max(close - open) > 1e-5 AS mixed FROM bars) SELECT u.c AS \"column\", CASE WHEN u.k = 'signed' THEN CASE WHEN mixed THEN 'diff' ELSE 'other' END ELSE u.k END AS \"group\" FROM e, (VALUES ('close', 'price'), ('volume', 'price'), ('gap', 'signed'), ('ret_rate', 'signed'), ('body_diff', 'diff'), ('share', 'other')) u(c, k)")
add("p28_select_features", lambda s, d: preparation.select_features(_wide(s, d), ("volume",)).drop("tf"), over_bars({"open": "open", "high": "high", "low": "low", "close": "close", "gap": "close - open", "ret_rate": "(close - open) / close", "body_diff": "abs(close - open)", "share": "abs(close - open) / close"}))

# --- ranges and the chain -------------------------------------------------------------------------------------------
_SPLIT = "CASE WHEN k0 - 1 < floor(n0 * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN k0 - 1 < floor(n0 * CAST(0.7 AS DOUBLE)) + floor(n0 * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END"
_W = lambda n: f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_RANGES = (
    f"WITH RECURSIVE {HOURLY}, n1 AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, row_number() OVER w AS k, row_number() OVER w AS k0, count(*) OVER (PARTITION BY symbol) AS n0 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),"
    f" n AS (SELECT *, {_SPLIT} AS split, avg(tr) OVER {_W(14)} AS ma, CASE WHEN count(*) OVER {_W(60)} >= 20 THEN max(high) OVER {_W(60)} END AS rh, CASE WHEN count(*) OVER {_W(60)} >= 20 THEN min(low) OVER {_W(60)} END AS rl FROM n1),"
    " rec AS (SELECT n.*, ma AS y FROM n WHERE k = 1 UNION ALL SELECT b.*, b.ma * 2 / 15 + p.y * 13 / 15 FROM rec p JOIN n b ON b.symbol = p.symbol AND b.k = p.k + 1), tr0 AS (SELECT * FROM rec WHERE split = 'train'),"
    " fac AS (SELECT symbol, coalesce(least(greatest(0.5 * (max(close) - min(close)) / nullif(avg(y), 0), 28), 100), 28) AS f FROM tr0 GROUP BY 1), rng AS (SELECT t.symbol, max(rh + f * y) AS hi, min(rl - f * y) AS lo, first(f) AS f FROM tr0 t JOIN fac USING (symbol) GROUP BY 1)"
)
add("t04_structural_range", lambda s, d: preparation.fit_structural_range(scaling.split_sequential(hourly(s, d)), 60).select("symbol", "range_high", "range_low", "range_width", "range_factor"), f"{_RANGES} SELECT symbol, round(hi, 6) AS range_high, round(lo, 6) AS range_low, round(hi - lo, 6) AS range_width, round(f, 6) AS range_factor FROM rng")


def _bodies(s: SparkSession, d: str) -> DataFrame:
    return hourly(s, d).withColumns({"body_diff": F.col("close") - F.col("open"), "span": F.col("high") - F.col("low")})


_COLUMNS = preparation.Columns(volumes=("volume",), scaled=("span",), differences=("body_diff",))
_PLACE = lambda x: f"least(greatest(({x} - lo) / (hi - lo), 0), 1)"
_FITS = "fit AS (SELECT symbol, 1.2 * quantile_cont(abs(volume), 0.95) AS top, avg(high - low) AS me, stddev_pop(high - low) AS sd FROM tr0 GROUP BY 1)"
_OUT = {"open": _PLACE("open"), "high": _PLACE("high"), "low": _PLACE("low"), "close": _PLACE("close"), "volume": "coalesce(volume / nullif(top, 0), 0)", "span": f"1 / (1 + exp(-coalesce({div('high - low - me', 'sd')}, 0)))", "body_diff": "(least(greatest((close - open) / (hi - lo), -1), 1) + 1) / 2"}
add("t09_split_pipeline", lambda s, d: preparation.split_pipeline(_bodies(s, d), _COLUMNS, 60).select("symbol", "ts", "split", *_OUT), f"{_RANGES}, {_FITS} SELECT n.symbol, ts, split, {', '.join(f'round({e}, 6) AS {c}' for c, e in _OUT.items())} FROM n JOIN rng USING (symbol) JOIN fit USING (symbol)")


def _windows(s: SparkSession, d: str) -> DataFrame:
    b = scaling.split_sequential(_bodies(s, d))
    out = preparation.inference_window(b, preparation.fit_normalisation(b, _COLUMNS, 60), _COLUMNS, ("close", "body_diff", "absent"), 10)
    return out.select("symbol", "ts", F.size("window").alias("n"), F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get("window", F.lit(27)).alias("last_close"))


add("t17_inference_window", _windows, f"{_RANGES}, {_FITS}, z AS (SELECT n.symbol, ts, k, n0, {_OUT['close']} AS c, {_OUT['body_diff']} AS b FROM n JOIN rng USING (symbol) JOIN fit USING (symbol)) SELECT symbol, max(ts) AS ts, 30 AS n, round(sum(c + b), 6) AS total, round(max_by(c, k), 6) AS last_close FROM z WHERE k > n0 - 10 GROUP BY 1")


def _back(s: SparkSession, d: str) -> DataFrame:
    b = scaling.split_sequential(hourly(s, d))
    b = b.join(preparation.fit_structural_range(b, 60), "symbol")
    share = (F.col("close") - F.col("range_low")) / F.col("range_width")
    b = b.withColumns({"y": 1 / (1 + F.exp(-2 * (share - 0.5) / 0.5)), "v": share})
    return b.select("symbol", "ts", decisions.denormalise("v", "structural").alias("price"), decisions.denormalise("y", "sigmoid", anchor=F.lit(0.5)).alias("price_by_sigmoid"), decisions.denormalise("v", "range_fraction").alias("points"), decisions.denormalise("v", "return_points").alias("of_close"))


add("p21_denormalise", _back, f"{_RANGES} SELECT symbol, ts, round(close, 6) AS price, round(lo + (0.5 + (close - lo) / (hi - lo) / 1 - 0.5 + ((close - lo) / (hi - lo) - 0.5) * 2 * 1e-8) * (hi - lo), 6) AS price_by_sigmoid, round(close - lo, 6) AS points, round((close - lo) / (hi - lo) * close, 6) AS of_close FROM n JOIN rng USING (symbol)")

# --- stored splits, batches, sequences ------------------------------------------------------------------------------
add("s17_windowed_read", lambda s, d: preparation.windowed_read(preparation.numbered(scaling.split_sequential(hourly(s, d))), "train", 20, 50).select("symbol", "ts", "row", "total"), f"WITH {HOURLY}, l0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k0, count(*) OVER (PARTITION BY symbol) AS n0 FROM bars), l1 AS (SELECT *, {_SPLIT} AS split FROM l0), l2 AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ts, symbol) - 1 AS row, count(*) OVER (PARTITION BY split) AS total FROM l1) SELECT symbol, ts, row, total FROM l2 WHERE split = 'train' AND row >= 20 AND row < 70")
_DIGEST = "md5('7|' || CAST(o_orderkey AS VARCHAR))"
add("t14_shuffle_batches", lambda s, d: preparation.shuffle_batches(read(s, d, "orders").select("o_orderkey"), ("o_orderkey",), 16, 7), f"WITH h AS (SELECT o_orderkey, {_DIGEST} AS g FROM orders), b AS (SELECT *, CAST('0x' || substr(g, 1, 8) AS BIGINT) % 16 AS batch, CAST('0x' || substr(g, 9, 8) AS BIGINT) < {int(0.1 * 2**32)} AS held_back FROM h) SELECT o_orderkey, batch, held_back, CAST(row_number() OVER (PARTITION BY batch ORDER BY g) AS INTEGER) AS place FROM b")


def _sequences(s: SparkSession, d: str) -> DataFrame:
    b = hourly(s, d)
    seq = preparation.reconstruct_sequences(preparation.sequence_refs(b, F.col("close") > F.col("open"), 12), b, ("close",))
    return seq.select("symbol", "ts", F.col("start").cast("int"), F.col("end").cast("int"), F.size("sequence").alias("n"), F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x["close"]).alias("total"), F.element_at("sequence", 1)["close"].alias("first_close"))


add("z12_sequences", _sequences, over_bars({"start": "CAST(greatest(k - 12, 0) AS INTEGER)", "\"end\"": "CAST(k AS INTEGER)", "n": "CAST(c AS INTEGER)", "total": "t", "first_close": "f"}, {"k": "row_number() OVER s", "c": "count(*) OVER r12", "t": "sum(close) OVER r12", "f": "first_value(close) OVER r12"}, where="close > open", plain=("start", "\"end\"", "n")))
add("o04_old_sessions", lambda s, d: preparation.old_sessions(read(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("archived")), F.lit("1997-01-01").cast("timestamp_ntz"), 365).select("o_orderkey", "created_at"), "SELECT o_orderkey, o_orderdate AS created_at FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 365 DAY AND o_orderstatus <> 'F'")


def _signals(s: SparkSession, d: str) -> DataFrame:
    b = hourly(s, d).select("symbol", "tf", "ts", F.when(F.col("close") > F.col("open"), "bounce").otherwise("break").alias("type"), F.lit("up").alias("direction"), F.col("close").alias("price"))
    return preparation.merge_signal_chunks(b.filter(F.hour("ts") < 14), b.filter(F.hour("ts") >= 10)).select("symbol", "ts", "type", "price")


add("a43_merge_signal_chunks", _signals, over_bars({"type": "CASE WHEN close > open THEN 'bounce' ELSE 'break' END", "price": "close"}, plain=("type",)))
add("s18_list_datasets", lambda s, d: preparation.list_datasets(read(s, d, "part").select(F.col("p_partkey").alias("dataset_id"), F.col("p_brand").alias("session_id"), F.col("p_type").alias("source_step"), F.col("p_size").alias("created_at")), session="Brand#23").select("dataset_id", "source_step", "created_at"), "SELECT p_partkey AS dataset_id, p_type AS source_step, p_size AS created_at FROM part WHERE p_brand = 'Brand#23'")

# --- statistics of orders ---------------------------------------------------------------------------------------------
def _orders(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 97).cast("double").alias("cust"), F.dayofmonth("o_orderdate").cast("double").alias("day"))


_ROBUST = " + ".join(f"pow(coalesce(0.6745 * ({c} - m.{c}) / nullif(m.{c}_mad, 0), 0), 2)" for c in ("o_totalprice", "cust", "day"))
_MEDIANS = ", ".join(f"median({c}) AS {c}, mad({c}) AS {c}_mad" for c in ("o_totalprice", "cust", "day"))
add("a18_robust_outliers", lambda s, d: stats.robust_outliers(_orders(s, d), ("o_totalprice", "cust", "day"), "o_orderkey"), f"WITH o AS (SELECT o_orderkey, o_totalprice, CAST(o_custkey % 97 AS DOUBLE) AS cust, CAST(day(o_orderdate) AS DOUBLE) AS day FROM orders), m AS (SELECT {_MEDIANS} FROM o) SELECT o_orderkey, round(sqrt(({_ROBUST.replace('(o_', '(o.o_').replace('(cust -', '(o.cust -').replace('(day -', '(o.day -')}) / 3), 6) AS score, sqrt(({_ROBUST.replace('(o_', '(o.o_').replace('(cust -', '(o.cust -').replace('(day -', '(o.day -')}) / 3) > 3.5 AS outlier FROM o, m")
