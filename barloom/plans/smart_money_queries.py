"""Queries over order blocks, confirmed breaks and structure features of hourly bars, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import last_rows, rounded
from ..operators import movement, order_blocks, zone_bars
from ..operators.indicators import fractals
from ..operators.structure import swing_points
from .bar_queries import hourly
from .sql import HOURLY
from .structure_queries import swings_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir).drop("tf"))
    if sql is not None:
        SQL[name] = sql


def first(bar: str, of: str, after: str, condition: str) -> str:
    return f"(SELECT min({bar}.ts) FROM bars {bar} WHERE {bar}.symbol = {of}.symbol AND {bar}.ts > {after} AND ({condition}))"


#: Candles keep one block; what is left of an upward one under a downward one is whether it was mitigated and removed.
_BLOCKS = f"""
sw AS (SELECT symbol, ts, swing AS side, lead(ts) OVER (PARTITION BY symbol, swing ORDER BY ts) AS until, CASE WHEN swing = 1 THEN high ELSE low END AS price, high, low FROM swings WHERE swing <> 0),
br AS (SELECT *, {first("b", "sw", "sw.ts", "side = 1 AND b.close > sw.price OR side = -1 AND b.close < sw.price")} AS created_at FROM sw),
bk AS (SELECT * FROM br WHERE created_at IS NOT NULL AND (until IS NULL OR created_at <= until)),
cd AS (SELECT bk.symbol, bk.side, bk.created_at, coalesce(any_value(c.ts), bk.ts) AS ts FROM bk LEFT JOIN LATERAL (SELECT b.ts FROM bars b WHERE b.symbol = bk.symbol AND b.ts > bk.ts AND b.ts < bk.created_at ORDER BY CASE WHEN bk.side = 1 THEN b.low ELSE -b.high END, b.ts DESC LIMIT 1) c ON true GROUP BY bk.symbol, bk.side, bk.created_at, bk.ts),
vl AS (SELECT symbol, ts, volume + coalesce(lag(volume) OVER w, 0) AS two, coalesce(lag(volume, 2) OVER w, 0) AS one FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
ob AS (SELECT cd.*, b.high, b.low, two + one AS vol, CASE WHEN greatest(two, one) <> 0 THEN 100.0 * least(two, one) / greatest(two, one) ELSE 100 END AS pct FROM cd JOIN bars b ON b.symbol = cd.symbol AND b.ts = cd.ts JOIN vl ON vl.symbol = cd.symbol AND vl.ts = cd.created_at),
mi AS (SELECT *, {first("b", "ob", "ob.created_at", "side = 1 AND b.low < ob.low OR side = -1 AND b.high > ob.high")} AS mitigated_at FROM ob),
ea AS (SELECT *, CASE WHEN side = -1 THEN max(CASE WHEN side = 1 THEN mitigated_at END) OVER (PARTITION BY symbol, ts) END AS earlier FROM mi),
fr AS (SELECT *, CASE WHEN earlier IS NOT NULL THEN created_at ELSE mitigated_at END AS breaker_from FROM ea),
re AS (SELECT *, {first("b", "fr", "fr.breaker_from", "side = 1 AND b.high > fr.high OR side = -1 AND b.low < fr.low")} AS removed_at FROM fr),
blocks AS (SELECT * REPLACE (CASE WHEN earlier IS NULL THEN mitigated_at WHEN gone IS NULL THEN earlier END AS mitigated_at) FROM (SELECT *, max(CASE WHEN side = 1 THEN removed_at END) OVER (PARTITION BY symbol, ts) AS gone, side = 1 AND min(side) OVER (PARTITION BY symbol, ts) < 0 AS replaced FROM re) WHERE NOT replaced)"""
_BREAKS = f"""
nx AS (SELECT symbol, ts, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS known FROM bars),
z AS (SELECT symbol, ts, swing, lvl AS d, lag(lvl, 3) OVER w AS a, lag(lvl, 2) OVER w AS b, lag(lvl, 1) OVER w AS c, lag(ts) OVER w AS at FROM swings WHERE swing <> 0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
y AS (SELECT *, CASE WHEN swing = 1 AND a < c AND c < b AND b < d THEN 1 WHEN swing = -1 AND a > c AND c > b AND b > d THEN -1 ELSE 0 END AS bos, CASE WHEN swing = 1 AND d > b AND b > a AND a > c THEN 1 WHEN swing = -1 AND d < b AND b < a AND a < c THEN -1 ELSE 0 END AS choch FROM z),
ev AS (SELECT y.symbol, y.at AS ts, known, bos, choch, CASE WHEN bos <> 0 THEN bos ELSE choch END AS side, b AS price FROM y JOIN nx ON nx.symbol = y.symbol AND nx.ts = y.at WHERE bos <> 0 OR choch <> 0),
eb AS (SELECT *, {first("b", "ev", "ev.known", "side = 1 AND b.close > ev.price OR side = -1 AND b.close < ev.price")} AS broken_at FROM ev),
breaks AS (SELECT * FROM eb WHERE broken_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM eb l WHERE l.symbol = eb.symbol AND l.ts > eb.ts AND l.broken_at <= eb.broken_at))"""
add(
    "w43_order_blocks", lambda s, d: order_blocks.order_blocks(swing_points(hourly(s, d))),
    f"{swings_sql()}, {_BLOCKS} SELECT symbol, ts, CAST(side AS INTEGER) AS ob, round(high, 6) AS ob_top, round(low, 6) AS ob_bottom, round(vol, 6) AS ob_volume, round(pct, 6) AS ob_percentage, created_at, mitigated_at, removed_at FROM blocks",
)
add(
    "w42_confirmed_breaks", lambda s, d: order_blocks.confirmed_breaks(swing_points(hourly(s, d))),
    f"{swings_sql()}, {_BREAKS} SELECT symbol, ts, CAST(bos AS INTEGER) AS bos, CAST(choch AS INTEGER) AS choch, round(price, 6) AS broken_level, broken_at FROM breaks",
)
_POOLS = "".join(
    f", s{i} AS (SELECT symbol, ts, swing, lvl, (max(lvl) OVER (PARTITION BY symbol) - min(lvl) OVER (PARTITION BY symbol)) * {share} AS width FROM swings WHERE swing <> 0), g{i} AS (SELECT *, coalesce(CAST(lvl - lag(lvl) OVER w > width AS INTEGER), 1) AS nw FROM s{i} WINDOW w AS (PARTITION BY symbol, swing ORDER BY lvl, ts)),"
    f" p{i} AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, swing ORDER BY lvl, ts ROWS UNBOUNDED PRECEDING) AS pool FROM g{i}), o{i} AS (SELECT symbol, min(ts) AS ts, -swing AS liquidity, avg(lvl) AS level, {share} AS share FROM p{i} GROUP BY symbol, swing, pool HAVING count(*) > 1)"
    for i, share in enumerate(order_blocks.POOL_SHARES)
)
_GAPS = """, fg AS (SELECT *, lag(high) OVER s < lead(low) OVER s AND close > open AS up, lag(low) OVER s > lead(high) OVER s AND close < open AS dn, lag(high) OVER s AS ph, lag(low) OVER s AS pl, lead(high) OVER s AS nh, lead(low) OVER s AS nl, lead(ts) OVER s AS kt FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
gk AS (SELECT symbol, ts, kt, CASE WHEN up THEN 1 ELSE -1 END AS fvg, CASE WHEN up THEN nl ELSE pl END AS top, CASE WHEN up THEN ph ELSE nh END AS bot FROM fg WHERE up OR dn),
gaps AS (SELECT *, (SELECT min(b.ts) FROM bars b WHERE b.symbol = gk.symbol AND b.ts > gk.kt AND (fvg = 1 AND b.close < bot OR fvg = -1 AND b.close > top)) AS mitigated_at FROM gk)"""
_FILLED = "last_value({} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - close"
_COLUMNS = {"fvg": "g.fvg", "fvg_top": "g.top", "fvg_bottom": "g.bot", "ob_top": "o.high", "ob_bottom": "o.low", "swing_level": "lvl", "liquidity_level": "q.level"}
add(
    "w46_smc_features", lambda s, d: order_blocks.smc_features(hourly(s, d)).select("symbol", "ts", "swing", "swing_level", "fvg", "fvg_top", "fvg_bottom", "fvg_mitigated_at", "ob", "ob_top", "ob_bottom", "ob_volume", "ob_percentage", "ob_mitigated_at", "bos", "choch", "broken_level", "broken_at", "liquidity", "liquidity_level", *[f"{c}_diff" for c in _COLUMNS]),
    f"{swings_sql(by_size=True)}, {_BLOCKS}, {_BREAKS}{_POOLS}, al AS (SELECT *, min(share) OVER (PARTITION BY symbol) AS least FROM ({' UNION ALL '.join(f'SELECT * FROM o{i}' for i in range(len(order_blocks.POOL_SHARES)))})), pools AS (SELECT * FROM al WHERE share = least){_GAPS}, live AS (SELECT * FROM blocks WHERE removed_at IS NULL),"
    f" jo AS (SELECT s.symbol, s.ts, s.close, CAST(nullif(swing, 0) AS INTEGER) AS swing, CAST(g.fvg AS INTEGER) AS fvg, g.mitigated_at AS fvg_mitigated_at, CAST(o.side AS INTEGER) AS ob, o.vol AS ob_volume, o.pct AS ob_percentage, o.mitigated_at AS ob_mitigated_at, CAST(nullif(k.bos, 0) AS INTEGER) AS bos, CAST(nullif(k.choch, 0) AS INTEGER) AS choch, k.price AS broken_level, k.broken_at, CAST(q.liquidity AS INTEGER) AS liquidity, {', '.join(f'{e} AS {c}' for c, e in _COLUMNS.items() if c != 'fvg')}"
    f" FROM swings s LEFT JOIN gaps g ON g.symbol = s.symbol AND g.ts = s.ts LEFT JOIN live o ON o.symbol = s.symbol AND o.ts = s.ts LEFT JOIN breaks k ON k.symbol = s.symbol AND k.ts = s.ts LEFT JOIN pools q ON q.symbol = s.symbol AND q.ts = s.ts)"
    f" SELECT symbol, ts, swing, fvg, fvg_mitigated_at, ob, round(ob_volume, 6) AS ob_volume, round(ob_percentage, 6) AS ob_percentage, ob_mitigated_at, bos, choch, round(broken_level, 6) AS broken_level, broken_at, liquidity, {', '.join(f'round({c}, 6) AS {c}' for c in _COLUMNS if c != 'fvg')}, {', '.join(f'round({_FILLED.format(c)}, 6) AS {c}_diff' for c in _COLUMNS)} FROM jo",
)


def level_signals(bars: DataFrame) -> DataFrame:
    """Bounces at five-bar fractals, and closes beyond the extremes of the twenty bars before."""
    before = last_rows(21).rowsBetween(-20, -1)
    f = fractals(bars).withColumns({"_h": F.max("high").over(before), "_l": F.min("low").over(before)})
    kind = F.when(F.col("is_support"), "bounce_support").when(F.col("is_resistance"), "bounce_resistance").when(F.col("close") > F.col("_h"), "breakout_resistance").when(F.col("close") < F.col("_l"), "breakout_support")
    level = F.when(F.col("is_support"), F.col("low")).when(F.col("is_resistance"), F.col("high")).when(F.col("close") > F.col("_h"), F.col("_h")).otherwise(F.col("_l"))
    return f.select("symbol", "tf", "ts", kind.alias("signal_type"), level.alias("level_price")).filter("signal_type is not null")


_BODY, _UPPER, _LOWER = "abs(close - open) / nullif(high - low, 0)", "(high - greatest(open, close)) / nullif(high - low, 0)", "(least(open, close) - low) / nullif(high - low, 0)"
_CANDLES = {
    "doji_count": f"{_BODY} <= 0.1", "hammer_count": f"{_BODY} <= 0.3 AND {_LOWER} >= 0.6 AND {_UPPER} <= 0.1", "shooting_star_count": f"{_BODY} <= 0.3 AND {_UPPER} >= 0.6 AND {_LOWER} <= 0.1",
    "engulfing_bullish_count": "pc < po AND close > open AND open < pc AND close > po", "engulfing_bearish_count": "pc > po AND close < open AND open > pc AND close < po",
    "spinning_top_count": f"{_BODY} <= 0.3 AND {_UPPER} >= 0.25 AND {_LOWER} >= 0.25", "marubozu_count": f"{_BODY} >= 0.8 AND {_UPPER} <= 0.1 AND {_LOWER} <= 0.1",
}
_TURNS = " + ".join(c for c in _CANDLES if c not in ("spinning_top_count", "marubozu_count"))
_MOVES = f"""fr AS (SELECT *, coalesce(low < lag(low) OVER s AND low < lead(low) OVER s AND lead(low) OVER s < lead(low, 2) OVER s AND lag(low) OVER s < lag(low, 2) OVER s, false) AS sup, coalesce(high > lag(high) OVER s AND high > lead(high) OVER s AND lead(high) OVER s > lead(high, 2) OVER s AND lag(high) OVER s > lag(high, 2) OVER s, false) AS res,
 max(high) OVER p AS ph, min(low) OVER p AS pl, row_number() OVER s - 1 AS i, lag(close) OVER s AS pc, lag(open) OVER s AS po FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts), p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
sg AS (SELECT * FROM (SELECT symbol, ts, i AS at, close AS e, CASE WHEN sup THEN 'bounce_support' WHEN res THEN 'bounce_resistance' WHEN close > ph THEN 'breakout_resistance' WHEN close < pl THEN 'breakout_support' END AS kind, CASE WHEN sup THEN low WHEN res THEN high WHEN close > ph THEN ph ELSE pl END AS lv FROM fr) WHERE kind IS NOT NULL),
s2 AS (SELECT *, kind IN ('bounce_support', 'breakout_resistance') AS up, lv * (1 - 0.005) AS lo, lv * (1 + 0.005) AS hi FROM sg),
fu AS (SELECT s.symbol, s.ts, s.e, s.up, s.lv, s.lo, s.hi, s.kind, b.i - s.at - 1 AS k, b.open, b.high, b.low, b.close, b.volume, CASE WHEN s.up THEN b.high ELSE b.low END AS ld, CASE WHEN s.up THEN b.low ELSE b.high END AS bk, CASE WHEN b.i = s.at + 1 THEN b.high - b.low ELSE greatest(b.high - b.low, abs(b.high - b.pc), abs(b.low - b.pc)) END AS tr FROM s2 s JOIN fr b ON b.symbol = s.symbol AND b.i > s.at AND b.i <= s.at + 50),
ex AS (SELECT *, CASE WHEN up THEN greatest(e, max(ld) OVER w) ELSE least(e, min(ld) OVER w) END AS best, CASE WHEN up THEN greatest(e, coalesce(max(ld) OVER v, e)) ELSE least(e, coalesce(min(ld) OVER v, e)) END AS prior FROM fu WINDOW w AS (PARTITION BY symbol, ts ORDER BY k ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY symbol, ts ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pb AS (SELECT *, abs(best - bk) / best * 100 * CASE WHEN (up AND bk > best) OR (NOT up AND bk < best) THEN -1 ELSE 1 END AS cur, CAST(best <> prior AS INTEGER) AS fresh FROM ex),
sq AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, ts ORDER BY k ROWS UNBOUNDED PRECEDING) AS seg FROM pb),
se AS (SELECT symbol, ts, seg, min(k) AS k0, min(CASE WHEN cur > 2 THEN k END) AS began FROM sq GROUP BY 1, 2, 3),
rc AS (SELECT symbol, ts, max_by(back - began, seg) AS recovery FROM (SELECT *, lead(k0) OVER (PARTITION BY symbol, ts ORDER BY seg) AS back FROM se) WHERE began IS NOT NULL AND back IS NOT NULL GROUP BY 1, 2),
fa AS (SELECT symbol, ts, count(*) AS n, max(high) AS top, min(low) AS bot, max_by(close, k) AS lastc, CASE WHEN any_value(up) THEN min(low) FILTER (WHERE k < 5) ELSE max(high) FILTER (WHERE k < 5) END AS bep, CASE WHEN any_value(up) THEN arg_min(k, low) FILTER (WHERE k < 5) ELSE arg_max(k, high) FILTER (WHERE k < 5) END AS bec,
 arg_max(k, high) AS kt, arg_min(k, low) AS kb, count(*) FILTER (WHERE low <= hi AND low >= lo OR high <= hi AND high >= lo) AS touches, max(k) FILTER (WHERE low <= hi AND low >= lo OR high <= hi AND high >= lo) AS lt, arg_min(close, abs(close - lv)) FILTER (WHERE low <= hi AND low >= lo OR high <= hi AND high >= lo) AS ltp,
 count(*) FILTER (WHERE CASE WHEN kind LIKE '%support' THEN close < lo ELSE close > hi END) AS held, avg(volume) AS av, max(volume) AS mv, stddev_samp(volume) AS sv, min(k) FILTER (WHERE CASE WHEN up THEN high >= e * 1.01 ELSE low <= e * 0.99 END) AS hit, avg(tr) AS atr, max(tr) AS mtr, stddev_pop(tr) AS str, max(cur) AS deep, count(*) FILTER (WHERE cur > 2) AS falls FROM sq GROUP BY 1, 2),
hi AS (SELECT s.symbol, s.ts, count(*) AS hn, avg(b.volume) AS hv, avg(b.volume) FILTER (WHERE b.low <= s.hi AND b.high >= s.lo) AS tv, sum(b.volume) FILTER (WHERE b.i >= s.at - 5) / 5 AS tl, sum(b.volume) FILTER (WHERE b.i < greatest(s.at - 200, 0) + 5) / 5 AS hd FROM s2 s JOIN fr b ON b.symbol = s.symbol AND b.i < s.at AND b.i >= s.at - 200 GROUP BY 1, 2),
pa AS (SELECT s.symbol, s.ts, count(*) AS pn, {', '.join(f"count(*) FILTER (WHERE {'b.i > greatest(s.at - 10, 0) AND ' if 'engulfing' in n else ''}{c}) AS {n}" for n, c in _CANDLES.items())} FROM s2 s JOIN fa USING (symbol, ts) JOIN fr b ON b.symbol = s.symbol AND b.i >= s.at - 10 AND b.i < s.at + fa.n GROUP BY 1, 2),
al AS (SELECT s.*, fa.*, hi.*, pa.*, rc.recovery, CASE WHEN up THEN top - e ELSE e - bot END AS fav, CASE WHEN up THEN e - bot ELSE top - e END AS adv, CASE WHEN up THEN lastc - e ELSE e - lastc END AS fin, CASE WHEN kind LIKE 'bounce%' THEN greatest(0, 1 - held / n) ELSE held / n END AS resp FROM s2 s LEFT JOIN fa USING (symbol, ts) LEFT JOIN hi USING (symbol, ts) LEFT JOIN pa USING (symbol, ts) LEFT JOIN rc USING (symbol, ts))"""
_STATS = {
    "max_favorable_move": "fav", "max_adverse_move": "adv", "final_move": "fin", "max_favorable_pct": "fav / e * 100", "max_adverse_pct": "adv / e * 100", "final_move_pct": "fin / e * 100", "signal_strength": "greatest(0, fin / (adv + 0.0001))",
    "best_entry_price": "bep", "best_entry_improvement": "abs(bep - e) / e * 100", "best_entry_candle": "bec", "optimal_exit_price": "CASE WHEN up THEN top ELSE bot END", "optimal_exit_return": "fav / e * 100", "optimal_exit_candle": "CASE WHEN up THEN kt ELSE kb END",
    "max_return_potential": "fav / e * 100", "max_risk_exposure": "adv / e * 100", "risk_reward_ratio": "CASE WHEN adv / e * 100 > 0 THEN fav / e * 100 / (adv / e * 100 + 0.0001) ELSE 0 END", "last_touch_price": "coalesce(ltp, lv)", "last_touch_candle": "coalesce(lt, 0)",
    "touches_after_signal": "touches", "level_respect_score": "resp", "level_break_strength": "CASE WHEN kind LIKE 'breakout%' THEN 1 - resp ELSE 0 END", "retest_occurred": "touches > 0", "avg_volume_during_move": "av", "volume_surge_factor": "mv / (av + 1)",
    "volume_consistency": "CASE WHEN av > 0 THEN 1 / (sv / (av + 1) + 1) ELSE 0 END", "historical_avg_volume": "hv", "volume_surge_vs_historical": "av / (hv + 1)", "level_touch_volume_avg": "CASE WHEN hn > 0 THEN coalesce(tv, 0) END", "level_touch_volume_surge": "CASE WHEN hn > 0 THEN coalesce(tv, 0) / (hv + 1) END",
    "pre_signal_volume_trend": "CASE WHEN hn >= 10 THEN (tl - hd) / (hd + 1) WHEN hn > 0 THEN 0 END", **{c: f"CASE WHEN pn >= 2 THEN {c} ELSE 0 END" for c in _CANDLES}, "pattern_strength_score": f"CASE WHEN pn >= 2 THEN ({_TURNS} + marubozu_count) / pn ELSE 0 END",
    "reversal_pattern_strength": f"CASE WHEN pn >= 2 THEN ({_TURNS}) / pn ELSE 0 END", "continuation_pattern_strength": "CASE WHEN pn >= 2 THEN marubozu_count / pn ELSE 0 END", "time_to_max_favorable": "CASE WHEN up THEN kt ELSE kb END", "time_to_max_adverse": "CASE WHEN up THEN kb ELSE kt END",
    "time_to_target_1pct": "coalesce(hit, n)", "avg_volatility": "atr", "volatility_surge": "mtr / (atr + 0.0001)", "volatility_consistency": "CASE WHEN atr > 0 THEN 1 / (str / (atr + 0.0001) + 1) ELSE 0 END", "pullback_occurred": "falls > 0", "max_pullback_pct": "greatest(deep, 0)", "pullback_recovery_candles": "coalesce(recovery, 0)",
}
_WHOLE = {*movement.PLACES, "retest_occurred", "pullback_occurred"}
add(
    "z11_movement_stats", lambda s, d: movement.movement_stats(level_signals(hourly(s, d)), hourly(s, d)),
    f"WITH {HOURLY}, {_MOVES} SELECT symbol, ts, kind AS signal_type, round(lv, 6) AS level_price, round(e, 6) AS entry_price, CAST(coalesce(n, 0) AS INTEGER) AS analysis_period, {', '.join(f'CASE WHEN n > 0 THEN {e} END AS {c}' if c in _WHOLE else f'round(CASE WHEN n > 0 THEN {e} END, 6) AS {c}' for c, e in _STATS.items())} FROM al",
)


def _bar_signals(s: SparkSession, d: str, share: float) -> DataFrame:
    return zone_bars.bar_signals(hourly(s, d), share=share, distance=2.0, width=0.05)


# chosen and clustered anew from bar to bar: no SQL, tests hold them against each bar's own window
add("z09_bar_signals", lambda s, d: _bar_signals(s, d, 0.8).drop("signals"), None)
add("z10_strict_signals", lambda s, d: zone_bars.signals_of(_bar_signals(s, d, 1.0)), None)
