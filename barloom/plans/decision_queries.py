"""Queries of decision rules over hourly bars with rolling zones, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import forward, lag, lead, ratio, roll, rounded
from ..operators import decisions, indicators
from .bar_queries import TR, hourly
from .sql import div, forward as fwd, over_bars
from .sql import roll as sroll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def state(b: DataFrame) -> DataFrame:
    """Bars with zones, ranges, volumes of rising and falling bars, and what stands for an account: held, drawdown, entries."""
    c, o, v = F.col("close"), F.col("open"), F.col("volume")
    b = indicators.trend_strength(indicators.atr_sma(indicators.quantile_zones(b)))
    b = b.withColumns({"_up": F.when(c > o, v).otherwise(0.0), "_down": F.when(c < o, v).otherwise(0.0)})
    b = b.withColumns({
        "buys": roll(F.sum, "_up", 10, 1), "sells": roll(F.sum, "_down", 10, 1), "held": F.hour("ts") % 6 == 0, "support_gone": lag("close") < F.col("support") * 0.996, "resistance_gone": lag("close") > F.col("resistance") * 1.004,
        "move": F.coalesce(ratio(lead("close", 3) - c, c), F.lit(0.0)), "fall": F.coalesce(F.greatest(ratio(c - forward(F.min, "low", 3), c), F.lit(0.0)), F.lit(0.0)), "pnl": F.coalesce(ratio(c - lag("close"), lag("close")), F.lit(0.0)),
        "strength": F.coalesce(0.5 + 0.5 * F.col("trend_strength"), F.lit(0.5)), "top": roll(F.max, "close", 24, 1),
    })
    return b.withColumns({"net": F.col("buys") - F.col("sells"), "drawdown": ratio(F.col("top") - c, F.col("top")), "entries": (F.hour("ts") % 5).cast("int"), "action": (F.hour("ts") % 3).cast("int")})


#: The same in SQL: layers of columns over hourly bars.
STATE = (
    {"tr": TR, "up0": "CASE WHEN close > open THEN volume ELSE 0 END", "down0": "CASE WHEN close < open THEN volume ELSE 0 END", "step0": "abs(close - lag(close) OVER s)", "far0": "abs(close - lag(close, 10) OVER s)", "before": "lag(close) OVER s"},
    {"atr": sroll("avg", "tr", 14), "lo": sroll("quantile_cont({}, 0.2)", "close", 50), "hi": sroll("quantile_cont({}, 0.8)", "close", 50), "buys": sroll("sum", "up0", 10, 1), "sells": sroll("sum", "down0", 10, 1), "trend": div("far0", sroll("sum", "step0", 10)),
     "move": "coalesce((lead(close, 3) OVER s - close) / close, 0)", "fall": f"coalesce(greatest((close - {fwd('min', 'low', 3)}) / close, 0), 0)", "pnl": "coalesce((close - before) / before, 0)", "top": sroll("max", "close", 24, 1)},
    {"unit": "atr", "net": "buys - sells", "sgone": "coalesce(before < lo * 0.996, false)", "rgone": "coalesce(before > hi * 1.004, false)", "reach": "greatest(coalesce(atr, 0) * 0.75, close * 0.003)", "held": "hour(ts) % 6 = 0", "strength": "coalesce(0.5 + 0.5 * trend, 0.5)", "drawdown": "(top - close) / top", "action": "hour(ts) % 3"},
    {"call": "CASE WHEN held THEN 0 WHEN lo IS NULL AND hi IS NULL THEN 1 WHEN abs(close - lo) <= reach AND NOT sgone AND (buys >= sells * 0.8 OR net >= 0) THEN 1 ELSE 0 END",
     "put": "CASE WHEN held THEN 0 WHEN lo IS NULL AND hi IS NULL THEN 1 WHEN abs(close - hi) <= reach AND NOT rgone AND (sells >= buys * 0.8 OR net <= 0) THEN 1 ELSE 0 END"},
)


def on_state(name: str, op: Callable[[DataFrame], DataFrame], final: dict[str, str], *layers: dict[str, str], plain: tuple[str, ...] = (), digits: int = 6) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(op(state(hourly(spark, sf_dir))).select("symbol", "ts", *final), digits)
    SQL[name] = over_bars(final, *STATE, *layers, plain=plain, digits=digits)


def masked(b: DataFrame) -> DataFrame:
    return decisions.entry_mask(b, support_net="net", resistance_net="net", support_gone="support_gone", resistance_gone="resistance_gone")


on_state(
    "p14_direction", lambda b: b.withColumn("_cross", F.when(F.hour("ts") % 7 == 0, F.signum("net")).otherwise(0.0)).withColumns({"by_crosses": decisions.direction_by_crosses(100 * F.col("strength") - 20, F.col("move"), F.col("_cross")), "by_trend": decisions.direction_by_trend("strength", "net")}),
    {"by_crosses": "CASE WHEN x > 0 THEN 'bullish' WHEN x < 0 THEN 'bearish' WHEN 100 * strength - 20 < 40 OR move > 0 THEN 'bullish' ELSE 'bearish' END",
     "by_trend": "CASE WHEN strength < 0.35 OR (strength < 0.5 AND net > 0) THEN 'bullish' WHEN strength > 0.65 OR (strength > 0.5 AND net < 0) THEN 'bearish' WHEN net >= 0 THEN 'bullish' ELSE 'bearish' END"},
    {"x": "CASE WHEN hour(ts) % 7 = 0 THEN sign(net) ELSE 0 END"}, plain=("by_crosses", "by_trend"),
)
on_state("p15_action_mask", lambda b: masked(b).select("*", *[F.col("mask")[i].alias(f"may_{n}") for i, n in enumerate(("wait", "call", "put", "half", "flatten"))]), {"may_wait": "1", "may_call": "call", "may_put": "put", "may_half": "CAST(held AS INTEGER)", "may_flatten": "CAST(held AS INTEGER)"}, plain=("may_wait", "may_call", "may_put", "may_half", "may_flatten"))

_NEAR = lambda x: f"least(greatest(1 - coalesce({div(x, 'unit')}, 10) / 4, 0), 1)"
on_state(
    "p16_signal_quality",
    lambda b: b.withColumn("quality", decisions.signal_quality("action", "strength", F.signum("move"), ratio(F.abs(F.col("close") - F.col("support")), "atr"), ratio(F.abs(F.col("close") - F.col("resistance")), "atr"), ratio("net", F.col("buys") + F.col("sells")), confluence=F.hour("ts") % 4, crosses=(F.signum("net"), -F.signum("move")), regime=("strength", 1 - F.col("strength")))),
    {"quality": "least(greatest(CASE WHEN (action = 1 AND strength > 0.5) OR (action = 2 AND 1 - strength > 0.5) THEN least(q2 + 0.08, 1) ELSE q2 END, 0), 1)"},
    {"near_s": _NEAR("abs(close - lo)"), "near_r": _NEAR("abs(close - hi)"), "flag": "sign(move)", "vd": f"coalesce({div('net', 'buys + sells')}, 0)", "way": "CASE action WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END"},
    {"q": "0.25 * least(greatest((strength - 0.45) / 0.25, 0), 1) + 0.25 * CASE WHEN action = 0 THEN 1 - 0.5 * abs(flag) ELSE 0.5 + 0.5 * way * flag END + 0.2 * CASE action WHEN 1 THEN near_s WHEN 2 THEN near_r ELSE 1 - 0.5 * greatest(near_s, near_r) END + 0.1 * (0.5 + 0.5 * way * vd) + 0.2 * least((hour(ts) % 4) / 2, 1)"},
    {"q2": "0.8 * q + 0.2 * (0.5 + 0.5 * way * (sign(net) - flag) / 2)"},
)
on_state(
    "p17_shaped_reward",
    lambda b: masked(b).withColumn("reward", decisions.shaped_reward("action", "mask", "pnl", "fall", "move", "strength", F.hour("ts") % 8 == 0, F.col("pnl") < 0, F.hour("ts") == 23)),
    {"reward": "least(greatest(CASE WHEN action > 0 THEN CASE WHEN gain >= 0.003 THEN least(greatest(0.15 * gain / 0.003 * greatest(1 - fall / 0.005, 0), 0), 0.35) ELSE 0 END - 0.05 ELSE 0 END + CASE WHEN hour(ts) % 8 = 0 THEN pnl / greatest(abs(fall), 0.01) + CASE WHEN pnl < 0 THEN 0.2 ELSE 0 END ELSE 0 END"
               " + CASE WHEN action = 0 AND hour(ts) % 8 <> 0 AND hour(ts) <> 23 THEN CASE WHEN side IS NULL THEN 0.02 WHEN side * move >= 0.003 THEN greatest(-0.45 * side * move / 0.003, -1.5) WHEN side * move < 0 THEN least(0.15 * abs(move) / 0.003, 0.3) ELSE 0 END ELSE 0 END, -3), 3)"},
    {"gain": "CASE WHEN action = 1 THEN move ELSE -move END", "side": "CASE WHEN strength < 0.65 THEN NULL WHEN call = 1 THEN 1 WHEN put = 1 THEN -1 END"},
)
on_state("p20_risk_gate", lambda b: b.withColumn("open", decisions.risk_gate("drawdown", "entries")), {"open": "coalesce(drawdown < 0.03 AND hour(ts) % 5 < 4, false)"}, plain=("open",))
on_state(
    "p27_reentry_gate", lambda b: b.withColumn("again", decisions.reentry_gate(F.when(F.col("net") >= 0, "bullish").otherwise("bearish"), "strength", "drawdown", "entries", 3, "support_gone", "resistance_gone")),
    {"again": "hour(ts) % 5 < 3 AND strength >= 0.65 AND drawdown <= 0.35 AND NOT (net >= 0 AND sgone) AND NOT (net < 0 AND rgone)"}, plain=("again",),
)


def _vector(b: DataFrame) -> DataFrame:
    named = {
        "direction": F.when(F.col("net") >= 0, "bullish").otherwise("bearish"), "strength": "strength", "reversal": "drawdown", "mfe_pips": 1000 * F.col("move"), "mae_pips": 1000 * F.col("fall"), "strength_1h": "strength",
        "drawdown": "drawdown", "position": F.col("held").cast("int"), "pnl": "pnl", "wins": "entries", "atr": "atr", "support": "support", "resistance": "resistance", "buys": "buys", "sells": "sells", "entries": "entries", "most_entries": F.lit(3),
    }
    return decisions.state_vector(b, named, F.hour("ts"), F.weekday("ts"), F.when(F.hour("ts") == 14, "nyse_open").when(F.hour("ts") == 20, "nyse_power_hour"))


_ZEROS = ("q_value", "wins", "losses", "quarter_hour", "support_delta", "resistance_delta")
on_state(
    "p25_state_vector", _vector,
    {f"state_{k}": x for k, x in ({
        "direction": "CASE WHEN net >= 0 THEN 1.0 ELSE -1.0 END", "strength": "strength", "reversal": "drawdown", "mfe": "10 * move", "mae": "10 * fall", "strength_5m": "CAST(0.5 AS DOUBLE)", "strength_15m": "CAST(0.5 AS DOUBLE)", "strength_30m": "CAST(0.5 AS DOUBLE)", "strength_1h": "strength",
        "drawdown": "drawdown", "position": "CAST(held AS DOUBLE)", "pnl": "pnl", "atr_share": "coalesce(atr / close, 0)", "support_dist": "coalesce(abs(close - lo) / close, 1)", "resistance_dist": "coalesce(abs(close - hi) / close, 1)", "volume_delta": "net / (buys + sells + 1e-6)",
        "entries": "CAST(hour(ts) % 5 AS DOUBLE) / 3", "hour_sin": "sin(2 * pi() * hour(ts) / 24)", "hour_cos": "cos(2 * pi() * hour(ts) / 24)", "weekday": "(isodow(ts) - 1) / 6", "open": "CAST(hour(ts) = 14 AS DOUBLE)", "power_hour": "CAST(hour(ts) = 20 AS DOUBLE)",
    } | dict.fromkeys(_ZEROS, "CAST(0 AS DOUBLE)") | {"wins": "CAST(hour(ts) % 5 AS DOUBLE) / 10"}).items()},
    digits=12,  # shares of a price are small: at six places a last bit shows
)
