"""SQL over the same tables, for the queries that SQL can express. Windows are named: s (frameless), cum, rN and fN."""

from __future__ import annotations

import re

TICKS = "ticks AS (SELECT event_type AS symbol, ts, value AS price, CAST(1.0 AS DOUBLE) AS volume, event_id AS seq FROM events)"
TRADES = "trades AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS volume, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"


def bars(name: str, unit: str, tf: str) -> str:
    return (
        f"{name} AS (SELECT symbol, '{tf}' AS tf, date_trunc('{unit}', ts) AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high,"
        " min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2, 3)"
    )


HOURLY = f"{TICKS}, {bars('bars', 'hour', '1 hour')}"


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    """The rolling aggregate; ``agg`` may hold {} for its argument."""
    call = agg.format(x) if "{}" in agg else f"{agg}({x})"
    return f"CASE WHEN count({x}) OVER r{n} >= {n if least is None else least} THEN {call} OVER r{n} END"


def forward(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER f{n} = {n} THEN {agg}({x}) OVER f{n} END"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def windows(text: str) -> str:
    used = ["s AS (PARTITION BY symbol ORDER BY ts)"] if re.search(r"\bs\b", text) else []
    if re.search(r"OVER cum\b", text):
        used.append("cum AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)")
    for n in sorted({int(m) for m in re.findall(r"OVER r(\d+)\b", text)}):
        used.append(f"r{n} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
    for n in sorted({int(m) for m in re.findall(r"OVER f(\d+)\b", text)}):
        used.append(f"f{n} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)")
    return f" WINDOW {', '.join(used)}" if used else ""


def over_bars(final: dict[str, str], *layers: dict[str, str], plain: tuple[str, ...] = (), where: str = "", base: str = HOURLY, source: str = "bars", keep: tuple[str, ...] = ("symbol", "ts"), digits: int = 6) -> str:
    """SELECT ``keep`` and the final columns (rounded to ``digits`` places but for ``plain``) from layers of added columns over bars."""
    parts, last = [base], source
    for i, layer in enumerate(layers):
        cols = ", ".join(f"{e} AS {n}" for n, e in layer.items())
        parts.append(f"l{i} AS (SELECT *, {cols} FROM {last}{windows(cols)})")
        last = f"l{i}"
    cols = ", ".join(f"{e} AS {n}" if n in plain else f"round({e}, {digits}) AS {n}" for n, e in final.items())
    return f"WITH {', '.join(parts)} SELECT {', '.join([*keep, cols])} FROM {last}{where and ' WHERE ' + where}{windows(cols)}"
