"""Pieces of DuckDB SQL that the oracles share. They are written by hand, not made from Spark's plans."""

from __future__ import annotations

HOURLY = """c AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, row(ts, event_id)) AS close, sum(value)::DOUBLE AS volume FROM events GROUP BY event_type, date_trunc('hour', ts))"""
DAILY = """c AS (SELECT CAST(user_id AS VARCHAR) AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY user_id, date_trunc('day', ts))"""


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


W = "(PARTITION BY symbol ORDER BY ts)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {W}"


def query(base: str, *ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([base, *ctes])} {select}"


def recursion(source: str, first: dict[str, str], step: dict[str, str], extra: str = "") -> str:
    """CTEs n (rows numbered from 0 as i) and r (the state by row); steps speak of r and n."""
    names = ", ".join(first)
    a = ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in first.items())
    b = ", ".join(f"CAST({e} AS DOUBLE)" for e in step.values())
    return f"""n AS (SELECT *, row_number() OVER {W} - 1 AS i FROM {source}),
r(symbol, i, {names}) AS (SELECT symbol, i, {a} FROM n WHERE i = 0 UNION ALL SELECT n.symbol, n.i, {b} FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)"""


def back(values: str, rows: str = "n") -> str:
    """The recursion's results beside the candles' keys."""
    return f"SELECT n.symbol, n.ts, {values} FROM {rows} n JOIN r ON r.symbol = n.symbol AND r.i = n.i"


def ema_step(m: str, t: str, x: str, n: int) -> dict[str, str]:
    """Steps of a mean that starts with the plain mean of the first n values."""
    return {m: f"CASE WHEN n.i < {n - 1} THEN NULL WHEN n.i = {n - 1} THEN (r.{t} + {x}) / {n} ELSE r.{m} + {2 / (n + 1)!r} * ({x} - r.{m}) END", t: f"CASE WHEN n.i <= {n - 1} THEN r.{t} + {x} ELSE r.{t} END"}


def wilder(m: str, x: str, n: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN r.{m} WHEN r.{m} IS NULL THEN {x} ELSE r.{m} + ({x} - r.{m}) / {n} END"


_HEAD, _TAIL = "floor((", ") * 1e6 + 0.5) / 1e6"


def unrounded(sql: str) -> str:
    """An oracle's text without the rounding of what it gives."""
    at = sql.find(_HEAD)
    if at < 0:
        return sql
    start, depth, end = at + len(_HEAD), 1, at + len(_HEAD)
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    if not sql.startswith(_TAIL, end - 1):
        return sql[:start] + unrounded(sql[start:])
    return sql[:at] + "(" + unrounded(sql[start : end - 1]) + ")" + unrounded(sql[end - 1 + len(_TAIL) :])
