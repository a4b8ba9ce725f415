"""DuckDB SQL pieces that the operators' oracle queries are written with. Nothing here is derived from Spark plans."""

from __future__ import annotations

EVENT_BARS = """
t AS (SELECT event_type AS symbol, epoch_us(ts) // 1000000 AS s, value AS price, 1.0::DOUBLE AS size, row_number() OVER (ORDER BY ts, event_id) AS k FROM events),
bars AS (SELECT symbol, s - s % {tf} AS time, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(size) AS volume
         FROM t GROUP BY ALL)"""
LINEITEM_BARS = """
t AS (SELECT l_returnflag || l_linestatus AS symbol, epoch_us(l_shipdate) // 1000000 AS s, l_extendedprice / l_quantity AS price, l_quantity::DOUBLE AS size,
             row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
bars AS (SELECT symbol, s - s % {tf} AS time, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(size) AS volume
         FROM t GROUP BY ALL)"""
DENSE = """,
ends AS (SELECT symbol, min(time) AS a, max(time) AS b FROM bars GROUP BY symbol),
grid AS (SELECT g.time, e.symbol FROM (SELECT DISTINCT time FROM bars WHERE time BETWEEN (SELECT max(a) FROM ends) AND (SELECT min(b) FROM ends)) g, ends e),
carried AS (SELECT symbol, time, close FROM bars),
p AS (SELECT g.symbol, g.time, coalesce(b.open, c.close) AS open, coalesce(b.high, c.close) AS high, coalesce(b.low, c.close) AS low, coalesce(b.close, c.close) AS close, coalesce(b.volume, 0) AS volume
      FROM grid g LEFT JOIN bars b USING (symbol, time) ASOF LEFT JOIN carried c ON c.symbol = g.symbol AND c.time <= g.time)"""


def panel(tf: int = 3600, source: str = "events") -> str:
    """WITH-clause body that ends with p, the dense panel."""
    return (EVENT_BARS if source == "events" else LINEITEM_BARS).format(tf=tf) + DENSE


def rounded(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def settled(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) THEN 0.0 WHEN ({x}) = 'inf'::DOUBLE THEN 1.0 WHEN ({x}) = '-inf'::DOUBLE THEN -1.0 ELSE ({x}) END)"


WINDOWS = "WINDOW w AS (PARTITION BY symbol ORDER BY time), wu AS (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING), c AS (PARTITION BY time), " + ", ".join(
    f"w{n} AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (2, 3, 5, 7, 9, 10, 14, 20, 25, 26, 28, 30, 50, 60, 200)
)


def pad(x: str, n: int) -> str:
    """The last n values of x, oldest first, padded with 0."""
    return f"list_concat(list_transform(range(0, {n} - len(list({x}) OVER w{n})), lambda i: 0.0::DOUBLE), list({x}) OVER w{n})"


def lmean(v: str, n: int) -> str:
    return f"(list_sum({v}) / {n})"


def lmoment(v: str, m: str, k: int, n: int) -> str:
    return f"(list_sum(list_transform({v}, lambda u: {' * '.join([f'(u - {m})'] * k)})) / {n})"


def ema(x: str, span: int) -> str:
    a = 2.0 / (span + 1)
    return f"list_reduce(list({x}) OVER wu, lambda s, v: {a!r} * v + {1 - a!r} * s)"
