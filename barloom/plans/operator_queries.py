"""A query per formula operator on the dense hourly panel, and its SQL.

Inputs: x is the log return, y the bar's body over its range, z a volume score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formula
from ..functions.expr import Env, clean, fn
from ..registry import register
from ..sources import bars
from . import oracle
from .oracle import lmean, lmoment

HOUR = 3600


def dense_panel(spark: SparkSession, sf_dir: str, seconds: int = HOUR) -> DataFrame:
    return bars.densify(bars.resample(bars.ticks_from_events(spark, sf_dir), seconds))


def rounded(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def inputs(env: Env) -> dict:
    c = env["close"]
    x = env.let(clean(fn("log", c / env.lag(c, 1))))
    y = env.let((c - env["open"]) / (env["high"] - env["low"] + 1.0))
    z = env.let(env["volume"] / 3.0 - 1.0)
    return {"x": x, "y": y, "z": z}


def run(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = Env(dense_panel(spark, sf_dir))
        v = inputs(env)
        out = formula.apply(env, name, *[v[k] for k in "xyz"[: formula.OPERATORS[name].arity]])
        return env.frame({"value": out}).select("symbol", "time", rounded(F.col("value")).alias("value"))

    return query


# Layers of the oracle: a has the inputs, b arrays and running values of a, d what needs both.
HEAD = (
    "WITH "
    + oracle.panel(HOUR)
    + f""",
a AS (SELECT symbol, time, coalesce(ln(close / lag(close) OVER w), 0) AS x, (close - open) / (high - low + 1) AS y, volume / 3.0 - 1 AS z FROM p {oracle.WINDOWS}),
b AS (SELECT *, {", ".join(f"{oracle.pad('x', n)} AS x{n}" for n in (5, 10, 20))}, {oracle.pad("y", 10)} AS y10,
      sum(x) OVER wu AS sx, sum(x * x) OVER wu AS sxx, sum(abs(x)) OVER wu AS sa, row_number() OVER w AS n, count(*) OVER c AS wide FROM a {oracle.WINDOWS}),
d AS (SELECT *, {lmean("x5", 5)} AS m5, {lmean("x10", 10)} AS m10, {lmean("x20", 20)} AS m20, {lmean("y10", 10)} AS my, list_sort(x20) AS o20, sx / n AS jm, greatest(sxx / n - (sx / n) * (sx / n), 1e-12) AS jv FROM b),
e AS (SELECT *, {", ".join(f"sqrt({lmoment(f'x{n}', f'm{n}', 2, n)}) AS s{n}" for n in (5, 10, 20))}, sqrt({lmoment("y10", "my", 2, 10)}) AS sy,
      list_sum(list_transform(range(1, 11), lambda i: (x10[i] - m10) * (y10[i] - my))) / 10 AS cxy,
      o20[1] + (o20[2] - o20[1]) * 0.95 AS q05, o20[19] + (o20[20] - o20[19]) * 0.05 AS q95 FROM d)
"""
)


def sq(x: str) -> str:
    return f"greatest(least(sign({x}) * {x} * {x}, 1e9), -1e9)"


def lags(weights: list[float], by: float) -> str:
    return "(" + " + ".join(f"{w} * " + ("x" if k == 0 else f"lag(x, {k}, 0.0) OVER w") for k, w in enumerate(weights)) + f") / {by}"


SQL = {
    "ADD": "x + y",
    "SUB": "x - y",
    "MUL": "x * y",
    "DIV": "x / (y + 1e-6)",
    "NEG": "-x",
    "ABS": "abs(x)",
    "SIGN": "sign(x)",
    "GATE": "CASE WHEN x > 0 THEN y ELSE z END",
    "JUMP": "CASE WHEN n <= 5 THEN 0 ELSE tanh((x - jm) / sqrt(jv) - 1.5) END",
    "DECAY": lags([1, 0.8, 0.6], 2.4),
    "DELAY1": "lag(x, 1, 0.0) OVER w",
    "MAX3": "greatest(x, lag(x, 1, 0.0) OVER w, lag(x, 2, 0.0) OVER w)",
    "TS_CORR_10": "CASE WHEN s10 < 1e-6 OR sy < 1e-6 THEN 0 ELSE cxy / (s10 * sy + 1e-8) END",
    "MOMENTUM_5": "sum(x) OVER w5 / 5 - sum(x) OVER w20 / 20",
    "MOMENTUM_10": "sum(x) OVER w10 / 10 - sum(x) OVER w20 / 20",
    "TS_MAX_10": "list_max(x10)",
    "TS_MIN_10": "list_min(x10)",
    "WMA": lags([3, 2, 1], 6),
    "DELAY4": "lag(x, 4, 0.0) OVER w",
    "EMA_5": oracle.ema("x", 5),
    "EMA_20": oracle.ema("x", 20),
    "TS_QUANTILE_10": "len(list_filter(x10, lambda u: u < x)) / 10",
    "TS_SKEW_10": f"{lmoment('x10', 'm10', 3, 10)} / pow(s10 + 1e-6, 3)",
    "TS_MIN_20": "list_min(x20)",
    "TS_MAX_20": "list_max(x20)",
    "DELTA": "coalesce(x - lag(x) OVER w, 0)",
    "TS_ARG_MAX_5": "(list_position(x5, list_max(x5)) - 1) / 4",
    "TS_ARG_MIN_5": "(list_position(x5, list_min(x5)) - 1) / 4",
    "DECAY_LINEAR_5": lags([5, 4, 3, 2, 1], 15),
    "SCALE": "x / (sa + 1e-6)",
    "COVARIANCE_10": "cxy",
    "PRODUCT_5": "exp(greatest(least(sum(ln(1 + greatest(x, -0.999))) OVER w5, 10), -10)) - 1",
    "SIGNED_POWER_2": sq("x"),
    "TS_DECAY_EXP_5": lags([0.03125, 0.0625, 0.125, 0.25, 0.5], 0.96875),
    "DELTA_5": "coalesce(x - lag(x, 5) OVER w, 0)",
    "CS_RANK": "CASE WHEN wide = 1 THEN x ELSE (row_number() OVER (PARTITION BY time ORDER BY x, symbol) - 1) / (wide - 1) END",
    "CS_SCALE": "CASE WHEN wide = 1 THEN x WHEN max(x) OVER c - min(x) OVER c < 1e-9 THEN 0.5 ELSE (x - min(x) OVER c) / (max(x) OVER c - min(x) OVER c) END",
    "CS_NEUTRALIZE": "CASE WHEN wide = 1 THEN x ELSE x - avg(x) OVER c END",
    "MIN": "least(x, y)",
    "MAX": "greatest(x, y)",
    "POWER": sq("x"),
    "SIGNED_LOG": "sign(x) * ln(1 + abs(x))",
    "SQRT": "sign(x) * sqrt(abs(x))",
    "TS_ZSCORE_10": "CASE WHEN s10 + 1e-9 < 2e-9 THEN 0 ELSE (x - m10) / (s10 + 1e-9) END",
    "TS_ZSCORE_20": "CASE WHEN s20 + 1e-9 < 2e-9 THEN 0 ELSE (x - m20) / (s20 + 1e-9) END",
    "WINSORIZE": "CASE WHEN q95 - q05 < 1e-9 THEN x ELSE greatest(least(x, q95), q05) END",
    "CLIP": "greatest(least(x, 3), -3)",
    "SIGMOID": "2 / (1 + exp(-x)) - 1",
    "TANH_SQUASH": "tanh(x)",
    "IF_GT": "CASE WHEN x > 0 THEN y ELSE z END",
}
for _n in (5, 10, 20):
    SQL[f"TS_MEAN_{_n}"] = f"sum(x) OVER w{_n} / {_n}"
    SQL[f"TS_SUM_{_n}"] = f"sum(x) OVER w{_n}"
    SQL[f"TS_STD_{_n}"] = f"s{_n} + 1e-6"
    SQL[f"TS_RANK_{_n}"] = f"len(list_filter(x{_n}, lambda u: u < x)) / {_n}"

for _name in formula.OPERATORS:
    register(
        f"fx_{_name.lower()}",
        HEAD + f", v AS (SELECT symbol, time, ({SQL[_name]})::DOUBLE AS v FROM e {oracle.WINDOWS}) SELECT symbol, time, {oracle.rounded(oracle.settled('v'))} AS value FROM v",
    )(run(_name))
