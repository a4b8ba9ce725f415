"""Panel operators, features and reports against NumPy and DuckDB on small inputs."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom import registry
from barloom.functions import features, formula, vocabulary
from barloom.functions.expr import Env
from barloom.operators import gates, portfolio
from barloom.plans import compiler

SF = "/root/testdata/sf0.001"


def panel(spark, n=240, symbols=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        o = c * (1 + rng.normal(0, 0.002, n))
        h, l = np.maximum(o, c) * 1.003, np.minimum(o, c) * 0.997
        rows += [(f"s{s}", i * 3600, float(o[i]), float(h[i]), float(l[i]), float(c[i]), float(rng.integers(1, 50))) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, time long, open double, high double, low double, close double, volume double")


def test_vocabulary_version_is_frozen():
    assert len(features.FEATURES) == 65 and len(formula.OPERATORS) == 62
    assert vocabulary.version() == "v9217a2c0d91a"


def test_formulas_that_cant_be_evaluated():
    assert vocabulary.feasible([0, 1, 65])
    for tokens in ([65], [0, 1], [], [200], [-1]):
        assert not vocabulary.feasible(tokens)
    assert vocabulary.depths([0, 1, 65, 2, 68]) == [1, 2, 1, 2, 1]
    assert vocabulary.hamming([1, 2, 3], [1, 5, 3]) == 1 and vocabulary.repeats([1, 1, 2, 2, 2]) == 3


def test_registration_errors():
    with pytest.raises(formula.RegistrationError):
        formula.operator("ADD", 2, lambda env, x, y: x)
    with pytest.raises(formula.RegistrationError):
        formula.operator("WIDE", 11, lambda env: None)
    with pytest.raises(formula.RegistrationError):
        features.feature("RET", "trend")(lambda env: None)



def test_padding_and_special_values(spark):
    values = [1.0, float("nan"), float("inf"), -1e-6, 0.0, -float("inf"), 2.0]
    df = spark.createDataFrame([("a", i, v, 1.0, 1.0, v, 1.0) for i, v in enumerate(values)], "symbol string, time long, open double, high double, low double, close double, volume double")
    env = Env(df)
    x = env["close"]
    out = {n: formula.apply(env, n, *[x] * formula.OPERATORS[n].arity) for n in ("ADD", "DIV", "SIGN", "GATE", "MIN", "MAX", "DELAY1")}
    rows = env.frame(out).orderBy("time").collect()
    assert [r["ADD"] for r in rows] == [2.0, 0.0, 1.0, -2e-6, 0.0, -1.0, 4.0]
    assert [r["SIGN"] for r in rows] == [1.0, 0.0, 1.0, -1.0, 0.0, -1.0, 1.0]
    assert rows[3]["DIV"] == -1.0 and rows[4]["DIV"] == 0.0
    assert [r["GATE"] for r in rows][2] == 0.0  # inf * 0
    assert [r["MIN"] for r in rows][1] == 0.0 and [r["DELAY1"] for r in rows][0] == 0.0


def test_rolling_operators_against_numpy(spark):
    df = panel(spark, 60, 1)
    env = Env(df)
    x = env["close"]
    names = ("TS_MEAN_10", "TS_STD_5", "TS_MAX_10", "EMA_5", "TS_RANK_5", "TS_ARG_MIN_5", "WINSORIZE", "JUMP")
    rows = env.frame({n: formula.apply(env, n, x) for n in names} | {"x": x}).orderBy("time").collect()
    v = np.array([r["x"] for r in rows])

    def win(n):
        p = np.concatenate([np.zeros(n - 1), v])
        return np.stack([p[i : i + n] for i in range(len(v))])

    ema = [v[0]]
    for y in v[1:]:
        ema.append(y / 3 + ema[-1] * 2 / 3)
    want = {
        "TS_MEAN_10": win(10).mean(1),
        "TS_STD_5": win(5).std(1) + 1e-6,
        "TS_MAX_10": win(10).max(1),
        "EMA_5": np.array(ema),
        "TS_RANK_5": (win(5) < v[:, None]).mean(1),
        "TS_ARG_MIN_5": win(5).argmin(1) / 4,
        "WINSORIZE": np.clip(v, np.quantile(win(20), 0.05, axis=1), np.quantile(win(20), 0.95, axis=1)),
    }
    for n, w in want.items():
        np.testing.assert_allclose([r[n] for r in rows], w, rtol=1e-9, atol=1e-9, err_msg=n)
    assert [r["JUMP"] for r in rows][:5] == [0.0] * 5


def test_the_future_doesnt_change_the_past(spark):
    tokens = [3, 33, 119, 66, 62, 65]
    df = panel(spark, 230, 2)
    shifted = df.selectExpr("symbol", "time", *[f"CASE WHEN time >= 210 * 3600 THEN {c} * 3 ELSE {c} END AS {c}" for c in ("open", "high", "low", "close", "volume")])
    out = []
    for d in (df, shifted):
        env = Env(d)
        e = compiler.compile_formula(env, tokens)
        out.append([r["f"] for r in env.frame({"f": e}).where("time < 210 * 3600").orderBy("symbol", "time").collect()])
    assert out[0] == out[1] and any(out[0])


def test_trades_own_their_bars(spark):
    pos = [0, 0, 0.5, 0.6, 0, 0, -0.5, 0.7, 0.7, 0, 0]
    df = spark.createDataFrame([("a", i, float(p), float(i)) for i, p in enumerate(pos)], "symbol string, time long, position double, pnl double")
    got = [(r["entry_time"], r["exit_time"], r["direction"]) for r in portfolio.trades(df, 0.05).orderBy("trade_id").collect()]
    assert got == [(2, 4, 1), (5, 6, -1), (7, 9, 1)]


def test_gates():
    assert gates.deflated_sharpe(0.1, 500, 1) == 1.0
    assert gates.deflated_sharpe(0.1, 500, 10) > gates.deflated_sharpe(0.1, 500, 1000)
    assert gates.bonferroni(0.05, 10) == 0.005 and gates.expected_max(1, 1.0) == -math.inf
    assert all(a[2] == a[1] for a in gates.walk_forward(1003))
    assert gates.prune([("a", 1.0), ("b", 0.9), ("c", 0.5)], {("a", "b"): 0.95, ("a", "c"): 0.1, ("b", "c"): 0.2}) == ["a", "c"]


def canonical(rows, columns):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "None"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize(
    "name",
    ["bars_lineitem_d1", "bars_dense_h1", "bars_rebar_offset", "compare_sources", "contradicted_gaps", "candles_decode", "fx_jump", "fx_cs_rank", "feature_supertrend_dir", "trades", "performance", "information_coefficients", "benjamini_hochberg", "verdicts"],
)
def test_query_and_sql_agree(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    import duckdb

    db = duckdb.connect()
    for t in ("events", "lineitem", "orders", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = db.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = [dict(zip(columns, r)) for r in cur.fetchall()]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert canonical([r.asDict() for r in got.collect()], sorted(columns)) == canonical(want, sorted(columns))


def test_entry_runs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_few_frames_are_kept(spark):
    rows = [(s, t, float(t * k % 7)) for k, s in enumerate("abc") for t in range(30)]
    frames = [spark.createDataFrame(rows, "symbol string, time long, factor double").withColumn("factor", F.col("factor") + k) for k in range(4)]
    got = [compiler.normalise(f) for f in frames]
    assert [f.is_cached for f in frames[-2:]] == [True, True] and len(compiler._HELD) == 2
    assert all(g.count() == 90 for g in got)
