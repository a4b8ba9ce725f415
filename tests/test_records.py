"""Ledgers, payloads and scores on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from barloom.operators import objective, payloads, records
from barloom.sources import exchanges


def test_a_holdout_is_used_once(spark, tmp_path):
    path = str(tmp_path / "seals")
    records.seal(spark, path, "abc", "first")
    with pytest.raises(ValueError):
        records.seal(spark, path, "abc")
    records.seal(spark, path, "def")
    assert sorted(tuple(r) for r in records.seals(spark, path).collect()) == [("abc", "first"), ("def", "")]


def test_payload_has_nulls_for_what_is_no_number(spark):
    eq = spark.createDataFrame([(2, float("nan"), 0.5), (1, 1.1234567, float("inf"))], "time long, equity double, drawdown double")
    trades = spark.createDataFrame([("a", k, 10 - k, 20, 1, 0.1, 3) for k in range(5)], "symbol string, trade_id long, entry_time long, exit_time long, direction int, pnl double, n_bars long")
    p = json.loads(payloads.payload(eq, trades, {"ppy": 10}, 3).first()["payload"])
    assert p["series"] == {"time": [1, 2], "equity": [1.123457, None], "drawdown": [None, 0.5]}
    assert [t["start"] for t in p["trades"]] == [6, 7, 8] and p["trades_truncated"] and p["meta"] == {"ppy": "10"}
    assert not json.loads(payloads.payload(eq, trades.limit(0), {}, 3).first()["payload"])["trades_truncated"]


def test_pages_without_a_closed_candle(spark):
    page = lambda rows: spark.createDataFrame([("s", 0, json.dumps(rows))], "symbol string, number int, page string")
    one = [["1000000", "1", "2", "0.5", "1.5", None, "1999999"]]
    assert [tuple(r) for r in exchanges.klines(page(one), 1500000).collect()] == [("s", 1000, 1.0, 2.0, 0.5, 1.5, 0.0)]
    assert exchanges.klines(page([*one, ["2000000", "1", "2", "0.5", "1.5", "3", "2999999"]]), 2500000).count() == 1
    assert exchanges.candles(page([["1000000", "1", "2", "0.5", "1.5", "3", "", "", "0"]])).count() == 0
    assert exchanges.klines(page([]), 0).count() == 0


def test_drawdown_over_symbols_laid_end_to_end(spark):
    pnl = {"a": [0.1, -0.3, 0.1], "b": [-0.2, 0.05, -0.1], "c": [0.5, -0.1, 0.0]}
    rows = [("all", s, t, 0.1 * t, 0.5, 0.0, 0.0, x) for s, xs in pnl.items() for t, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "fold string, symbol string, time long, factor double, position double, ret double, delta double, pnl double")
    flat = [x for s in sorted(pnl) for x in pnl[s]]
    cum = [sum(flat[: i + 1]) for i in range(len(flat))]
    worst = max(max(cum[: i + 1]) - cum[i] for i in range(len(cum)))
    got = objective.parts(df, 1.0).select("calmar", "half_consistency", "turnover_quality", F.lit(1)).first()
    assert abs(got["calmar"] - sum(flat) / len(flat) / worst) < 1e-9 and got["half_consistency"] == 0.0 and got["turnover_quality"] == -2.0


def test_orders_without_an_intent_or_a_fill(spark):
    from barloom.operators import compare

    intents = spark.createDataFrame([(1, 2.0), (2, 1.0), (4, 3.0)], "order_id long, lots double")
    fills = spark.createDataFrame([(1, 1.5), (1, 0.5), (3, 1.0), (4, 1.0)], "order_id long, lots double")
    got = {r["order_id"]: r["status"] for r in compare.reconcile(intents, fills).collect()}
    assert got == {1: "matched", 2: "no_fill", 3: "no_intent", 4: "lots_differ"}


def test_equal_scores_and_names_go_by_id(spark):
    rows = [(i, "bolt", "f", "AB"[i % 2], 9.0) for i in range(40)]
    want = [(i, i + 1) for i in range(5)]
    for order in (rows, rows[::-1], rows[7:] + rows[:7]):
        df = spark.createDataFrame(order, "id long, name string, file string, tokens string, score double").repartition(3)
        top = records.top_per_file(df, 5)
        assert sorted((r["id"], r["place"]) for r in top.collect()) == want
        assert sorted((r["tokens"], r["place"], r["id"]) for r in records.distinct_members(top).collect()) == [("A", 1, 0), ("B", 2, 1)]
