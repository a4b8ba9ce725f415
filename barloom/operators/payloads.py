"""JSON texts: a back-test (series of a portfolio, a number per bar however many symbols, and its first trades); specs, a line each."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPEC_VERSION = 1
SPEC = "spec_version int, name string, payload struct<kind: string, tokens: array<int>, vocab_version: string>, evidence struct<train: double, val: double, verdict: string>, notes string"
DIGITS = 6
TRADES = 200


def told(c: str) -> Column:
    """Rounded; null for what isn't a number."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.round(c, DIGITS))


def payload(equity: DataFrame, trades: DataFrame, meta: dict, most: int = TRADES) -> DataFrame:
    """One row (payload) of JSON with meta, series, the first trades by entry and whether there are more."""
    names = ("equity", "drawdown")
    rows = F.sort_array(F.collect_list(F.struct("time", *[told(c).alias(c) for c in names])))
    series = equity.agg(rows.alias("r")).select(F.struct(*[F.col("r")[c].alias(c) for c in ("time", *names)]).alias("series"))
    first = trades.orderBy("entry_time", "symbol", "trade_id").limit(most + 1)
    one = F.struct(F.col("entry_time").alias("start"), F.col("symbol"), F.col("trade_id"), F.col("exit_time").alias("end"), "direction", told("pnl").alias("pnl"), F.col("n_bars").alias("bars"))
    detail = first.agg(F.sort_array(F.collect_list(one)).alias("t")).select(F.slice("t", 1, most).alias("trades"), (F.size("t") > most).alias("trades_truncated"))
    told_ = F.to_json(F.struct(F.from_json(F.lit(json.dumps(meta)), "map<string,string>").alias("meta"), "series", "trades", "trades_truncated"), {"ignoreNullFields": "false"})
    return series.join(F.broadcast(detail)).select(told_.alias("payload"))  # a row on both sides


def specs_json(specs: DataFrame, vocab_version: str) -> DataFrame:
    """(name, spec) of specs (name, tokens, train, val, verdict, notes); fields that are null are written."""
    body = F.struct(
        F.lit(SPEC_VERSION).alias("spec_version"),
        "name",
        F.struct(F.lit("formula").alias("kind"), "tokens", F.lit(vocab_version).alias("vocab_version")).alias("payload"),
        F.struct(told("train").alias("train"), told("val").alias("val"), "verdict").alias("evidence"),
        "notes",
    )
    return specs.select("name", F.to_json(body, {"ignoreNullFields": "false"}).alias("spec"))


def read_specs(texts: DataFrame) -> DataFrame:
    """Specs of JSON texts (spec) that are of this version and name tokens; others are left out."""
    s = texts.select(F.from_json("spec", SPEC).alias("s"))
    ok = (F.col("s.spec_version") == SPEC_VERSION) & (F.size("s.payload.tokens") > 0)
    return s.where(ok).select("s.name", "s.payload.tokens", "s.evidence.train", "s.evidence.val", "s.evidence.verdict", "s.notes")
