"""Closed bars and signals from a stream of ticks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def closed_bars(ticks: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """Tumbling bars of a stream (symbol, ts timestamp, price, size, seq): emitted once the watermark has passed their end, so a
    forming bar is never seen and ticks that come later are dropped."""
    at = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
        .select("symbol", F.unix_timestamp("w.start").alias("time"), "open", "high", "low", "close", "volume")
    )


SIGNAL = "symbol string, time long, position double, changed boolean"
STATE = "times array<long>, closes array<double>, last_time long, last_sign int"


def momentum_signals(bars: DataFrame, lookback: int = 20, band: float = 0.05) -> DataFrame:
    """A stateful signal per closed bar: tanh of the z-score of the close over lookback bars, 0 before; bars at or before the last
    one of their symbol are dropped; changed marks a new direction. State is the last lookback bars."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, closes, last, sign = state.get if state.exists else ([], [], -(2**62), 0)
        times, closes = list(times), list(closes)
        got = pd.concat(list(batches)).sort_values("time").drop_duplicates("time", keep="last")
        out = []
        for t, c in zip(got["time"], got["close"], strict=True):
            if t <= last:
                continue
            times, closes, last = [*times, int(t)][-lookback:], [*closes, float(c)][-lookback:], int(t)
            p = position(closes, lookback, band)
            now = (p > 0) - (p < 0)
            out.append((key[0], last, p, now != sign))
            sign = now
        state.update((times, closes, last, sign))
        yield pd.DataFrame(out, columns=["symbol", "time", "position", "changed"])

    return bars.groupBy("symbol").applyInPandasWithState(step, SIGNAL, STATE, "append", GroupStateTimeout.NoTimeout)


def position(closes: list[float], lookback: int, band: float) -> float:
    """The signal of a full window of closes; the batch path uses the same function."""
    if len(closes) < lookback:
        return 0.0
    s = pd.Series(closes)
    sd = s.std()
    p = float(math.tanh((closes[-1] - s.mean()) / sd)) if sd > 1e-12 else 0.0
    return p if abs(p) >= band else 0.0


def next_open_fills(bars: DataFrame, intents: DataFrame, slippage: float = 1e-4, fee: float = 2e-5) -> DataFrame:
    """Intents (symbol, time, lots) queued at a bar fill at the next bar's open, moved against them by slippage."""
    nxt = bars.select("symbol", "time", F.lead("open").over(Window.partitionBy("symbol").orderBy("time")).alias("next_open"), F.lead("time").over(Window.partitionBy("symbol").orderBy("time")).alias("fill_time"))
    price = F.col("next_open") * (1 + slippage * F.signum("lots"))
    return intents.join(nxt, ["symbol", "time"]).where("next_open IS NOT NULL").select("symbol", "fill_time", "lots", price.alias("price"), (F.abs("lots") * price * fee).alias("fee"))
