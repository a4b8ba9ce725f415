"""From factors to positions, profit and loss, equity and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import series


def target_return(df: DataFrame) -> DataFrame:
    """ret: log return from the next open to the one after it; 0 for the last two bars."""
    nxt, after = F.lead("open", 1).over(series()), F.lead("open", 2).over(series())
    return df.withColumn("ret", F.coalesce(F.ln(F.when(after == 0, 1.0).otherwise(after) / F.when(nxt == 0, 1.0).otherwise(nxt)), F.lit(0.0)))


def position(factor: Column, band: float = 0.05, long_only: bool = False) -> Column:
    p = F.tanh(factor)
    p = F.when(F.abs(p) < band, 0.0).otherwise(p)
    return F.greatest(p, F.lit(0.0)) if long_only else p


def direction(p: Column, band: float = 0.05) -> Column:
    return F.when(p > band, 1).when(p < -band, -1).otherwise(0)


def action(now: Column, wanted: Column) -> Column:
    return F.when(now == wanted, "HOLD").when(now == 0, "OPEN").when(wanted == 0, "CLOSE").otherwise("REVERSE")


def pnl(df: DataFrame, buy: float = 3e-4, sell: float = 3e-4) -> DataFrame:
    """delta and pnl: position times return, less costs of what is bought and sold; the first bar trades from 0."""
    d = F.col("position") - F.lag("position", 1, 0.0).over(series())
    out = df.withColumn("delta", d)
    return out.withColumn("pnl", F.col("position") * F.col("ret") - buy * F.greatest(F.col("delta"), F.lit(0.0)) - sell * F.greatest(-F.col("delta"), F.lit(0.0)))


def portfolio(df: DataFrame) -> DataFrame:
    """Equal-weight mean over symbols per bar."""
    return df.groupBy("time").agg(F.avg("pnl").alias("pnl"))


def equity(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """equity = 1 + running sum of pnl, its peak, and the drawdown absolute and relative. A portfolio is one series, one row
    per bar, however many symbols there are."""
    w = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("equity", 1 + F.sum("pnl").over(w))
    out = out.withColumn("peak", F.max("equity").over(w))
    return out.withColumn("drawdown", F.col("peak") - F.col("equity")).withColumn("relative", F.when(F.col("peak") != 0, F.col("drawdown") / F.abs("peak")).otherwise(0.0))


def rolling_sharpe(df: DataFrame, bars_per_year: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Null before a full window of a twelfth of a year; 0 where the window is constant."""
    n = max(2, int(bars_per_year) // 12)
    w = Window.partitionBy(*by).orderBy("time").rowsBetween(1 - n, 0)
    sd = F.stddev_samp("pnl").over(w)
    value = F.when(sd <= 1e-12, 0.0).otherwise(F.avg("pnl").over(w) / F.nullif(sd, F.lit(0.0)) * (bars_per_year**0.5))
    return df.withColumn("rolling_sharpe", F.when(F.count(F.lit(1)).over(w) == n, value))


def trades(df: DataFrame, band: float = 0.05) -> DataFrame:
    """A row per trade of each symbol (gaps and islands on the sign of positions of at least band): the bar that flattens belongs to the trade it
    ends, a bar that flips to the new one, flat bars in between to the later one; leading and trailing flat bars to none."""
    w = series()
    p = F.col("position")
    d = F.when((p >= band) & (p > 0), 1).when((p <= -band) & (p < 0), -1).otherwise(0)
    t = df.select("symbol", "time", "pnl", d.alias("d"))
    t = t.withColumn("next", F.lead("d").over(w)).withColumn("prev", F.lag("d").over(w))
    ends = ((F.col("d") != 0) & (F.col("next").isNull() | ((F.col("next") != F.col("d")) & (F.col("next") != 0)))) | ((F.col("d") == 0) & (F.coalesce("prev", F.lit(0)) != 0))
    t = t.withColumn("end", ends)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("trade_id", F.coalesce(F.sum(F.col("end").cast("int")).over(before), F.lit(0)).cast("long")).withColumn("begun", F.max((F.col("d") != 0).cast("int")).over(upto) == 1)
    return (
        t.where("begun")
        .groupBy("symbol", "trade_id")
        .agg(
            F.min("time").alias("entry_time"),
            F.max("time").alias("exit_time"),
            F.max_by("d", F.struct(F.col("d") != 0, F.col("time"))).alias("direction"),
            F.sum("pnl").alias("pnl"),
            F.count("*").alias("n_bars"),
            F.max(F.col("end").cast("int")).alias("closed"),
        )
        .where("closed = 1")
        .drop("closed")
    )


def trade_summary(t: DataFrame) -> DataFrame:
    """Profit factor is the ratio of the mean win to the mean loss, infinite without losses."""
    win, loss = F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))), F.avg(F.when(F.col("pnl") < 0, F.col("pnl")))
    return t.agg(
        F.count("*").alias("n_trades"),
        F.count_if(F.col("pnl") > 0).alias("n_wins"),
        (F.count_if(F.col("pnl") > 0) / F.count("*")).alias("win_rate"),
        F.coalesce(win, F.lit(0.0)).alias("avg_win"),
        F.coalesce(loss, F.lit(0.0)).alias("avg_loss"),
        F.when(loss.isNull(), F.lit(float("inf"))).otherwise(F.coalesce(win, F.lit(0.0)) / F.abs(loss)).alias("profit_factor"),
        F.max("pnl").alias("best"),
        F.min("pnl").alias("worst"),
    )


def netting(fills: DataFrame) -> DataFrame:
    """Net lots per (symbol, magic) of fills (side, lots, price), volume-weighted price of the net side; flat pairs are left out."""
    signed = F.when(F.col("side") == "BUY", F.col("lots")).otherwise(-F.col("lots"))
    buy, sell = F.col("side") == "BUY", F.col("side") == "SELL"
    out = fills.groupBy("symbol", "magic").agg(
        F.sum(signed).alias("net"),
        (F.sum(F.when(buy, F.col("lots") * F.col("price"))) / F.sum(F.when(buy, F.col("lots")))).alias("b"),
        (F.sum(F.when(sell, F.col("lots") * F.col("price"))) / F.sum(F.when(sell, F.col("lots")))).alias("s"),
    )
    return out.where(F.abs("net") >= 1e-12).select("symbol", "magic", "net", F.when(F.col("net") > 0, F.col("b")).otherwise(F.col("s")).alias("vwap"))
