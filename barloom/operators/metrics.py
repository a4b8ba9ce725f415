"""Aggregates over series of profit and loss, and of factors against returns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .portfolio import equity

YEAR = 31557600
MULTIPLES = (0.5, 1.0, 2.0, 3.0)


def periods_per_year(panel: DataFrame) -> DataFrame:
    """Bars per year of the upper median symbol, rounded, within 10 and 600000; 6240 if no symbol spans time."""
    per = panel.groupBy("symbol").agg((F.count("*") / (F.nullif(F.max("time") - F.min("time"), F.lit(0)) / F.lit(YEAR))).alias("p")).where("p is not null")
    many = per.agg(F.sort_array(F.collect_list("p")).alias("l"))  # one number per symbol
    upper = F.get(F.col("l"), F.floor(F.size("l") / 2).cast("int"))
    return many.select(F.coalesce(F.least(F.greatest(F.round(upper), F.lit(10.0)), F.lit(600000.0)), F.lit(6240.0)).alias("ppy"))


def correlation(x: str, y: str) -> Column:
    """Pearson's, null where one side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) * F.stddev_pop(F.when(F.col(x).isNotNull(), F.col(y))), F.lit(0.0))


def sharpe(x: Column, ppy: float) -> Column:
    sd = F.stddev_samp(x)
    return F.when(F.coalesce(sd, F.lit(0.0)) < 1e-12, 0.0).otherwise(F.avg(x) / F.nullif(sd, F.lit(0.0)) * math.sqrt(ppy))


def sortino(x: Column, ppy: float) -> Column:
    """Against the deviation of negative values, of which two are needed."""
    sd = F.stddev_samp(F.when(x < 0, x))
    return F.when(F.coalesce(sd, F.lit(0.0)) < 1e-12, 0.0).otherwise(F.avg(x) / F.nullif(sd, F.lit(0.0)) * math.sqrt(ppy))


def search_sortino(x: Column, ppy: float) -> Column:
    """Population deviations: of the negative values, at least a fifth of that of all; within 20."""
    down = F.coalesce(F.stddev_pop(F.when(x < 0, x)), F.lit(0.0))
    whole = F.greatest(F.stddev_pop(x), F.lit(1e-8))
    return F.greatest(F.least(F.avg(x) / F.greatest(down, 0.2 * whole, F.lit(1e-8)) * math.sqrt(ppy), F.lit(20.0)), F.lit(-20.0))


def performance(series: DataFrame, ppy: float, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (per group) of return, volatility, Sharpe, Sortino, drawdown and Calmar from (time, pnl)."""
    x = F.col("pnl")
    out = equity(series, by).groupBy(*by).agg(
        (F.avg(x) * ppy).alias("annual_return"),
        (F.coalesce(F.stddev_samp(x), F.lit(0.0)) * math.sqrt(ppy)).alias("volatility"),
        sharpe(x, ppy).alias("sharpe"),
        sortino(x, ppy).alias("sortino"),
        F.max("relative").alias("max_drawdown"),
        F.count("*").alias("n_bars"),
    )
    return out.withColumn("calmar", F.when(F.col("max_drawdown") > 1e-12, F.col("annual_return") / F.nullif(F.col("max_drawdown"), F.lit(0.0))).otherwise(0.0))


def turnover(df: DataFrame) -> DataFrame:
    """Mean over symbols of the sum of absolute position changes."""
    return df.groupBy("symbol").agg(F.sum(F.abs("delta")).alias("t")).agg(F.avg("t").alias("turnover"))


def cost_sensitivity(df: DataFrame, ppy: float, buy: float = 3e-4, sell: float = 3e-4) -> DataFrame:
    """Performance at multiples of the costs, in which pnl is linear: bars are averaged over symbols once, then repeated."""
    cost = buy * F.greatest(F.col("delta"), F.lit(0.0)) + sell * F.greatest(-F.col("delta"), F.lit(0.0))
    bars = df.groupBy("time").agg(F.avg(F.col("position") * F.col("ret")).alias("gross"), F.avg(cost).alias("cost"))
    each = bars.withColumn("multiple", F.explode(F.array(*[F.lit(v) for v in MULTIPLES])))
    return performance(each.select("multiple", "time", (F.col("gross") - F.col("multiple") * F.col("cost")).alias("pnl")), ppy, ("multiple",))


def information(df: DataFrame) -> DataFrame:
    """ic and rank_ic per symbol (average ranks for ties); symbols whose factor or return is constant are left out."""
    def rank(c):
        by = Window.partitionBy("symbol").orderBy(c)
        return F.rank().over(by) + (F.count(F.lit(1)).over(Window.partitionBy("symbol", c)) - 1) / 2.0

    ranked = df.withColumn("rf", rank("factor")).withColumn("rr", rank("ret"))
    out = ranked.groupBy("symbol").agg(correlation("factor", "ret").alias("ic"), correlation("rf", "rr").alias("rank_ic"), F.stddev_pop("factor").alias("sf"), F.stddev_pop("ret").alias("sr"))
    return out.where("sf > 1e-12 and sr > 1e-12").select("symbol", "ic", "rank_ic")


def information_ratio(per_symbol: DataFrame) -> DataFrame:
    return per_symbol.agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.when(F.stddev_pop("rank_ic") > 1e-12, F.avg("rank_ic") / F.stddev_pop("rank_ic")).otherwise(0.0).alias("ir"))


def mutual_information(df: DataFrame, bins: int) -> DataFrame:
    """Of factor and ret in nats, over equally frequent bins (quantile edges), never below 0."""
    shares = [i / bins for i in range(1, bins)]
    q = df.agg(F.percentile("factor", F.array(*[F.lit(s) for s in shares])).alias("qx"), F.percentile("ret", F.array(*[F.lit(s) for s in shares])).alias("qy"), F.max("factor").alias("mx"), F.max("ret").alias("my"))
    met = df.join(F.broadcast(q))  # one row

    def bin_of(edges, v, most):  # an edge at the maximum ends the last bin
        return F.size(F.filter(F.array_distinct(edges), lambda e: (e <= v) & (e < most)))

    cells = met.groupBy(bin_of(F.col("qx"), F.col("factor"), F.col("mx")).alias("bx"), bin_of(F.col("qy"), F.col("ret"), F.col("my")).alias("by")).agg(F.count("*").cast("double").alias("n"))
    one = cells.withColumn("nx", F.sum("n").over(Window.partitionBy("bx"))).withColumn("ny", F.sum("n").over(Window.partitionBy("by"))).withColumn("t", F.sum("n").over(Window.partitionBy()))
    return one.agg(F.greatest(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))), F.lit(0.0)).alias("mi"))


def daily(fills: DataFrame) -> DataFrame:
    return fills.groupBy(F.to_date(F.timestamp_seconds("ts")).cast("string").alias("day")).agg(F.sum(F.col("profit") + F.col("fee")).alias("realised"))
