"""Scores of the search: information against the next bar, penalties and gates of one candidate, all from aggregate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import series
from .metrics import correlation, search_sortino

IC_GATE = 0.01


def next_bar_ic(df: DataFrame) -> DataFrame:
    """Per symbol: population correlation of the factor with the next bar's return, denominators widened by 1e-8."""
    d = df.withColumn("nxt", F.lead("ret").over(series())).where("nxt IS NOT NULL")
    cov = F.covar_pop("factor", "nxt")
    return d.groupBy("symbol").agg((cov / (F.stddev_pop("factor") * F.stddev_pop("nxt") + 1e-8)).alias("ic"))


def ic_gate(score: Column, ic: Column) -> Column:
    return F.when(ic > IC_GATE, score * 1.15).when(ic < -IC_GATE, score * 0.75).otherwise(score)


def exposure_penalty(mean_abs: Column) -> Column:
    return F.when(mean_abs < 0.10, 2.0 * (mean_abs / 0.10 - 1)).otherwise(0.0)


def beta_penalty(longs: Column, shorts: Column) -> Column:
    m = F.greatest(longs, shorts)
    return F.when(m > 0.85, -2.0 * (m - 0.85) / 0.15).when(m > 0.70, -0.5 * (m - 0.70) / 0.15).otherwise(0.0)


def turnover_penalty(mean_delta: Column) -> Column:
    return -F.greatest(F.least(3.0 * (mean_delta - 0.2), F.lit(3.0)), F.lit(0.0))


def out_of_sample(score: Column, sortino: Column) -> Column:
    """Validation score by the Sortino of the same bars."""
    return score * F.when(sortino <= 0, F.greatest(F.lit(0.1), 0.5 + 0.4 * sortino)).otherwise(F.least(F.lit(1.2), 1.0 + 0.1 * sortino))


def components(df: DataFrame, ppy: float, cost: float = 3e-4) -> DataFrame:
    """Per symbol from (position, ret): annual return, search Sortino, exposure, shares long and short, mean change, and the
    penalties that follow from them. Costs are charged at one rate on the absolute change."""
    d = df.withColumn("delta", F.abs(F.col("position") - F.lag("position", 1, 0.0).over(series())))
    d = d.withColumn("net", F.col("position") * F.col("ret") - cost * F.col("delta"))
    out = d.groupBy("symbol").agg(
        (F.avg("net") * ppy).alias("annual_return"),
        search_sortino(F.col("net"), ppy).alias("sortino"),
        F.avg(F.abs("position")).alias("exposure"),
        F.avg((F.col("position") > 0.05).cast("double")).alias("longs"),
        F.avg((F.col("position") < -0.05).cast("double")).alias("shorts"),
        F.avg("delta").alias("mean_delta"),
    )
    return out.select(
        "*",
        exposure_penalty(F.col("exposure")).alias("exposure_penalty"),
        beta_penalty(F.col("longs"), F.col("shorts")).alias("beta_penalty"),
        turnover_penalty(F.col("mean_delta")).alias("turnover_penalty"),
        F.greatest(F.least(1 - 2 * (F.abs(F.col("longs") - 0.5) + F.abs(F.col("shorts") - 0.5)), F.lit(1.0)), F.lit(-1.0)).alias("symmetry"),
    )


def reversal_bonus(df: DataFrame) -> DataFrame:
    """Mean over symbols of 1 - |a| (+ 0.5 where a < 0), within -1 and 2, a the lag-1 autocorrelation of the factor."""
    d = df.withColumn("before", F.lag("factor").over(series())).where("before IS NOT NULL")
    a = F.coalesce(correlation("factor", "before"), F.lit(0.0))
    per = d.groupBy("symbol").agg(a.alias("a"))
    return per.agg(F.avg(F.greatest(F.least(1 - F.abs("a") + F.when(F.col("a") < 0, 0.5).otherwise(0.0), F.lit(2.0)), F.lit(-1.0))).alias("reversal"))


def vol_target_lots(equity: float, target: float, atr: Column, contract: float, step: float = 0.01, least: float = 0.01) -> Column:
    """Lots for a risk budget per average range, cut to the step; 0 below the least lot."""
    lots = F.floor(equity * target / F.nullif(atr * contract, F.lit(0.0)) / step + 1e-9) * step
    return F.when(lots >= least - 1e-12, lots).otherwise(0.0)


