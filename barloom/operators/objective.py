"""The search's multi-objective score and its parts, for any number of folds in one pass.

Input rows are (fold, symbol, time, factor, position, ret, delta, pnl); a fold is any label. Windows are per fold and symbol,
and all that is carried on is a row per fold and symbol: the drawdown over the symbols' series laid end to end follows from
each symbol's total, extremes and own drawdown.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scores
from .metrics import search_sortino

COST = 3e-4
MODES = ("ftmo", "forex", "other")
# Weights of annual return, Sortino, Calmar, IC stability, turnover quality, symbol consistency, stressed
# Sortino, reversal and symmetry, by mode, for panels of several symbols and of one.
WEIGHTS = {
    ("ftmo", True): (0.75, 0.05, 0.10, 0.02, 0.03, 0.03, 0.02, 0.0, 0.0),
    ("forex", True): (0.60, 0.10, 0.05, 0.10, 0.05, 0.05, 0.05, 0.0, 0.0),
    ("other", True): (0.60, 0.10, 0.05, 0.10, 0.05, 0.05, 0.05, 0.0, 0.0),
    ("ftmo", False): (0.80, 0.05, 0.10, 0.03, 0.02, 0.0, 0.0, 0.0, 0.0),
    ("forex", False): (0.25, 0.05, 0.05, 0.25, 0.05, 0.0, 0.0, 0.20, 0.15),
    ("other", False): (0.60, 0.15, 0.10, 0.10, 0.05, 0.0, 0.0, 0.0, 0.0),
}
PARTS = ("annual_return", "sortino", "calmar", "ic_stability", "turnover_quality", "symbol_consistency", "cost_stress", "reversal", "symmetry")
N_FOLDS = 5


def within(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def symbol_consistency(n: Column, inactive: Column, active: Column, positive: Column, worst: Column) -> Column:
    """From counts of symbols, of those that trade too little or enough, of the latter with a positive Sortino, and the lowest Sortino."""
    ratio = positive / F.nullif(active, F.lit(0))
    score = (ratio - 0.6) / F.when(ratio < 0.6, 0.6).otherwise(0.4) + F.when(ratio == 1, 0.5).otherwise(0.0)
    return F.when(n == 0, 0.0).when(inactive / n > 0.4, -3.0).when(worst < -2, -2.0).when(active == 0, -3.0).otherwise(score)


def turnover_quality(runs: Column, held: Column, bars: Column) -> Column:
    """One run per 12 bars is best; up to 0.3 more for long runs. Runs are of positions cut to whole numbers."""
    ratio = runs / F.greatest(bars / 12.0, F.lit(1.0))
    often = (
        F.when(ratio <= 0, -2.0)
        .when(ratio < 0.05, -2.0 + ratio / 0.05)
        .when(ratio < 0.5, -1.0 + (ratio - 0.05) / 0.45)
        .when(ratio <= 2, F.exp(-0.5 * F.pow(F.log2(F.nullif(ratio, F.lit(0.0))), F.lit(2))))
        .when(ratio <= 8, 0.5 - (ratio - 2) / 4)
        .otherwise(-2.0)
    )
    hold = F.ln(F.greatest(held / F.nullif(runs, F.lit(0)), F.lit(1.0))) / math.log(30) * 0.3
    return often + F.when(runs > 0, F.least(F.lit(0.3), hold)).otherwise(0.0)


def half_consistency(first: Column, second: Column, bars: Column) -> Column:
    return F.when(bars < 20, 0.0).when((first > 0) & (second > 0), 0.5).when(first * second < 0, -1.0).otherwise(0.0)


def parts(df: DataFrame, ppy: float, cost: float = COST) -> DataFrame:
    """One row per fold with every part of the score."""
    w = Window.partitionBy("fold", "symbol").orderBy("time")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = F.when(F.col("position") < 0, F.ceil("position")).otherwise(F.floor("position")).cast("int")
    each = df.select(
        "*",
        F.lead("ret").over(w).alias("nxt"),
        F.lag("factor").over(w).alias("earlier"),
        (F.row_number().over(w) - 1).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy("fold", "symbol")).alias("t"),
        F.abs(F.col("position") - F.lag("position", 1, 0.0).over(w)).alias("own"),
        (F.abs(F.abs("position") - F.lag(F.abs("position")).over(w)) > 0.1).cast("int").alias("moved"),
        whole.alias("whole"),
        F.lag(whole, 1, 0).over(w).alias("before"),
        F.sum("pnl").over(upto).alias("cum"),
    )
    each = each.withColumn("peak", F.max("cum").over(upto)).withColumn("stressed", F.col("position") * F.col("ret") - 2 * cost * F.col("own"))
    sx, sy = F.stddev_pop(F.when(F.col("nxt").isNotNull(), F.col("factor"))), F.stddev_pop("nxt")
    rx, ry = F.stddev_pop(F.when(F.col("earlier").isNotNull(), F.col("factor"))), F.stddev_pop("earlier")
    auto = F.when((rx > 1e-6) & (ry > 1e-6), F.covar_pop("factor", "earlier") / (rx * ry + 1e-8)).otherwise(0.0)
    per = each.groupBy("fold", "symbol").agg(
        F.count("*").alias("t"),
        search_sortino(F.col("pnl"), ppy).alias("s"),
        F.sum("moved").alias("trades"),
        F.when((sx >= 1e-6) & (sy >= 1e-6), F.covar_pop("factor", "nxt") / (sx * sy + 1e-8)).alias("ic"),
        within(1 - F.abs(auto) + F.when(auto < 0, 0.5).otherwise(0.0), -1.0, 2.0).alias("reversal"),
        F.sum("pnl").alias("total"),
        F.min("cum").alias("low"),
        F.max("cum").alias("high"),
        F.max(F.col("peak") - F.col("cum")).alias("own_drawdown"),
    )
    order = Window.partitionBy("fold").orderBy("symbol")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))
    per = per.withColumn("top", F.max(F.col("base") + F.col("high")).over(earlier))
    enough = F.col("trades") >= F.greatest(F.lit(5), F.floor(F.col("t") / 100))
    ic, spread = F.avg("ic"), F.stddev_pop("ic")
    symbols = per.groupBy("fold").agg(
        F.max("t").alias("bars"),
        F.count("*").alias("symbols"),
        F.max(F.greatest("own_drawdown", F.col("top") - F.col("base") - F.col("low"))).alias("drawdown"),
        symbol_consistency(F.count("*"), F.count_if(~enough), F.count_if(enough), F.count_if(enough & (F.col("s") > 0)), F.min("s")).alias("symbol_consistency"),
        F.when((F.max("t") >= 10) & (F.count("ic") > 0), within(ic / (spread + 1e-6), -3.0, 3.0)).otherwise(0.0).alias("ic_stability"),
        F.avg("reversal").alias("reversal"),
    )
    late = F.col("i") >= F.floor(F.col("t") / 2)
    flat = each.groupBy("fold").agg(
        (F.avg("pnl") * ppy).alias("annual_return"),
        F.avg("pnl").alias("mean_pnl"),
        search_sortino(F.col("pnl"), ppy).alias("sortino"),
        within(search_sortino(F.col("stressed"), ppy), -5.0, 5.0).alias("cost_stress"),
        search_sortino(F.when(~late, F.col("pnl")), ppy).alias("first_half"),
        search_sortino(F.when(late, F.col("pnl")), ppy).alias("second_half"),
        F.avg(F.abs("position")).alias("exposure"),
        F.avg((F.col("position") > 0.05).cast("double")).alias("longs"),
        F.avg((F.col("position") < -0.05).cast("double")).alias("shorts"),
        F.avg((F.col("position") > 0).cast("double")).alias("up"),
        F.avg((F.col("position") < 0).cast("double")).alias("down"),
        F.avg(F.abs("delta")).alias("mean_delta"),
        F.count_if((F.col("whole") != 0) & (F.col("whole") != F.col("before"))).alias("runs"),
        F.count_if(F.col("whole") != 0).alias("held"),
        F.count("*").alias("rows"),
    )
    return flat.join(symbols, "fold").select(
        "fold", "bars", "symbols", "annual_return", "mean_pnl", "sortino", "cost_stress", "symbol_consistency", "ic_stability", "reversal",
        within(F.col("annual_return") / F.greatest("drawdown", F.lit(1e-8)), -10.0, 10.0).alias("calmar"),
        turnover_quality(F.col("runs"), F.col("held"), F.col("rows")).alias("turnover_quality"),
        half_consistency(F.col("first_half"), F.col("second_half"), F.col("bars")).alias("half_consistency"),
        scores.exposure_penalty(F.col("exposure")).alias("exposure_penalty"),
        scores.beta_penalty(F.col("longs"), F.col("shorts")).alias("beta_penalty"),
        scores.turnover_penalty(F.col("mean_delta")).alias("turnover_penalty"),
        within(1 - 2 * (F.abs(F.col("up") - 0.5) + F.abs(F.col("down") - 0.5)), -1.0, 1.0).alias("symmetry"),
    )


def multi_objective(mode: str = "ftmo") -> Column:
    """Score of a row of parts."""
    def of(several):
        return sum((w * F.col(p) for w, p in zip(WEIGHTS[mode, several], PARTS, strict=True) if w), F.lit(0.0))

    return F.when(F.col("symbols") > 1, of(True)).otherwise(of(False)) + F.col("exposure_penalty") + F.col("beta_penalty") + F.col("half_consistency")


def indexed(df: DataFrame) -> DataFrame:
    """Rows with their bar's index i and the number of bars t."""
    w = Window.partitionBy("symbol").orderBy("time")
    return df.withColumn("i", F.row_number().over(w) - 1).withColumn("t", F.count(F.lit(1)).over(Window.partitionBy("symbol")))


def in_and_out_of_sample(df: DataFrame) -> DataFrame:
    d = indexed(df)
    return d.withColumn("fold", F.when(F.col("i") < F.floor(F.col("t") * 0.8), "in").otherwise("out")).drop("i", "t")


def evaluation(df: DataFrame, ppy: float, mode: str = "ftmo") -> DataFrame:
    """Score of the first 80 % of the bars, gated by the Sortino of the rest, and the rest's mean."""
    p = parts(in_and_out_of_sample(df), ppy).select("fold", (multi_objective(mode) + F.col("turnover_penalty")).alias("score"), "sortino", "mean_pnl")
    one = p.agg(*[F.max(F.when(F.col("fold") == f, F.col(c))).alias(n) for f, c, n in (("in", "score", "score"), ("out", "sortino", "sortino"), ("out", "mean_pnl", "mean_oos"))])
    return one.select(scores.out_of_sample(F.col("score"), F.col("sortino")).alias("score"), "mean_oos")


def walk_forward(df: DataFrame, folds: int = N_FOLDS) -> DataFrame:
    """Rows once per fold that they train or validate: block k trains fold k + 1 and validates fold k."""
    d = indexed(df).withColumn("block", F.floor(F.col("i") / F.floor(F.col("t") / folds)).cast("int"))
    role = F.array(F.when(F.col("block") < folds - 1, F.struct((F.col("block") + 1).alias("k"), F.lit("train").alias("role"))), F.when((F.col("block") > 0) & (F.col("block") < folds), F.struct(F.col("block").alias("k"), F.lit("val").alias("role"))))
    return d.withColumn("fold", F.explode(F.array_compact(role))).drop("i", "t", "block")


def fold_scores(df: DataFrame, ppy: float, folds: int = N_FOLDS, mode: str = "ftmo") -> DataFrame:
    """Train and validation score of each walk-forward fold."""
    p = parts(walk_forward(df, folds), ppy)
    score = multi_objective(mode)
    both = p.select("fold.*", F.when(F.col("fold.role") == "train", score + F.col("turnover_penalty")).otherwise(scores.out_of_sample(score, F.col("sortino"))).alias("score"))
    return both.groupBy(F.col("k").alias("fold")).agg(F.max(F.when(F.col("role") == "train", F.col("score"))).alias("train_score"), F.max(F.when(F.col("role") == "val", F.col("score"))).alias("val_score"))
