"""Scores of candidate factors: information, ranks over candidates, ablation, the active subset, combination.

Candidates are long rows (name, symbol, time, factor, ret). What leaves the windows is a row per candidate and symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import correlation

W_RANK, W_MI = 0.6, 0.4
FLAT = 1e-8
WINDOWS = 5


def stacked(panel: DataFrame, names: list[str]) -> DataFrame:
    """A row per bar and candidate column."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("factor")) for n in names])).alias("c")
    return panel.select("symbol", "time", "ret", each).select("c.name", "symbol", "time", "c.factor", "ret")


def _rank(by: list[str], c: str) -> Column:
    w = Window.partitionBy(*by).orderBy(c)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2.0


def _mutual(c: DataFrame, bins: int) -> DataFrame:
    """(name, mi) over equally frequent bins of each candidate's factor and of the returns."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = c.groupBy(F.col("name").alias("__name")).agg(F.array_distinct(F.percentile("factor", shares)).alias("qx"), F.array_distinct(F.percentile("ret", shares)).alias("qy"), F.max("factor").alias("mx"), F.max("ret").alias("my"))
    met = c.join(edges, F.col("name") == F.col("__name"))
    bin_of = lambda q, v, most: F.size(F.filter(q, lambda e: (e <= v) & (e < most)))  # noqa: E731 (an edge at the maximum ends the last bin)
    cells = met.groupBy("name", bin_of(F.col("qx"), F.col("factor"), F.col("mx")).alias("bx"), bin_of(F.col("qy"), F.col("ret"), F.col("my")).alias("by")).agg(F.count("*").cast("double").alias("n"))
    of = lambda *k: F.sum("n").over(Window.partitionBy("name", *k))
    told = cells.withColumn("nx", of("bx")).withColumn("ny", of("by")).withColumn("t", of())
    return told.groupBy("name").agg(F.greatest(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))), F.lit(0.0)).alias("mi"))


def candidate_scores(c: DataFrame, bins: int = 10) -> DataFrame:
    """(name, ic, rank_ic, ir, mi, score); a candidate that hardly moves has zeros and no score."""
    ranked = c.withColumn("rf", _rank(["name", "symbol"], "factor")).withColumn("rr", _rank(["name", "symbol"], "ret"))
    per = ranked.groupBy("name", "symbol").agg(correlation("factor", "ret").alias("ic"), correlation("rf", "rr").alias("rank_ic"), F.stddev_pop("factor").alias("sf"), F.stddev_pop("ret").alias("sr"))
    mean = per.where("sf > 1e-12 and sr > 1e-12").groupBy("name").agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.stddev_pop("rank_ic").alias("spread"))
    flat = c.groupBy("name").agg(((F.count_if(F.col("factor").isNotNull() & ~F.isnan("factor")) < 2) | (F.coalesce(F.stddev_pop("factor"), F.lit(0.0)) < FLAT)).alias("flat"))
    met = flat.join(mean, "name", "left").join(_mutual(c, bins), "name", "left")
    told = lambda x: F.when(F.col("flat"), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))
    ir = F.when(F.col("spread") > 1e-12, F.col("rank_ic") / F.nullif(F.col("spread"), F.lit(0.0))).otherwise(0.0)
    out = met.select("name", "flat", told(F.col("ic")).alias("ic"), told(F.col("rank_ic")).alias("rank_ic"), told(ir).alias("ir"), told(F.col("mi")).alias("mi"))
    return out.withColumn("score", F.when(~F.col("flat"), W_RANK * F.abs("rank_ic") + W_MI * F.col("mi"))).drop("flat")


def ranked_scores(scores: DataFrame) -> DataFrame:
    """The score over candidates: both measures as ranks in [0, 1] among those that have a score. One row per candidate."""
    able = F.col("score").isNotNull()
    n = F.count_if(able).over(Window.partitionBy())

    def place(x: Column) -> Column:
        at = F.row_number().over(Window.partitionBy(able).orderBy(x, "name")) - 1
        return F.when(~able, 0.0).when(n == 1, 1.0).otherwise(at / F.nullif(n - 1, F.lit(0)))

    out = scores.withColumn("r_ic", place(F.abs("rank_ic"))).withColumn("r_mi", place(F.col("mi")))
    return out.withColumn("importance", F.when(able, W_RANK * F.col("r_ic") + W_MI * F.col("r_mi")))


def report_order(ranked: DataFrame) -> DataFrame:
    """place from 1: by falling importance, names decide ties, those without one last."""
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.col("importance").desc_nulls_last(), "name")))


def active_subset(ranked: DataFrame, retained: DataFrame, least: float = 0.0, most: int = 30) -> DataFrame:
    """The most important candidates among the retained ones (a column name), above the threshold."""
    able = ranked.join(retained.select("name"), "name", "left_semi").where(F.col("importance") >= least)
    return report_order(able).where(F.col("place") <= most).select("place", "name", "importance")


def ablation(c: DataFrame, limit: float = -0.01, windows: int = WINDOWS) -> DataFrame:
    """(name, marginal, drop): what a candidate adds to the mean absolute IC, averaged over windows of time."""
    w = Window.partitionBy("name", "symbol").orderBy("time")
    size = F.floor(F.count(F.lit(1)).over(Window.partitionBy("name", "symbol")) / windows)
    cut = c.withColumn("window", F.floor((F.row_number().over(w) - 1) / size).cast("int")).where(F.col("window") < windows)
    per = cut.groupBy("window", "name", "symbol").agg(correlation("factor", "ret").alias("ic"), F.stddev_pop("factor").alias("sf"), F.stddev_pop("ret").alias("sr"))
    flat = cut.groupBy("window", "name").agg((F.coalesce(F.stddev_pop("factor"), F.lit(0.0)) >= FLAT).alias("able"))
    mean = per.where("sf > 1e-12 and sr > 1e-12").groupBy("window", "name").agg(F.abs(F.avg("ic")).alias("a"))
    each = flat.join(mean, ["window", "name"], "left").withColumn("a", F.when(F.col("able"), F.coalesce("a", F.lit(0.0))))
    of = Window.partitionBy("window")
    total, n = F.coalesce(F.sum("a").over(of), F.lit(0.0)), F.count("a").over(of)
    without = (total - F.coalesce("a", F.lit(0.0))) / F.nullif(n - F.when(F.col("a").isNull(), 0).otherwise(1), F.lit(0))
    gain = F.coalesce(total / F.nullif(n, F.lit(0)), F.lit(0.0)) - F.coalesce(without, F.lit(0.0))
    return each.withColumn("gain", gain).groupBy("name").agg(F.avg("gain").alias("marginal")).withColumn("drop", F.col("marginal") <= limit)


def correlation_pairs(c: DataFrame, limit: float = 0.9) -> DataFrame:
    """(a, b, corr, close) of each two candidates, from bars that both have; equal bars meet by key, so nothing is crossed."""
    x = c.select("symbol", "time", F.col("name").alias("a"), F.col("factor").alias("x"))
    y = c.select("symbol", "time", F.col("name").alias("b"), F.col("factor").alias("y"))
    r = x.join(y, ["symbol", "time"]).where("a < b").groupBy("a", "b").agg(F.coalesce(correlation("x", "y"), F.lit(0.0)).alias("corr"))
    return r.withColumn("close", F.abs("corr") >= limit)


def combined(c: DataFrame, weight: str = "equal") -> DataFrame:
    """(symbol, time, factor): candidates turned so that their IC isn't negative, weighed alike or by |IC|, added."""
    ic = c.groupBy("name").agg(correlation("factor", "ret").alias("ic"))
    total = F.sum(F.abs(F.coalesce("ic", F.lit(0.0)))).over(Window.partitionBy())
    share = F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy()) if weight == "equal" else F.abs(F.coalesce("ic", F.lit(0.0))) / F.nullif(total, F.lit(0.0))
    turned = ic.select(F.col("name").alias("__name"), (F.when(F.col("ic") < 0, -share).otherwise(share)).alias("w"))
    return c.join(turned, F.col("name") == F.col("__name")).groupBy("symbol", "time").agg(F.sum(F.col("factor") * F.col("w")).alias("factor"))
