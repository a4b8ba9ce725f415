"""Candidate scores, corrections for multiple tests and verdicts."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import correlation

# Fixed value: Euler's constant.
GAMMA = 0.5772156649015329
_N = NormalDist()


def bonferroni(alpha: float, n: int) -> float:
    return alpha / max(1, n)


def benjamini_hochberg(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(name, p, rank, passed): all up to the largest k with p(k) <= k / m alpha pass. One row per candidate."""
    ranked = p.withColumn("rank", F.row_number().over(Window.orderBy("p", "name"))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.withColumn("last", F.coalesce(F.max(F.when(F.col("p") <= F.col("rank") / F.col("m") * alpha, F.col("rank"))).over(Window.partitionBy()), F.lit(0))).select(
        "name", "p", F.col("rank").cast("long").alias("rank"), (F.col("rank") <= F.col("last")).alias("passed")
    )


def expected_max(n_trials: int, sigma: float) -> float:
    """Of n standard normal trials, times sigma; -inf for a single one."""
    if n_trials <= 1:
        return -math.inf
    return sigma * ((1 - GAMMA) * _N.inv_cdf(1 - 1 / n_trials) + GAMMA * _N.inv_cdf(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(sr: float, n_obs: int, n_trials: int, skew: float = 0.0, kurt: float = 3.0, variance: float | None = None) -> float:
    sr0 = expected_max(n_trials, math.sqrt(variance if variance else 1 / n_obs))
    if sr0 == -math.inf:
        return 1.0
    spread = math.sqrt(max((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n_obs - 1), 1e-18))
    return _N.cdf((sr - sr0) / spread)


def deflated(series: DataFrame, n_trials: int) -> dict:
    """Deflated Sharpe ratio of a series of pnl, from one aggregate row; the kurtosis handed on is the excess one, as defined."""
    r = series.agg(F.count("*").alias("n"), (F.avg("pnl") / (F.stddev_pop("pnl") + 1e-12)).alias("sr"), F.skewness("pnl").alias("skew"), F.kurtosis("pnl").alias("kurt")).first()
    return {"sr": r["sr"], "n_obs": r["n"], "dsr": deflated_sharpe(r["sr"], r["n"], n_trials, r["skew"] or 0.0, r["kurt"] or 0.0)}


def decay(train: Column, val: Column) -> Column:
    return F.when(train <= 1e-9, F.when(val > 0, 1.0).otherwise(0.0)).otherwise(val / F.nullif(train, F.lit(0.0)))


def verdict(c: DataFrame) -> DataFrame:
    """Adds decay, failures and verdict to candidates (train, val, sharpe_2x, dsr, win_rate)."""
    d = decay(F.col("train"), F.col("val"))
    hard = F.array_compact(F.array(F.when(F.col("val") <= 0, "val"), F.when(F.col("sharpe_2x") <= 0, "sharpe_2x"), F.when(F.col("dsr") < 0.5, "dsr")))
    soft = F.array_compact(F.array(F.when(d < 0.5, "decay"), F.when(F.col("win_rate") < 0.6, "win_rate"), F.when(F.col("dsr") < 0.95, "dsr_soft")))
    out = c.withColumn("decay", d).withColumn("hard", hard).withColumn("failures", F.when(F.size("hard") > 0, F.col("hard")).otherwise(soft))
    return out.withColumn("verdict", F.when(F.size("hard") > 0, "BLOCKED").when(F.size("failures") > 0, "RESEARCH_ONLY").otherwise("DEPLOYABLE")).drop("hard")


def rank_scores(c: DataFrame, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Ranks of rank_ic and mi over candidates scaled to [0, 1], and their weighted sum."""
    n = F.greatest(F.count(F.lit(1)).over(Window.partitionBy()) - 1, F.lit(1))
    place = lambda x: (F.row_number().over(Window.orderBy(x, "name")) - 1) / n
    out = c.withColumn("r_ic", place(F.abs("rank_ic"))).withColumn("r_mi", place(F.col("mi")))
    return out.withColumn("score", weights[0] * F.col("r_ic") + weights[1] * F.col("r_mi"))


def prune(scores: list[tuple[str, float]], correlation: dict[tuple[str, str], float], limit: float = 0.9, gap: float = 0.01) -> list[str]:
    """Candidates by falling score, without those that correlate with a kept one that is better by more than gap. Sequential by
    definition, over a small matrix that Spark aggregated."""
    kept: list[tuple[str, float]] = []
    for name, s in sorted(scores, key=lambda x: (-x[1], x[0])):
        if not any(abs(correlation.get((name, k), correlation.get((k, name), 0.0))) >= limit and ks - s > gap for k, ks in kept):
            kept.append((name, s))
    return [k for k, _ in kept]


def correlations(df: DataFrame, names: list[str]) -> dict[tuple[str, str], float]:
    """Of all pairs of columns in one aggregate row."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return {}
    row = df.agg(*[F.coalesce(correlation(a, b), F.lit(0.0)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: row[i] for i, p in enumerate(pairs)}


def split(df: DataFrame, gap: int = 24, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Adds part: train, gap, val, gap, holdout by the place of the bar on the shared time axis."""
    times = df.select("time").distinct().withColumn("i", F.row_number().over(Window.orderBy("time")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    a = F.floor(train * F.col("n"))
    b = a + gap + F.floor(val * F.col("n"))
    part = F.when(F.col("i") < a, "train").when(F.col("i") < a + gap, "gap").when(F.col("i") < b, "val").when(F.col("i") < b + gap, "gap").otherwise("holdout")
    return df.join(times.select("time", part.alias("part")), "time")


def walk_forward(n_bars: int, folds: int = 5, gap: int = 20) -> list[tuple[int, int, int, int]]:
    """(train start, train end, validation start, end): folds - 1 of them; the gap shrinks to what the remainder leaves, which
    is 0 for any length, so validation starts right after training."""
    size = n_bars // folds
    g = gap if size * folds + gap * (folds - 1) <= n_bars else (n_bars % folds) // folds
    return [(0, size * (k + 1), size * (k + 1) + g, min(n_bars, size * (k + 2) + g)) for k in range(folds - 1)]
