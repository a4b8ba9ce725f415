"""Queries of the multi-objective score, its parts and folds, with SQL written over the flat series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import objective
from ..registry import register
from .report_queries import PPY, TRADED, r6, traded

SORTINO = (
    "greatest(least(avg({x}) / greatest(coalesce(stddev_pop({x}) FILTER ({x} < 0), 0), 0.2 * greatest(stddev_pop({x}), 1e-8), 1e-8) * sqrt(6240), 20), -20)"
)


def parts_sql(fold: str) -> str:
    """CTEs up to pt, the parts by fold; fold is the FROM item of rows (fold, symbol, time, factor, position, ret, delta, pnl)."""
    return (
        TRADED
        + f""", n0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS t FROM tr), fd AS ({fold}),
x AS (SELECT *, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY fold, symbol) AS n, lead(ret) OVER w AS nxt, lag(factor) OVER w AS earlier, position * ret - 6e-4 * abs(position - coalesce(lag(position) OVER w, 0)) AS st,
  abs(abs(position) - lag(abs(position)) OVER w) > 0.1 AS moved, trunc(position)::INT AS d, coalesce(lag(trunc(position)::INT) OVER w, 0) AS d0, sum(pnl) OVER (PARTITION BY fold ORDER BY symbol, time ROWS UNBOUNDED PRECEDING) AS cum FROM fd WINDOW w AS (PARTITION BY fold, symbol ORDER BY time)),
y AS (SELECT *, max(cum) OVER (PARTITION BY fold ORDER BY symbol, time ROWS UNBOUNDED PRECEDING) - cum AS dd FROM x),
s0 AS (SELECT fold, symbol, max(n) AS n, {SORTINO.format(x='pnl')} AS s, count(*) FILTER (moved) AS trades,
  covar_pop(factor, nxt) / (stddev_pop(factor) FILTER (nxt IS NOT NULL) * stddev_pop(nxt) + 1e-8) AS ic, stddev_pop(factor) FILTER (nxt IS NOT NULL) >= 1e-6 AND stddev_pop(nxt) >= 1e-6 AS able,
  CASE WHEN stddev_pop(factor) FILTER (earlier IS NOT NULL) > 1e-6 AND stddev_pop(earlier) > 1e-6 THEN covar_pop(factor, earlier) / (stddev_pop(factor) FILTER (earlier IS NOT NULL) * stddev_pop(earlier) + 1e-8) ELSE 0 END AS a FROM y GROUP BY fold, symbol),
s1 AS (SELECT *, trades >= greatest(5, n // 100) AS enough FROM s0),
s2 AS (SELECT fold, count(*) AS symbols, max(n) AS bars, count(*) FILTER (NOT enough) AS idle, count(*) FILTER (enough) AS busy, count(*) FILTER (enough AND s > 0) AS good, min(s) AS worst, CASE WHEN max(n) >= 10 AND count(*) FILTER (able) > 0 THEN greatest(least(avg(ic) FILTER (able) / (stddev_pop(ic) FILTER (able) + 1e-6), 3), -3) ELSE 0 END AS ic_stability,
  avg(greatest(least(1 - abs(a) + CASE WHEN a < 0 THEN 0.5 ELSE 0 END, 2), -1)) AS reversal FROM s1 GROUP BY fold),
f9 AS (SELECT fold, avg(pnl) * 6240 AS annual_return, avg(pnl) AS mean_pnl, {SORTINO.format(x='pnl')} AS sortino, greatest(least({SORTINO.format(x='st')}, 5), -5) AS cost_stress, max(dd) AS dd, avg(abs(position)) AS ex, avg((position > 0.05)::INT) AS lo, avg((position < -0.05)::INT) AS sh,
  avg((position > 0)::INT) AS up, avg((position < 0)::INT) AS dn, avg(abs(delta)) AS md, count(*) FILTER (d <> 0 AND d <> d0) / greatest(count(*) / 12.0, 1) AS ratio, count(*) FILTER (d <> 0) / nullif(count(*) FILTER (d <> 0 AND d <> d0), 0) AS hold FROM y GROUP BY fold),
h1 AS (SELECT fold, {SORTINO.format(x='pnl')} AS a FROM y WHERE j < n // 2 GROUP BY fold), h2 AS (SELECT fold, {SORTINO.format(x='pnl')} AS b FROM y WHERE j >= n // 2 GROUP BY fold),
pt AS (SELECT fold, bars, symbols, annual_return, mean_pnl, sortino, cost_stress, ic_stability, reversal, greatest(least(annual_return / greatest(dd, 1e-8), 10), -10) AS calmar,
  CASE WHEN idle / symbols > 0.4 THEN -3.0 WHEN worst < -2 THEN -2.0 WHEN busy = 0 THEN -3.0 WHEN good / busy < 0.6 THEN (good / busy - 0.6) / 0.6 ELSE (good / busy - 0.6) / 0.4 + CASE WHEN good = busy THEN 0.5 ELSE 0 END END AS symbol_consistency,
  CASE WHEN ratio <= 0 THEN -2 WHEN ratio < 0.05 THEN -2 + ratio / 0.05 WHEN ratio < 0.5 THEN -1 + (ratio - 0.05) / 0.45 WHEN ratio <= 2 THEN exp(-0.5 * (ln(ratio) / ln(2)) ** 2) WHEN ratio <= 8 THEN 0.5 - (ratio - 2) / 6 * 1.5 ELSE -2 END + CASE WHEN hold IS NULL THEN 0 ELSE least(0.3, ln(greatest(hold, 1)) / ln(30) * 0.3) END AS turnover_quality,
  CASE WHEN bars < 20 THEN 0.0 WHEN a > 0 AND b > 0 THEN 0.5 WHEN a * b < 0 THEN -1.0 ELSE 0.0 END AS half_consistency,
  CASE WHEN ex < 0.1 THEN (ex / 0.1 - 1) * 2 ELSE 0 END AS exposure_penalty, CASE WHEN greatest(lo, sh) > 0.85 THEN -2 * (greatest(lo, sh) - 0.85) / 0.15 WHEN greatest(lo, sh) > 0.7 THEN -0.5 * (greatest(lo, sh) - 0.7) / 0.15 ELSE 0 END AS beta_penalty,
  -greatest(least((md - 0.2) * 3, 3), 0) AS turnover_penalty, greatest(least(1 - 2 * (abs(up - 0.5) + abs(dn - 0.5)), 1), -1) AS symmetry FROM f9 JOIN s2 USING (fold) JOIN h1 USING (fold) JOIN h2 USING (fold))"""
    )


ALL, ONE = "SELECT 'all' AS fold, * FROM n0", "SELECT symbol AS fold, * FROM n0"
REST = " + exposure_penalty + beta_penalty + half_consistency"
FTMO = "(CASE WHEN symbols > 1 THEN 0.75 * annual_return + 0.05 * sortino + 0.10 * calmar + 0.02 * ic_stability + 0.03 * symbol_consistency + 0.02 * cost_stress + 0.03 * turnover_quality ELSE 0.80 * annual_return + 0.05 * sortino + 0.10 * calmar + 0.03 * ic_stability + 0.02 * turnover_quality END" + REST + ")"
FOREX = "(CASE WHEN symbols > 1 THEN 0.60 * annual_return + 0.10 * sortino + 0.05 * calmar + 0.10 * ic_stability + 0.05 * symbol_consistency + 0.05 * cost_stress + 0.05 * turnover_quality ELSE 0.25 * annual_return + 0.05 * sortino + 0.05 * calmar + 0.25 * ic_stability + 0.20 * reversal + 0.15 * symmetry + 0.05 * turnover_quality END" + REST + ")"
OTHER = "(CASE WHEN symbols > 1 THEN 0.60 * annual_return + 0.10 * sortino + 0.05 * calmar + 0.10 * ic_stability + 0.05 * symbol_consistency + 0.05 * cost_stress + 0.05 * turnover_quality ELSE 0.60 * annual_return + 0.15 * sortino + 0.10 * calmar + 0.10 * ic_stability + 0.05 * turnover_quality END" + REST + ")"
GATE = "CASE WHEN sortino <= 0 THEN greatest(0.1, 0.5 + sortino * 0.4) ELSE least(1.2, 1 + sortino * 0.1) END"


def both(spark, sf_dir):
    """The panel as one fold and each symbol as a fold of its own."""
    t = traded(spark, sf_dir)
    return t.withColumn("fold", F.explode(F.array(F.lit("all"), F.col("symbol"))))


BOTH = parts_sql(f"{ALL} UNION ALL {ONE}")
for _part in ("symbol_consistency", "cost_stress", "turnover_quality", "half_consistency", "calmar", "ic_stability"):

    def _query(spark, sf_dir, part=_part):
        return r6(objective.parts(both(spark, sf_dir), PPY).select("fold", part), part, digits=5)

    register("search_calmar" if _part == "calmar" else _part, f"{BOTH} SELECT fold, round({_part}, 5) + 0.0 AS {_part} FROM pt")(_query)


@register("turnover_quality_lots", parts_sql(ALL.replace("* FROM n0", "* REPLACE (position * 3 AS position) FROM n0")) + " SELECT fold, round(turnover_quality, 5) + 0.0 AS turnover_quality FROM pt")
def turnover_quality_lots(spark, sf_dir):
    """With positions of up to three lots, which make runs of whole numbers."""
    t = traded(spark, sf_dir).withColumn("fold", F.lit("all")).withColumn("position", F.col("position") * 3)
    return r6(objective.parts(t, PPY).select("fold", "turnover_quality"), "turnover_quality", digits=5)


@register("multi_objective", BOTH + f" SELECT fold, round({FTMO}, 4) + 0.0 AS ftmo, round({FOREX}, 4) + 0.0 AS forex, round({OTHER}, 4) + 0.0 AS other FROM pt")
def multi_objective(spark, sf_dir):
    p = objective.parts(both(spark, sf_dir), PPY)
    return r6(p.select("fold", *[objective.multi_objective(m).alias(m) for m in objective.MODES]), *objective.MODES, digits=4)


@register(
    "evaluation_80_20",
    parts_sql("SELECT CASE WHEN i < floor(t * 0.8) THEN 'in' ELSE 'out' END AS fold, * FROM n0")
    + f" SELECT round((SELECT {FTMO} + turnover_penalty FROM pt WHERE fold = 'in') * {GATE}, 4) + 0.0 AS score, round(mean_pnl, 6) + 0.0 AS mean_oos FROM pt WHERE fold = 'out'",
)
def evaluation(spark, sf_dir):
    return r6(r6(objective.evaluation(traded(spark, sf_dir), PPY), "score", digits=4), "mean_oos")


@register(
    "fold_scores",
    parts_sql("SELECT (i // (t // 5) + 1) * 10 AS fold, * FROM n0 WHERE i // (t // 5) < 4 UNION ALL SELECT (i // (t // 5)) * 10 + 1 AS fold, * FROM n0 WHERE i // (t // 5) BETWEEN 1 AND 4")
    + f" SELECT (fold // 10)::INT AS fold, round(max({FTMO} + turnover_penalty) FILTER (fold % 10 = 0), 4) + 0.0 AS train_score, round(max({FTMO} * {GATE}) FILTER (fold % 10 = 1), 4) + 0.0 AS val_score FROM pt GROUP BY 1",
)
def fold_scores(spark, sf_dir):
    return r6(objective.fold_scores(traded(spark, sf_dir), PPY), "train_score", "val_score", digits=4)
