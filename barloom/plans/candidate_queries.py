"""Queries of candidate scores, ranks, ablation, pruning and combination, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, gates
from ..registry import register
from .report_queries import EDGES, TRADED, r6, traded

NAMES = ["mom1", "mom3", "mom5", "range", "flat"]


def candidates(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("time")
    log = lambda n: F.coalesce(F.ln(F.col("close") / F.lag("close", n).over(w)), F.lit(0.0))
    p = traded(spark, sf_dir).withColumns({"mom1": log(1), "mom3": log(3), "mom5": log(5), "range": (F.col("high") - F.col("low")) / F.col("close"), "flat": F.lit(1.0)})
    return evaluate.stacked(p, NAMES)


CANDIDATES = (
    TRADED
    + """, k0 AS (SELECT symbol, time, ret, coalesce(ln(close / lag(close, 1) OVER w), 0) AS mom1, coalesce(ln(close / lag(close, 3) OVER w), 0) AS mom3, coalesce(ln(close / lag(close, 5) OVER w), 0) AS mom5, (high - low) / close AS range, 1.0::DOUBLE AS flat FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY time)),
c AS (UNPIVOT k0 ON mom1, mom3, mom5, range, flat INTO NAME name VALUE factor)"""
)
SCORES = (
    CANDIDATES
    + f""", rk AS (SELECT *, rank() OVER (PARTITION BY name, symbol ORDER BY factor) + (count(*) OVER (PARTITION BY name, symbol, factor) - 1) / 2 AS rf, rank() OVER (PARTITION BY name, symbol ORDER BY ret) + (count(*) OVER (PARTITION BY name, symbol, ret) - 1) / 2 AS rr FROM c),
ps AS (SELECT name, symbol, CASE WHEN stddev_pop(factor) > 1e-12 THEN corr(factor, ret) END AS ic, CASE WHEN stddev_pop(factor) > 1e-12 THEN corr(rf, rr) END AS rank_ic FROM rk GROUP BY name, symbol HAVING stddev_pop(factor) > 1e-12 AND stddev_pop(ret) > 1e-12),
mn AS (SELECT name, avg(ic) AS ic, avg(rank_ic) AS rank_ic, stddev_pop(rank_ic) AS sp FROM ps GROUP BY name),
fl AS (SELECT name, stddev_pop(factor) < 1e-8 AS flat FROM c GROUP BY name),
qe AS (SELECT name, list_distinct(quantile_cont(factor, [{EDGES}])) AS qx, list_distinct(quantile_cont(ret, [{EDGES}])) AS qy, max(factor) AS mx, max(ret) AS my FROM c GROUP BY name),
ce AS (SELECT c.name, len(list_filter(qx, lambda e: e <= factor AND e < mx)) AS bx, len(list_filter(qy, lambda e: e <= ret AND e < my)) AS bz, count(*)::DOUBLE AS n FROM c JOIN qe ON qe.name = c.name GROUP BY ALL),
cm AS (SELECT name, n, sum(n) OVER (PARTITION BY name, bx) AS nx, sum(n) OVER (PARTITION BY name, bz) AS ny, sum(n) OVER (PARTITION BY name) AS t FROM ce),
mi AS (SELECT name, greatest(sum(n / t * ln(n * t / (nx * ny))), 0) AS mi FROM cm GROUP BY name),
sc AS (SELECT name, flat, CASE WHEN flat THEN 0 ELSE ic END AS ic, CASE WHEN flat THEN 0 ELSE rank_ic END AS rank_ic, CASE WHEN flat THEN 0 ELSE rank_ic / sp END AS ir, CASE WHEN flat THEN 0 ELSE mi END AS mi, CASE WHEN NOT flat THEN 0.6 * abs(rank_ic) + 0.4 * mi END AS score FROM fl LEFT JOIN mn USING (name) LEFT JOIN mi USING (name)),
ra AS (SELECT name, score, rank_ic, mi, CASE WHEN flat THEN 0 ELSE (row_number() OVER (PARTITION BY flat ORDER BY abs(rank_ic), name) - 1) / (count(*) FILTER (NOT flat) OVER () - 1) END AS r_ic, CASE WHEN flat THEN 0 ELSE (row_number() OVER (PARTITION BY flat ORDER BY mi, name) - 1) / (count(*) FILTER (NOT flat) OVER () - 1) END AS r_mi FROM sc),
im AS (SELECT *, CASE WHEN score IS NOT NULL THEN 0.6 * r_ic + 0.4 * r_mi END AS importance FROM ra)"""
)


@register("candidate_scores", SCORES + " SELECT name, round(ic, 6) + 0.0 AS ic, round(rank_ic, 6) + 0.0 AS rank_ic, round(ir, 5) + 0.0 AS ir, round(mi, 5) + 0.0 AS mi, round(score, 5) + 0.0 AS score FROM sc")
def scores(spark, sf_dir):
    return r6(r6(evaluate.candidate_scores(candidates(spark, sf_dir)), "ic", "rank_ic"), "ir", "mi", "score", digits=5)


def ranked(spark, sf_dir):
    return evaluate.ranked_scores(evaluate.candidate_scores(candidates(spark, sf_dir)))


@register("candidate_ranks", SCORES + " SELECT name, round(r_ic, 6) + 0.0 AS r_ic, round(r_mi, 6) + 0.0 AS r_mi, round(importance, 6) + 0.0 AS importance FROM im")
def ranks(spark, sf_dir):
    return r6(ranked(spark, sf_dir).select("name", "r_ic", "r_mi", "importance"), "r_ic", "r_mi", "importance")


@register("report_order", SCORES + " SELECT row_number() OVER (ORDER BY importance DESC NULLS LAST, name)::INT AS place, name FROM im")
def order(spark, sf_dir):
    return evaluate.report_order(ranked(spark, sf_dir)).select("place", "name")


@register("active_subset", SCORES + " SELECT row_number() OVER (ORDER BY importance DESC, name)::INT AS place, name, round(importance, 6) + 0.0 AS importance FROM im WHERE name <> 'mom3' AND importance >= 0.1 QUALIFY place <= 2")
def active(spark, sf_dir):
    r = ranked(spark, sf_dir)
    return r6(evaluate.active_subset(r, r.where("name <> 'mom3'"), 0.1, 2), "importance")


@register(
    "ablation",
    CANDIDATES
    + """, a0 AS (SELECT *, ((row_number() OVER (PARTITION BY name, symbol ORDER BY time) - 1) // (count(*) OVER (PARTITION BY name, symbol) // 5))::INT AS win FROM c), a1 AS (SELECT * FROM a0 WHERE win < 5),
a2 AS (SELECT win, name, symbol, CASE WHEN stddev_pop(factor) > 1e-12 THEN corr(factor, ret) END AS ic FROM a1 GROUP BY ALL HAVING stddev_pop(factor) > 1e-12 AND stddev_pop(ret) > 1e-12), a3 AS (SELECT win, name, abs(avg(ic)) AS a FROM a2 GROUP BY ALL),
a4 AS (SELECT x.name, w.win, (SELECT avg(a) FROM a3 WHERE a3.win = w.win) AS m1, (SELECT avg(a) FROM a3 WHERE a3.win = w.win AND a3.name <> x.name) AS m2 FROM (SELECT DISTINCT name FROM c) x, (SELECT DISTINCT win FROM a1) w)
SELECT name, round(avg(m1 - m2), 6) + 0.0 AS marginal, avg(m1 - m2) <= -0.01 AS drop FROM a4 GROUP BY name""",
)
def ablation(spark, sf_dir):
    return r6(evaluate.ablation(candidates(spark, sf_dir)), "marginal")


@register(
    "correlation_pairs",
    CANDIDATES + " SELECT x.name AS a, y.name AS b, round(CASE WHEN 'flat' IN (x.name, y.name) THEN 0 ELSE corr(x.factor, y.factor) END, 6) + 0.0 AS corr, coalesce(abs(CASE WHEN 'flat' IN (x.name, y.name) THEN 0 ELSE corr(x.factor, y.factor) END) >= 0.6, false) AS close FROM c x JOIN c y ON x.symbol = y.symbol AND x.time = y.time AND x.name < y.name GROUP BY x.name, y.name",
)
def pairs(spark, sf_dir):
    return r6(evaluate.correlation_pairs(candidates(spark, sf_dir), 0.6), "corr")


@register("correlation_prune")
def prune(spark, sf_dir):
    """Greedy and sequential over a few candidates: the driver walks through the small table of pairs."""
    c = candidates(spark, sf_dir)
    pairs_ = {(r["a"], r["b"]): r["corr"] for r in evaluate.correlation_pairs(c).collect()}
    scored = [(r["name"], r["importance"]) for r in ranked(spark, sf_dir).where("importance is not null").collect()]
    return spark.createDataFrame([(n,) for n in gates.prune(scored, pairs_, 0.6)], "name string")


for _weight, _share in (("equal", "1.0 / count(*) OVER ()"), ("ic", "abs(coalesce(ic, 0)) / sum(abs(coalesce(ic, 0))) OVER ()")):

    def _combined(spark, sf_dir, weight=_weight):
        return r6(evaluate.combined(candidates(spark, sf_dir).where("name <> 'flat'"), weight), "factor")

    register(
        f"combined_{_weight}",
        CANDIDATES + f", ci AS (SELECT name, corr(factor, ret) AS ic FROM c WHERE name <> 'flat' GROUP BY name), cw AS (SELECT name, {_share} * CASE WHEN ic < 0 THEN -1 ELSE 1 END AS w FROM ci) SELECT symbol, time, round(sum(factor * w), 6) + 0.0 AS factor FROM c JOIN cw ON cw.name = c.name GROUP BY symbol, time",
    )(_combined)


@register("deflated_sharpe")
def deflated(spark, sf_dir):
    from ..operators import portfolio

    d = gates.deflated(portfolio.portfolio(traded(spark, sf_dir)), 100)
    return spark.createDataFrame([(round(d["sr"], 6), d["n_obs"], round(d["dsr"], 6))], "sr double, n_obs long, dsr double")
