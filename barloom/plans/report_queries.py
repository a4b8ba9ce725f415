"""Queries for bars, joins, portfolios, metrics and gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import compare, gates, metrics, portfolio, scores
from ..registry import register
from ..sources import bars
from . import compiler, feature_queries, oracle
from .operator_queries import dense_panel, rounded

DAY, H4, HOUR = 86400, 14400, 3600
PPY = 6240.0
PRICES = "open, high, low, close, volume"
WITH = "WITH " + oracle.EVENT_BARS.format(tf=HOUR)


def r6(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.resample(bars.ticks_from_events(spark, sf_dir), HOUR)


def perturbed(df: DataFrame) -> DataFrame:
    """A second source: without every 7th hour, every 11th close 2 % higher."""
    return df.where((F.col("time") / HOUR).cast("long") % 7 != 0).withColumn("close", F.col("close") * F.when((F.col("time") / HOUR).cast("long") % 11 == 0, 1.02).otherwise(1.0))


SECOND = ", second AS (SELECT * REPLACE (close * CASE WHEN (time // 3600) % 11 = 0 THEN 1.02 ELSE 1.0 END AS close) FROM bars WHERE (time // 3600) % 7 <> 0)"

for _name, _tf, _src in (("bars_events_h1", HOUR, "events"), ("bars_events_h4", H4, "events"), ("bars_events_d1", DAY, "events"), ("bars_lineitem_d1", DAY, "lineitem")):

    def _bars(spark, sf_dir, tf=_tf, src=_src):
        ticks = bars.ticks_from_events(spark, sf_dir) if src == "events" else bars.ticks_from_lineitem(spark, sf_dir)
        return bars.resample(ticks, tf)

    register(
        _name,
        "WITH " + (oracle.EVENT_BARS if _src == "events" else oracle.LINEITEM_BARS).format(tf=_tf) + f" SELECT symbol, time, {PRICES} FROM bars",
    )(_bars)


@register("bars_dense_h1", "WITH " + oracle.panel(HOUR) + f" SELECT symbol, time, {PRICES} FROM p")
def bars_dense(spark, sf_dir):
    return dense_panel(spark, sf_dir)


@register("bars_rebar_offset", WITH + f" SELECT symbol, time - (time - 7200) % 14400 AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume, count(*) AS n, count(*) >= 0.8 * 4 AS complete FROM bars GROUP BY symbol, time - (time - 7200) % 14400")
def rebar_offset(spark, sf_dir):
    return bars.rebar(hourly(spark, sf_dir), H4, 7200, HOUR)


@register("bars_clean", WITH + f" SELECT symbol, time, {PRICES} FROM bars WHERE NOT (open = high AND high = low AND low = close AND volume = 0) AND dayofweek(make_timestamp(time * 1000000)) <> 0")
def clean_bars(spark, sf_dir):
    return bars.clean(hourly(spark, sf_dir))


@register("bars_merge_last", WITH + SECOND + f" SELECT symbol, time, coalesce(s.open, b.open) AS open, coalesce(s.high, b.high) AS high, coalesce(s.low, b.low) AS low, round(coalesce(s.close, b.close), 6) AS close, coalesce(s.volume, b.volume) AS volume FROM bars b LEFT JOIN second s USING (symbol, time)")
def merge_last(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return r6(bars.merge(b, perturbed(b)), "close")


@register("bars_merge_first", WITH + f" SELECT symbol, time, {PRICES} FROM bars")
def merge_first(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return bars.merge(b, perturbed(b), "first")


@register("bars_split_union", WITH + SECOND + f" SELECT symbol, time, {PRICES} FROM bars WHERE time < 1705276800 UNION ALL SELECT symbol, time, open, high, low, round(close, 6), volume FROM second WHERE time >= 1705276800")
def split_union(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return r6(bars.split_union(b, perturbed(b), 1705276800), "close")


@register(
    "bars_price_filter",
    WITH + f", q AS (SELECT quantile_cont(close, 0.001) AS a, quantile_cont(close, 0.999) AS b FROM bars) SELECT symbol, time, {PRICES} FROM bars, q WHERE close >= greatest(1, a - 5 * (b - a)) AND close <= least(400, b + 5 * (b - a))",
)
def price_filter(spark, sf_dir):
    return bars.price_filter(hourly(spark, sf_dir), 1.0, 400.0)


@register(
    "bars_self_check",
    WITH
    + ", s AS (SELECT *, time - lag(time) OVER (PARTITION BY symbol ORDER BY time) AS step FROM bars), q AS (SELECT symbol, "
    + ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in ("open", "high", "low", "close"))
    + " FROM bars GROUP BY symbol) SELECT symbol, count(*) AS n_bars, count(*) FILTER (step > 5400) AS n_gaps, "
    + ", ".join(f"count(*) FILTER ({c} < a_{c} - 3 * (b_{c} - a_{c}) OR {c} > b_{c} + 3 * (b_{c} - a_{c})) AS n_outliers_{c}" for c in ("open", "high", "low", "close"))
    + ", count(*) FILTER (volume = 0) AS n_no_volume FROM s JOIN q USING (symbol) GROUP BY symbol",
)
def self_check(spark, sf_dir):
    return bars.self_check(hourly(spark, sf_dir), HOUR)


@register("bars_time_range", WITH + " SELECT min(time) AS first, max(time) AS last FROM bars")
def time_range(spark, sf_dir):
    return hourly(spark, sf_dir).agg(F.min("time").alias("first"), F.max("time").alias("last"))


@register("bars_last_n", WITH + " SELECT symbol, time, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 10")
def last_n(spark, sf_dir):
    d = hourly(spark, sf_dir)
    return d.withColumn("__n", F.row_number().over(_by_symbol().orderBy(F.desc("time")))).where("__n <= 10").select("symbol", "time", "close")


def _by_symbol():
    return Window.partitionBy("symbol")


@register(
    "candles_decode",
    WITH
    + ", n AS (SELECT *, lead(time) OVER (PARTITION BY symbol ORDER BY time) AS next FROM bars)"
    + " SELECT symbol, time, round(open, 2) AS open, round(close, 2) AS close, volume FROM n UNION ALL SELECT symbol, unnest(range(time + 3600, next, 3600)) AS time, round(close, 2), round(close, 2), 0 FROM n WHERE next > time + 3600",
)
def candles_decode(spark, sf_dir):
    """Bars are encoded as steps of 0.01 per day and symbol... and decoded again."""
    w = _by_symbol().orderBy("time")
    b = hourly(spark, sf_dir).select("symbol", "time", *[F.round(c, 2).alias(c) for c in bars.BAR[:4]], "volume")
    first = b.groupBy("symbol").agg(F.min("time").alias("timestamp"), *[F.min_by(c, "time").alias(c) for c in bars.BAR[:4]])
    steps = b.select(
        "symbol",
        "time",
        "volume",
        F.coalesce(((F.col("time") - F.lag("time").over(w)) / HOUR).cast("long"), F.lit(0)).alias("times"),
        *[F.coalesce(F.round((F.col(c) - F.lag(c).over(w)) * 100).cast("long"), F.lit(0)).alias(f"{c}s") for c in bars.BAR[:4]],
    )
    packed = steps.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("time", "times", "opens", "highs", "lows", "closes", F.col("volume").alias("volumes")))).alias("z"))
    rows = packed.join(first, "symbol").select(
        "symbol", "timestamp", F.lit(HOUR).alias("shift"), F.lit(0.01).alias("multiplier"), *bars.BAR[:4], *[F.col(f"z.{c}").alias(c) for c in ("times", "opens", "highs", "lows", "closes", "volumes")]
    )
    return r6(bars.decode_candles(rows).select("symbol", "time", "open", "close", "volume"), "open", "close", digits=2)


# -- joins

OFF = "(greatest(" + ", ".join(f"abs(b.{c} - s.{c}) / greatest(abs(s.{c}), 1e-12)" for c in ("open", "high", "low", "close")) + ") > 1e-3)"
VOL = "(abs(b.volume - s.volume) / greatest(abs(s.volume), 1e-12) > 1e-2)"


@register(
    "compare_sources",
    WITH + SECOND + f" SELECT coalesce(b.symbol, s.symbol) AS symbol, count(*) FILTER (b.time IS NOT NULL AND s.time IS NOT NULL AND NOT {OFF} AND NOT {VOL}) AS matched, count(*) FILTER (b.time IS NOT NULL AND s.time IS NOT NULL AND {OFF}) AS price_mismatch,"
    f" count(*) FILTER (b.time IS NOT NULL AND s.time IS NOT NULL AND NOT {OFF} AND {VOL}) AS volume_mismatch, count(*) FILTER (s.time IS NULL) AS only_a, count(*) FILTER (b.time IS NULL) AS only_b FROM bars b FULL JOIN second s ON b.symbol = s.symbol AND b.time = s.time GROUP BY 1",
)
def compare_sources(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return compare.compare(b, perturbed(b))


@register(
    "overlap_check",
    WITH + SECOND + ", d AS (SELECT symbol, abs(b.close - s.close) / greatest(abs(s.close), 1e-12) AS d FROM bars b JOIN second s USING (symbol, time)) SELECT symbol, count(*) AS common, round(max(d), 6) AS max_diff, round(avg((d > 1e-3)::INT), 6) AS mismatch_share FROM d GROUP BY symbol",
)
def overlap_check(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return r6(compare.overlap(b, perturbed(b)), "max_diff", "mismatch_share")


@register("semi_join_times", WITH + SECOND + f" SELECT symbol, time, {PRICES} FROM bars SEMI JOIN second USING (symbol, time)")
def semi(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return compare.common(b, perturbed(b))


@register("anti_join_times", WITH + SECOND + f" SELECT symbol, time, {PRICES} FROM bars ANTI JOIN second USING (symbol, time)")
def anti(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return compare.missing(b, perturbed(b))


@register(
    "contradicted_gaps",
    WITH + SECOND + ", g AS (SELECT symbol, time, lead(time) OVER (PARTITION BY symbol ORDER BY time) AS next FROM second) SELECT symbol, time, next FROM g WHERE next - time > 5400 AND EXISTS (SELECT 1 FROM bars b WHERE b.symbol = g.symbol AND b.time > g.time AND b.time < g.next)",
)
def gaps(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return compare.contradicted_gaps(perturbed(b), b, HOUR)


@register(
    "reconcile_orders",
    "WITH i AS (SELECT o_orderkey AS order_id, o_totalprice AS wanted FROM orders), f AS (SELECT l_orderkey AS order_id, sum(l_quantity) AS filled FROM lineitem GROUP BY 1)"
    " SELECT coalesce(i.order_id, f.order_id) AS order_id, wanted, filled, CASE WHEN filled IS NULL THEN 'no_fill' WHEN wanted IS NULL THEN 'no_intent' WHEN abs(wanted - filled) > 1e-9 THEN 'lots_differ' ELSE 'matched' END AS status FROM i FULL JOIN f ON i.order_id = f.order_id",
)
def reconcile(spark, sf_dir):
    o, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    return compare.reconcile(o.select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("lots")), li.select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("lots")))


@register(
    "position_netting",
    "WITH f AS (SELECT l_shipmode_ AS symbol, l_suppkey % 10 AS magic, CASE WHEN l_linenumber % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, l_quantity AS lots, l_extendedprice / l_quantity AS price FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem)),"
    " n AS (SELECT symbol, magic, sum(CASE WHEN side = 'BUY' THEN lots ELSE -lots END) AS net, sum(lots * price) FILTER (side = 'BUY') / sum(lots) FILTER (side = 'BUY') AS b, sum(lots * price) FILTER (side = 'SELL') / sum(lots) FILTER (side = 'SELL') AS s FROM f GROUP BY ALL)"
    " SELECT symbol, magic, net, round(CASE WHEN net > 0 THEN b ELSE s END, 6) AS vwap FROM n WHERE abs(net) >= 1e-12",
)
def netting(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fills = li.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), (F.col("l_suppkey") % 10).alias("magic"), F.when(F.col("l_linenumber") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("l_quantity").alias("lots"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    )
    return r6(portfolio.netting(fills), "vwap")


# -- portfolios: the factor is the 5-bar return's z-score over the symbols of a bar


def traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dense_panel(spark, sf_dir)
    w = Window.partitionBy("symbol").orderBy("time")
    r5 = F.coalesce(F.ln(F.col("close") / F.lag("close", 5).over(w)), F.lit(0.0))
    p = compiler.normalise(p.withColumn("factor", r5))
    return portfolio.pnl(portfolio.target_return(p).withColumn("position", portfolio.position(F.col("factor"))))


TRADED = (
    "WITH "
    + oracle.panel(HOUR)
    + """,
f0 AS (SELECT *, coalesce(ln(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY time)), 0) AS r5, coalesce(ln(lead(open, 2) OVER (PARTITION BY symbol ORDER BY time) / lead(open) OVER (PARTITION BY symbol ORDER BY time)), 0) AS ret FROM p),
f1 AS (SELECT *, greatest(least((r5 - avg(r5) OVER c) / greatest(stddev_samp(r5) OVER c, 1e-8), 3), -3) AS factor FROM f0 WINDOW c AS (PARTITION BY time)),
f2 AS (SELECT *, CASE WHEN abs(tanh(factor)) < 0.05 THEN 0 ELSE tanh(factor) END AS position FROM f1),
f3 AS (SELECT *, position - coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY time), 0) AS delta FROM f2),
tr AS (SELECT *, position * ret - 3e-4 * abs(delta) AS pnl FROM f3),
pf AS (SELECT time, avg(pnl) AS pnl FROM tr GROUP BY time),
eq0 AS (SELECT *, 1 + sum(pnl) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS equity FROM pf),
eq AS (SELECT *, max(equity) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS peak FROM eq0)"""
)


@register("target_return", TRADED + " SELECT symbol, time, round(ret, 6) + 0.0 AS ret FROM tr")
def target(spark, sf_dir):
    return r6(traded(spark, sf_dir).select("symbol", "time", "ret"), "ret")


@register("positions_pnl", TRADED + " SELECT symbol, time, round(factor, 6) + 0.0 AS factor, round(position, 6) + 0.0 AS position, round(delta, 6) + 0.0 AS delta, round(pnl, 6) + 0.0 AS pnl FROM tr")
def positions(spark, sf_dir):
    return r6(traded(spark, sf_dir).select("symbol", "time", "factor", "position", "delta", "pnl"), "factor", "position", "delta", "pnl")


@register("equity_curve", TRADED + " SELECT time, round(pnl, 6) + 0.0 AS pnl, round(equity, 6) + 0.0 AS equity, round(peak - equity, 6) + 0.0 AS drawdown, round((peak - equity) / abs(peak), 6) + 0.0 AS relative FROM eq")
def equity_curve(spark, sf_dir):
    return r6(portfolio.equity(portfolio.portfolio(traded(spark, sf_dir))), "pnl", "equity", "drawdown", "relative").select("time", "pnl", "equity", "drawdown", "relative")


@register(
    "rolling_sharpe",
    TRADED + " SELECT time, CASE WHEN count(*) OVER q = 520 THEN CASE WHEN stddev_samp(pnl) OVER q <= 1e-12 THEN 0 ELSE round(avg(pnl) OVER q / stddev_samp(pnl) OVER q * sqrt(6240), 5) + 0.0 END END AS rolling_sharpe FROM pf WINDOW q AS (ORDER BY time ROWS BETWEEN 519 PRECEDING AND CURRENT ROW)",
)
def rolling(spark, sf_dir):
    return r6(portfolio.rolling_sharpe(portfolio.portfolio(traded(spark, sf_dir)), PPY).select("time", "rolling_sharpe"), "rolling_sharpe", digits=5)


TRADES = """,
d0 AS (SELECT symbol, time, pnl, CASE WHEN position >= 0.3 THEN 1 WHEN position <= -0.3 THEN -1 ELSE 0 END AS d FROM tr),
d1 AS (SELECT *, lag(d) OVER w AS prev, lead(d) OVER w AS next FROM d0 WINDOW w AS (PARTITION BY symbol ORDER BY time)),
d2 AS (SELECT *, (d <> 0 AND (next IS NULL OR (next <> d AND next <> 0))) OR (d = 0 AND coalesce(prev, 0) <> 0) AS fin FROM d1),
d3 AS (SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS trade_id, max(abs(d)) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS begun FROM d2),
td AS (SELECT symbol, trade_id, min(time) AS entry_time, max(time) AS exit_time, arg_max(d, time) FILTER (d <> 0) AS direction, sum(pnl) AS pnl, count(*) AS n_bars FROM d3 WHERE begun = 1 GROUP BY symbol, trade_id HAVING max(fin::INT) = 1)"""


@register("trades", TRADED + TRADES + " SELECT symbol, trade_id, entry_time, exit_time, direction, round(pnl, 6) + 0.0 AS pnl, n_bars FROM td")
def trades(spark, sf_dir):
    return r6(portfolio.trades(traded(spark, sf_dir), 0.3), "pnl")


@register(
    "trade_summary",
    TRADED + TRADES + " SELECT count(*) AS n_trades, count(*) FILTER (pnl > 0) AS n_wins, round(avg((pnl > 0)::INT), 6) AS win_rate, round(avg(pnl) FILTER (pnl > 0), 6) AS avg_win, round(avg(pnl) FILTER (pnl < 0), 6) AS avg_loss,"
    " round(avg(pnl) FILTER (pnl > 0) / abs(avg(pnl) FILTER (pnl < 0)), 6) AS profit_factor, round(max(pnl), 6) AS best, round(min(pnl), 6) AS worst FROM td",
)
def summary(spark, sf_dir):
    return r6(portfolio.trade_summary(portfolio.trades(traded(spark, sf_dir), 0.3)), "win_rate", "avg_win", "avg_loss", "profit_factor", "best", "worst")


def perf_sql(source: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return (
        f"SELECT {g}round(avg(pnl) * 6240, 6) AS annual_return, round(stddev_samp(pnl) * sqrt(6240), 6) AS volatility, round(avg(pnl) / stddev_samp(pnl) * sqrt(6240), 6) AS sharpe,"
        f" round(avg(pnl) / (stddev_samp(pnl) FILTER (pnl < 0)) * sqrt(6240), 6) AS sortino, round(max((peak - equity) / abs(peak)), 6) AS max_drawdown, count(*) AS n_bars,"
        f" round(avg(pnl) * 6240 / max((peak - equity) / abs(peak)), 5) AS calmar FROM {source}" + (f" GROUP BY {group}" if group else "")
    )


PERF = ("annual_return", "volatility", "sharpe", "sortino", "max_drawdown")


@register("performance", TRADED + " " + perf_sql("eq"))
def performance(spark, sf_dir):
    return r6(r6(metrics.performance(portfolio.portfolio(traded(spark, sf_dir)), PPY), *PERF), "calmar", digits=5)


@register("turnover", TRADED + ", s AS (SELECT symbol, sum(abs(delta)) AS t FROM tr GROUP BY symbol) SELECT round(avg(t), 6) AS turnover FROM s")
def turnover(spark, sf_dir):
    return r6(metrics.turnover(traded(spark, sf_dir)), "turnover")


@register(
    "cost_sensitivity",
    TRADED
    + """, m AS (SELECT multiple, time, avg(position * ret - multiple * 3e-4 * abs(delta)) AS pnl FROM tr, (SELECT unnest([0.5, 1.0, 2.0, 3.0])::DOUBLE AS multiple) GROUP BY ALL),
m1 AS (SELECT *, 1 + sum(pnl) OVER (PARTITION BY multiple ORDER BY time ROWS UNBOUNDED PRECEDING) AS equity FROM m), m2 AS (SELECT *, max(equity) OVER (PARTITION BY multiple ORDER BY time ROWS UNBOUNDED PRECEDING) AS peak FROM m1) """
    + perf_sql("m2", "multiple"),
)
def costs(spark, sf_dir):
    return r6(r6(metrics.cost_sensitivity(traded(spark, sf_dir), PPY), *PERF), "calmar", digits=5)


IC = TRADED + """, rk AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY factor) + (count(*) OVER (PARTITION BY symbol, factor) - 1) / 2 AS rf, rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2 AS rr FROM tr),
ic AS (SELECT symbol, corr(factor, ret) AS ic, corr(rf, rr) AS rank_ic FROM rk GROUP BY symbol HAVING stddev_pop(factor) > 1e-12 AND stddev_pop(ret) > 1e-12)"""


@register("information_coefficients", IC + " SELECT symbol, round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic FROM ic")
def ic(spark, sf_dir):
    return r6(metrics.information(traded(spark, sf_dir)), "ic", "rank_ic")


@register("information_ratio", IC + " SELECT round(avg(ic), 6) AS ic, round(avg(rank_ic), 6) AS rank_ic, round(avg(rank_ic) / stddev_pop(rank_ic), 5) AS ir FROM ic")
def ir(spark, sf_dir):
    return r6(r6(metrics.information_ratio(metrics.information(traded(spark, sf_dir))), "ic", "rank_ic"), "ir", digits=5)


EDGES = ", ".join(f"{i}/10.0" for i in range(1, 10))


@register(
    "mutual_information",
    TRADED
    + f""", q AS (SELECT list_distinct(quantile_cont(factor, [{EDGES}])) AS qx, list_distinct(quantile_cont(ret, [{EDGES}])) AS qy, max(factor) AS mx, max(ret) AS my FROM tr),
b AS (SELECT len(list_filter(qx, lambda e: e <= factor AND e < mx)) AS bx, len(list_filter(qy, lambda e: e <= ret AND e < my)) AS by_, count(*)::DOUBLE AS n FROM tr, q GROUP BY ALL),
m AS (SELECT n, sum(n) OVER (PARTITION BY bx) AS nx, sum(n) OVER (PARTITION BY by_) AS ny, sum(n) OVER () AS t FROM b) SELECT round(greatest(sum(n / t * ln(n * t / (nx * ny))), 0), 5) AS mi FROM m""",
)
def mi(spark, sf_dir):
    return r6(metrics.mutual_information(traded(spark, sf_dir), 10), "mi", digits=5)


@register(
    "periods_per_year",
    WITH + ", s AS (SELECT count(*) / ((max(time) - min(time)) / 31557600.0) AS p FROM bars GROUP BY symbol), l AS (SELECT list_sort(list(p)) AS l FROM s) SELECT greatest(least(round(l[len(l) // 2 + 1]), 600000), 10) AS ppy FROM l",
)
def ppy(spark, sf_dir):
    return metrics.periods_per_year(hourly(spark, sf_dir))


@register(
    "latest_signal",
    TRADED + ", w AS (SELECT unnest(['click', 'purchase', 'nothing']) AS symbol), l AS (SELECT symbol, arg_max(position, time) AS position, max(time) AS time FROM tr GROUP BY symbol) SELECT w.symbol, round(position, 6) + 0.0 AS position, time, CASE WHEN time IS NULL THEN 'no_data' ELSE 'signal' END AS status FROM w LEFT JOIN l USING (symbol)",
)
def latest(spark, sf_dir):
    watch = spark.createDataFrame([("click",), ("purchase",), ("nothing",)], "symbol string")
    return r6(compare.latest(traded(spark, sf_dir), watch), "position")


@register(
    "train_val_holdout",
    TRADED + ", i AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n FROM pf) SELECT CASE WHEN i < floor(0.6 * n) THEN 'train' WHEN i < floor(0.6 * n) + 24 THEN 'gap' WHEN i < floor(0.6 * n) + 24 + floor(0.2 * n) THEN 'val' WHEN i < floor(0.6 * n) + 48 + floor(0.2 * n) THEN 'gap' ELSE 'holdout' END AS part, count(*) AS n_bars, round(sum(pnl), 6) AS pnl FROM i JOIN pf USING (time) GROUP BY 1",
)
def split(spark, sf_dir):
    return r6(gates.split(portfolio.portfolio(traded(spark, sf_dir))).groupBy("part").agg(F.count("*").alias("n_bars"), F.sum("pnl").alias("pnl")), "pnl")


@register(
    "benjamini_hochberg",
    "WITH p AS (SELECT p_name AS name, p_retailprice / 20000 * (p_size / 50.0) AS p FROM part WHERE p_partkey <= 200), r AS (SELECT name, p, row_number() OVER (ORDER BY p, name) AS rank, count(*) OVER () AS m FROM p)"
    " SELECT name, p, rank, rank <= coalesce((SELECT max(rank) FROM r WHERE p <= rank / m * 0.05), 0) AS passed FROM r",
)
def bh(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey <= 200").select(F.col("p_name").alias("name"), (F.col("p_retailprice") / 20000 * (F.col("p_size") / 50.0)).alias("p"))
    return gates.benjamini_hochberg(p)


@register(
    "verdicts",
    "WITH c AS (SELECT p_partkey AS id, (p_size - 10) / 10.0 AS train, (p_partkey % 40 - 8) / 10.0 AS val, (p_partkey % 17 - 3) / 5.0 AS sharpe_2x, (p_partkey % 101) / 100.0 AS dsr, (p_partkey % 13) / 12.0 AS win_rate FROM part),"
    " d AS (SELECT *, CASE WHEN train <= 1e-9 THEN CASE WHEN val > 0 THEN 1.0 ELSE 0.0 END ELSE val / train END AS decay FROM c)"
    " SELECT id, round(decay, 6) + 0.0 AS decay, CASE WHEN val <= 0 OR sharpe_2x <= 0 OR dsr < 0.5 THEN 'BLOCKED' WHEN decay < 0.5 OR win_rate < 0.6 OR dsr < 0.95 THEN 'RESEARCH_ONLY' ELSE 'DEPLOYABLE' END AS verdict FROM d",
)
def verdicts(spark, sf_dir):
    k = F.col("p_partkey")
    c = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("id"), ((F.col("p_size") - 10) / 10.0).alias("train"), ((k % 40 - 8) / 10.0).alias("val"), ((k % 17 - 3) / 5.0).alias("sharpe_2x"), ((k % 101) / 100.0).alias("dsr"), ((k % 13) / 12.0).alias("win_rate")
    )
    return r6(gates.verdict(c).select("id", "decay", "verdict"), "decay")


SCORES = ("annual_return", "sortino", "exposure", "longs", "shorts", "mean_delta", "exposure_penalty", "beta_penalty", "turnover_penalty", "symmetry")


@register(
    "score_components",
    TRADED
    + """, k AS (SELECT symbol, avg(pnl) AS m, stddev_pop(pnl) AS sd, coalesce(stddev_pop(pnl) FILTER (pnl < 0), 0) AS dn, avg(abs(position)) AS exposure, avg((position > 0.05)::INT) AS longs, avg((position < -0.05)::INT) AS shorts, avg(abs(delta)) AS mean_delta FROM tr GROUP BY symbol)
SELECT symbol, round(m * 6240, 6) AS annual_return, round(greatest(least(m / greatest(dn, 0.2 * greatest(sd, 1e-8), 1e-8) * sqrt(6240), 20), -20), 6) AS sortino, round(exposure, 6) AS exposure, round(longs, 6) AS longs, round(shorts, 6) AS shorts, round(mean_delta, 6) AS mean_delta,
round(CASE WHEN exposure < 0.1 THEN 2 * (exposure / 0.1 - 1) ELSE 0 END, 6) AS exposure_penalty,
round(CASE WHEN greatest(longs, shorts) > 0.85 THEN -2 * (greatest(longs, shorts) - 0.85) / 0.15 WHEN greatest(longs, shorts) > 0.7 THEN -0.5 * (greatest(longs, shorts) - 0.7) / 0.15 ELSE 0 END, 6) AS beta_penalty,
round(-greatest(least(3 * (mean_delta - 0.2), 3), 0), 6) + 0.0 AS turnover_penalty, round(greatest(least(1 - 2 * (abs(longs - 0.5) + abs(shorts - 0.5)), 1), -1), 6) AS symmetry FROM k""",
)
def score_components(spark, sf_dir):
    return r6(scores.components(traded(spark, sf_dir), PPY), *SCORES)


@register(
    "next_bar_ic",
    TRADED + ", x AS (SELECT symbol, factor, lead(ret) OVER (PARTITION BY symbol ORDER BY time) AS nxt FROM tr) SELECT symbol, round(covar_pop(factor, nxt) / (stddev_pop(factor) * stddev_pop(nxt) + 1e-8), 6) AS ic FROM x WHERE nxt IS NOT NULL GROUP BY symbol",
)
def next_bar_ic(spark, sf_dir):
    return r6(scores.next_bar_ic(traded(spark, sf_dir)), "ic")


@register(
    "reversal_bonus",
    TRADED + ", x AS (SELECT symbol, factor, lag(factor) OVER (PARTITION BY symbol ORDER BY time) AS b FROM tr), a AS (SELECT symbol, coalesce(corr(factor, b), 0) AS a FROM x WHERE b IS NOT NULL GROUP BY symbol) SELECT round(avg(greatest(least(1 - abs(a) + CASE WHEN a < 0 THEN 0.5 ELSE 0 END, 2), -1)), 6) AS reversal FROM a",
)
def reversal(spark, sf_dir):
    return r6(scores.reversal_bonus(traded(spark, sf_dir)), "reversal")


# -- a formula end to end, on daily bars of line items


def formula_sql() -> str:
    head = feature_queries.HEAD.replace(oracle.panel(HOUR), oracle.panel(DAY, "lineitem"))
    a = feature_queries.simple("r1").replace(", v AS", ", va AS") + feature_queries.robust("va", "na")
    b = feature_queries.sloped("close", 20).replace(", v AS", ", vb AS") + feature_queries.robust("vb", "nb")
    return (
        head
        + a
        + b
        + """,
g0 AS (SELECT symbol, time, na.v + nb.v AS x FROM na JOIN nb USING (symbol, time)),
g1 AS (SELECT *, greatest(least((x - avg(x) OVER c) / greatest(stddev_samp(x) OVER c, 1e-8), 3), -3) AS factor FROM g0 WINDOW c AS (PARTITION BY time)),
g2 AS (SELECT g1.*, CASE WHEN abs(tanh(factor)) < 0.05 THEN 0 ELSE tanh(factor) END AS position, coalesce(ln(lead(open, 2) OVER w / lead(open) OVER w), 0) AS ret FROM g1 JOIN p USING (symbol, time) WINDOW w AS (PARTITION BY symbol ORDER BY time)),
tr AS (SELECT *, position * ret - 3e-4 * abs(position - coalesce(lag(position) OVER w, 0)) AS pnl FROM g2 WINDOW w AS (PARTITION BY symbol ORDER BY time)),
pf AS (SELECT time, avg(pnl) AS pnl FROM tr GROUP BY time),
eq0 AS (SELECT *, 1 + sum(pnl) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS equity FROM pf),
eq AS (SELECT *, max(equity) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS peak FROM eq0)
"""
        + perf_sql("eq").replace(", 6)", ", 4)").replace(", 5)", ", 3)")
    )


@register("factor_backtest", formula_sql())
def factor_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADD(RET, SLOPE20) on the dense daily panel to a row of performance."""
    panel = bars.densify(bars.resample(bars.ticks_from_lineitem(spark, sf_dir), DAY))
    f = compiler.evaluate(panel, [0, 4, 65])
    t = portfolio.pnl(portfolio.target_return(f).withColumn("position", portfolio.position(F.col("factor"))))
    return r6(r6(metrics.performance(portfolio.portfolio(t), PPY), *PERF, digits=4), "calmar", digits=3)
