"""Queries of sources, records, signals and sizing, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formula
from ..functions.expr import E, Env
from ..operators import compare, metrics, payloads, portfolio, records, scores
from ..registry import register
from ..sources import bars, exchanges
from .report_queries import PPY, SECOND, TRADED, WITH, hourly, perturbed, r6, traded

HOUR = 3600
ON = "symbol, time, open, high, low, close, volume"


def part(spark, sf_dir):
    """Specs: the parts, in files by brand, with the type as tokens."""
    k = F.col("p_partkey")
    verdict = F.when(k % 7 == 0, "DEPLOYABLE").when(k % 3 == 0, "RESEARCH_ONLY").otherwise("BLOCKED")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("tokens"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("score"), verdict.alias("verdict"), (k % 5 == 0).alias("exported")
    )


PART = "WITH s AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file, p_type AS tokens, p_size AS size, p_retailprice AS score, CASE WHEN p_partkey % 7 = 0 THEN 'DEPLOYABLE' WHEN p_partkey % 3 = 0 THEN 'RESEARCH_ONLY' ELSE 'BLOCKED' END AS verdict, p_partkey % 5 = 0 AS exported FROM part)"


@register("score_floor", PART + " SELECT id, max(score) OVER (PARTITION BY size % 6 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM s")
def floor(spark, sf_dir):
    return records.score_floor(part(spark, sf_dir), F.col("size") % 6)


@register("catalogue_summary", PART + " SELECT count(*) AS total, count(*) FILTER (verdict = 'DEPLOYABLE') AS deployable, count(*) FILTER (verdict = 'RESEARCH_ONLY') AS research_only, count(*) FILTER (verdict = 'BLOCKED') AS blocked, count(*) FILTER (exported) AS exported FROM s")
def summary(spark, sf_dir):
    return records.summary(part(spark, sf_dir))


TOP = PART + ", t AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, name) AS place FROM s QUALIFY place <= 20)"


@register("top_per_file", TOP + " SELECT file, place::INT AS place, id FROM t")
def top(spark, sf_dir):
    return records.top_per_file(part(spark, sf_dir), 20).select("file", "place", "id")


@register("distinct_members", TOP + " SELECT tokens, file, place::INT AS place FROM t QUALIFY row_number() OVER (PARTITION BY tokens ORDER BY file, place, name) = 1")
def distinct(spark, sf_dir):
    return records.distinct_members(records.top_per_file(part(spark, sf_dir), 20)).select("tokens", "file", "place")


@register("member_consistency", PART + " SELECT file, count(DISTINCT tokens) AS n_tokens, count(DISTINCT verdict) AS n_verdict, count(DISTINCT tokens) = 1 AND count(DISTINCT verdict) = 1 AS agree FROM s GROUP BY file")
def consistent(spark, sf_dir):
    return records.consistency(part(spark, sf_dir), "file", "tokens", "verdict")


@register(
    "nested_collect",
    "WITH s AS (SELECT lpad(n_nationkey::VARCHAR, 12, '0') || 'x' AS id, n_name AS file, n_nationkey AS k FROM nation), e AS (SELECT lpad(s_nationkey::VARCHAR, 12, '0') AS i, list(s_name ORDER BY s_name, s_suppkey) AS names FROM supplier GROUP BY 1), r AS (SELECT n_name AS file, list(c_custkey ORDER BY c_custkey) AS runs FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 GROUP BY 1)"
    " SELECT id, s.file, coalesce(array_to_string(names, ','), '') AS exports, coalesce(array_to_string(runs, ','), '') AS runs FROM s LEFT JOIN e ON e.i = s.id[1:12] LEFT JOIN r ON r.file = s.file",
)
def nested(spark, sf_dir):
    nation, supplier, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier", "customer"))
    pad = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    specs = nation.select(F.concat(pad("n_nationkey"), F.lit("x")).alias("id"), F.col("n_name").alias("file"))
    exports = supplier.select(F.concat(pad("s_nationkey"), F.lit("/export")).alias("spec_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("size"))
    runs = customer.where("c_acctbal < 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("file"), F.col("c_custkey").alias("run"))
    got = records.nested(specs, exports, runs)
    return got.select("id", "file", F.array_join(F.transform("exports", lambda x: x["name"]), ",").alias("exports"), F.array_join(F.transform("runs", lambda x: x.cast("string")), ",").alias("runs"))


@register(
    "profile_lookup",
    WITH + ", p AS (SELECT * FROM (VALUES ('click', 100.0, 0.01), ('*', 1.0, 0.1)) AS v(symbol, contract, step)) SELECT b.symbol, count(*) AS n_bars, p.symbol IS NOT NULL AS known, coalesce(p.contract, 1.0)::DOUBLE AS contract, coalesce(p.step, 0.1)::DOUBLE AS step FROM bars b LEFT JOIN p USING (symbol) GROUP BY ALL",
)
def profiles(spark, sf_dir):
    p = spark.createDataFrame([("click", 100.0, 0.01), ("*", 1.0, 0.1)], "symbol string, contract double, step double")
    return records.profiled(hourly(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n_bars")), p, "*")


@register("contiguous_prefix", WITH + ", j AS (SELECT symbol, time, volume < 2 AS failed FROM bars), k AS (SELECT *, max(failed::INT) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS bad FROM j) SELECT symbol, max(time) FILTER (bad = 0) AS upto FROM k GROUP BY symbol")
def prefix(spark, sf_dir):
    return records.contiguous_prefix(hourly(spark, sf_dir).select("symbol", "time", (F.col("volume") < 2).alias("failed")))


@register(
    "year_windows",
    "WITH s AS (SELECT o_orderpriority AS symbol, epoch_us(min(o_orderdate)) // 1000000 AS first, epoch_us(max(o_orderdate)) // 1000000 AS last FROM orders GROUP BY 1), w AS (SELECT symbol, first, last, unnest(range(year(make_timestamp(first * 1000000)), year(make_timestamp(last * 1000000)) + 1)) AS y, year(make_timestamp(last * 1000000)) AS ly FROM s)"
    " SELECT symbol, greatest(epoch_us(make_timestamp(y, 1, 1, 0, 0, 0.0)) // 1000000, first) AS begin, least(epoch_us(make_timestamp(y + 1, 1, 1, 0, 0, 0.0)) // 1000000 + CASE WHEN y < ly THEN 1296000 ELSE 0 END, last + 1) AS \"end\", row_number() OVER (PARTITION BY symbol ORDER BY y DESC)::INT AS place FROM w",
)
def windows(spark, sf_dir):
    s = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    span = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.min(s).alias("first"), F.max(s).alias("last"))
    return records.year_windows(span)


FILLS = "WITH f AS (SELECT epoch_us(l_shipdate) // 1000000 AS ts, l_extendedprice * l_discount AS profit, -l_extendedprice * l_tax / 100 AS fee FROM lineitem)"


def fills(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("ts"), (F.col("l_extendedprice") * F.col("l_discount")).alias("profit"), (-F.col("l_extendedprice") * F.col("l_tax") / 100).alias("fee"))


@register("daily_realised", FILLS + " SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day, round(sum(profit + fee), 6) + 0.0 AS realised FROM f GROUP BY 1")
def daily(spark, sf_dir):
    return r6(metrics.daily(fills(spark, sf_dir)), "realised")


@register("fees_total", FILLS + " SELECT round(sum(fee), 2) + 0.0 AS fees FROM f")
def fees(spark, sf_dir):
    return r6(records.fees(fills(spark, sf_dir)), "fees", digits=2)


@register(
    "panel_fingerprint",
    WITH + ", r AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS i, concat_ws(',', time, round(open * 1000000)::BIGINT, round(high * 1000000)::BIGINT, round(low * 1000000)::BIGINT, round(close * 1000000)::BIGINT, round(volume * 1000000)::BIGINT) AS row FROM bars), d AS (SELECT symbol, i // 1024 AS b, count(*) AS n, sha256(string_agg(row, ';' ORDER BY i)) AS d FROM r GROUP BY ALL) SELECT symbol, sum(n)::BIGINT AS n_bars, sha256(string_agg(d, ':' ORDER BY b)) AS digest FROM d GROUP BY symbol",
)
def fingerprint(spark, sf_dir):
    return records.fingerprint(hourly(spark, sf_dir))


# -- sources


def pages(spark, sf_dir, rising: bool):
    """The hourly bars as an exchange would page them: strings, a page's last candle again on the next, the newest one still open."""
    b = hourly(spark, sf_dir)
    w = Window.partitionBy("symbol").orderBy("time" if rising else F.desc("time"))
    s = lambda c: F.col(c).cast("string")
    ms = (F.col("time") * 1000).cast("string")
    newest = F.col("time") == F.max("time").over(Window.partitionBy("symbol"))
    tail = [((F.col("time") + HOUR) * 1000 - 1).cast("string")] if rising else [F.lit("0"), F.lit("0"), F.when(newest, "0").otherwise("1")]
    rows = b.select("symbol", (F.row_number().over(w) - 1).alias("i"), F.array(ms, s("open"), s("high"), s("low"), s("close"), s("volume"), *tail).alias("item"))
    again = rows.withColumn("number", F.explode(F.array_distinct(F.array(F.floor(F.col("i") / 100), F.floor(F.greatest(F.col("i") - 1, F.lit(0)) / 100)))))
    return again.groupBy("symbol", "number").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("i", "item"))), lambda x: x["item"])).alias("page"))


CLOSED = WITH + f" SELECT {ON} FROM bars QUALIFY time < max(time) OVER (PARTITION BY symbol)"


@register("klines", CLOSED)
def klines(spark, sf_dir):
    ends = hourly(spark, sf_dir).groupBy("symbol").agg(F.max("time").alias("t")).agg(F.min("t")).first()[0]  # one row: every newest bar is still open
    return exchanges.klines(pages(spark, sf_dir, True), ends * 1000)


@register("candles", CLOSED)
def candles(spark, sf_dir):
    return exchanges.candles(pages(spark, sf_dir, False))


@register("clock_shift", WITH + f" SELECT {ON.replace('time', 'time + 10800 AS time')} FROM bars WHERE time + 10800 > 1704240000")
def shift(spark, sf_dir):
    """Three hours on, to a broker's clock; the bound is held against the moved time."""
    return exchanges.shifted(hourly(spark, sf_dir), 3 * HOUR, 1704240000)


@register("source_fallback", WITH + SECOND + f" SELECT {ON} FROM second WHERE symbol <> 'click' UNION ALL SELECT {ON} FROM bars WHERE symbol = 'click'")
def fallback(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return exchanges.first_source(perturbed(b).where("symbol <> 'click'"), b)


@register("grid_filter", WITH + f" SELECT {ON} FROM (SELECT * REPLACE (time + CASE WHEN (time // 3600) % 9 = 0 THEN 60 ELSE 0 END AS time) FROM bars) WHERE time % 3600 = 0")
def grid(spark, sf_dir):
    return bars.on_grid(hourly(spark, sf_dir).withColumn("time", F.col("time") + F.when(F.floor(F.col("time") / HOUR) % 9 == 0, 60).otherwise(0)), HOUR)


@register("time_slice", WITH + f" SELECT {ON} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time) BETWEEN 101 AND 200")
def time_slice(spark, sf_dir):
    return bars.sliced(hourly(spark, sf_dir), 100, 200)


@register("next_open_gaps", WITH + ", g AS (SELECT symbol, time, lead(open) OVER (PARTITION BY symbol ORDER BY time) - close AS gap FROM bars) SELECT symbol, time, gap FROM g WHERE gap IS NOT NULL AND dayofweek(make_timestamp(time * 1000000)) BETWEEN 1 AND 5")
def gaps(spark, sf_dir):
    return bars.next_open_gaps(hourly(spark, sf_dir))


@register("last_close", WITH + " SELECT symbol, max(time) AS time, arg_max(close, time) AS price FROM bars GROUP BY symbol")
def last_close(spark, sf_dir):
    return bars.last_close(hourly(spark, sf_dir))


@register("largest_differences", WITH + SECOND + " SELECT symbol, time, abs(b.close - s.close) / greatest(abs(s.close), 1e-12) AS diff FROM bars b JOIN second s USING (symbol, time) ORDER BY diff DESC, symbol, time LIMIT 20")
def worst(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return compare.worst(b, perturbed(b), 20)


# -- signals and sizing

STEPS = TRADED + ", g AS (SELECT symbol, time, CASE WHEN position > 0.05 THEN 1 WHEN position < -0.05 THEN -1 ELSE 0 END AS d FROM tr), h AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY symbol ORDER BY time), 0) AS held FROM g)"


@register("signal_actions", STEPS + " SELECT symbol, time, d AS direction, CASE WHEN held = d THEN 'HOLD' WHEN held = 0 THEN 'OPEN' WHEN d = 0 THEN 'CLOSE' ELSE 'REVERSE' END AS action FROM h")
def actions(spark, sf_dir):
    d = traded(spark, sf_dir).select("symbol", "time", portfolio.direction(F.col("position")).alias("direction"))
    held = F.lag("direction", 1, 0).over(Window.partitionBy("symbol").orderBy("time"))
    return d.select("symbol", "time", "direction", portfolio.action(held, F.col("direction")).alias("action"))


@register(
    "sized_lots",
    WITH + ", tr AS (SELECT symbol, time, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)), a AS (SELECT symbol, time, avg(tr.tr) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr FROM tr QUALIFY count(*) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) = 14),"
    " l AS (SELECT *, CASE WHEN atr = 0 THEN 0 ELSE floor(100000.0::DOUBLE * 0.01::DOUBLE / (atr * 100) / 0.01::DOUBLE + 1e-9::DOUBLE) * 0.01::DOUBLE END AS lots FROM a) SELECT symbol, time, round(atr, 6) AS atr, round(CASE WHEN lots >= 0.01 - 1e-12 THEN lots ELSE 0 END, 6) + 0.0 AS lots FROM l",
)
def lots(spark, sf_dir):
    a = bars.average_range(hourly(spark, sf_dir), 14)
    return r6(a.select("symbol", "time", "atr", scores.vol_target_lots(100000.0, 0.01, F.col("atr"), 100.0).alias("lots")), "atr", "lots")


@register("gated_score", TRADED + ", x AS (SELECT symbol, factor, lead(ret) OVER (PARTITION BY symbol ORDER BY time) AS nxt FROM tr), i AS (SELECT symbol, covar_pop(factor, nxt) / (stddev_pop(factor) * stddev_pop(nxt) + 1e-8) AS ic FROM x WHERE nxt IS NOT NULL GROUP BY symbol) SELECT symbol, round(CASE WHEN ic > 0.01 THEN 1.15 WHEN ic < -0.01 THEN 0.75 ELSE 1.0 END, 6)::DOUBLE AS score FROM i")
def gated(spark, sf_dir):
    return r6(scores.next_bar_ic(traded(spark, sf_dir)).select("symbol", scores.ic_gate(F.lit(1.0), F.col("ic")).alias("score")), "score")


@register(
    "backtest_payload",
    TRADED + " SELECT count(*) AS n_bars, sum(time)::BIGINT AS time, round(sum(round(equity, 6)), 4) AS equity, round(sum(round(peak - equity, 6)), 4) + 0.0 AS drawdown FROM eq",
)
def payload(spark, sf_dir):
    """The payload's JSON, read back."""
    text = payloads.payload(portfolio.equity(portfolio.portfolio(traded(spark, sf_dir))), portfolio.trades(traded(spark, sf_dir), 0.3), {"ppy": PPY})
    back = text.select(F.from_json("payload", "series struct<time: array<bigint>, equity: array<double>, drawdown: array<double>>").alias("p"))
    total = lambda c, t: F.aggregate(F.col(f"p.series.{c}"), F.lit(0).cast(t), lambda a, x: a + x)
    return r6(back.select(F.size("p.series.time").cast("long").alias("n_bars"), total("time", "bigint").alias("time"), total("equity", "double").alias("equity"), total("drawdown", "double").alias("drawdown")), "equity", "drawdown", digits=4)


@register(
    "spec_round_trip",
    PART + " SELECT name, size % 65 AS first, round(score / 1000, 6) AS train, CASE WHEN id % 4 = 0 THEN NULL ELSE round(score / 2000, 6) END AS val, verdict FROM s",
)
def spec_round_trip(spark, sf_dir):
    """Specs to JSON and back, with a broken text and one of another version among them."""
    p = part(spark, sf_dir)
    specs = p.select("name", F.array((F.col("size") % 65).cast("int"), F.lit(1)).alias("tokens"), (F.col("score") / 1000).alias("train"), F.when(F.col("id") % 4 != 0, F.col("score") / 2000).alias("val"), "verdict", F.lit(None).cast("string").alias("notes"))
    texts = payloads.specs_json(specs, "v1").unionByName(spark.createDataFrame([("x", "{broken"), ("y", '{"spec_version": 9, "payload": {"tokens": [1]}}')], "name string, spec string"))
    return payloads.read_specs(texts).select("name", F.col("tokens")[0].alias("first"), "train", "val", "verdict")


@register(
    "gate_dead_band",
    WITH + ", d AS (SELECT *, close / open - 1 AS c FROM bars), e AS (SELECT *, last_value(CASE WHEN c > 0.3 THEN 1.0 WHEN c < -0.3 THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS h FROM d) SELECT symbol, time, round(coalesce(h, 0) * high + (1 - coalesce(h, 0)) * low, 6) + 0.0 AS v FROM e",
)
def gate_dead_band(spark, sf_dir):
    env = Env(hourly(spark, sf_dir).withColumn("c", F.col("close") / F.col("open") - 1))
    gated = formula.gate_with_dead_band(env, E(F.col("c"), 0, True), env["high"], env["low"], 0.3)
    return r6(env.frame({"v": gated}), "v")
