"""Bars: resampling, densifying, cleaning and merging panels (symbol, time, open, high, low, close, volume); time is Unix seconds in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = ("open", "high", "low", "close", "volume")


def unix(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def ticks_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, price, size, o1..): a tick per event, in order of (ts, event_id)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("symbol"), unix("ts").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.struct(F.col("ts"), F.col("event_id")).alias("at"))


def ticks_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tick per line: unit price, quantity. (l_orderkey, l_linenumber) is no key, so five columns order the ticks of a day."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        unix("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("double").alias("size"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"),
    )


def resample(ticks: DataFrame, seconds: int, offset: int = 0) -> DataFrame:
    """Ticks (symbol, ts, price, size, at) to bars; one shuffle of partial aggregates by (symbol, time)."""
    bucket = (F.col("ts") - F.pmod(F.col("ts") - offset, F.lit(seconds))).alias("time")
    return ticks.groupBy("symbol", bucket).agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("size").alias("volume")
    )


def rebar(bars: DataFrame, seconds: int, offset: int = 0, period: int | None = None, complete: float = 0.8) -> DataFrame:
    """Bars to longer bars; with a source period also the number of bars and whether enough of those expected are there."""
    bucket = (F.col("time") - F.pmod(F.col("time") - offset, F.lit(seconds))).alias("bucket")
    out = bars.groupBy("symbol", bucket).agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n")
    )
    out = out.withColumnRenamed("bucket", "time")
    return out.withColumn("complete", F.col("n") >= complete * (seconds / period)) if period else out.drop("n")


def densify(bars: DataFrame) -> DataFrame:
    """Every symbol at every time that some symbol has between the latest first bar and the earliest last bar; missing bars
    are flat at the last close with volume 0."""
    ends = bars.groupBy("symbol").agg(F.min("time").alias("a"), F.max("time").alias("b"))
    span = F.broadcast(ends.agg(F.max("a").alias("a"), F.min("b").alias("b")))  # one row
    times = bars.select("time").distinct().join(span, F.col("time").between(F.col("a"), F.col("b"))).select("time")
    grid = _grid(times, ends)
    last = F.last("close", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("time"))
    full = bars.select("symbol", "time", *BAR, F.lit(True).alias("real")).unionByName(grid.withColumn("real", F.lit(False)), allowMissingColumns=True)
    one = full.groupBy("symbol", "time").agg(*[F.max(c).alias(c) for c in BAR], F.max("real").alias("real"), F.min("real").alias("grid"))
    held = one.withColumn("held", last).where(~F.col("grid"))
    return held.select("symbol", "time", *[F.coalesce(c, "held").alias(c) for c in BAR[:4]], F.coalesce("volume", F.lit(0.0)).alias("volume"))


def _grid(times: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each time with each symbol: the list of symbols, a dimension, is one row of an array that is exploded per time."""
    every = symbols.agg(F.sort_array(F.collect_set("symbol")).alias("every"))
    return times.join(F.broadcast(every)).select(F.explode("every").alias("symbol"), "time")


def stale(open_="open", high="high", low="low", close="close", volume="volume") -> Column:
    return (F.col(open_) == F.col(high)) & (F.col(high) == F.col(low)) & (F.col(low) == F.col(close)) & (F.coalesce(F.col(volume), F.lit(0.0)) == 0)


def sunday(time: str = "time") -> Column:
    return F.dayofweek(F.timestamp_seconds(F.col(time))) == 1


def clean(bars: DataFrame) -> DataFrame:
    """Without stale bars and Sundays."""
    return bars.where(~stale() & ~sunday())


def newest(bars: DataFrame, rank: str, first: bool = False, key: tuple[str, ...] = ("symbol", "time")) -> DataFrame:
    """One row per key: that with the largest rank (the smallest if first)."""
    order = F.col(rank).asc() if first else F.col(rank).desc()
    return bars.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__n = 1").drop("__n")


def merge(old: DataFrame, new: DataFrame, keep: str = "last") -> DataFrame:
    """Union of two panels, one row per (symbol, time): new wins, or old with keep='first'."""
    both = old.withColumn("__rank", F.lit(0)).unionByName(new.withColumn("__rank", F.lit(1)))
    return newest(both, "__rank", keep == "first").drop("__rank")


def split_union(old: DataFrame, new: DataFrame, at: int) -> DataFrame:
    """old before a time, new from it on."""
    return old.where(F.col("time") < at).unionByName(new.where(F.col("time") >= at))


def price_filter(bars: DataFrame, low: float = 100.0, high: float = 10000.0) -> DataFrame:
    """close within 5 interquantile ranges (0.1 % to 99.9 %) of the range, and within low and high."""
    q = bars.agg(F.percentile("close", F.array(F.lit(0.001), F.lit(0.999))).alias("q"))
    met = bars.join(F.broadcast(q))
    span = F.col("q")[1] - F.col("q")[0]
    return met.where((F.col("close") >= F.greatest(F.lit(low), F.col("q")[0] - 5 * span)) & (F.col("close") <= F.least(F.lit(high), F.col("q")[1] + 5 * span))).drop("q")


def self_check(bars: DataFrame, seconds: int) -> DataFrame:
    """Per symbol: bars, gaps over 1.5 periods, prices of each column beyond 3 of its interquartile ranges, bars without volume."""
    w = Window.partitionBy("symbol").orderBy("time")
    step = bars.withColumn("step", F.col("time") - F.lag("time").over(w))
    prices = BAR[:4]
    q = bars.groupBy("symbol").agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"q_{c}") for c in prices])

    def outlying(c):
        low, high = F.col(f"q_{c}")[0], F.col(f"q_{c}")[1]
        return F.count_if((F.col(c) < low - 3 * (high - low)) | (F.col(c) > high + 3 * (high - low))).alias(f"n_outliers_{c}")

    return (
        step.join(q, "symbol")
        .groupBy("symbol")
        .agg(
            F.count("*").alias("n_bars"),
            F.count_if(F.col("step") > 1.5 * seconds).alias("n_gaps"),
            *[outlying(c) for c in prices],
            F.count_if(F.col("volume") == 0).alias("n_no_volume"),
        )
    )


def normal_time(time: Column, largest: Column, unit: str = "auto") -> Column:
    """Unix seconds: of seconds, milliseconds, or by the column's largest value, which under 1e7 tells thousands of seconds."""
    if unit not in ("auto", "s", "ms"):
        raise ValueError(f"no unit of time: {unit}")
    if unit == "ms":
        return F.floor(time / 1000).cast("long")
    return (time if unit == "s" else F.when(largest < 1e7, time * 1000).otherwise(time)).cast("long")


def decode_candles(rows: DataFrame) -> DataFrame:
    """Delta-encoded candles (symbol, timestamp, shift, multiplier, open, high, low, close, times[], opens[], ..., volumes[]) to
    bars: each array holds steps, times in shifts and prices in multipliers; gaps are filled with flat bars."""
    names = ("times", "opens", "highs", "lows", "closes", "volumes")
    flat = rows.select("symbol", "timestamp", "shift", "multiplier", *BAR[:4], F.posexplode(F.arrays_zip(*names)).alias("pos", "z"))
    w = Window.partitionBy("symbol", "timestamp").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    real = flat.select(
        "symbol",
        "shift",
        (F.col("timestamp") + F.sum("z.times").over(w) * F.col("shift")).alias("time"),
        *[F.round(F.col(c) + F.sum(f"z.{c}s").over(w) * F.col("multiplier"), 10).alias(c) for c in BAR[:4]],
        F.col("z.volumes").cast("double").alias("volume"),
    )
    after = F.lead("time").over(Window.partitionBy("symbol").orderBy("time"))
    gap = real.withColumn("next", after).where(F.col("next") > F.col("time") + F.col("shift"))
    fill = gap.select("symbol", F.explode(F.sequence(F.col("time") + F.col("shift"), F.col("next") - F.col("shift"), F.col("shift"))).alias("time"), *[F.col("close").alias(c) for c in BAR[:4]], F.lit(0.0).alias("volume"))
    return real.select("symbol", "time", *BAR).unionByName(fill)


def on_grid(bars: DataFrame, seconds: int) -> DataFrame:
    return bars.where(F.col("time") % seconds == 0)


def sliced(bars: DataFrame, start: int, end: int) -> DataFrame:
    """Bars start to end - 1 of each symbol."""
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1
    return bars.withColumn("__i", i).where((F.col("__i") >= start) & (F.col("__i") < end)).drop("__i")


def next_open_gaps(bars: DataFrame) -> DataFrame:
    """What the next open is above the close, Monday to Friday."""
    gap = F.lead("open").over(Window.partitionBy("symbol").orderBy("time")) - F.col("close")
    return bars.select("symbol", "time", gap.alias("gap")).where(F.col("gap").isNotNull() & F.dayofweek(F.timestamp_seconds("time")).between(2, 6))


def last_close(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("time").alias("time"), F.max_by("close", "time").alias("price"))


def average_range(bars: DataFrame, n: int) -> DataFrame:
    """Bars with atr, the mean true range of the last n; those before a full window go."""
    w = Window.partitionBy("symbol").orderBy("time")
    before = F.lag("close").over(w)
    reach = F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - before), F.lit(0.0)), F.coalesce(F.abs(F.col("low") - before), F.lit(0.0)))
    last = w.rowsBetween(1 - n, 0)
    return bars.withColumn("__tr", reach).withColumn("atr", F.avg("__tr").over(last)).withColumn("__n", F.count(F.lit(1)).over(last)).where(F.col("__n") == n).drop("__tr", "__n")
