"""Pages of candles as exchanges and terminals hand them out, and shifts of their clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _parsed(pages: DataFrame) -> DataFrame:
    """(symbol, page) with a JSON array of arrays to (symbol, item, ms); of candles with one opening time that of the first page and place."""
    rows = pages.select("symbol", "number", F.posexplode(F.from_json("page", "array<array<string>>")).alias("pos", "item"))
    rows = rows.withColumn("ms", F.col("item")[0].cast("long"))
    w = Window.partitionBy("symbol", "ms").orderBy("number", "pos")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _bars(rows: DataFrame) -> DataFrame:
    return rows.select(
        "symbol", F.floor(F.col("ms") / 1000).alias("time"), *[F.col("item")[i + 1].cast("double").alias(c) for i, c in enumerate(("open", "high", "low", "close"))], F.coalesce(F.col("item")[5].cast("double"), F.lit(0.0)).alias("volume")
    )


def klines(pages: DataFrame, now_ms: int) -> DataFrame:
    """Rising pages [open ms, open, high, low, close, volume, close ms, ...]: the last candle goes if it closes after now."""
    rows = _parsed(pages)
    last = F.col("ms") == F.max("ms").over(Window.partitionBy("symbol"))
    alone = F.count(F.lit(1)).over(Window.partitionBy("symbol")) == 1
    return _bars(rows.withColumn("__open", last & ~alone & (F.col("item")[6].cast("long") > now_ms)).where("not __open"))


def candles(pages: DataFrame) -> DataFrame:
    """Falling pages [ms, open, high, low, close, volume, .., .., confirm]: the newest candle goes if it isn't confirmed."""
    rows = _parsed(pages)
    last = F.col("ms") == F.max("ms").over(Window.partitionBy("symbol"))
    return _bars(rows.withColumn("__open", last & F.coalesce(F.get(F.col("item"), F.lit(8)) == "0", F.lit(False))).where("not __open"))


def clock_offset(seconds: Column) -> Column:
    """An offset rounded to half hours."""
    return (F.round(seconds / 1800) * 1800).cast("long")


def shifted(bars: DataFrame, offset: int, since: int | None = None) -> DataFrame:
    """Bars with their clock moved; since is held against the moved time."""
    out = bars.withColumn("time", F.col("time") + offset)
    return out if since is None else out.where(F.col("time") > since)


def first_source(*sources: DataFrame) -> DataFrame:
    """Per symbol the bars of the first source that has any."""
    all_ = sources[0].withColumn("__source", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        all_ = all_.unionByName(s.withColumn("__source", F.lit(i)))
    best = F.min("__source").over(Window.partitionBy("symbol"))
    return all_.withColumn("__best", best).where("__source = __best").drop("__source", "__best")
