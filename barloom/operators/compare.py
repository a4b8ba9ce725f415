"""Joins of two panels and of ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import BAR

KEY = ("symbol", "time")


def _pair(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    x = a.select(*KEY, *[F.col(c).alias(f"a_{c}") for c in BAR], F.lit(True).alias("in_a"))
    y = b.select(*KEY, *[F.col(c).alias(f"b_{c}") for c in BAR], F.lit(True).alias("in_b"))
    return x.join(y, [*KEY], how)


def apart(a: Column, b: Column) -> Column:
    """Relative difference."""
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-12))


def compare(a: DataFrame, b: DataFrame, price: float = 1e-3, volume: float = 1e-2) -> DataFrame:
    """Counts per symbol: bars of both that agree, differ in price, differ in volume only, and bars of one side."""
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    off = F.greatest(*[apart(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in BAR[:4]]) > price
    vol = apart(F.col("a_volume"), F.col("b_volume")) > volume
    return _pair(a, b, "full_outer").groupBy("symbol").agg(
        F.count_if(both & ~off & ~vol).alias("matched"),
        F.count_if(both & off).alias("price_mismatch"),
        F.count_if(both & ~off & vol).alias("volume_mismatch"),
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
    )


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per symbol over common bars: count, largest relative close difference, share beyond 0.1 %."""
    d = apart(F.col("a_close"), F.col("b_close"))
    return _pair(a, b, "inner").groupBy("symbol").agg(F.count("*").alias("common"), F.max(d).alias("max_diff"), F.avg((d > 1e-3).cast("double")).alias("mismatch_share"))


def worst(a: DataFrame, b: DataFrame, n: int = 5) -> DataFrame:
    d = apart(F.col("a_close"), F.col("b_close"))
    return _pair(a, b, "inner").select(*KEY, d.alias("diff")).orderBy(F.desc("diff"), *KEY).limit(n)


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY), [*KEY], "left_semi")


def missing(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY), [*KEY], "left_anti")


def contradicted_gaps(a: DataFrame, b: DataFrame, seconds: int) -> DataFrame:
    """Gaps of a inside which b has a bar. Both sides are dealt by symbol and order themselves in one window: b's next bar
    after a gap's start decides, so no range join is needed."""
    w = Window.partitionBy("symbol").orderBy("time")
    gaps = a.withColumn("next", F.lead("time").over(w)).where(F.col("next") - F.col("time") > 1.5 * seconds).select("symbol", "time", "next", F.lit(0).alias("kind"))
    marks = b.select("symbol", "time", F.lit(None).cast("long").alias("next"), F.lit(1).alias("kind"))
    after = Window.partitionBy("symbol").orderBy("time").rangeBetween(1, Window.unboundedFollowing)
    both = gaps.unionByName(marks).withColumn("theirs", F.min(F.when(F.col("kind") == 1, F.col("time"))).over(after))
    return both.where("kind = 0 and theirs < next").select("symbol", "time", "next")


def reconcile(intents: DataFrame, fills: DataFrame) -> DataFrame:
    """Status of each order id: matched, lots_differ, no_fill (intent only) or no_intent (fill only)."""
    x = intents.select("order_id", F.col("lots").alias("wanted"))
    y = fills.groupBy("order_id").agg(F.sum("lots").alias("filled"))
    status = F.when(F.col("filled").isNull(), "no_fill").when(F.col("wanted").isNull(), "no_intent").when(F.abs(F.col("wanted") - F.col("filled")) > 1e-9, "lots_differ").otherwise("matched")
    return x.join(y, "order_id", "full_outer").select("order_id", "wanted", "filled", status.alias("status"))


def latest(signals: DataFrame, watch: DataFrame) -> DataFrame:
    """The last position of each watched symbol, with its status."""
    last = signals.groupBy("symbol").agg(F.max_by("position", "time").alias("position"), F.max("time").alias("time"))
    return watch.join(last, "symbol", "left").withColumn("status", F.when(F.col("time").isNull(), "no_data").otherwise("signal"))
