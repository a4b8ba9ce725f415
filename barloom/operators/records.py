"""Records beside the bars: specs and their candidates, exports, jobs, ledgers, profiles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86400
ID = 12


def score_floor(specs: DataFrame, timeframe: Column) -> DataFrame:
    """(id, floor): the best score among the earlier specs of the same timeframe."""
    w = Window.partitionBy(timeframe).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return specs.select("id", F.max("score").over(w).alias("floor"))


def summary(specs: DataFrame) -> DataFrame:
    """One row of totals by verdict and export."""
    return specs.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("DEPLOYABLE", "RESEARCH_ONLY", "BLOCKED")],
        F.count_if("exported").alias("exported"),
    )


def top_per_file(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each file, with their place in it; of equal score and name the smallest id comes first."""
    w = Window.partitionBy("file").orderBy(F.desc("score"), "name", "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def distinct_members(rows: DataFrame) -> DataFrame:
    """One row per token string over all files: that of the first file, then of the best place, then of the smallest name and id."""
    w = Window.partitionBy("tokens").orderBy("file", "place", "name", "id")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def consistency(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Per key how many different values each column has, and whether all agree."""
    out = rows.groupBy(key).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])
    return out.withColumn("agree", F.greatest(*[F.col(f"n_{c}") for c in columns], F.lit(1)) == 1)


def nested(specs: DataFrame, exports: DataFrame, runs: DataFrame) -> DataFrame:
    """Specs with their exports (same first characters of the id) and runs (same file) as sorted arrays; none is an empty array.
    Each side is collected under its own key before it meets the specs."""
    e = exports.groupBy(F.substring("spec_id", 1, ID).alias("__id")).agg(F.sort_array(F.collect_list(F.struct("name", "size"))).alias("exports"))
    r = runs.groupBy("file").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    met = specs.join(e, F.substring("id", 1, ID) == F.col("__id"), "left").join(r, "file", "left").drop("__id")
    none = lambda c: F.coalesce(c, F.array().cast(met.schema[c].dataType))
    return met.withColumn("exports", none("exports")).withColumn("runs", none("runs"))


def profiled(rows: DataFrame, profiles: DataFrame, default: str) -> DataFrame:
    """Rows with the profile of their symbol, or the default's. The planner broadcasts profiles if they are small."""
    p = profiles.select(F.col("symbol").alias("__symbol"), F.struct(*[c for c in profiles.columns if c != "symbol"]).alias("own"))
    d = profiles.where(F.col("symbol") == default).limit(1).agg(F.first(F.struct(*[c for c in profiles.columns if c != "symbol"])).alias("other"))
    met = rows.join(p, F.col("symbol") == F.col("__symbol"), "left").join(F.broadcast(d))  # one row
    return met.withColumn("known", F.col("own").isNotNull()).withColumn("profile", F.coalesce("own", "other")).select(*rows.columns, "known", "profile.*")


def contiguous_prefix(jobs: DataFrame) -> DataFrame:
    """Per symbol the end of the last window before the first failure, null if the first one failed."""
    w = Window.partitionBy("symbol").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return jobs.withColumn("bad", F.max(F.col("failed").cast("int")).over(w)).groupBy("symbol").agg(F.max(F.when(F.col("bad") == 0, F.col("time"))).alias("upto"))


def year_windows(span: DataFrame, overlap: int = 15 * DAY) -> DataFrame:
    """Half-open yearly windows from (symbol, first, last), newest first, each reaching overlap into the newer one."""
    years = F.sequence(F.year(F.timestamp_seconds("first")), F.year(F.timestamp_seconds("last")))
    w = span.select("symbol", "first", "last", F.explode(years).alias("y"))
    begin = lambda y: F.unix_timestamp(F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    end = F.least(begin(F.col("y") + 1) + F.when(F.col("y") < F.year(F.timestamp_seconds("last")), overlap).otherwise(0), F.col("last") + 1)
    return w.select("symbol", F.greatest(begin(F.col("y")), F.col("first")).alias("begin"), end.alias("end"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("y"))).alias("place"))


def fees(fills: DataFrame) -> DataFrame:
    return fills.agg(F.sum("fee").alias("fees"))


def fingerprint(panel: DataFrame, block: int = 1024) -> DataFrame:
    """(symbol, n_bars, digest): SHA-256 over the digests of blocks of bars, prices in whole millionths, so no task holds a series."""
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1
    row = F.concat_ws(",", "time", *[F.round(F.col(c) * 1000000).cast("long") for c in ("open", "high", "low", "close", "volume")])
    each = panel.select("symbol", i.alias("i"), row.alias("row")).withColumn("block", F.floor(F.col("i") / block))
    part = each.groupBy("symbol", "block").agg(F.sha2(F.concat_ws(";", F.transform(F.sort_array(F.collect_list(F.struct("i", "row"))), lambda x: x["row"])), 256).alias("d"), F.count("*").alias("n"))
    whole = part.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("block", "d"))).alias("ds"), F.sum("n").alias("n_bars"))
    return whole.select("symbol", "n_bars", F.sha2(F.concat_ws(":", F.transform("ds", lambda x: x["d"])), 256).alias("digest"))


def seal(spark: SparkSession, path: str, digest: str, note: str = "") -> None:
    """Marks a hold-out as used, once: its file is created only if there is none, so of two that try one fails."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(f"{path.rstrip('/')}/{digest}.json")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ValueError(f"hold-out {digest} was used before")
    out = fs.create(target, False)
    out.write(bytearray(json.dumps({"fingerprint": digest, "note": note}).encode()))
    out.close()


def seals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fingerprint string, note string").json(path)
