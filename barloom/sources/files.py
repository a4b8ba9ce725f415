"""Bar files: readers by suffix, names to symbol and timeframe, atomic writers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bars import newest, normal_time

# Seconds of each timeframe and other spellings.
SECONDS = {"M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400, "W1": 604800, "MN1": 2592000}
ALIASES = {
    "1M": "M1", "1MIN": "M1", "5M": "M5", "5MIN": "M5", "15M": "M15", "15MIN": "M15", "30M": "M30", "30MIN": "M30", "1H": "H1", "60M": "H1", "60MIN": "H1", "4H": "H4", "240M": "H4", "240MIN": "H4",
    "1D": "D1", "1DAY": "D1", "DAILY": "D1", "1W": "W1", "WEEKLY": "W1", "1MO": "MN1", "MONTHLY": "MN1",
}
_NAMES = "|".join(sorted({*SECONDS, *ALIASES}, key=lambda x: (-len(x), x)))
_LABEL = re.compile(rf"(?P<symbol>.+?)_(?P<frame>-*(?:{_NAMES})-*)(?:_.*)?", re.IGNORECASE)


def timeframe(token: str) -> str:
    """The usual name of a timeframe; an unknown one in upper case."""
    t = token.strip().upper()
    plain = t.replace("-", "").replace("_", "")
    return plain if plain in SECONDS else ALIASES.get(plain, t)


def label(path: str) -> tuple[str, str]:
    """(symbol, timeframe) of a file name: the first known timeframe between underscores ends the symbol; without one the last
    part is taken for it; a name without underscores is all symbol."""
    stem = re.sub(r"\.[A-Za-z]+$", "", path.rsplit("/", 1)[-1])
    if found := _LABEL.fullmatch(stem):
        return found["symbol"].strip() or stem, timeframe(found["frame"])
    symbol, _, last = stem.rpartition("_")
    return (symbol.strip() or stem, timeframe(last)) if symbol or "_" in stem else (stem, "")


def catalogue(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> list[dict]:
    """A row per bar file of a folder, by name: path, symbol, timeframe, bytes and time of change, from the file system alone."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    rows = [{"path": f.getPath().toString(), "bytes": f.getLen(), "changed": f.getModificationTime() // 1000} for f in found]
    return [r | dict(zip(("symbol", "timeframe"), label(r["path"]), strict=True)) for r in sorted(rows, key=lambda r: r["path"])]


def lookup(spark: SparkSession, folder: str, symbol: str, frame: str, pattern: str = "*.parquet") -> list[str]:
    """Paths of the files whose name says symbol and timeframe."""
    return [r["path"] for r in catalogue(spark, folder, pattern) if (r["symbol"].upper(), r["timeframe"]) == (symbol.upper(), timeframe(frame))]


def load(spark: SparkSession, path: str, symbol: str | None = None, since: int | None = None, unit: str = "auto") -> DataFrame:
    """A panel from a parquet or csv file of bars: volume is tick_volume or volume, time in seconds, of equal times the row that
    comes last. Only the named columns are read; since reaches the scan."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("parquet", "pq"):
        df = spark.read.parquet(path)
    elif suffix in ("csv", "txt"):
        df = spark.read.csv(path, header=True, inferSchema=True)
    else:
        raise ValueError(f"{path}: not a parquet or csv file")
    gone = {"time", "open", "high", "low", "close"} - set(df.columns)
    volume = next((c for c in ("tick_volume", "volume") if c in df.columns), None)
    if gone or volume is None:
        raise ValueError(f"{path} lacks {', '.join(sorted(gone)) or 'a volume column'}")
    largest = df.agg(F.max("time")).first()[0] if unit == "auto" else None
    out = df.select(
        F.lit(symbol or label(path)[0]).alias("symbol"),
        normal_time(F.col("time"), F.lit(largest if largest is not None else 0), unit).alias("time"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.col(volume).cast("double").alias("volume"),
        F.monotonically_increasing_id().alias("__at"),
    )
    out = newest(out, "__at").drop("__at")
    return out if since is None else out.where(F.col("time") > since)


def save(df: DataFrame, path: str) -> None:
    """Writes beside the target, moves the old table aside and the new one in; if that fails the old one comes back. The target
    is away between two renames, never half written."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    stage, aside = f"{path.rstrip('/')}.stage-{mark}", f"{path.rstrip('/')}.old-{mark}"
    df.write.parquet(stage)
    target, staged, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, stage, aside))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(staged, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{stage} can't be moved to {path}")
    if had:
        fs.delete(old, True)


def jdbc_bars(spark: SparkSession, url: str, symbol: str, frame: str, since: int | None = None, table: str = "ohlcv", **options: str) -> DataFrame:
    """Bars of a database table (timestamp, open, .., volume, timeframe); both filters reach the database. Needs its driver's jar."""
    rows = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load().where(F.col("timeframe") == timeframe(frame))
    rows = rows if since is None else rows.where(F.col("timestamp") > since)
    return rows.select(F.lit(symbol).alias("symbol"), F.col("timestamp").cast("long").alias("time"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])


def continuity(old: DataFrame, new: DataFrame, seconds: int) -> DataFrame:
    """One row per symbol: median step, whether it fits the period, whether new goes on beyond old, and the verdict on the gap."""
    step = new.withColumn("step", F.col("time") - F.lag("time").over(Window.partitionBy("symbol").orderBy("time")))
    a = step.groupBy("symbol").agg(F.median("step").alias("median_step"), F.min("time").alias("first"), F.max("time").alias("last"))
    met = a.join(old.groupBy("symbol").agg(F.max("time").alias("old_last")), "symbol", "left")
    gap = F.col("first") - F.col("old_last")
    day = 86400
    return met.select(
        "symbol",
        "median_step",
        (F.abs(F.col("median_step") - seconds) <= 0.25 * seconds).alias("fits"),
        (F.coalesce(F.col("last") > F.col("old_last"), F.lit(True))).alias("extends"),
        F.when(gap > max(30 * day, 3 * seconds), "reject").when(gap > max(7 * day, 5 * seconds), "warn").otherwise("ok").alias("gap"),
    )
