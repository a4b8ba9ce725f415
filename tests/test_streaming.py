"""Streamed bars and signals equal those of a batch."""

from pyspark.sql import functions as F

from barloom.streaming import bars as sb


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 2}", i * 97, 100.0 + (i * 7919 % 53), 1.0, i) for i in range(600)]
    ticks = spark.createDataFrame(rows, "symbol string, s long, price double, size double, seq long").select("symbol", F.timestamp_seconds("s").alias("ts"), "price", "size", "seq")
    src = str(tmp_path / "in")
    for k in range(3):
        ticks.where(f"seq >= {k * 200} AND seq < {k * 200 + 200}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = sb.closed_bars(stream, 600).writeStream.format("memory").queryName("streamed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r["symbol"], r["time"]): tuple(r)[2:] for r in spark.table("streamed").collect()}
    want = {(r["symbol"], r["time"]): tuple(r)[2:] for r in sb.closed_bars(ticks, 600).collect()}
    end = 599 * 97
    assert got == {k: v for k, v in want.items() if k[1] + 600 <= end}
    closed = str(tmp_path / "bars")
    spark.table("streamed").coalesce(1).write.parquet(closed)
    b = spark.readStream.schema(spark.table("streamed").schema).parquet(closed)
    q = sb.momentum_signals(b, 5).writeStream.format("memory").queryName("signals").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination(120)
    for s in ("s0", "s1"):
        closes = [got[k][3] for k in sorted(k for k in got if k[0] == s)]
        batch = [sb.position(closes[max(0, i - 4) : i + 1], 5, 0.05) for i in range(len(closes))]
        assert [r["position"] for r in spark.table("signals").where(f"symbol = '{s}'").orderBy("time").collect()] == batch
