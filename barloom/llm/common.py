"""Shared folder, materialised steps and null handling for the text operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = 2**63 - 1
"""Documents without an id sort after all others and get a null id back."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in one process, one of our own where that is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        path = sc._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, gives the planner true sizes."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    drop_at_exit(df.sparkSession, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.step_path = path
    return back


def let_go(spark: SparkSession, *done: DataFrame) -> None:
    """Removes the files of steps, as materialise() returned them, that nothing reads any more, and has the driver collect its garbage: executors
    keep the shuffle files of finished steps until then, which may be never while a large job runs on a small driver heap."""
    for df in done:
        p = spark._jvm.org.apache.hadoop.fs.Path(df.step_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    spark._jvm.System.gc()


def trimmed(run: Callable) -> Callable:
    """run, with freed memory given back to the system at the end of each task: workers are used again and would keep their peak."""

    def go(it):
        try:
            yield from run(it)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return go


FILTER_SLICE = 1 << 19
FILTER_MOST = 27


def filter_places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Four places of each key in a filter of 2**bits bits; keys are hashes."""
    k = keys.view(np.uint64)
    return [((k * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)]


def key_filter(keys: DataFrame) -> bytes:
    """A Bloom filter of keys' single long column, 16 bits a key but 2**FILTER_MOST in all at most: it may let others pass, never stops a key."""
    name = keys.columns[0]
    bits = min(FILTER_MOST, max(16, (16 * keys.count()).bit_length()))

    def places(it):
        for batch in it:
            at = np.unique(np.concatenate(filter_places(batch.column(0).to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at // FILTER_SLICE).astype(np.int32)), pa.array((at % FILTER_SLICE).astype(np.int32))], names=["slice", "at"])

    def bitmaps(it):
        held: dict[int, np.ndarray] = {}
        for batch in it:
            part, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in np.unique(part).tolist():
                held.setdefault(b, np.zeros(FILTER_SLICE, bool))[at[part == b]] = True
        for b, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(x).tobytes()], pa.binary())], names=["slice", "blob"])

    out = np.zeros(max(1 << bits, FILTER_SLICE) // 8, np.uint8)
    slices = max(1, (1 << bits) // FILTER_SLICE)
    for r in keys.select(name).mapInArrow(places, "slice int, at int").repartition(min(partitions(keys.sparkSession), slices), "slice").mapInArrow(bitmaps, "slice int, blob binary").collect():
        out[r["slice"] * FILTER_SLICE // 8 :][: FILTER_SLICE // 8] = np.frombuffer(r["blob"], np.uint8)
    return out[: (1 << bits) // 8].tobytes()


def passes(keys: np.ndarray, filter_: bytes) -> np.ndarray:
    held = np.frombuffer(filter_, np.uint8)
    ok = np.ones(len(keys), bool)
    for at in filter_places(keys, (8 * len(held)).bit_length() - 1):
        ok &= (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Results are lazy and may be read as long as the session lives: what they rest on goes when the driver's JVM ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(c: Column | str = "doc_id") -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("long"), F.lit(NULL_ID))


def id_back(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != NULL_ID, c)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
