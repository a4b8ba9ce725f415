"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014).

Each round materialises the edges in the shared folder; partitions first contract their own edges to a spanning forest, so
a round moves at most one edge per node and partition. Joins are on node ids with the star's centre on the unique side, so
adaptive execution can split a centre that holds many of the edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n nodes' components, given edges between nodes 0..n-1."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        keep = low != high
        if not keep.any():
            break
        u, v, low, high = u[keep], v[keep], low[keep], high[keep]
        np.minimum.at(root, high, low)
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def contract(it, most: int = 1 << 20):
    """Edges to (node, smallest node of its component among the edges held)."""
    held, size = [], 0

    def forest():
        t = pa.Table.from_batches(held)
        u, v = (t.column(c).to_numpy() for c in ("u", "v"))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        low = nodes[roots(at[: len(u)], at[len(u) :], len(nodes))]
        own = low != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(low[own])], schema=EDGES)

    for batch in it:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            yield forest()
            held, size = [], 0
    if held:
        yield forest()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge, the component named by its smallest node. edges: two long columns u, v."""
    held = edges.where("u <> v").select("u", "v").mapInArrow(common.trimmed(contract), "u long, v long")
    now = common.materialise(held.distinct(), "edges")
    before = _state(now)
    while before[0]:
        # large star: each larger neighbour of u meets the smallest neighbour of u
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u, meet the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v")
        last, now = now, common.materialise(small.distinct(), "edges")
        after = _state(now)
        common.let_go(edges.sparkSession, last)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
