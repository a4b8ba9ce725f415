"""Embedding near-dedup by cross-polytope hashing.

A vector is rotated by three rounds of random signs and fast Hadamard transforms; its hash is the axis, with sign, that it
then stands closest to. HASHES such hashes of independent rotations make a code, of which there are TABLES. Multiprobe: a
vector is also put under the codes in which one hash is its second closest axis. Codes are paired with the label and the
dimension, so only vectors of one label meet.

Equal vectors of a label are one class. Codes that a single class has are dropped before any vector is moved. Within a
code, blocked products in double precision verify all pairs; a pair that meets under several codes counts under the first
of them. A code with many classes is cut into chunks, whose pairs of chunks are separate groups, so no task gathers a hot
code, and links are counted where they are found: no pair of a hot group becomes a row.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a null label, link
with nothing, not even with equal ones; vectors of different dimension don't link; a null id counts as larger than all
others and comes back as null; rows that repeat an id are separate vectors; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textscan as ts
from .components import components, roots
from .jaccard import whole_groups

TABLES = 6
HASHES = 2
COSINE = 0.98
CHUNK = 2048
SEED = 20240301
CLASSES_ARROW = pa.schema([("vec_id", pa.int64()), ("node", pa.int64()), ("label", pa.string()), ("vec", pa.binary())])


def classed(it):
    """(vec_id, label, embedding) to (vec_id, class, label, doubles); class and doubles are null for vectors that link with nothing."""
    for batch in it:
        vecs = batch.column("embedding")
        values, offs = vecs.values, vecs.offsets.to_numpy()
        x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        labels = batch.column("label").to_pylist()
        valid = vecs.is_valid().to_numpy(zero_copy_only=False)
        nodes, kept = [], []
        for i, label in enumerate(labels):
            v = x[offs[i] : offs[i + 1]] + 0.0  # -0 becomes 0
            if label is None or not valid[i] or not len(v) or not np.isfinite(v).all() or not v.any():
                nodes.append(None)
                kept.append(None)
            else:
                raw = v.tobytes()
                nodes.append(int.from_bytes(hashlib.blake2b(raw + label.encode(), digest_size=8).digest(), "little", signed=True))
                kept.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.int64()), pa.array(labels, pa.string()), pa.array(kept, pa.binary())], schema=CLASSES_ARROW)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int, hashes: int, seed: int = SEED) -> np.ndarray:
    """[rows, tables, 1 + hashes] codes of unit vectors: the closest axes, then one hash after the other replaced by its second."""
    n, dim = x.shape
    d = max(2, 1 << (dim - 1).bit_length())
    rng = np.random.default_rng([seed, d])
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    out = np.zeros((n, tables, 1 + hashes), np.int64)
    for t in range(tables):
        best = []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            two = np.argpartition(size, d - 2, axis=1)[:, -2:]
            at = np.take_along_axis(size, two, 1)
            two = np.where(at[:, :1] > at[:, 1:], two, two[:, ::-1])
            best.append(2 * two + (np.take_along_axis(y, two, 1) < 0))
        for probe in range(1 + hashes):
            code = np.zeros(n, np.int64)
            for k in range(hashes):
                code = code * (2 * d) + best[k][:, int(probe == k + 1)]
            out[:, t, probe] = code * tables + t
    return out


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def probed(tables: int, hashes: int):
    """(node, label, vec) to (node, keys): the hashed (label, dimension, code) of each table and probe, in a fixed order."""

    def run(it):
        for batch in it:
            raw = batch.column("vec").to_pylist()
            labels = batch.column("label").to_pylist()
            keys = np.zeros((len(raw), tables * (1 + hashes)), np.uint64)
            dims = np.array([len(r) // 8 for r in raw], np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), 4096):
                    some = at[lo : lo + 4096]
                    keys[some] = codes(unit([raw[i] for i in some]), tables, hashes).reshape(len(some), -1).astype(np.uint64)
            salt = np.array([int.from_bytes(hashlib.blake2b(f"{dim}/{x}".encode(), digest_size=8).digest(), "little") for dim, x in zip(dims.tolist(), labels, strict=True)], np.uint64)
            keys = ts.mix(keys ^ salt[:, None]).view(np.int64)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), rows], names=["node", "keys"])

    return run


LINKS_ARROW = pa.schema([("node", pa.int64()), ("low", pa.int64()), ("links", pa.int64())])


def verified(cosine: float):
    """Sorted rows (part, key, side, node, n, vec, keys) to (node, smallest node it's joined with here, links found here).

    side 0 and 1 are the two chunks of a pair, 2 a chunk with itself."""

    def one(key, side, nodes, n, vec, keys):
        x = unit(vec)
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        if side[0] != 2:
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return None
        active = np.flatnonzero(linked.any(axis=1))
        linked, nodes, n = linked[np.ix_(active, active)], nodes[active], n[active]
        lists = [keys[i] for i in active]
        before = [(i, k) for i, row in enumerate(lists) for k in row[row < key].tolist()]
        if before:  # met under a smaller key: counted there
            who = np.array([b[0] for b in before])
            what, at, times = np.unique([b[1] for b in before], return_inverse=True, return_counts=True)
            shared = times[at] > 1
            met = np.zeros((len(active), len(what)), np.float32)
            met[who[shared], at[shared]] = 1
            fresh = linked & (met @ met.T == 0)
        else:
            fresh = linked
        u, v = np.nonzero(linked)
        return nodes, nodes[roots(u, v, len(nodes))], fresh @ n

    def run(it):
        for table in whole_groups(it, "part"):
            cols = {c: table.column(c).to_numpy() for c in ("part", "key", "side", "node", "n")}
            vec, keys = table.column("vec").to_pylist(), table.column("keys").combine_chunks()
            keys = [np.asarray(k, np.int64) for k in keys.to_pylist()]
            cut = np.flatnonzero(ts.new_group(cols["part"]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(vec)], strict=True):
                if b - a > 1 and (got := one(cols["key"][a], cols["side"][a:b], cols["node"][a:b], cols["n"][a:b], vec[a:b], keys[a:b])):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], schema=LINKS_ARROW)

    return run


def near(table: DataFrame, tables: int = TABLES, hashes: int = HASHES, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    parts = common.partitions(table.sparkSession)
    rows = table.select(common.id_key("vec_id").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding"))
    each = common.materialise(rows.mapInArrow(classed, "vec_id long, node long, label string, vec binary"), "vectors")
    able = each.where("node is not null")
    classes = common.materialise(able.groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec")), "vector-classes")
    keyed = common.materialise(classes.select("node", "label", "vec").mapInArrow(probed(tables, hashes), "node long, keys array<long>"), "vector-keys")
    entries = keyed.select("node", F.explode("keys").alias("key")).distinct()
    met = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    cut = entries.join(met, "key").withColumn("g", F.ceil(F.col("m") / F.lit(chunk)).cast("long")).withColumn("c", F.pmod(F.xxhash64("node"), F.col("g")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda o: F.struct(F.least(o, F.col("c")).alias("i"), F.greatest(o, F.col("c")).alias("j"), F.when(F.col("c") == o, 2).when(F.col("c") > o, 1).otherwise(0).alias("side")))
    blocks = cut.select("node", "key", F.explode(pair).alias("p")).select("node", "key", F.xxhash64("key", "p.i", "p.j").alias("part"), F.col("p.side").alias("side"))
    full = blocks.join(classes.select("node", "n", "vec"), "node").join(keyed, "node").select("part", "key", "side", "node", "n", "vec", "keys")
    found = full.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(verified(cosine), "node long, low long, links long")
    found = common.materialise(found, "vector-links")
    joined = components(found.select(F.col("node").alias("u"), F.col("low").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    state = classes.select("node", "least", "n").join(links, "node", "left").join(joined, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = state.groupBy("c").agg(F.min("least").alias("component_id"))
    state = state.join(least, "c").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = each.select("vec_id", "node").join(state, "node", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select(
        common.id_back("vec_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), common.id_back("component_id").alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept")
    )


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
c AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT e.b, c.y FROM c JOIN e ON e.a = c.x),
m AS (SELECT x, min(y) AS component_id FROM c GROUP BY x),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.component_id, vec_id = m.component_id AS kept
FROM embeddings JOIN m ON m.x = vec_id LEFT JOIN k ON k.a = vec_id
"""
