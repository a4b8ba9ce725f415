"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Terms are hashed byte trigrams and hashed word shapes (case, digits, symbols, length, same word again), so nothing is kept
per vocabulary. A document's vector holds the square roots of its terms' shares, weighted by inverse document frequency
and projected on the first singular vectors of a labelled sample. The sample's latent vectors are broadcast with their
labels; for every document exact cosine products with all of them are computed in blocks, and the labels of the K nearest
vote with weights SHARPNESS-fold exponential in the similarity. The score is the share of votes for label 1, as if both
labels were equally frequent in the sample times PRIOR.

Document frequencies are counted over all documents, with or without labels. The fit is bounded: FIT_ROWS labelled rows,
taken by a hash of the id, half of each label as far as there are; the singular vectors are the fit's own. Labels are only read for rows outside the held-out fold.

Defined cases: null, empty and blank texts have the vector of no terms and score NO_TERMS; a null id is in the fold of
the empty string; rows that repeat an id are scored each by its own
text, and one of them is fitted on; ids with several or no labels (null counts as none) are
not fitted on unless all labels agree; without labelled rows of both kinds every score is the share of label 1 (1 without any);
an empty table gives an empty result; lang, source and other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import textscan as ts

GRAM_TERMS = 1024
SHAPE_TERMS = 1024
GRAM_WEIGHT = 0.35
LATENT = 64
FIT_ROWS = 4096
NEIGHBOURS = 15
SHARPNESS = 20.0
PRIOR = 1.0
THRESHOLD = 0.7
NO_TERMS = 0.0
FOLDS, HELD_OUT = 4, 2
BLOCK = 256

_CLASS = np.full(256, 4, np.uint8)  # symbols
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3


def terms(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """[documents, GRAM_TERMS + SHAPE_TERMS] counts of hashed terms."""
    n = len(offs) - 1
    out = np.zeros((n, GRAM_TERMS + SHAPE_TERMS), np.float32)
    if not len(data):
        return out
    row = np.repeat(np.arange(n), np.diff(offs))
    low = ts.LOWER[data].astype(np.uint32)
    g = (low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - (GRAM_TERMS.bit_length() - 1))
    inside = row[:-2] == row[2:]
    out[:, :GRAM_TERMS] = np.bincount(row[:-2][inside] * GRAM_TERMS + g[inside], minlength=n * GRAM_TERMS).reshape(n, -1)
    s, e, upto = ts.words(data, offs)
    if not len(s):
        return out
    kinds = _CLASS[data]
    sums = np.zeros((5, len(data) + 1), np.int32)
    for k in range(5):
        np.cumsum(kinds == k, out=sums[k, 1:])
    up, lower, digit, high, symbol = (sums[k][e] - sums[k][s] for k in range(5))
    length = e - s
    case = np.where(up == 0, 0, np.where(up + symbol + digit == length, 3, np.where((up == 1) & (kinds[s] == 0), 1, 2)))
    last = np.where(kinds[e - 1] == 4, data[e - 1], 0).astype(np.uint64)
    wrow = ts.owners(upto)
    h = ts.word_hashes(data, s, e)
    again = np.zeros(len(s), bool)
    again[1:] = (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])
    shape = np.minimum(length, 24) // 3
    for part, width in ((case, 4), (np.minimum(digit, 3), 4), (np.minimum(symbol, 4), 5), (again, 2), (high > 0, 2)):
        shape = shape * width + part
    shape = ts.mix(shape.astype(np.uint64) * np.uint64(256) + last) >> np.uint64(64 - (SHAPE_TERMS.bit_length() - 1))
    out[:, GRAM_TERMS:] = np.bincount(wrow * SHAPE_TERMS + shape.astype(np.int64), minlength=n * SHAPE_TERMS).reshape(n, -1)
    return out


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors; a document without terms is zero."""
    x = counts.copy()
    for cols, weight in ((slice(0, GRAM_TERMS), GRAM_WEIGHT), (slice(GRAM_TERMS, None), 1.0)):
        x[:, cols] = np.sqrt(x[:, cols] / np.maximum(x[:, cols].sum(axis=1, keepdims=True), 1)) * weight
    x *= idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(counts: np.ndarray, labels: np.ndarray, idf: np.ndarray, latent: int = LATENT) -> dict:
    """idf, projection, latent unit vectors and vote weights of a labelled sample."""
    x = weighed(counts, idf)
    w, v = np.linalg.eigh((x.T @ x).astype(np.float64))
    projection = v[:, np.argsort(-w)[:latent]].astype(np.float32)
    z = x @ projection
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    ones = labels == 1
    votes = np.where(ones, PRIOR * len(labels) / max(1, ones.sum()), len(labels) / max(1, (~ones).sum())).astype(np.float32)
    return {"idf": idf, "projection": projection, "z": z.astype(np.float32), "ones": ones, "votes": votes}


def vote(counts: np.ndarray, model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Score of each row of counts: exact cosine products with the whole sample."""
    z = weighed(counts, model["idf"]) @ model["projection"]
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    near = z @ model["z"].T
    k = min(neighbours, near.shape[1])
    at = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
    sim = np.take_along_axis(near, at, 1)
    w = np.exp(SHARPNESS * (sim - sim.max(axis=1, keepdims=True))) * model["votes"][at]
    score = (w * model["ones"][at]).sum(axis=1) / w.sum(axis=1)
    return np.where(counts.any(axis=1), score, NO_TERMS)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def _frequencies(it):
    """(term, documents that have it); term -1 counts all documents."""
    n = np.zeros(GRAM_TERMS + SHAPE_TERMS + 1, np.int64)
    for batch in it:
        for lo, hi, data, offs in ts.chunks(batch.column(0), 1 << 19):
            n[0] += hi - lo
            n[1:] += (terms(data, offs) > 0).sum(axis=0)
    if n[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)) - 1), pa.array(n)], names=["term", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Weight of each hashed term by its share of all documents; the driver gets a row a term whatever the input."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = np.zeros(GRAM_TERMS + SHAPE_TERMS + 1, np.int64)
    for r in counted.collect():
        n[r["term"] + 1] = r["n"]
    return np.log((1 + n[0]) / (1 + n[1:])).astype(np.float32) + 1


def _counted(it):
    for batch in it:
        for lo, hi, data, offs in ts.chunks(batch.column("text"), 1 << 19):
            blobs = [zlib.compress(c.astype(np.uint32).tobytes(), 1) for c in terms(data, offs)]
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), pa.array(blobs, pa.binary())], names=["label", "counts"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict | float:
    """A model from at most fit_rows labelled documents outside the held-out fold; a constant score if one label is missing."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .join(docs.select(F.col("doc_id").cast("long").alias("id")).distinct(), "id")
        .select("id", "label", F.md5(F.concat(F.lit("fit:"), F.col("id").cast("string"))).alias("u"))
    )
    half = [known.where(F.col("label") == v).orderBy("u", "id").limit(fit_rows // 2) for v in (0, 1)]
    chosen = F.broadcast(half[0].unionByName(half[1]).select("id", "label"))  # at most fit_rows rows
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(chosen, "id")
    # an id that repeats is fitted on once: the text of the smallest hash
    texts = texts.groupBy("id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))
    # one task fits the bounded sample; the driver only gets the model
    row = texts.mapInArrow(_counted, "label int, counts binary").repartition(1).mapInArrow(_fitted(inverse_frequencies(docs)), "model binary").first()
    return pickle.loads(row["model"]) if row else 1.0


def _fitted(idf: np.ndarray):
    def run(it):
        got = [(y, bytes(c)) for batch in it for y, c in zip(batch.column("label").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
        if not got:
            return
        got.sort()  # the same order in every run
        y = np.array([g[0] for g in got], np.int64)
        if len(set(y.tolist())) < 2:
            model = float(y.mean())
        else:
            counts = np.empty((len(got), GRAM_TERMS + SHAPE_TERMS), np.float32)
            for i, (_, raw) in enumerate(got):
                counts[i] = np.frombuffer(zlib.decompress(raw), np.uint32)
            model = fit(counts, y, idf)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def scores(texts: pa.Array, model: dict | float) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    out = [np.zeros(0)]
    for _, _, data, offs in ts.chunks(texts, 1 << 19):
        counts = terms(data, offs)
        out += [vote(counts[i : i + BLOCK], model) for i in range(0, len(counts), BLOCK)]
    return np.concatenate(out)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_rows))

    def run(it):
        for batch in it:
            s = scores(batch.column("text"), model.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, whole, that score at least threshold."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_rows))
    at = docs.columns.index("text")

    def run(it):
        for batch in it:
            yield batch.filter(pa.array(scores(batch.column(at).cast(pa.string()), model.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
