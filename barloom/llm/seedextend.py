"""Substring dedup by seed and extend.

Seeds: every window of WINDOW words picks the first of its smallest GRAM-word hashes (winnowing), so equal windows pick
equal seeds at equal places. One row per seed stands for the run of windows that picked it. Documents meet on seeds.
Extension: two seeds that stand in the same run (the same words to the left and right as far as their windows reach, told
by a hash) are repeats over their whole reach. Where seeds are equal but their surroundings differ, the repeat ends inside
the reach; the windows of these runs are then compared one by one. Overlapping windows join to the maximal repeats.

Nothing gathers a hot group: a map task keeps one row per seed and surroundings, having marked the later ones itself; a seed
that has several surroundings in one task is sent to window comparison at once, leaving a single marker under the seed; and
windows are kept once per task as well. So a reducer gets at most one row per key and map block, whatever the group's size,
and works through one bucket of keys at a time.

Order is (doc_id, word): all but the first occurrence of a window are removed, as judged on the input.

Defined cases: null or blank text has no words, n_removed 0 and the hash of the empty string; a text shorter than WINDOW
loses nothing; a null id counts as larger than all others; rows with equal id and text are one document (both get the same
result, neither makes the other a repeat); rows with equal id and different texts are told apart by a hash of the text, and
windows at the same place of both count as one occurrence; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textscan as ts

WINDOW = 20
GRAM = 8
BLOCK = 1 << 20
"""Seeds that a map task holds before it hands them on."""
SEED_TYPES = ["u8", "u8", "i8", "i4", "i4", "u1"]  # seed, surroundings, doc, tag, first window, windows (0: marker)
SPOT_TYPES = ["i8", "i4", "i8"]  # doc, tag, spot
WINDOW_TYPES = ["u8", "i8", "i4", "i4"]  # window, doc, tag, place
ROWS = "kind byte, bucket int, n int, blob binary"
SPOTS = "kind byte, doc long, tag int, spot long"
ROWS_ARROW = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
SPOTS_ARROW = pa.schema([("kind", pa.int8()), ("doc", pa.int64()), ("tag", pa.int32()), ("spot", pa.int64())])
SEEDS, REPEAT, COMPARE, WINDOWS = 0, 1, 2, 3
"""Kinds of rows: seeds; windows known to be repeats; windows to be compared; hashed windows. A spot is first window << 8 | windows."""


def spots(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) << 8 | n.astype(np.int64)


def seeds_of(data: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, seed, surroundings, first window, windows) of each run of windows with one seed."""
    s, e, upto = ts.words(data, offs)
    if len(s) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    h = ts.word_hashes(data, s, e)
    grams = ts.gram_hashes(h, gram, ts.FIRST)
    seed = ts.sliding_argmin(grams, window - gram + 1)
    row = ts.owners(upto)
    at = np.flatnonzero(np.arange(window, len(s) + 1) <= upto[1:][row[: len(seed)]])
    seed = seed[at]
    cut = np.flatnonzero(ts.new_group(seed))
    n = np.diff(np.append(cut, len(seed)))
    first, seed = at[cut], seed[cut]
    reach = ts.span_hashes(ts.prefix_sums(h, ts.SECOND), first, first + n + window - 1, ts.SECOND)
    reach = ts.mix(reach + (seed - first).astype(np.uint64) * np.uint64(0x9E6C63D0676A9A99))
    row = row[first]
    return row, grams[seed], reach, first - upto[row], n


def block_rows(parts: list, buckets: int) -> Iterator[tuple]:
    """What a map task hands on for a block of seeds."""
    seed, reach, doc, tag, first, n = ts.concat(parts, SEED_TYPES)
    order = np.argsort(seed)
    fresh = ts.new_group(seed[order])
    alone = fresh & np.append(fresh[1:], True)
    keep, rest = order[alone], order[~alone]
    rest = rest[np.lexsort((first[rest], tag[rest], doc[rest], reach[rest], seed[rest]))]
    found = []
    if len(rest):
        of_seed = ts.new_group(seed[rest])
        of_reach = ts.new_group(seed[rest], reach[rest])
        head = np.maximum.accumulate(np.where(of_reach, np.arange(len(rest)), 0))
        later = (doc[rest] != doc[rest][head]) | (first[rest] != first[rest][head])
        found.append((REPEAT, rest[later]))
        kinds = np.add.reduceat(of_reach.astype(np.int64), np.flatnonzero(of_seed))
        many = np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(of_seed), len(rest))))
        keep = np.concatenate([keep, rest[of_reach & ~many]])
        found.append((COMPARE, rest[many & ~later]))
        marker = rest[of_seed & many]
        n = n.copy()
        n_out = np.concatenate([n[keep], np.zeros(len(marker), n.dtype)])
        keep = np.concatenate([keep, marker])
    else:
        n_out = n[keep]
    back = np.argsort(keep)  # in the order of the documents, which packs better
    keep, n_out = keep[back], n_out[back]
    for b, size, blob in ts.bucketed(ts.bucket_of(seed[keep], buckets), [seed[keep], reach[keep], doc[keep], tag[keep], first[keep], n_out]):
        yield SEEDS, b, size, blob
    for kind, at in found:
        yield from spot_rows(kind, doc[at], tag[at], spots(first[at], n[at]), buckets)


def spot_rows(kind: int, doc: np.ndarray, tag: np.ndarray, spot: np.ndarray, buckets: int, most: int = 1 << 16) -> Iterator[tuple]:
    for lo in range(0, len(doc), most):
        cut = slice(lo, lo + most)
        yield kind, int(doc[lo] * 31 + lo) % buckets, len(doc[cut]), ts.pack([doc[cut], tag[cut], spot[cut]])


def to_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 32 + len(row[-1])
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def scan(window: int, gram: int, buckets: int):
    """Batches of (doc, text) to rows of kinds SEEDS, REPEAT and COMPARE."""

    def rows(it):
        parts, held = [], 0
        for batch in it:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in ts.chunks(batch.column(1)):
                row, seed, reach, first, n = seeds_of(data, offs, window, gram)
                tags = ts.doc_tags(data, offs)
                parts.append([seed, reach, ids[lo:hi][row], tags[row], first.astype(np.int32), n.astype(np.uint8)])
                held += len(seed)
                if held >= BLOCK:
                    yield from block_rows(parts, buckets)
                    parts, held = [], 0
        if held:
            yield from block_rows(parts, buckets)

    return lambda it: to_batches(rows(it), ROWS_ARROW)


def spot_batch(kind: np.ndarray | int, doc, tag, spot) -> pa.RecordBatch:
    kind = np.full(len(doc), kind, np.int8) if isinstance(kind, int) else kind
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(doc), pa.array(tag), pa.array(spot)], schema=SPOTS_ARROW)


def taken(it, kind: int, types: list) -> tuple[list, list]:
    """The blobs of one kind as columns, and the batches of spots among the other rows."""
    mine, spots_ = [], []
    for batch in it:
        for k, n, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if k == kind:
                mine.append(ts.unpack(blob.as_buffer(), n, types))
            else:
                spots_.append(spot_batch(k, *ts.unpack(blob.as_buffer(), n, SPOT_TYPES)))
    return mine, spots_


def meet(it) -> Iterator[pa.RecordBatch]:
    """Seeds to spots: repeats of an earlier run, and runs whose windows are to be compared."""
    for rows in ts.by_bucket(it):
        yield from _meet(rows)


def _meet(rows: list) -> Iterator[pa.RecordBatch]:
    parts, others = taken(rows, SEEDS, SEED_TYPES)
    yield from others
    seed, reach, doc, tag, first, n = ts.concat(parts, SEED_TYPES)
    del parts, others
    order = np.argsort(seed)
    fresh = ts.new_group(seed[order])
    rest = order[~(fresh & np.append(fresh[1:], True))] if len(order) else order
    if not len(rest):
        return
    rest = rest[np.lexsort((first[rest], tag[rest], doc[rest], reach[rest], n[rest] == 0, seed[rest]))]
    marker = n[rest] == 0
    of_seed, of_reach = ts.new_group(seed[rest]), ts.new_group(seed[rest], marker, reach[rest])
    head = np.maximum.accumulate(np.where(of_reach, np.arange(len(rest)), 0))
    later = ((doc[rest] != doc[rest][head]) | (first[rest] != first[rest][head])) & ~marker
    cuts = np.flatnonzero(of_seed)
    many = np.repeat(np.add.reduceat(of_reach.astype(np.int64), cuts) > 1, np.diff(np.append(cuts, len(rest))))
    kind = np.where(later, REPEAT, COMPARE).astype(np.int8)
    at = rest[later | (many & ~marker)]
    yield spot_batch(kind[later | (many & ~marker)], doc[at], tag[at], spots(first[at], n[at]))


def spot_list(scalar) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False) if scalar.is_valid else np.zeros(0, np.int64)


def finished(text: bytes, spot: np.ndarray, window: int) -> tuple[int, int, str]:
    """(words, words removed, SHA-256 of what is kept)."""
    parts = text.split()  # bytes split at the same six separators
    if not len(spot):
        return len(parts), 0, hashlib.sha256(b" ".join(parts)).hexdigest()
    first, n = spot >> 8, spot & 255
    edge = np.zeros(len(parts) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + n + window - 1, len(parts)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return len(parts), int(gone.sum()), hashlib.sha256(b" ".join(compress(parts, (~gone).tolist()))).hexdigest()


RESULT = "doc long, n_words long, n_removed long, kept_sha256 string"
CARRIED = RESULT + ", tag int, text string, repeats array<long>, compare array<long>"
CARRIED_ARROW = pa.schema(
    [("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("tag", pa.int32()), ("text", pa.string()), ("repeats", pa.list_(pa.int64())), ("compare", pa.list_(pa.int64()))]
)


def finish(window: int):
    """Batches of (doc, text, tag, repeats, compare) to results; documents with windows to compare are carried on."""

    def rows(it):
        for batch in it:
            texts = batch.column("text")
            tags = batch.column("tag").to_pylist()
            for i, doc in enumerate(batch.column("doc").to_pylist()):
                repeats, compare = batch.column("repeats")[i], batch.column("compare")[i]
                if compare.is_valid and len(compare):
                    yield doc, None, None, None, tags[i], texts[i].as_py(), repeats.as_py(), compare.as_py()
                else:
                    text = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                    yield (doc, *finished(text, spot_list(repeats), window), None, None, None, None)

    def run(it):
        held, size = [], 0
        for row in rows(it):
            held.append(row)
            size += 100 + len(row[5] or "")
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), CARRIED_ARROW, strict=True)], schema=CARRIED_ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), CARRIED_ARROW, strict=True)], schema=CARRIED_ARROW)

    return run


def windows_of(window: int, buckets: int):
    """Batches of carried documents to rows of kind WINDOWS (one per window and block) and REPEAT."""

    def block(parts):
        h, doc, tag, place = ts.concat(parts, WINDOW_TYPES)
        order = np.lexsort((place, tag, doc, h))
        fresh = ts.new_group(h[order])
        head = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        later = (doc[order] != doc[head]) | (place[order] != place[head])
        at = order[later]
        yield from spot_rows(REPEAT, doc[at], tag[at], spots(place[at], np.ones(len(at), np.int64)), buckets)
        keep = np.sort(order[fresh])
        for b, n, blob in ts.bucketed(ts.bucket_of(h[keep], buckets), [h[keep], doc[keep], tag[keep], place[keep]]):
            yield WINDOWS, b, n, blob

    def rows(it):
        parts, held = [], 0
        for batch in it:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
            lists = batch.column("compare")
            for lo, hi, data, offs in ts.chunks(batch.column("text")):
                s, e, upto = ts.words(data, offs)
                grams = ts.gram_hashes(ts.word_hashes(data, s, e), window, ts.SECOND)
                asked = [np.unique(spot_list(lists[i])) for i in range(lo, hi)]
                row = np.repeat(np.arange(hi - lo), [len(a) for a in asked])
                spot = np.concatenate(asked)
                first, n = spot >> 8, spot & 255
                place = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                row = np.repeat(row, n)
                parts.append([grams[upto[row] + place], ids[lo:hi][row], tags[lo:hi][row], place.astype(np.int32)])
                held += len(row)
                if held >= 2 * BLOCK:
                    yield from block(parts)
                    parts, held = [], 0
        if held:
            yield from block(parts)

    return lambda it: to_batches(rows(it), ROWS_ARROW)


def meet_windows(it) -> Iterator[pa.RecordBatch]:
    for rows in ts.by_bucket(it):
        yield from _meet_windows(rows)


def _meet_windows(rows: list) -> Iterator[pa.RecordBatch]:
    parts, others = taken(rows, WINDOWS, WINDOW_TYPES)
    yield from others
    h, doc, tag, place = ts.concat(parts, WINDOW_TYPES)
    if not len(h):
        return
    order = np.lexsort((place, tag, doc, h))
    fresh = ts.new_group(h[order])
    head = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    at = order[(doc[order] != doc[head]) | (place[order] != place[head])]
    yield spot_batch(REPEAT, doc[at], tag[at], spots(place[at], np.ones(len(at), np.int64)))


def text_tags(it):
    """(doc, text) with the tag of the text."""
    for batch in it:
        tags = [ts.doc_tags(data, offs) for _, _, data, offs in ts.chunks(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(np.concatenate(tags) if tags else np.zeros(0, np.int32), pa.int32())], names=["doc", "text", "tag"])


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per input row."""
    spark = docs.sparkSession
    parts = common.partitions(spark)
    buckets = 16 * parts
    rows = docs.select(common.id_key().alias("doc"), F.col("text").cast("string").alias("text"))
    seeds = rows.mapInArrow(scan(window, gram, buckets), ROWS).repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = common.materialise(seeds.mapInArrow(meet, SPOTS), "seed-spots")
    per_doc = found.groupBy("doc", "tag").agg(  # sets: rows that repeat an id and text name the same spots
        F.collect_set(F.when(F.col("kind") == REPEAT, F.col("spot"))).alias("repeats"), F.collect_set(F.when(F.col("kind") == COMPARE, F.col("spot"))).alias("compare")
    )
    tagged = rows.mapInArrow(text_tags, "doc long, text string, tag int")
    met = common.materialise(tagged.join(per_doc, ["doc", "tag"], "left").select("doc", "text", "tag", "repeats", "compare").mapInArrow(finish(window), CARRIED), "seed-carried")
    carried = met.where("text is not null")
    hashed = carried.select("doc", "tag", "text", "compare").mapInArrow(windows_of(window, buckets), ROWS).repartition(parts, "bucket").sortWithinPartitions("bucket")
    more = hashed.mapInArrow(meet_windows, SPOTS).groupBy("doc", "tag").agg(F.collect_set("spot").alias("more"))
    rest = (
        carried.join(more, ["doc", "tag"], "left")
        .select("doc", "text", "tag", F.concat("repeats", F.coalesce("more", F.array().cast("array<long>"))).alias("repeats"), F.lit(None).cast("array<long>").alias("compare"))
        .mapInArrow(finish(window), CARRIED)
    )
    both = met.where("text is null").unionByName(rest)
    return both.select(common.id_back("doc").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) AS r(p)),
f AS (SELECT h, min((doc_id, p)) AS first FROM s GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT s.doc_id, s.p + k AS q FROM s JOIN f USING (h), unnest(range(0, 20)) AS u(k) WHERE (s.doc_id, s.p) <> f.first),
a AS (SELECT doc_id, list(q) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
