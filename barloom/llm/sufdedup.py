"""Suffix-array dedup: bytes that some LENGTH-byte string covers which also starts anywhere else are removed.

Equal strings of LENGTH bytes pick equal winnowed seeds (the smallest GRAM-byte hash) at equal places, so a repeat can only
be between runs of strings with one seed. Runs of one seed whose surroundings are equal as far as their strings reach are
repeats; a seed with one run is unique; neither needs sorting. What is left, the runs of a seed with different surroundings,
goes with its bytes to the shard of the seed. Each shard is a text whose suffixes are sorted with their common prefixes by
external induced sorting (suffixes.py); a string is a repeat if its suffix shares LENGTH bytes with a neighbour in the order.

A map task hands on one row per seed and surroundings, whatever the size of a group, and sends a seed that has several
surroundings to the shards at once. A seed with more than RUNS pieces (a passage that many documents hold) is dealt to several
shards: each is sorted by itself, and every different string that it holds then meets those of the seed's other shards, once
per shard, under its hash. So no task gets a group that grows with the input. A shard's bytes, queues and arrays go to scratch
files in the task's temporary folder beyond a fixed number of entries, and are removed with it.

Defined cases: null and empty texts have no bytes, n_removed 0 and the hash of the empty string; texts shorter than LENGTH
lose nothing; a null id counts as larger than all others; rows that repeat an id are
documents of their own, and repeats of each other where their bytes are (their spots are kept once, by id and a hash of the text); removal may cut a
character in two, so only the hash and counts are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textscan as ts
from .seedextend import COMPARE, REPEAT, ROWS, ROWS_ARROW, SEEDS, SPOTS, spot_batch, spot_list, spot_rows, taken, to_batches
from .suffixes import Scratch, suffix_array

LENGTH = 400
GRAM = 256
BLOCK = 1 << 20
SEED_TYPES = ["u8", "u8", "i8", "i4", "i4", "u2", "u1"]  # seed, surroundings, doc, tag, first byte, strings, state
ONE, SEVERAL, MARKER = 0, 1, 2
"""States of a seed's row: one run with these surroundings in its task; several, which the task has marked; a seed sent to the shards."""
CLASS_TYPES = ["u8", "i8", "i4", "i4", "u1"]  # string, doc, tag, place, whether marked
CLASSES = 4
"""Kind of rows with the different strings of a shard of a salted seed."""
RUNS = 512
"""Pieces of a seed beyond which it is dealt to several shards."""
SPLITS = 64
"""Tasks that the pieces of one seed are spread over when they learn the number of its shards."""
PLACE_BITS = 24


def spots(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) << 16 | n.astype(np.int64)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w values in a row, from running minima of blocks of w."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    b = np.full(-(-len(a) // w) * w, np.iinfo(a.dtype).max, a.dtype)
    b[: len(a)] = a
    b = b.reshape(-1, w)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    back = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def seeds_of(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, seed, surroundings, first byte in the document, strings) of each run of strings with one seed."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    values = ts.BYTE_VALUES[data]
    sums = ts.prefix_sums(values, ts.FIRST)
    g = ts.mix((sums[gram:] - sums[:-gram]) * ts.FIRST(len(sums))[1][: len(data) - gram + 1])
    bits = np.uint64(max(PLACE_BITS, len(g).bit_length()))
    low = sliding_min(g >> bits << bits | np.arange(len(g), dtype=np.uint64), length - gram + 1)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    at = np.flatnonzero(np.arange(length, len(data) + 1) <= offs[1:][row[: len(low)]])
    seed = (low[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    cut = np.flatnonzero(ts.new_group(seed))
    n = np.diff(np.append(cut, len(seed)))
    first, seed = at[cut], seed[cut]
    reach = ts.span_hashes(ts.prefix_sums(values, ts.SECOND), first, first + n + length - 1, ts.SECOND)
    reach = ts.mix(reach + (seed - first).astype(np.uint64) * np.uint64(0x9E6C63D0676A9A99))
    row = row[first]
    return row, g[seed], reach, first - offs[row], n


def grouped(seed, reach, rest):
    """rest in order, with masks: first of a seed; first of its surroundings; per row the number of rows with its seed and
    surroundings, and of surroundings with its seed."""
    rest = rest[np.lexsort((reach[rest], seed[rest]))]
    of_seed, of_reach = ts.new_group(seed[rest]), ts.new_group(seed[rest], reach[rest])
    size = np.diff(np.append(np.flatnonzero(of_reach), len(rest)))
    cut = np.flatnonzero(of_seed)
    kinds = np.repeat(np.add.reduceat(of_reach.astype(np.int64), cut), np.diff(np.append(cut, len(rest))))
    return rest, of_seed, of_reach, np.repeat(size, size), kinds


def block_rows(parts: list, buckets: int) -> Iterator[tuple]:
    seed, reach, doc, tag, first, n, _ = ts.concat(parts, SEED_TYPES)
    state = np.full(len(seed), ONE, np.uint8)
    order = np.argsort(seed)
    fresh = ts.new_group(seed[order])
    alone = fresh & np.append(fresh[1:], True)
    keep, rest = order[alone], order[~alone]
    if len(rest):
        rest, of_seed, of_reach, places, kinds = grouped(seed, reach, rest)
        marked = rest[places > 1]
        yield from spot_rows(REPEAT, doc[marked], tag[marked], spots(first[marked], n[marked]), buckets)
        sent = rest[(kinds > 1) & of_reach]
        yield from spot_rows(COMPARE, doc[sent], tag[sent], spots(first[sent], n[sent]), buckets)
        state[rest[of_reach & (places > 1)]] = SEVERAL
        marker = rest[of_seed & (kinds > 1)]
        state[marker] = MARKER
        keep = np.concatenate([keep, rest[of_reach & (kinds == 1)], marker])
    keep = np.sort(keep)
    for b, size, blob in ts.bucketed(ts.bucket_of(seed[keep], buckets), [x[keep] for x in (seed, reach, doc, tag, first, n, state)]):
        yield SEEDS, b, size, blob


def scan(length: int, gram: int, buckets: int):
    def rows(it):
        parts, held = [], 0
        for batch in it:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in ts.chunks(batch.column(1)):
                row, seed, reach, first, n = seeds_of(data, offs, length, gram)
                parts.append([seed, reach, ids[lo:hi][row], ts.doc_tags(data, offs)[row], first.astype(np.int32), n.astype(np.uint16), np.zeros(len(seed), np.uint8)])
                held += len(seed)
                if held >= BLOCK:
                    yield from block_rows(parts, buckets)
                    parts, held = [], 0
        if held:
            yield from block_rows(parts, buckets)

    return lambda it: to_batches(rows(it), ROWS_ARROW)


def meet(it) -> Iterator[pa.RecordBatch]:
    """Seeds to spots: strings known to be repeats, and runs that go to the shards."""
    for rows in ts.by_bucket(it):
        yield from _meet(rows)


def _meet(rows: list) -> Iterator[pa.RecordBatch]:
    parts, others = taken(rows, SEEDS, SEED_TYPES)
    yield from others
    seed, reach, doc, tag, first, n, state = ts.concat(parts, SEED_TYPES)
    del parts, others
    order = np.argsort(seed)
    fresh = ts.new_group(seed[order])
    rest = order[~(fresh & np.append(fresh[1:], True))] if len(order) else order
    if not len(rest):
        return
    reach = np.where(state == MARKER, np.uint64(0), reach)
    rest, _, of_reach, places, kinds = grouped(seed, reach, rest)
    several = state[rest] == SEVERAL
    cut = np.flatnonzero(of_reach)
    told = np.repeat(np.logical_or.reduceat(several, cut), np.diff(np.append(cut, len(rest))))
    marker = state[rest] == MARKER
    again = ~marker & ~several & ((places > 1) | told)
    at = rest[again]
    yield spot_batch(REPEAT, doc[at], tag[at], spots(first[at], n[at]))
    at = rest[of_reach & ~marker & (kinds > 1)]
    yield spot_batch(COMPARE, doc[at], tag[at], spots(first[at], n[at]))


def finished(text: bytes, spot: np.ndarray, length: int) -> tuple[int, int, int, str]:
    """(bytes, bytes removed, runs removed, SHA-256 of what is kept)."""
    if not len(spot):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    first, n = spot >> 16, spot & 65535
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + n + length - 1, len(text)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()


CARRIED = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, tag int, text string, repeats array<long>, compare array<long>"
CARRIED_ARROW = pa.schema(
    [("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("tag", pa.int32()), ("text", pa.string())]
    + [("repeats", pa.list_(pa.int64())), ("compare", pa.list_(pa.int64()))]
)


def finish(length: int):
    """Batches of (doc, text, tag, repeats, compare) to results; documents with runs for the shards are carried on."""

    def rows(it):
        for batch in it:
            texts, tags = batch.column("text"), batch.column("tag").to_pylist()
            for i, doc in enumerate(batch.column("doc").to_pylist()):
                repeats, compare = batch.column("repeats")[i], batch.column("compare")[i]
                if compare.is_valid and len(compare):
                    yield doc, None, None, None, None, tags[i], texts[i].as_py(), repeats.as_py(), compare.as_py()
                else:
                    text = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                    yield (doc, *finished(text, spot_list(repeats), length), None, None, None, None)

    def run(it):
        held, size = [], 0
        for row in rows(it):
            held.append(row)
            size += 100 + len(row[6] or "")
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), CARRIED_ARROW, strict=True)], schema=CARRIED_ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), CARRIED_ARROW, strict=True)], schema=CARRIED_ARROW)

    return run


PIECES = "seed long, doc long, tag int, first int, n int, bytes binary"
PIECES_ARROW = pa.schema([("seed", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())])


def pieces(length: int, gram: int):
    """Batches of carried documents to the bytes of their runs, with the seed."""

    def rows(it):
        for batch in it:
            ids, tags, lists = batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("compare")
            for lo, _, data, offs in ts.chunks(batch.column("text")):
                row, seed, _, first, n = seeds_of(data, offs, length, gram)
                cuts = np.searchsorted(row, np.arange(len(offs)))
                for d in range(len(offs) - 1):
                    mine = np.arange(cuts[d], cuts[d + 1])
                    asked = mine[np.isin(first[mine], spot_list(lists[lo + d]) >> 16)]
                    text = data[offs[d] : offs[d + 1]]
                    for j in asked.tolist():
                        a = int(first[j])
                        yield int(seed[j].view(np.int64)), ids[lo + d], tags[lo + d], a, int(n[j]), text[a : a + int(n[j]) + length - 1].tobytes()

    return lambda it: to_batches(rows(it), PIECES_ARROW)


def dealt(piece: DataFrame, buckets: int, runs: int) -> DataFrame:
    """Pieces with their shard; a seed with more than runs pieces has as many shards of its own as it takes, told by salted."""
    hot = piece.groupBy("seed").count().where(F.col("count") > runs).select("seed", F.ceil(F.col("count") / runs).alias("salts"))
    hot = hot.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))  # a row for each RUNS / SPLITS pieces at most
    place = F.xxhash64("doc", "tag", "first")
    salted = F.col("salts").isNotNull()
    part = F.when(salted, F.xxhash64("seed", F.pmod(place, F.col("salts")))).otherwise(F.pmod(F.xxhash64("seed"), F.lit(buckets)))
    return piece.withColumn("split", F.pmod(place, F.lit(SPLITS)).cast("int")).join(hot, ["seed", "split"], "left").select(part.alias("part"), salted.alias("salted"), "doc", "tag", "first", "n", "bytes")


class Shard:
    """The pieces of one part: heads in memory, bytes there or, beyond the scratch's limit, in its file."""

    def __init__(self, files: Scratch, salted: bool):
        self.files, self.salted, self.path, self.heads, self.parts, self.held, self.total = files, salted, None, [], [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        doc, tag, first, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "tag", "first", "n"))
        begin = np.zeros(len(doc), np.int64)
        for i, raw in enumerate(batch.column("bytes")):
            begin[i] = self.total
            piece = np.zeros(len(raw.as_buffer()) + 1, np.uint16)  # ends with a 0
            piece[:-1] = np.frombuffer(raw.as_buffer(), np.uint8)
            piece[:-1] += 1
            self.parts.append(piece)
            self.total += len(piece)
        self.heads.append(np.stack([doc, tag, first, n, begin], axis=1))
        if self.total - self.held > self.files.held:
            self._spill()

    def _spill(self) -> None:
        self.path = self.path or self.files.path()
        with open(self.path, "ab") as f:
            for piece in self.parts:
                f.write(piece.tobytes())
        self.parts, self.held = [], self.total

    def text(self) -> np.ndarray:
        if self.path is None:
            return np.concatenate(self.parts)
        self._spill()
        return np.memmap(self.path, np.uint16, "r", shape=(self.total,))

    def repeats(self, length: int, buckets: int) -> Iterator[tuple]:
        """Rows of kind REPEAT for the strings that share their first length bytes with another one's; if the seed is salted,
        also one row of kind CLASSES per different string, to meet those of its other shards."""
        head = np.concatenate(self.heads)
        begin, text = head[:, 4], self.text()
        hits: list[np.ndarray] = []
        classes: list[np.ndarray] = []

        def close(at: np.ndarray, group: np.ndarray) -> None:
            """Places in order with the number of their group: those of groups with several strings are hits."""
            p = np.searchsorted(begin, at, "right") - 1
            ok = at - begin[p] < head[p, 3]  # a string of the piece's own starts here
            at, p, group = at[ok], p[ok], group[ok]
            many = np.bincount(group, minlength=1)[group] > 1
            hits.append(np.stack([p, at - begin[p]], axis=1)[many])
            if self.salted:
                one = ts.new_group(group)
                classes.append(np.stack([p, at - begin[p], many], axis=1)[one])

        left: list[np.ndarray] = []  # the group that the next batch may go on with
        for at, lcp in suffix_array(text, self.files):
            cut = np.flatnonzero(lcp < length)
            if not len(cut):
                left.append(at)
                continue
            done = np.concatenate([*left, at[: cut[-1]]])
            before = len(done) - int(cut[-1])
            starts = np.zeros(len(done), np.int64)
            starts[before + cut[:-1]] = 1
            if len(done):
                group = np.cumsum(starts)
                some = np.bincount(group)[group] > 1
                if self.salted:
                    close(done, group)
                elif some.any():
                    close(done[some], group[some])
            left = [at[cut[-1] :]]
        last = np.concatenate(left)
        close(last, np.zeros(len(last), np.int64))
        found = np.concatenate(hits)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        p, place = found[:, 0], found[:, 1] + head[found[:, 0], 2]
        new = ts.new_group(p)
        new[1:] |= place[1:] != place[:-1] + 1
        cut = np.flatnonzero(new)
        at = head[p[cut]]
        yield from spot_rows(REPEAT, at[:, 0].copy(), at[:, 1].astype(np.int32), spots(place[cut], np.diff(np.append(cut, len(p)))), buckets)
        if self.salted:
            yield from self._classes(np.concatenate(classes), head, text, length, buckets)

    def _classes(self, one: np.ndarray, head: np.ndarray, text: np.ndarray, length: int, buckets: int) -> Iterator[tuple]:
        one = one[np.lexsort((one[:, 1], one[:, 0]))]
        cut = np.flatnonzero(ts.new_group(one[:, 0]))
        parts, held = [], 0

        def block():
            h, doc, tag, place, many = ts.concat(parts, CLASS_TYPES)
            for b, n, blob in ts.bucketed(ts.bucket_of(h, buckets), [h, doc, tag, place, many]):
                yield CLASSES, b, n, blob

        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(one)], strict=True):
            doc, tag, first, n, begin = head[one[a, 0]].tolist()
            values = ts.BYTE_VALUES[np.asarray(text[begin : begin + n + length - 1]).astype(np.int64) - 1]
            at = one[a:b, 1]
            parts.append([ts.gram_hashes(values, length, ts.SECOND)[at], np.full(b - a, doc), np.full(b - a, tag, np.int32), (first + at).astype(np.int32), one[a:b, 2].astype(np.uint8)])
            held += b - a
            if held >= BLOCK:
                yield from block()
                parts, held = [], 0
        if held:
            yield from block()


def sort_shards(length: int, buckets: int, **scratch):
    """Pieces sorted by part to rows of kinds REPEAT and CLASSES, a shard at a time."""

    def rows(it):
        part, files, shard = None, None, None
        try:
            for batch in it:
                keys = batch.column("part").to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(ts.new_group(keys)).tolist()
                for a, b in zip(cuts, [*cuts, len(keys)][1:], strict=True):
                    if shard is not None and keys[a] != part:
                        yield from shard.repeats(length, buckets)
                        files.__exit__()
                        shard = None
                    if shard is None:
                        part, files = keys[a], Scratch(**scratch)
                        shard = Shard(files, batch.column("salted")[a].as_py())
                    shard.add(batch.slice(a, b - a))
            if shard is not None:
                yield from shard.repeats(length, buckets)
        finally:
            if files is not None:
                files.__exit__()

    return lambda it: to_batches(rows(it), ROWS_ARROW)


def meet_classes(it) -> Iterator[pa.RecordBatch]:
    """Strings of salted seeds that several shards hold: those not yet marked are repeats."""
    for rows in ts.by_bucket(it):
        parts, others = taken(rows, CLASSES, CLASS_TYPES)
        yield from others
        h, doc, tag, place, many = ts.concat(parts, CLASS_TYPES)
        order = np.argsort(h)
        n = np.diff(np.append(np.flatnonzero(ts.new_group(h[order])), len(h)))
        at = order[(np.repeat(n, n) > 1) & (many[order] == 0)]
        yield spot_batch(REPEAT, doc[at], tag[at], spots(place[at], np.ones(len(at), np.int64)))


def text_tags(it):
    for batch in it:
        tags = [ts.doc_tags(data, offs) for _, _, data, offs in ts.chunks(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(np.concatenate(tags) if tags else np.zeros(0, np.int32), pa.int32())], names=["doc", "text", "tag"])


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, runs: int = RUNS, **scratch) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row."""
    parts = common.partitions(docs.sparkSession)
    buckets = 16 * parts
    rows = docs.select(common.id_key().alias("doc"), F.col("text").cast("string").alias("text"))
    seeds = rows.mapInArrow(scan(length, gram, buckets), ROWS).repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = common.materialise(seeds.mapInArrow(meet, SPOTS), "suffix-spots")
    per_doc = found.groupBy("doc", "tag").agg(  # sets: rows that repeat an id and text name the same spots
        F.collect_set(F.when(F.col("kind") == REPEAT, F.col("spot"))).alias("repeats"), F.collect_set(F.when(F.col("kind") == COMPARE, F.col("spot"))).alias("compare")
    )
    tagged = rows.mapInArrow(text_tags, "doc long, text string, tag int")
    met = common.materialise(tagged.join(per_doc.hint("merge"), ["doc", "tag"], "left").select("doc", "text", "tag", "repeats", "compare").mapInArrow(finish(length), CARRIED), "suffix-carried")
    carried = met.where("text is not null")
    piece = common.materialise(carried.select("doc", "tag", "text", "compare").mapInArrow(pieces(length, gram), PIECES), "suffix-pieces")
    shards = dealt(piece, 8 * parts, runs).repartition(parts, "part").sortWithinPartitions("part")
    sorted_ = shards.mapInArrow(sort_shards(length, buckets, **scratch), ROWS).repartition(parts, "bucket").sortWithinPartitions("bucket")
    more = sorted_.mapInArrow(meet_classes, SPOTS).groupBy("doc", "tag").agg(F.collect_set("spot").alias("more"))
    rest = (
        carried.join(more.hint("merge"), ["doc", "tag"], "left")
        .select("doc", "text", "tag", F.concat("repeats", F.coalesce("more", F.array().cast("array<long>"))).alias("repeats"), F.lit(None).cast("array<long>").alias("compare"))
        .mapInArrow(finish(length), CARRIED)
    )
    both = met.where("text is null").unionByName(rest)
    return both.select(common.id_back("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
