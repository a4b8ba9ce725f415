"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence with its transpose.

Equal shingle sets are one row of the matrix. Columns (shingles) are ordered from rare to frequent by a fixed-size count
sketch over all texts; two sets of similarity s share a column among the first n - ceil(s n) + 1 of each (prefix bound), so
only those entries are shuffled, each block of columns to one task. There
 - a column with few rows yields its pairs, unless sizes (5 |x| < 4 |y|) or what is left after the shared place bound the
   overlap below what the similarity needs;
 - a column with many rows yields no pairs but an edge from each row to a node that stands for the column. Columns that the
   sketch already shows to be frequent do so in the map task and are never gathered.
The pairs' components hold every link. Each component's texts meet once, cut into chunks of bounded size, and the product
of a chunk accumulates exact overlap counts, a row at a time against all rows that aren't in its component yet: rows of the
smallest component come first, so that a group of near copies takes a few rows, not all pairs.

The sketch has a fixed size, so in large inputs shingles of some hundred rows pass for rare and glue texts of one boilerplate
together. A component of several chunks is therefore taken apart first, by exact counts of its shingles: a linked set shares
at least s n of its n shingles with others (a sample of the shingles already shows most sets that can't), and the sets that
do get their prefix, columns and components again, ordered by those counts. Where a component still has several chunks, the
rows outside its largest linked part go to each of the chunks in a second product.

Defined cases: null, blank and word-less texts have no shingles and link with nothing; a text of 1 to 4 words is one
shingle; rows with equal id and text link with each other and get equal results; a null id counts as larger than all others and comes back
as null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import textscan as ts
from .components import components
from .seedextend import ROWS, ROWS_ARROW, to_batches

SHINGLE = 5
PERCENT = 80
SKETCH_BITS = 22
SLICE = 1 << 16
FEW = 128
"""Rows up to which a column yields pairs."""
BLOCK = 1 << 21
CHUNK_SHINGLES = 1 << 21
ENTRY_TYPES = ["u8", "i8", "i4", "i4"]  # shingle, set, size, place
DOC, SKETCH, ENTRY, EDGE, SIZE = 0, 1, 2, 3, 4
SAMPLE = 96
"""Shingles, of 256, whose counts are taken first in components of several chunks."""
SHARED_TYPES = ["i8", "u8", "i4"]  # set, shingle, rows
SIZE_TYPES = ["i8", "i4", "i4"]  # set, size, shingles counted
STATS = "kind byte, doc long, tag int, n long, node long, bucket int, blob binary"
STATS_ARROW = pa.schema([("kind", pa.int8()), ("doc", pa.int64()), ("tag", pa.int32()), ("n", pa.int64()), ("node", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
PAIRS_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's begin (one more at the end)."""
    low = ts.LOWER[data]
    s, e, upto = ts.words(low, offs)
    h = ts.word_hashes(low, s, e)
    grams = ts.gram_hashes(h, k, ts.FIRST)
    n = np.diff(upto)
    row = ts.owners(upto)
    short = np.flatnonzero((n > 0) & (n < k))
    full = np.arange(len(grams)) + k <= upto[1:][row[: len(grams)]]
    values, row = grams[full], row[: len(grams)][full]
    if len(short):
        whole = ts.span_hashes(ts.prefix_sums(h, ts.SECOND), upto[short], upto[short + 1], ts.SECOND)
        at = np.searchsorted(row, short)
        values, row = np.insert(values, at, whole), np.insert(row, at, short)
    cuts = np.searchsorted(row, np.arange(len(n) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        values[a:b].sort()
    keep = ts.new_group(row, values)
    return values[keep], np.concatenate([[0], np.cumsum(np.add.reduceat(keep, cuts[:-1][cuts[:-1] < cuts[1:]], dtype=np.int64))])[np.concatenate([[0], np.cumsum(cuts[:-1] < cuts[1:])])] if len(values) else np.zeros(len(n) + 1, np.int64)


def set_ids(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, 0 for empty ones."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ts.mix(values ^ np.uint64(0xA0761D6478BD642F)))])
    n = np.diff(cuts)
    out = ts.mix((sums[cuts[1:]] - sums[cuts[:-1]]) + n.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)
    return np.where(n > 0, out, 0)


def stats(k: int, bits: int):
    """Batches of (doc, text) to a row per document and the partition's counts of shingle buckets."""

    def run(it):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in it:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags, sizes, names = [], [], []
            for _, _, data, offs in ts.chunks(batch.column(1)):
                values, cuts = shingle_sets(data, offs, k)
                name = set_ids(values, cuts)
                _, at = np.unique(name, return_index=True)  # equal sets of a chunk count once
                once = np.zeros(len(name), bool)
                once[at] = True
                spots = (values[np.repeat(once, np.diff(cuts))] >> np.uint64(64 - bits)).astype(np.int64)
                where, n = np.unique(spots, return_counts=True)
                counts[where] += n.astype(np.uint32)
                tags.append(ts.doc_tags(data, offs))
                sizes.append(np.diff(cuts))
                names.append(name)
            n = len(ids)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, DOC, np.int8)), pa.array(ids), pa.array(np.concatenate(tags)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(names)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    schema=STATS_ARROW,
                )
        for lo in range(0, len(counts), SLICE):
            part = counts[lo : lo + SLICE]
            if part.any():
                small = part.astype(np.uint8 if part.max() < 256 else np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((SKETCH, None, None, small.itemsize, None, lo // SLICE, small.tobytes()), STATS_ARROW, strict=True)], schema=STATS_ARROW)

    return run


def summed(it):
    """Slices of counts to their sums, a partition at a time."""
    total: dict[int, np.ndarray] = {}
    for batch in it:
        for n, b, blob in zip(batch.column("n").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            part = np.frombuffer(blob.as_buffer(), np.uint8 if n == 1 else np.uint32).astype(np.uint64)
            total[b] = total[b] + part if b in total else part
    for b, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([int(x.sum())], pa.int64()), pa.array([np.minimum(255, np.round(8 * np.log2(x + 1.0))).astype(np.uint8).tobytes()], pa.binary())], names=["bucket", "n", "blob"])


def prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)


def entries(k: int, percent: int, levels, frequent: int, buckets: int):
    """Batches of (doc, text) to blobs of entries by block of columns, and edges to frequent columns."""

    def block(parts):
        h, node, size, place = ts.concat(parts, ENTRY_TYPES)
        for b, n, blob in ts.bucketed(ts.bucket_of(h, buckets), [h, node, size, place]):
            yield ENTRY, b, n, blob

    def rows(it):
        level = np.frombuffer(levels.value, np.uint8)
        bits = len(level).bit_length() - 1
        parts, held, seen = [], 0, set()
        for batch in it:
            for _, _, data, offs in ts.chunks(batch.column(1)):
                values, cuts = shingle_sets(data, offs, k)
                names = set_ids(values, cuts)
                sizes = np.diff(cuts)
                lev = level[(values >> np.uint64(64 - bits)).astype(np.int64)]
                keys = lev.astype(np.uint64) << np.uint64(56) | values >> np.uint64(8)
                first = prefix_lengths(sizes, percent)
                at, whose = [], []
                for i, (a, b, p, name) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), first.tolist(), names.tolist(), strict=True)):
                    if p and name not in seen:
                        seen.add(name)
                        at.append(a + np.argsort(keys[a:b])[:p])
                        whose.append(i)
                if not at:
                    continue
                n = np.array([len(a) for a in at])
                where, row = np.concatenate(at), np.repeat(whose, n)
                place = np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
                hot = lev[where] >= frequent
                if hot.any():
                    u, v = names[row[hot]], ts.mix(values[where[hot]] ^ np.uint64(0x8EBC6AF09C88C6E3)).view(np.int64)
                    yield EDGE, int(u[0] % buckets), len(u), ts.pack([u, v])
                cold = ~hot
                parts.append([values[where[cold]], names[row[cold]], sizes[row[cold]].astype(np.int32), place[cold].astype(np.int32)])
                held += int(cold.sum())
                if held >= BLOCK:
                    yield from block(parts)
                    parts, held, seen = [], 0, set()
        if held:
            yield from block(parts)

    return lambda it: to_batches(rows(it), ROWS_ARROW)


def column_pairs(percent: int, few: int):
    """The product of a block of columns: candidate pairs, or edges to a column's node where it has many rows."""

    def run(it):
        for rows in ts.by_bucket(it):
            yield from block(rows)

    def block(rows):
        parts, edges = [], []
        for batch in rows:
            for kind, n, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if kind == ENTRY:
                    parts.append(ts.unpack(blob.as_buffer(), n, ENTRY_TYPES))
                else:
                    edges.append(ts.unpack(blob.as_buffer(), n, ["i8", "i8"]))
        if edges:
            u, v = ts.concat(edges, ["i8", "i8"])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=PAIRS_ARROW)
        h, node, size, place = ts.concat(parts, ENTRY_TYPES)
        del parts, edges
        order = np.argsort(h)
        fresh = ts.new_group(h[order])
        rest = order[~(fresh & np.append(fresh[1:], True))] if len(order) else order
        if not len(rest):
            return
        rest = rest[np.lexsort((node[rest], size[rest], h[rest]))]
        rest = rest[ts.new_group(h[rest], node[rest])]
        cut = np.flatnonzero(ts.new_group(h[rest]))
        deg = np.diff(np.append(cut, len(rest)))
        col = np.repeat(np.arange(len(cut)), deg)
        many = np.repeat(deg > few, deg)
        found = [np.stack([node[rest[many]], ts.mix(h[rest[many]] ^ np.uint64(0x8EBC6AF09C88C6E3)).view(np.int64)])] if many.any() else []
        keep = np.flatnonzero(~many)
        rest, col = rest[keep], col[keep]
        for step in range(1, few):  # pairs that stand step places apart in a column, sizes rising
            if len(rest) <= step:
                break
            same = np.flatnonzero(col[step:] == col[:-step])
            if not len(same):
                break
            a, b = rest[same], rest[same + step]
            near = 100 * size[a].astype(np.int64) >= percent * size[b].astype(np.int64)
            a, b = a[near], b[near]
            x, y = size[a].astype(np.int64), size[b].astype(np.int64)
            able = (100 + percent) * (np.minimum(x - place[a], y - place[b])) >= percent * (x + y)
            if able.any():
                found.append(np.unique(np.stack([np.minimum(node[a[able]], node[b[able]]), np.maximum(node[a[able]], node[b[able]])]), axis=1))
        if found:
            uv = np.concatenate(found, axis=1)
            uv = uv[:, np.lexsort((uv[1], uv[0]))]
            uv = uv[:, ts.new_group(uv[0], uv[1])]
            yield pa.RecordBatch.from_arrays([pa.array(uv[0]), pa.array(uv[1])], schema=PAIRS_ARROW)

    return run


def solve(values: np.ndarray, cuts: np.ndarray, percent: int, settled: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly what the sets' links join, as pairs of places. settled: labels of sets that are known to be joined."""
    m, size = len(cuts) - 1, np.diff(cuts)
    row = np.repeat(np.arange(m), size)
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    code, row = code[shared], row[shared]
    of_row = np.searchsorted(row, np.arange(m + 1))
    order = np.argsort(code, kind="stable")
    post = row[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(count)))])
    label = np.arange(m) if settled is None else np.unique(settled, return_inverse=True)[1]
    to_do = size > 0
    us, vs = [], []
    while True:
        left = np.flatnonzero(to_do)
        if not len(left):
            break
        _, back, n = np.unique(label[left], return_inverse=True, return_counts=True)
        if len(n) == 1:
            break
        p = left[np.argmin(n[back])]  # of the smallest component
        other = to_do & (label != label[p]) & (100 * size >= percent * size[p]) & (100 * size[p] >= percent * size)
        to_do[p] = False
        if not other.any():
            continue
        mine = code[of_row[p] : of_row[p + 1]]
        lens = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        overlap = np.bincount(post[at], minlength=m)
        linked = np.flatnonzero(other & (100 * overlap >= percent * (size[p] + size - overlap)))
        if len(linked):
            us.append(np.full(len(linked), p))
            vs.append(linked)
            joined = np.isin(label, np.append(label[linked], label[p]))
            label[joined] = label[p]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


def whole_groups(it, key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if held and (last or held[-1].column(key)[-1].as_py() != keys[0]):
            if last:
                held.append(batch.slice(0, last))
                batch = batch.slice(last)
            yield pa.Table.from_batches(held)
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def groups_links(k: int, percent: int):
    """Sorted batches of (part, node, label, text) to links."""

    def run(it):
        for table in whole_groups(it, "part"):
            part = table.column("part").to_numpy()
            node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
            texts = table.column("text").combine_chunks()
            texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
            us, vs = [], []
            cut = np.flatnonzero(ts.new_group(part))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True):
                data, offs = ts.buffers(texts.slice(a, b - a))
                values, cuts = shingle_sets(data[offs[0] : offs[-1]], offs - offs[0], k)
                u, v = solve(values, cuts, percent, label[a:b])
                us.append(node[a:b][u])
                vs.append(node[a:b][v])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=PAIRS_ARROW)

    return run


def shared_entries(k: int, buckets: int, sample: int, some: Broadcast | None):
    """Batches of (node, component, text) to blobs of (shingle of the component, node) by shingle, and of sizes by node.
    sample: of 256 shingles so many; some: a filter of the nodes to take."""

    def block(parts):
        key, node = ts.concat(parts, ["u8", "i8"])
        for b, n, blob in ts.bucketed(ts.bucket_of(key, buckets), [key, node]):
            yield ENTRY, b, n, blob

    def rows(it):
        parts, held = [], 0
        for batch in it:
            if some is not None:
                batch = batch.filter(pa.array(common.passes(batch.column(0).to_numpy(), some.value)))
            nodes, groups = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offs in ts.chunks(batch.column(2)):
                values, cuts = shingle_sets(data, offs, k)
                size = np.diff(cuts)
                row = np.repeat(np.arange(hi - lo), size)
                key = ts.mix(values ^ ts.mix(groups[lo:hi].view(np.uint64))[row])
                taken = key >> np.uint64(56) < sample
                key, row = key[taken], row[taken]
                counted = np.bincount(row, minlength=hi - lo).astype(np.int32)
                for b, n, blob in ts.bucketed(ts.bucket_of(nodes[lo:hi].view(np.uint64), buckets), [nodes[lo:hi], size.astype(np.int32), counted]):
                    yield SIZE, b, n, blob
                parts.append([key, nodes[lo:hi][row]])
                held += len(key)
                if held >= BLOCK:
                    yield from block(parts)
                    parts, held = [], 0
        if held:
            yield from block(parts)

    return lambda it: to_batches(rows(it), ROWS_ARROW)


def shared_counts(buckets: int):
    """Blocks of shingles to blobs, by node, of those that several nodes have, with the number of these; sizes go on as they are."""

    def block(parts):
        node, key, df = ts.concat(parts, SHARED_TYPES)
        for b, n, blob in ts.bucketed(ts.bucket_of(node.view(np.uint64), buckets), [node, key, df]):
            yield ENTRY, b, n, blob

    def rows(it):
        parts, held = [], 0
        for batches in ts.by_bucket(it):
            entry = []
            for batch in batches:
                for kind, b, n, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                    if kind == SIZE:
                        yield kind, b, n, blob.as_py()
                    else:
                        entry.append(ts.unpack(blob.as_buffer(), n, ["u8", "i8"]))
            key, node = ts.concat(entry, ["u8", "i8"])
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            once = ts.new_group(key, node)
            key, node = key[once], node[once]
            cut = np.flatnonzero(ts.new_group(key))
            df = np.diff(np.append(cut, len(key)))
            df = np.repeat(df, df)
            parts.append([node[df > 1], key[df > 1], df[df > 1].astype(np.int32)])
            held += len(parts[-1][0])
            if held >= BLOCK:
                yield from block(parts)
                parts, held = [], 0
        if held:
            yield from block(parts)

    return lambda it: to_batches(rows(it), ROWS_ARROW)


def able_nodes(batches: list, percent: int) -> tuple[np.ndarray, ...]:
    """Of a bucket of nodes: (nodes, size, shingles counted that no other has, able to link at all), and (place of the node, shingle, rows) of shared shingles."""
    sizes, entry = [], []
    for batch in batches:
        for kind, n, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            (sizes if kind == SIZE else entry).append(ts.unpack(blob.as_buffer(), n, SIZE_TYPES if kind == SIZE else SHARED_TYPES))
    node, size, counted = ts.concat(sizes, SIZE_TYPES)
    node, first = np.unique(node, return_index=True)
    size, counted = size[first].astype(np.int64), counted[first].astype(np.int64)
    whose, key, df = ts.concat(entry, SHARED_TYPES)
    at = np.searchsorted(node, whose)
    own = counted - np.bincount(at, minlength=len(node))
    return node, size, own, (size > 0) & (own < prefix_lengths(size, percent)), at, key, df


def sampled_able(percent: int):
    def run(it):
        for batches in ts.by_bucket(it):
            node, _, _, able, *_ = able_nodes(batches, percent)
            yield pa.RecordBatch.from_arrays([pa.array(node[able])], names=["node"])

    return run


def counted_entries(percent: int, buckets: int):
    """Entries, as of entries(), of the able nodes of a component, columns in the order of their exact counts."""

    def rows(it):
        for batches in ts.by_bucket(it):
            node, size, own, able, at, key, df = able_nodes(batches, percent)
            order = np.lexsort((key, df, at))
            order = order[able[at[order]]]
            at, key = at[order], key[order]
            fresh = np.flatnonzero(ts.new_group(at))
            place = own[at] + np.arange(len(at)) - np.repeat(fresh, np.diff(np.append(fresh, len(at))))
            first = place < prefix_lengths(size, percent)[at]
            at, key, place = at[first], key[first], place[first]
            if not len(key):
                continue
            for b, n, blob in ts.bucketed(ts.bucket_of(key, buckets), [key, node[at], size[at].astype(np.int32), place.astype(np.int32)]):
                yield ENTRY, b, n, blob

    return lambda it: to_batches(rows(it), ROWS_ARROW)


def apart(big: DataFrame, k: int, percent: int, few: int) -> DataFrame:
    """(node, component) of the nodes of (node, component, text) that can link within their component, in smaller components that hold every link."""
    spark = big.sparkSession
    parts = common.partitions(spark)
    rows = big.select("node", "component", "text")
    dealt = lambda df: df.repartition(parts, "bucket").sortWithinPartitions("bucket")
    counts = lambda sample, some: dealt(dealt(rows.mapInArrow(common.trimmed(shared_entries(k, 16 * parts, sample, some)), ROWS)).mapInArrow(common.trimmed(shared_counts(16 * parts)), ROWS))
    may = common.materialise(counts(SAMPLE, None).mapInArrow(common.trimmed(sampled_able(percent)), "node long"), "jaccard-able")
    common.let_go(spark)
    some = spark.sparkContext.broadcast(common.key_filter(may))
    cols = dealt(counts(256, some).mapInArrow(common.trimmed(counted_entries(percent, 16 * parts)), ROWS))
    found = components(cols.mapInArrow(common.trimmed(column_pairs(percent, few)), "u long, v long"))
    fine = common.materialise(found.join(may.distinct(), "node", "left_semi"), "jaccard-apart")
    common.let_go(spark, may)
    return fine


def row_keys(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return ts.mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tag.astype(np.int64).view(np.uint64)).view(np.int64)


def keyed_rows(it):
    for batch in it:
        yield pa.RecordBatch.from_arrays([pa.array(row_keys(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], names=["key"])


def tagged_texts(some: Broadcast):
    """Batches of (doc, text) to (doc, text, tag) of the rows whose key passes the filter."""

    def run(it):
        for batch in it:
            tags = [ts.doc_tags(data, offs) for _, _, data, offs in ts.chunks(batch.column(1))]
            tag = np.concatenate(tags) if tags else np.zeros(0, np.int32)
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(tag, pa.int32())], names=["doc", "text", "tag"])
            yield out.filter(pa.array(common.passes(row_keys(doc, tag), some.value)))

    return run


def passing_nodes(some: Broadcast):
    def run(it):
        for batch in it:
            yield batch.filter(pa.array(common.passes(batch.column("node").to_numpy(), some.value)))

    return run


def classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bits: int = SKETCH_BITS, few: int = FEW, chunk: int = CHUNK_SHINGLES) -> DataFrame:
    """(doc, tag, n_shingles, component, first_tag): doc is the id with nulls as NULL_ID, component the smallest doc reachable by
    links; of its rows that are reachable first_tag is the smallest tag, as null and repeated ids don't tell texts apart."""
    spark = docs.sparkSession
    parts = common.partitions(spark)
    rows = docs.select(common.id_key().alias("doc"), F.col("text").cast("string").alias("text"))
    seen = common.materialise(rows.mapInArrow(common.trimmed(stats(k, bits)), STATS), "jaccard-stats")
    per_doc = seen.where(F.col("kind") == DOC).select("doc", "tag", "n", "node")
    # the sketch has 2**bits counters whatever the input, and 1 byte of each comes to the driver
    sketch = seen.where(F.col("kind") == SKETCH).select("bucket", "n", "blob").repartition(min(parts, 1 << max(0, bits - 16)), "bucket").mapInArrow(common.trimmed(summed), "bucket int, n long, blob binary").collect()
    levels = np.zeros(1 << bits, np.uint8)
    for r in sketch:
        levels[r["bucket"] * SLICE : r["bucket"] * SLICE + len(r["blob"])] = np.frombuffer(r["blob"], np.uint8)
    mean = sum(r["n"] for r in sketch) / (1 << bits)
    frequent = min(255, round(8 * math.log2(max(few, 4 * mean) + 1)))
    held = spark.sparkContext.broadcast(levels.tobytes())

    cols = rows.mapInArrow(common.trimmed(entries(k, percent, held, frequent, 16 * parts)), ROWS).repartition(parts, "bucket").sortWithinPartitions("bucket")
    pairs = cols.mapInArrow(common.trimmed(column_pairs(percent, few)), "u long, v long")
    may = components(pairs)
    sets = per_doc.where("n > 0").groupBy("node").agg(F.min(F.struct("doc", "tag")).alias("first"), F.first("n").alias("n"))
    groups = common.materialise(may.join(sets, "node").select("node", "component", "n", F.col("first.doc").alias("doc"), F.col("first.tag").alias("tag")), "jaccard-groups")
    common.let_go(spark)
    cuts = groups.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(chunk)).alias("chunks"), F.count("*").alias("m")).where("m > 1")
    cut = common.materialise(groups.join(cuts, "component").select("doc", "tag", "node", "component", "n", "chunks"), "jaccard-cut")
    # one plan at every size: texts are dealt by document, never against a broadcast list that grows with the input; the filter is bounded
    wanted = spark.sparkContext.broadcast(common.key_filter(cut.select("doc", "tag").mapInArrow(keyed_rows, "key long")))
    texts = rows.mapInArrow(common.trimmed(tagged_texts(wanted)), "doc long, text string, tag int")
    met = common.materialise(texts.join(cut.hint("merge"), ["doc", "tag"]).select("node", "component", "n", "chunks", "text"), "jaccard-met")
    common.let_go(spark, cut, groups)
    done = [seen, met]

    def chunked(of: DataFrame) -> DataFrame:
        of = of.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
        return of.select("node", "component", "chunks", "chunk", F.xxhash64("component", "chunk").alias("part"), "text")

    def links(of: DataFrame) -> DataFrame:
        return of.select("part", "node", "label", "text").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(common.trimmed(groups_links(k, percent)), "u long, v long")

    every, several = chunked(met.where("chunks = 1")), None
    large = met.where("chunks > 1")
    if not large.isEmpty():
        fine = apart(large, k, percent, few)
        some = spark.sparkContext.broadcast(common.key_filter(fine.select("node")))
        again = large.select("node", "n", "text").mapInArrow(common.trimmed(passing_nodes(some)), "node long, n long, text string").join(fine.hint("merge"), "node")
        again = common.materialise(again, "jaccard-again")
        sizes = again.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(chunk)).alias("chunks"))
        several = common.materialise(chunked(again.join(sizes, "component")), "jaccard-several")
        common.let_go(spark, fine, again)
        done.append(several)
        every, several = every.unionByName(several), several.where("chunks > 1")
    found = common.materialise(links(every.withColumn("label", F.col("node"))), "jaccard-links")
    common.let_go(spark)
    done.append(found)
    joined = components(found)
    if several is not None and not several.isEmpty():
        lab = several.join(joined, "node", "left").withColumn("label", F.coalesce(joined["component"], "node")).drop(joined["component"])
        lab = common.materialise(lab, "jaccard-labelled")
        done.append(lab)
        size = lab.groupBy(F.col("component").alias("c"), "label").count()
        largest = size.groupBy("c").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
        strays = lab.join(largest, F.col("component") == F.col("c")).where("label <> largest").drop("c", "largest")
        everywhere = strays.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("to <> chunk").withColumn("part", F.xxhash64("component", "to")).drop("to")
        found = found.unionByName(links(lab.unionByName(everywhere)))
        joined = components(found)
    named = per_doc.join(joined, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    named = common.materialise(named, "jaccard-named")
    common.let_go(spark, *done)
    least = named.where("n > 0").groupBy("c").agg(F.min(F.struct("doc", "tag")).alias("least"))
    linked = F.col("n") > 0
    return named.join(least, "c", "left").select(
        "doc", "tag", F.col("n").alias("n_shingles"), F.when(linked, F.col("least.doc")).otherwise(F.col("doc")).alias("component"), F.when(linked, F.col("least.tag")).otherwise(F.col("tag")).alias("first_tag")
    )


def join(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row."""
    return classes(docs, **how).select(common.id_back("doc").alias("doc_id"), "n_shingles", common.id_back("component").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row of docs, whole, of each component: that of the smallest id, null being larger than all others, and of the
    smallest text hash where rows of the component share that id; documents without shingles stay. Of rows that repeat the
    id and text of a kept one all but one go: that with the smallest other columns stays."""
    rest = classes(docs, **how).where(((F.col("component") != F.col("doc")) | (F.col("first_tag") != F.col("tag"))) & (F.col("n_shingles") > 0)).select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag")).distinct()
    rest = common.materialise(rest, "jaccard-rest")
    common.let_go(docs.sparkSession)
    at = docs.columns.index("text")

    def tagged(it):
        for batch in it:
            texts = batch.column(at).cast(pa.string())
            tags = [ts.doc_tags(data, offs) for _, _, data, offs in ts.chunks(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(tags) if tags else np.zeros(0, np.int32), pa.int32())], names=[*batch.schema.names, "__tag"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__tag", T.IntegerType())])
    whole = docs.mapInArrow(common.trimmed(tagged), schema).withColumn("__doc", common.id_key())
    kept = whole.join(rest.hint("merge"), ["__doc", "__tag"], "left_anti")
    by = F.struct(*[F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != "text" and not isinstance(f.dataType, T.MapType)])
    one = kept.groupBy("__doc", "__tag").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), by).alias("__row"))
    return one.select(*[F.col(f"__row.`{c}`") for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + 4], ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
c AS (SELECT doc_id AS at, doc_id AS of FROM d UNION SELECT e.b, c.of FROM c JOIN e ON e.a = c.at)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(of) FROM c WHERE c.at = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
