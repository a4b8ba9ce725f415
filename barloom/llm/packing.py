"""Token ids packed into rows of a fixed length by best-fit decreasing.

A document's ids, ended by END, are cut into pieces of at most ROW ids; no id is lost and each piece says where it stands in
its document. Pieces are placed longest first, each into the fullest row that still has room. Room is found in a segment
tree over the free lengths 0..ROW that counts the rows of each: one walk down finds the smallest free length that suffices.

Each task packs its own documents, BUFFER ids at a time, so memory is bounded and nothing is shuffled; only the last rows of
a buffer are left with gaps.

A result row is a row of the id matrix: input_ids are ROW little-endian numbers of ID_BYTES bytes, padded with the end id;
cu_seqlens are the cumulative lengths 0, n1, n1 + n2, ... of its pieces; position_resets are the places at which position
ids start from 0 again, the padding included; doc_ids and doc_starts name each piece's document and its first id there.

Defined cases: null and empty texts are the end id alone; a null id is a null in doc_ids; rows that repeat an id are separate
documents (each has a piece with start 0); ids of special tokens are never made from text; bytes that aren't UTF-8 are
replaced; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import array
import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
ROW = 2048
BUFFER = 1 << 22
ID_BYTES = 2
RESULT = "shard int, row long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"
RESULT_ARROW = pa.schema(
    [("shard", pa.int32()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))]
)


class Rooms:
    """Rows by free length, in a segment tree of counts."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        at = free + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free length, row) of a row with the smallest free length of at least need."""
        at, count = need + self.size, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up to where something larger hangs on the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not count[at]:
                    at += 1
        free = at - self.size
        row = self.rows[free].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return free, row


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Pieces of each row; lengths are at most most."""
    rooms = Rooms(most)
    rows: list[list[int]] = []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = rooms.take(lengths[piece])
        if got is None:
            got = most, len(rows)
            rows.append([])
        free, row = got
        rows[row].append(piece)
        if free > lengths[piece]:
            rooms.add(free - lengths[piece], row)
    return rows


def encoder(lines: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
    return tiktoken.Encoding("barloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def packed(docs: Iterator[tuple[int | None, array.array]], row: int, end: int, buffer: int, id_bytes: int) -> Iterator[tuple]:
    """(tokens, input_ids, cu_seqlens, position_resets, doc_ids, doc_starts) of each row."""
    kind = {2: "<u2", 4: "<u4"}[id_bytes]

    def flush(pieces):
        for members in best_fit([len(p[2]) for p in pieces], row):
            parts = [pieces[m] for m in members]
            cuts = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])])
            total = int(cuts[-1])
            ids = np.full(row, end, kind)
            ids[:total] = np.concatenate([p[2] for p in parts])
            yield total, ids.tobytes(), cuts.tolist(), cuts[: len(parts) + (total < row)].tolist(), [p[0] for p in parts], [p[1] for p in parts]

    pieces, held = [], 0
    for doc, ids in docs:
        ids = np.frombuffer(ids, "u2" if ids.itemsize == 2 else "u4")
        for lo in range(0, len(ids), row):
            pieces.append((doc, lo, ids[lo : lo + row]))
            held += len(pieces[-1][2])
            if held >= buffer:
                yield from flush(pieces)
                pieces, held = [], 0
    yield from flush(pieces)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, row: int = ROW, end: int = END, buffer: int = BUFFER, id_bytes: int = ID_BYTES) -> DataFrame:
    with open(vocabulary, "rb") as f:  # the driver's; tasks get the bytes
        lines = docs.sparkSession.sparkContext.broadcast(f.read())
    code = "H" if id_bytes == 2 else "I"

    def run(it):
        enc = encoder(lines.value)
        shard = TaskContext.get().partitionId()

        def encoded():
            for batch in it:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = text.as_buffer().to_pybytes().decode("utf-8", "replace") if text.is_valid else ""
                    ids = array.array(code, enc.encode_ordinary(text))
                    ids.append(end)
                    yield doc, ids

        held, n = [], 0
        for got in packed(encoded(), row, end, buffer, id_bytes):
            held.append((shard, n, *got))
            n += 1
            if len(held) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), RESULT_ARROW, strict=True)], schema=RESULT_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), RESULT_ARROW, strict=True)], schema=RESULT_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def positions(resets: list[int], row: int) -> np.ndarray:
    """Position ids of a row from its resets."""
    at = np.arange(row)
    starts = np.array(resets)
    return at - starts[np.searchsorted(starts, at, "right") - 1]
