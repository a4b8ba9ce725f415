"""Vectorised scanning of document texts: words, rolling hashes, winnowing, columns packed into blobs for the shuffle.

Texts are scanned in chunks of whole documents, about CHUNK bytes at a time, straight from Arrow's buffers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), CHUNK + 1)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    def __reduce__(self):
        return Powers, (int(self.base),)


FIRST, SECOND = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all (the usual two rounds of shift and multiply)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[start:end] whatever stands around them."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def gram_hashes(values: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """Hash of each k values in a row."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values, powers)
    return mix((sums[k:] - sums[:-k]) * powers(len(sums))[1][: len(values) - k + 1])


def sliding_argmin(a: np.ndarray, w: int) -> np.ndarray:
    """Where the first smallest of each w values in a row stands."""
    at, low, width = np.arange(len(a)), a, 1
    while width < w:
        step = min(width, w - width)
        n = len(low) - step
        if n <= 0:
            return np.zeros(0, np.int64)
        later = low[step : step + n] < low[:n]
        at, low = np.where(later, at[step : step + n], at[:n]), np.minimum(low[:n], low[step : step + n])
        width += step
    return at


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; a null text is empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets is not None else np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offs


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows with about most bytes; at least one row each."""
    data, offs = buffers(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and for each document the number of words before it (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SEPARATOR[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first, last = offs[:-1][offs[:-1] < offs[1:]], offs[1:][offs[:-1] < offs[1:]] - 1
    start[first], end[last] = inside[first], inside[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers = FIRST) -> np.ndarray:
    return span_hashes(prefix_sums(BYTE_VALUES[data], powers), start, end, powers)


def doc_tags(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """31 bits of each text: rows that share an id but not the text are told apart."""
    sums = prefix_sums(BYTE_VALUES[data], SECOND)
    return (span_hashes(sums, offs[:-1], offs[1:], SECOND) >> np.uint64(33)).astype(np.int32)


def owners(counts_upto: np.ndarray) -> np.ndarray:
    """The document of each item, from the number of items before each document."""
    return np.repeat(np.arange(len(counts_upto) - 1), np.diff(counts_upto))


# -- columns in blobs


def pack(columns: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blob, n: int, types: list) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        t = np.dtype(t)
        out.append(np.frombuffer(blob, t, n, at))
        at += n * t.itemsize
    return out


def bucketed(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, rows, blob) of each bucket that has rows; order is kept inside a bucket."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.size and bucket.max() < 65536 else bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(b))
    columns = [c[order] for c in columns]
    for lo, hi in zip(cuts.tolist(), ends.tolist(), strict=True):
        yield int(b[lo]), hi - lo, pack([c[lo:hi] for c in columns])


def by_bucket(it) -> Iterator[list]:
    """The slices of one bucket at a time, from batches sorted by their column bucket."""
    held, last = [], None
    for batch in it:
        keys = batch.column("bucket").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(new_group(keys)).tolist()
        for a, b in zip(cuts, [*cuts, len(keys)][1:], strict=True):
            if held and keys[a] != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield held


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """A bucket of n from the upper half of a hash, mixed again: the smallest hashes of windows are not evenly spread."""
    return ((mix(h) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def concat(parts: list[list[np.ndarray]], types: list) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(types)]


def new_group(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    if n:
        out[0] = True
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out
