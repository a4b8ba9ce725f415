"""Benchmark decontamination within an edit distance.

Texts and items are compared as bytes of their lower-cased words, joined by one blank. A document is contaminated by an
item if some part of it is at most edits(length) byte edits from the item: RATE of its length, so 0 under 20 bytes.

Windows: items are put in classes of similar lengths. A window starts with a word, or where the benchmark's grams begin (so that
an unchanged item is met wherever it stands), and is as long as the shortest
item of a class, or LONGEST bytes, of which longer items have several. Only windows are looked at whose surroundings hold as many GRAM-byte strings of the benchmark, whichever, as
the q-gram lemma asks of a match of the class; it names no item and loses no match.
CGK: the random walk of Chakraborty, Goldenberg and Koucky maps items and windows to strings whose Hamming distance follows
their edit distance (a shared random bit per step and byte says whether to move on).
Bit sampling finds the candidates: of each of WALKS walks, TABLES samples of SAMPLED places make codes, and a window meets the
items of its class that have one of its codes. All starts near a match are tried, each by WALKS * TABLES codes. A window that
equals an item has all its codes. recall() measures what share of edited items is found, by kind of edit.
Exact verification: Myers' bit-parallel distance of the item to any part of the text around the windows that met it.

Items are worked through in blocks of at most BLOCK_BYTES (or one item), one after the other, each broadcast and let go of
before the next.

Defined cases: null, empty and word-less texts are clean; items without words match nothing; items of equal text are all
reported; items shorter than GRAM bytes match as whole words; null item ids are reported as null, after the others; rows
that repeat an id are separate documents; an empty benchmark leaves all clean; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textscan as ts

RATE = 0.05
GRAM = 8
DENSE = 64
WALKS, TABLES, SAMPLED = 4, 24, 4
RATIO = 1.25
"""Between the longest and the shortest item of a class."""
LONGEST = 512
"""Bytes of a window at most; longer items have one window after the other."""
STEPS = 2
"""Steps of a walk per byte of a window."""
WINDOWS = 2048
"""Windows that are embedded at once."""
SEED = 20240305
BLOCK_BYTES = 8 << 20
FILTER_BITS, KEY_BITS = 22, 20
BLANK = re.compile(r"[\W_]+")


def normal(text: str) -> bytes:
    return BLANK.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def normal_chunk(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal bytes of a chunk of texts, each ended by one zero, and where each begins. ASCII and Latin-1 texts are
    done for the whole chunk at once; a chunk with other symbols or letters is done text by text."""
    raw = data.tobytes()
    if int((data > 0xC3).any()) or int((data == 0xC2).any()):
        parts = [normal(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        out = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8)
        return out, np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    low = ts.LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    second = low[lead]
    up = (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    low[lead[up]] += 32
    sign = lead[(second == 0x97) | (second == 0xB7)]  # multiplication and division sign: not letters
    word = _WORD[low]
    word[sign] = False
    word[sign - 1] = False
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offs[:-1][offs[:-1] < offs[1:]]
    first[begins] = word[begins]
    # a blank before each word but a document's first
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    heads = np.flatnonzero(first)
    new_doc = np.ones(len(heads), bool)
    new_doc[1:] = row[heads[1:]] != row[heads[:-1]]
    extra = np.zeros(len(data), np.int64)
    extra[heads[~new_doc]] = 1
    kept = np.flatnonzero(word)
    krow = row[kept]
    place = np.arange(len(kept)) + np.cumsum(extra)[kept] + krow
    total = len(kept) + int(extra.sum()) + len(offs) - 1
    out = np.full(total, 32, np.uint8)
    out[place] = low[kept]
    ends = np.cumsum(np.bincount(krow, minlength=len(offs) - 1) + np.bincount(row[heads[~new_doc]], minlength=len(offs) - 1) + 1)
    out[ends - 1] = 0
    return out, np.concatenate([[0], ends])


def edits(length: int, rate: float = RATE) -> int:
    """What an item of that length may differ by; 0 if the q-gram bound would then ask for no gram."""
    most = int(length * rate)
    return most if length - GRAM + 1 - GRAM * most > 0 else 0


def grams(x: np.ndarray) -> np.ndarray:
    """Each GRAM bytes in a row as a number."""
    if len(x) < GRAM:
        return np.zeros(0, np.uint64)
    x = np.ascontiguousarray(x)
    return np.ndarray((len(x) - GRAM + 1,), "<u8", x, strides=(1,)).copy()


def spot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def walks(x: np.ndarray, steps: int, bits: np.ndarray) -> np.ndarray:
    """CGK embeddings [steps, walks, rows] of each row of x (bytes, 0 beyond the row's end) by tables of bits [steps, walks * 256]."""
    n, width = x.shape
    padded = np.zeros((n, width + 1), np.uint8)
    padded[:, :width] = x
    flat, begin = padded.ravel(), np.arange(n) * (width + 1)
    tables = bits.shape[1] // 256
    at, table = np.tile(begin, (tables, 1)), (np.arange(tables) * 256)[:, None]
    out = np.empty((steps, tables, n), np.uint8)
    for step in range(steps):
        c = flat.take(at, out=out[step], mode="clip")
        at += bits[step].take(c + table)
        np.minimum(at, begin + width, out=at)
    return out


def distance(item: bytes, text: bytes) -> int:
    """Smallest edit distance of item to any part of text (Myers, 1999, on whole integers)."""
    m = len(item)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best = ones, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & ones), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & ones, mh << 1 & ones
        pv, mv = mh | (~(xv | ph) & ones), ph & xv
        best = min(best, score)
    return best


class Sized:
    """Items of a class of lengths, with the codes of their first bytes."""

    def __init__(self, members: list[int], texts: list[bytes], limit: list[int], number: int):
        self.lo, self.hi = min(len(texts[k]) for k in members), max(len(texts[k]) for k in members)
        self.wide = min(self.lo, LONGEST)
        self.edits = max(limit[k] for k in members)
        self.need = min(len(texts[k]) - GRAM + 1 - GRAM * limit[k] for k in members)
        self.steps = STEPS * self.wide
        rng = np.random.default_rng([SEED, number])
        self.bits = rng.integers(0, 2, (self.steps, WALKS * 256), dtype=np.int64)
        self.picks = (rng.random((WALKS, TABLES, SAMPLED)) * self.steps).astype(np.int64)
        self.salts = ts.mix(np.arange(WALKS * TABLES, dtype=np.uint64) + np.uint64(number << 20))
        parts = [(k, at) for k in members for at in range(0, len(texts[k]) - self.wide + 1, self.wide)]
        keys = np.concatenate([self.codes(np.stack([np.frombuffer(texts[k], np.uint8)[at : at + self.wide] for k, at in parts[i : i + WINDOWS]])) for i in range(0, len(parts), WINDOWS)])
        who, offset = (np.repeat(np.array(x, np.int64), keys.shape[1]) for x in zip(*parts, strict=True))
        order = np.argsort(keys, axis=None, kind="stable")
        self.keys, self.who, self.offset = keys.ravel()[order], who[order], offset[order]
        self.some = np.zeros(1 << KEY_BITS, bool)
        self.some[self.keys >> np.uint64(64 - KEY_BITS)] = True

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """[rows, WALKS * TABLES] codes."""
        shift = np.arange(SAMPLED, dtype=np.uint64)[:, None] * np.uint64(8)
        e = walks(rows, int(self.picks.max()) + 1, self.bits)
        out = [(e[self.picks[w, t], w].astype(np.uint64) << shift).sum(axis=0, dtype=np.uint64) for w in range(WALKS) for t in range(TABLES)]
        return ts.mix(np.stack(out, axis=1) ^ self.salts)

    def meet(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """[(window, item, where in the item)] of windows at start, in documents that end at end, that have a code of an item."""
        found = []
        for lo in range(0, len(start), WINDOWS):
            s = start[lo : lo + WINDOWS]
            at = s[:, None] + np.arange(self.wide)
            rows = np.where(at < end[lo : lo + WINDOWS, None], data[np.minimum(at, len(data) - 1)], np.uint8(0))
            keys = self.codes(rows).ravel()
            hit = np.flatnonzero(self.some[keys >> np.uint64(64 - KEY_BITS)])
            a = np.searchsorted(self.keys, keys[hit], "left")
            n = np.searchsorted(self.keys, keys[hit], "right") - a
            of = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(np.unique(np.stack([np.repeat(hit // (WALKS * TABLES), n) + lo, self.who[of], self.offset[of]]), axis=1))
        return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)


class Items:
    """A block of items: the grams that it holds, and its classes by length."""

    def __init__(self, items: list[tuple[int | None, bytes]], rate: float = RATE):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.limit = [edits(len(t), rate) for t in self.texts]
        self.short = [k for k, t in enumerate(self.texts) if 0 < len(t) < GRAM]
        full = [k for k, t in enumerate(self.texts) if len(t) >= GRAM]
        self.grams = {k: np.unique(grams(np.frombuffer(self.texts[k], np.uint8))) for k in full}
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        for g in self.grams.values():
            self.filter[spot(g)] = True
        # the lemma: places of a window that must hold one of the item's grams
        self.need = [max(1, len(t) - GRAM + 1 - GRAM * e) for t, e in zip(self.texts, self.limit, strict=True)]
        self.dense = min((-(-self.need[k] // -(-(len(self.texts[k]) + self.limit[k]) // DENSE)) for k in full), default=1)
        self.reach = max((len(self.texts[k]) + self.limit[k] for k in full), default=0)
        self.inside = self.reach if self.reach >= 2 * LONGEST else 0
        by: dict[int, list[int]] = {}
        for k in full:
            by.setdefault(int(math.log(len(self.texts[k])) / math.log(RATIO)), []).append(k)
        self.classes = [Sized(by[c], self.texts, self.limit, c) for c in sorted(by)]

    def near(self, hit: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Places from which a match may start: within reach of a stretch dense in grams. Any match has such a stretch, as
        its grams are at least need of the places of at most length / DENSE stretches."""
        edge = np.arange(0, len(hit) + DENSE, DENSE // 2)
        count = upto[np.minimum(edge + DENSE + DENSE // 2, len(hit))] - upto[np.minimum(edge, len(hit))]
        rich = edge[count >= self.dense]
        mark = np.zeros(len(hit) + 1, np.int32)
        np.add.at(mark, np.maximum(rich - self.reach, 0), 1)
        np.add.at(mark, np.minimum(rich + 2 * DENSE + self.inside, len(hit)), -1)
        return np.flatnonzero(np.cumsum(mark[:-1]) > 0)

    def found(self, data: np.ndarray, begin: np.ndarray, g: np.ndarray) -> tuple[list[dict[int, int]], list[tuple]]:
        """For each document of a normal chunk with grams g the short items that it holds; and what may hold others: (document, item,
        starts of the windows that met it)."""
        n = len(begin) - 1
        out: list[dict[int, int]] = [{} for _ in range(n)]
        maybe: list[tuple] = []
        raw = data.tobytes() if self.short else b""
        for k in self.short:
            for i in range(n):
                if b" " + self.texts[k] + b" " in b" " + raw[begin[i] : begin[i + 1] - 1] + b" ":
                    out[i][k] = 0
        if not len(g) or not self.classes:
            return out, maybe
        hit = self.filter[spot(g)]
        upto = np.zeros(len(hit) + 1, np.int32)
        np.cumsum(hit, out=upto[1:])
        place = self.near(hit, upto)
        begins = np.ones(len(hit), bool)  # of a word, a document, or a run of places with the benchmark's grams
        begins[1:] = (data[: len(hit) - 1] == 32) | (data[: len(hit) - 1] == 0) | (hit[1:] & ~hit[:-1])
        place = place[begins[place]]
        doc = np.searchsorted(begin, place, "right") - 1
        end = begin[doc + 1] - 1
        for c in self.classes:
            back = 0 if c.hi < 2 * c.wide else c.hi  # windows inside of long items
            stop = np.minimum(place + c.hi + c.edits - GRAM + 1, np.minimum(end, len(hit)))
            first = np.maximum(place - back, begin[doc])
            able = np.flatnonzero((upto[np.maximum(stop, place)] - upto[first] >= c.need) & (end - place >= c.wide - c.edits))
            window, item, offset = c.meet(data, place[able], end[able])
            if not len(window):
                continue
            at = able[window]
            start, of = np.maximum(place[at] - offset, begin[doc[at]]), doc[at]
            order = np.lexsort((start, item, of))
            start, item, of = start[order], item[order], of[order]
            cut = np.flatnonzero(ts.new_group(of, item))
            maybe += [(int(of[a]), int(item[a]), np.unique(start[a:b]) - begin[of[a]]) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(of)], strict=True)]
        return out, maybe

    def shared(self, k: int, g: np.ndarray) -> int:
        """How many of the grams are item k's."""
        own = self.grams[k]
        return int(np.count_nonzero(own.take(own.searchsorted(g), mode="clip") == g))

    def nearest(self, text: np.ndarray, g: np.ndarray, k: int, starts: np.ndarray) -> int | None:
        """Edits between item k and the most similar part of a text, with grams g, around the starts, if within the limit."""
        item, e, need, best = self.texts[k], self.limit[k], self.need[k], None
        if self.shared(k, g[max(0, starts[0] - e) : starts[-1] + len(item) + e]) < need:
            return None
        apart = np.flatnonzero(np.append(True, np.diff(starts) > e + 1)).tolist()
        for lo, hi in zip(apart, [*apart[1:], len(starts)], strict=True):
            a, b = max(0, int(starts[lo]) - e), int(starts[hi - 1]) + len(item) + e
            if item in (raw := text[a:b].tobytes()):
                return 0
            if e and self.shared(k, g[a:b]) >= need and (d := distance(item, raw)) <= e:
                best = d if best is None else min(best, d)
        return best

    def scan(self, texts: pa.Array) -> list[list[tuple[int | None, int]]]:
        out: list[list] = []
        for _, _, raw, offs in ts.chunks(texts):
            data, begin = normal_chunk(raw, offs)
            g = grams(data)
            found, maybe = self.found(data, begin, g)
            for d, k, starts in maybe:
                if (n := self.nearest(data[begin[d] : begin[d + 1] - 1], g[begin[d] : begin[d + 1] - 1], k, starts)) is not None:
                    found[d][k] = n
            out += [[(self.ids[k], e) for k, e in x.items()] for x in found]
        return out


def recall(items: list[bytes], kind: str, trials: int, rng: random.Random, rate: float = RATE) -> float:
    """Share of items found with as many substitutions, insertions or deletions as are allowed, inside other text."""
    known = Items(list(enumerate(items)), rate)
    texts, want = [], []
    words = b" ".join(items).split()
    for n in range(trials):
        k = n % len(items)
        b = bytearray(items[k])
        for _ in range(known.limit[k]):
            at = rng.choice([i for i in range(1, len(b) - 1) if all(32 < c < 128 for c in b[i - 1 : i + 2])])  # no lost blank or half a letter, which would count twice
            b[at : at + (kind != "insert")] = b"" if kind == "delete" else bytes([rng.choice(b"abcdefghijklmnopqrstuvwxyz")])
        some = [" ".join(rng.choice(words).decode() for _ in range(20)) for _ in range(2)]
        texts.append(f"{some[0]} {normal(b.decode('utf-8', 'replace')).decode()} {some[1]}")
        want.append(k)
    got = known.scan(pa.array(texts))
    exact = [distance(items[k], normal(t)) <= known.limit[k] for k, t in zip(want, texts, strict=True)]
    return sum(k in dict(g) for k, g, e in zip(want, got, exact, strict=True) if e) / sum(exact)


FOUND = "array<struct<item:bigint,edits:int>>"
FOUND_ARROW = pa.list_(pa.struct([("item", pa.int64()), ("edits", pa.int32())]))


def block_count(benchmark: DataFrame, most: int = BLOCK_BYTES) -> int:
    return -(-(benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most) or 1


def block(benchmark: DataFrame, i: int, n: int) -> Broadcast:
    """The i-th of n blocks of items by hash of their text: what the driver and the executors hold at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()
    items = sorted(((r["item_id"], normal(r["text"])) for r in some), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return benchmark.sparkSession.sparkContext.broadcast([x for x in items if x[1]])


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, contaminated, item_ids, edits), one row per input row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.array().cast(FOUND).alias("found"))
    n = block_count(benchmark, block_bytes)
    for i in range(n):
        held, last = block(benchmark, i, n), i + 1 == n

        def run(it, held=held, last=last):
            known = Items(held.value, rate)
            for batch in it:
                found = [x + [{"item": k, "edits": e} for k, e in y] for x, y in zip(batch.column("found").to_pylist(), known.scan(batch.column("text")), strict=True)]
                kept = ["doc_id"] if last else ["doc_id", "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, FOUND_ARROW)], names=[*kept, "found"])

        rows = rows.mapInArrow(run, f"doc_id long, {'' if last else 'text string, '}found {FOUND}")
        if not last:  # the next block's pass reads what this one has found, and this block goes
            rows = common.materialise(rows, "leaks")
            held.destroy()
    by = F.array_sort(F.transform("found", lambda x: F.struct(x["item"].isNull().alias("none"), x["item"].alias("item"), x["edits"].alias("edits"))))
    return rows.select("doc_id", (F.size("found") > 0).alias("contaminated"), by.alias("by")).select("doc_id", "contaminated", F.col("by.item").alias("item_ids"), F.col("by.edits").alias("edits"))


def keep(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, whole, that hold no item."""
    at, n = docs.columns.index("text"), block_count(benchmark, block_bytes)
    rows = docs
    for i in range(n):
        held = block(benchmark, i, n)

        def run(it, held=held):
            known = Items(held.value, rate)
            for batch in it:
                yield batch.filter(pa.array([not x for x in known.scan(batch.column(at).cast(pa.string()))], pa.bool_()))

        rows = rows.mapInArrow(run, docs.schema)
        if i + 1 < n:
            rows = common.materialise(rows, "clean")
            held.destroy()
    return rows
