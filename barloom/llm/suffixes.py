"""Suffix array and common-prefix values of a text by external induced sorting (eSAIS; Bingmann, Fischer, Osipov, 2013).

Suffixes are of type S or L (smaller or larger than the next); leftmost S suffixes (LMS) cut the text into substrings. Their
order is found by inducing, they are named, the string of names is sorted by recursion (or, once it fits BASE, by doubling in
memory), and from the sorted LMS suffixes all L and then all S suffixes are induced, each together with its common prefix with
the one before: one more than the smallest value passed since the last suffix put under the same character.

The priority queue's keys only rise (L) or fall (S) and entries of a character come out in the order in which they went in. So
it is a row of first-in-first-out queues, one per range of characters; ranges are cut from the character counts so that one
holds at most a batch, unless it is a single character, which is streamed. Entries carry character, place and common prefix.
All queues together keep HELD entries; beyond that all of them go to one new run file at once, so the files are as many as
entries / HELD. Arrays of more than HELD entries (text, types, runs, LMS places, names, orders) are files of the scratch folder,
mapped, and let go of after every few batches. Memory is bounded by HELD, BATCH and BASE, and two numbers a character of the
alphabet; it doesn't grow with the text.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterator

import numpy as np

from . import textscan as ts

HELD = 1 << 21
BATCH = 1 << 18
BASE = 1 << 22
FAR = 2**62
Batches = Iterator[tuple[np.ndarray, np.ndarray]]


class Scratch:
    """Files of one sort; arrays up to held entries stay in memory."""

    def __init__(self, held: int = HELD, batch: int = BATCH, base: int = BASE):
        self.folder = tempfile.TemporaryDirectory(prefix="suffixes-")
        self.held, self.batch, self.base, self.n, self.waiting = held, batch, base, 0, 0
        self.maps: dict[str, mmap.mmap] = {}
        self.queues: list[Rows] = []

    def path(self) -> str:
        self.n += 1
        return os.path.join(self.folder.name, str(self.n))

    def array(self, n: int, kind) -> np.ndarray:
        if n <= self.held:
            return np.zeros(n, kind)
        path = self.path()
        out = np.memmap(path, kind, "w+", shape=(n,))
        self.maps[path] = out._mmap
        return out

    def done(self, *arrays: np.ndarray) -> None:
        for a in arrays:
            if isinstance(a, np.memmap):
                self.maps.pop(str(a.filename), None)
                os.remove(a.filename)

    def relax(self) -> None:
        """Mapped pages stay in the files and leave this process."""
        for m in self.maps.values():
            m.madvise(mmap.MADV_DONTNEED)

    def spill(self) -> None:
        path, at = self.path(), 0
        with open(path, "wb") as f:
            for q in self.queues:
                if q.parts:
                    whole = q.merged()
                    f.write(whole.tobytes())
                    q.runs.append((path, at, len(whole)))
                    at += whole.nbytes
                    q.parts = []
        self.waiting = 0
        self.relax()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.queues, self.maps = [], {}
        self.folder.cleanup()


class Rows:
    """Rows of numbers, appended, read in any order; what isn't in a run file yet is in memory."""

    def __init__(self, scratch: Scratch, width: int, wide: bool):
        self.scratch, self.width, self.kind = scratch, width, np.dtype(np.int64 if wide else np.int32)
        self.parts: list[tuple] = []
        self.runs: list[tuple[str, int, int]] = []
        self.n, self.read = 0, 0
        scratch.queues.append(self)

    def put(self, *columns: np.ndarray) -> None:
        n = len(columns[0])
        self.parts.append(columns)
        self.n += n
        self.scratch.waiting += max(n, 16)  # small parts cost more than their numbers
        if self.scratch.waiting > self.scratch.held:
            self.scratch.spill()

    def merged(self) -> np.ndarray:
        n = sum(len(p[0]) for p in self.parts)
        out = np.empty((n, self.width), self.kind)
        for k in range(self.width):
            np.concatenate([p[k] for p in self.parts], out=out[:, k], casting="unsafe")
        return out

    def slice(self, lo: int, hi: int) -> list[np.ndarray]:
        out, at = [], 0
        for path, offset, n in self.runs:
            a, b = max(lo - at, 0), min(hi - at, n)
            if a < b:
                step = self.width * self.kind.itemsize
                out.append(np.fromfile(path, self.kind, self.width * (b - a), offset=offset + step * a).reshape(-1, self.width))
            at += n
            if at >= hi:
                break
        if at < hi and self.parts:
            if len(self.parts) > 1:
                whole = self.merged()
                self.parts = [tuple(whole[:, k] for k in range(self.width))]
            a, b = max(lo - at, 0), hi - at
            out.append(np.stack([c[a:b] for c in self.parts[0]], axis=1))
        got = np.concatenate(out).astype(np.int64) if out else np.zeros((0, self.width), np.int64)
        return [got[:, k] for k in range(self.width)]

    def fresh(self) -> list[np.ndarray]:
        """The next batch that wasn't read yet."""
        hi = min(self.n, self.read + self.scratch.batch)
        got = self.slice(self.read, hi)
        self.read = hi
        return got

    def drop(self) -> None:
        self.scratch.queues.remove(self)
        self.parts, self.runs, self.n = [], [], 0


def _blocks(n: int, step: int) -> Iterator[tuple[int, int]]:
    for lo in range(0, n, step):
        yield lo, min(n, lo + step)


class Text:
    """A text with its types, runs of equal characters and LMS places."""

    def __init__(self, text: np.ndarray, scratch: Scratch):
        n, step = len(text), scratch.batch
        self.text, self.n, self.scratch, self.wide = text, n, scratch, n >= 2**31
        kind = np.int64 if self.wide else np.int32
        self.is_s, self.run = scratch.array(n, bool), scratch.array(n, kind)
        self.sigma = max(int(text[lo:hi].max()) for lo, hi in _blocks(n, step)) + 1
        self.n_l, self.n_s, self.n_m = (scratch.array(self.sigma, np.int64) for _ in range(3))
        later_s, later_run, later_char = False, 0, -1
        for lo in range((n - 1) // step * step, -1, -step):  # from the end
            x = np.asarray(text[lo : lo + step]).astype(np.int64)
            m = len(x)
            end = np.append(np.flatnonzero(x[1:] != x[:-1]), m - 1)  # where each run of equal characters ends
            which = np.searchsorted(end, np.arange(m))
            r = end[which] - np.arange(m) + 1
            s = np.append(x, later_char)[end + 1] > x[end]
            if later_char == x[-1]:
                s[-1] = later_s
                r[which == len(end) - 1] += later_run
            types = s[which]
            self.is_s[lo : lo + m], self.run[lo : lo + m] = types, r
            for of, c in ((self.n_l, x[~types]), (self.n_s, x[types])):
                c, k = np.unique(c, return_counts=True)
                of[c] += k
            later_s, later_run, later_char = bool(s[0]), int(r[0]), int(x[0])
        for count in (True, False):
            at = 0
            for lo, hi in _blocks(n, step):
                before = np.asarray(self.is_s[max(lo - 1, 0) : hi])
                here = np.flatnonzero(before[1:] & ~before[:-1]) + max(lo, 1)
                if not count:
                    self.lms[at : at + len(here)] = here
                    c, k = np.unique(np.asarray(text[here]), return_counts=True)
                    self.n_m[c] += k
                at += len(here)
            if count:
                self.lms = scratch.array(at, kind)
            scratch.relax()
        self.edges = self._ranges()

    def _ranges(self) -> np.ndarray:
        """Borders of the ranges of characters."""
        total = np.concatenate([[0], np.cumsum(self.n_l + self.n_s)])
        edges = [0]
        while edges[-1] < self.sigma:
            edges.append(max(edges[-1] + 1, int(np.searchsorted(total, total[edges[-1]] + self.scratch.batch, "right")) - 1))
        return np.array(edges)

    def close(self) -> None:
        self.scratch.done(self.is_s, self.run, self.n_l, self.n_s, self.n_m, self.lms)


class Pass:
    """One pass over the characters: scanned suffixes put those before them, of the pass's type, under their characters."""

    def __init__(self, of: Text, s_pass: bool):
        self.of, self.s_pass = of, s_pass
        scratch, many = of.scratch, len(of.edges) - 1
        self.last, self.tail = scratch.array(of.sigma, np.int64), scratch.array(of.sigma, np.int64)  # 0: none yet, else batch + 1
        self.queues: list[Rows | None] = [None] * many
        self.out = Rows(scratch, 2, of.wide)  # in the order of the scan
        self.now = 1
        self.times: list[int] = []
        self.lows: list[int] = []  # smallest values since each of times, rising
        self.range, self.local = -1, {}

    def put(self, d: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> None:
        """Entries sorted by character to the queues of their ranges; to lists where it is the range at work."""
        r = np.searchsorted(self.of.edges, d, "right") - 1
        cut = np.flatnonzero(ts.new_group(r)).tolist()
        for a, b in zip(cut, [*cut[1:], len(r)], strict=True):
            k = int(r[a])
            single = self.of.edges[k + 1] - self.of.edges[k] == 1
            if k == self.range and not single:
                some = (np.flatnonzero(ts.new_group(d[a:b])) + a).tolist()
                for x, y in zip(some, [*some[1:], b], strict=True):
                    self.local.setdefault(int(d[x]), []).append((place[x:y], lcp[x:y]))
                continue
            if self.queues[k] is None:
                self.queues[k] = Rows(self.of.scratch, 2 if single else 3, self.of.wide)
            self.queues[k].put(*((place[a:b], lcp[a:b]) if single else (place[a:b], lcp[a:b], d[a:b])))

    def first(self, place: int) -> None:
        """An entry that nothing scanned has put there."""
        c = int(self.of.text[place])
        self.last[c], self.tail[c] = 1, FAR
        self.put(np.array([c]), np.array([place]), np.array([0]))

    def scan(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """The next suffixes of the scan with the values they share with the one scanned before."""
        of = self.of
        self.now += 1
        y = np.flatnonzero(at > 0)
        prev = at[y] - 1
        want = np.asarray(of.is_s[prev]) == self.s_pass
        prev, y = prev[want], y[want]
        if len(y):
            d = np.asarray(of.text[prev]).astype(np.int64)
            if len(d) > 1:
                by = np.argsort(d.astype(np.uint16) if of.sigma <= 65536 else d, kind="stable")
                d, prev, y = d[by], prev[by], y[by]
            head = ts.new_group(d)
            first = np.flatnonzero(head)
            idx = np.empty(2 * len(y), np.int64)
            idx[::2], idx[1::2] = np.where(head, 0, np.append(0, y[:-1] + 1)), y + 1
            longer = np.append(lcp, FAR)
            low = np.minimum.reduceat(longer, idx)[::2]
            since = np.asarray(self.last[d[first]])
            rest = np.append(self.lows, FAR)[np.searchsorted(self.times, since, "right")]
            low[first] = np.where(since > 0, np.minimum(np.minimum(low[first], self.tail[d[first]]), rest), -1)
            tail = np.minimum.accumulate(longer[::-1])[::-1]
            self.last[d[first]], self.tail[d[first]] = self.now, tail[y[np.append(first[1:], len(y)) - 1] + 1]
            self.put(d, prev, low + 1)
        least = int(lcp.min())
        while self.lows and self.lows[-1] >= least:
            self.lows.pop()
            self.times.pop()
        self.lows.append(least)
        self.times.append(self.now)

    def entries(self, k: int) -> Iterator[tuple[int, Batches]]:
        """(character, batches of its entries in order) of a range. Batches are scanned as they are read, and may add to their own character."""
        of, lo, hi = self.of, int(self.of.edges[k]), int(self.of.edges[k + 1])
        self.range, self.local = k, {}
        there = np.flatnonzero((of.n_s if self.s_pass else of.n_l + of.n_m)[lo:hi] + (of.n_l[lo:hi] if self.s_pass else 0)) + lo
        queue = self.queues[k]
        if hi - lo == 1:

            def stream():
                while self.queues[k] is not None and self.queues[k].read < self.queues[k].n:
                    yield self.given(*self.queues[k].fresh())

            yield lo, stream()
        else:
            place, lcp, d = queue.slice(0, queue.n) if queue is not None else (np.zeros(0, np.int64),) * 3
            by = np.argsort(d, kind="stable")
            place, lcp, d = place[by], lcp[by], d[by]
            start, end = np.searchsorted(d, there), np.searchsorted(d, there, "right")
            which = range(len(there))
            for i in reversed(which) if self.s_pass else which:
                c, a, b = int(there[i]), int(start[i]), int(end[i])

                def known(c=c, a=a, b=b):
                    if a < b:
                        yield self.given(place[a:b], lcp[a:b])
                    while c in self.local:
                        some = self.local.pop(c)
                        yield self.given(*(np.concatenate([s[j] for s in some]) if len(some) > 1 else some[0][j] for j in range(2)))

                yield c, known()
        if self.queues[k] is not None:
            self.queues[k].drop()
            self.queues[k] = None

    def given(self, at, lcp):
        self.out.put(at, lcp)
        return at, lcp

    def close(self) -> None:
        self.of.scratch.done(self.last, self.tail)
        self.out.drop()


def _offsets(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


def _joint(of: Text, one: int, two: int) -> int:
    """What an L and an S suffix of one character share: the shorter run."""
    return min(int(of.run[one]), int(of.run[two])) if one >= 0 else 0


def _induce(of: Text, places: np.ndarray, lcps: np.ndarray) -> tuple[Rows, Rows]:
    """L suffixes by rising and S suffixes by falling order, from the LMS suffixes' places by character with common prefixes."""
    scratch, step = of.scratch, of.scratch.batch
    ls, begin = Pass(of, False), _offsets(of.n_m)
    ls.first(of.n - 1)  # the last suffix is L and the smallest of its character
    for k in range(len(of.edges) - 1):
        for c, batches in ls.entries(k):
            last = -1
            for at, lcp in batches:
                ls.scan(at, lcp)
                last = int(at[-1])
            for lo in range(int(begin[c]), int(begin[c + 1]), step):
                hi = min(int(begin[c + 1]), lo + step)
                at, lcp = np.asarray(places[lo:hi]).astype(np.int64), np.asarray(lcps[lo:hi]).astype(np.int64)
                if lo == begin[c]:
                    lcp[0] = _joint(of, last, int(at[0]))
                ls.scan(at, lcp)
        scratch.relax()
    ss, begin = Pass(of, True), _offsets(of.n_l)
    for k in range(len(of.edges) - 2, -1, -1):
        lo, hi = int(begin[of.edges[k]]), int(begin[of.edges[k + 1]])
        few = of.edges[k + 1] - of.edges[k] > 1
        held = ls.out.slice(lo, hi) if few else None
        for c, batches in ss.entries(k):
            smallest, prior = -1, 0
            for at, lcp in batches:  # values are shared with the next larger suffix
                ss.scan(at, lcp)
                smallest = int(at[-1])
            a, b = int(begin[c]), int(begin[c + 1])
            for end in range(b, a, -step):
                start = max(a, end - step)
                at, lcp = (x[start - lo : end - lo] for x in held) if few else ls.out.slice(start, end)
                at, lcp = at[::-1], lcp[::-1]  # values are shared with the next smaller one
                shifted = np.append(prior, lcp[:-1])
                if end == b:
                    shifted[0] = _joint(of, smallest, int(at[0]))
                ss.scan(at, shifted)
                prior = int(lcp[-1])
        scratch.relax()
    for p in (ls, ss):
        scratch.done(p.last, p.tail)
    return ls.out, ss.out


def _in_order(of: Text, ls: Rows, ss: Rows) -> Batches:
    """Batches of (places, common prefix with the one before) of all suffixes."""
    step, l_at, s_at = of.scratch.batch, _offsets(of.n_l), _offsets(of.n_s)

    def rising(lo, hi):
        at, lcp = ss.slice(ss.n - hi, ss.n - lo)
        return at[::-1], lcp[::-1]

    for lo, hi in zip(of.edges[:-1].tolist(), of.edges[1:].tolist(), strict=True):
        if hi - lo == 1:
            last = -1
            for a, b in _blocks(int(of.n_l[lo]), step):
                at, lcp = ls.slice(int(l_at[lo]) + a, int(l_at[lo]) + b)
                last = int(at[-1])
                yield at, lcp
            prior = None
            for a, b in _blocks(int(of.n_s[lo]), step):
                at, lcp = rising(int(s_at[lo]) + a, int(s_at[lo]) + b)
                yield at, np.append(_joint(of, last, int(at[0])) if prior is None else prior, lcp[:-1])
                prior = int(lcp[-1])
            continue
        chars = np.arange(lo, hi)
        at, lcp = ls.slice(int(l_at[lo]), int(l_at[hi]))
        s_place, s_lcp = rising(int(s_at[lo]), int(s_at[hi]))
        c, s_char = np.repeat(chars, of.n_l[lo:hi]), np.repeat(chars, of.n_s[lo:hi])
        if len(s_place):
            s_lcp = np.append(0, s_lcp[:-1])
            head = np.flatnonzero(ts.new_group(s_char))
            before = np.searchsorted(c, s_char[head], "right") - 1  # the largest L suffix up to the character
            same = (before >= 0) & (c[before] == s_char[head]) if len(c) else np.zeros(len(head), bool)
            s_lcp[head] = 0
            s_lcp[head[same]] = np.minimum(of.run[at[before[same]]], of.run[s_place[head[same]]])
        by = np.argsort(np.concatenate([c, s_char]), kind="stable")
        if len(by):
            yield np.concatenate([at, s_place])[by], np.concatenate([lcp, s_lcp])[by]
        of.scratch.relax()


def _common(text: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray, work: int) -> np.ndarray:
    """How many characters from p and q on are equal, up to most: compared in wider and wider strips, work characters at a time."""
    out = np.zeros(len(p), np.int64)
    left, width = np.flatnonzero(most > 0), 4
    while len(left):
        go_on = []
        for lo in range(0, len(left), max(1, work // width)):
            some = left[lo : lo + max(1, work // width)]
            k = np.minimum(out[some][:, None] + np.arange(width), most[some][:, None] - 1)
            equal = np.asarray(text[p[some][:, None] + k]) == np.asarray(text[q[some][:, None] + k])
            n = np.where(equal.all(axis=1), width, np.argmin(equal, axis=1))
            out[some] = np.minimum(out[some] + n, most[some])
            go_on.append(some[(n == width) & (out[some] < most[some])])
        left, width = np.concatenate(go_on), min(4 * width, max(4, work))
    return out


def _doubling(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes in memory: ranks of 1, 2, 4, ... characters; prefixes by descending through them."""
    n = len(text)
    key, k, ranks = np.asarray(text).astype(np.int64), 1, []
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(ts.new_group(key[order])) - 1
        ranks.append(rank)
        if n <= 1 or rank[order[-1]] == n - 1:
            break
        key = rank.astype(np.int64) * (n + 1)
        if k < n:
            key[: n - k] += rank[k:] + 1
        k *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r = ranks[level]
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[r[a[inside]] == r[b[inside]]]
        # a rank of 2**level characters may be of a suffix that ends before: such ranks are unique
        a[same] += 1 << level
        b[same] += 1 << level
        lcp[1:][same] += 1 << level
    return order, lcp


def suffix_array(text: np.ndarray, scratch: Scratch) -> Batches:
    """Batches of (places, common prefix with the suffix before) in the order of the suffixes of a text of numbers >= 0."""
    n, step = len(text), scratch.batch
    if n <= 2:
        yield _doubling(text)
        return
    of = Text(text, scratch)
    lms, m = of.lms, len(of.lms)
    kind = of.run.dtype
    places, lcps = scratch.array(m, kind), scratch.array(m, kind)
    if m:
        order = _lms_order(of, places, lcps)
        before, at = -1, 0
        for number, equal in order:
            a, b = np.append(before, number[:-1]), number
            places[at : at + len(b)] = lms[b]
            if at == 0:
                a, b, equal = a[1:], b[1:], equal[1:]
            lcps[at + len(number) - len(b) : at + len(number)] = _lms_common(of, a, b, equal)
            at, before = at + len(number), int(number[-1])
            scratch.relax()
    ls, ss = _induce(of, places, lcps)
    scratch.done(places, lcps)
    yield from _in_order(of, ls, ss)
    ls.drop()
    ss.drop()
    of.close()


def _lms_order(of: Text, places: np.ndarray, lcps: np.ndarray) -> Batches:
    """Batches of (numbers of LMS places in the order of their suffixes, how many substrings they share with the one before)."""
    text, lms, m, scratch, step = of.text, of.lms, len(of.lms), of.scratch, of.scratch.batch
    free = _offsets(of.n_m)[:-1].copy()
    for lo, hi in _blocks(m, step):  # by character, in any order of one character
        c = np.asarray(text[lms[lo:hi]]).astype(np.int64)
        by = np.argsort(c, kind="stable")
        cut = np.flatnonzero(ts.new_group(c[by]))
        size = np.diff(np.append(cut, len(by)))
        places[np.repeat(free[c[by][cut]] - cut, size) + np.arange(len(by))] = lms[lo:hi][by]
        free[c[by][cut]] += size
    ls, ss = _induce(of, places, lcps)
    ls.drop()
    # LMS substrings in order get names; the last one ends with the text and is like no other
    subs, names = scratch.array(m, lms.dtype), scratch.array(m, lms.dtype)
    at, name, before = 0, -1, -1
    for hi in range(ss.n, 0, -step):
        place = ss.slice(max(0, hi - step), hi)[0][::-1]
        place = place[place > 0]
        place = place[~np.asarray(of.is_s[place - 1])]
        if not len(place):
            continue
        number = np.searchsorted(lms, place)
        p, q = np.append(before, number[:-1]), number
        same = (p >= 0) & (p < m - 1) & (q < m - 1)
        same[same] = (lms[p[same] + 1] - lms[p[same]]) == (lms[q[same] + 1] - lms[q[same]])
        some = np.flatnonzero(same)
        size = (lms[q[some] + 1] - lms[q[some]] + 1).astype(np.int64)
        same[some] = _common(text, lms[p[some]], lms[q[some]], size, 4 * step) == size
        named = name + np.cumsum(~same)
        names[number], subs[at : at + len(number)] = named, number
        at, name, before = at + len(number), int(named[-1]), int(number[-1])
        scratch.relax()
    ss.drop()
    if name + 1 == m:
        for lo, hi in _blocks(m, step):
            yield np.asarray(subs[lo:hi]).astype(np.int64), np.zeros(hi - lo, np.int64)
        scratch.done(subs, names)
        return
    scratch.done(subs)
    if m <= scratch.base:
        order, equal = _doubling(names)
        for lo, hi in _blocks(m, step):
            yield order[lo:hi], equal[lo:hi]
    else:
        yield from suffix_array(names, scratch)
    scratch.done(names)


def _lms_common(of: Text, a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Common prefixes of LMS suffixes a and b that share so many substrings and then differ, or one ends."""
    n, m, lms = of.n, len(of.lms), of.lms

    def place(k):
        return np.where(k < m, lms[np.minimum(k, m - 1)], n).astype(np.int64)

    p, q, u, v = place(a), place(b), place(a + equal), place(b + equal)
    out = u - p
    inside = np.flatnonzero(np.maximum(a, b) + equal < m)
    u, v = u[inside], v[inside]
    most = np.minimum(np.minimum(place((a + equal)[inside] + 1), n - 1) - u, np.minimum(place((b + equal)[inside] + 1), n - 1) - v) + 1
    same = _common(of.text, u, v, most, 4 * of.scratch.batch)
    same[same == most] -= 1  # the shorter one's last character is of type S, the same one of the other of type L
    u, v = u + same, v + same
    more = of.text[u] == of.text[v]
    same[more] += np.minimum(of.run[u[more]], of.run[v[more]])  # they differ in type alone: the shorter run is common, too
    out[inside] += same
    return np.minimum(out, n - np.maximum(p, q))
