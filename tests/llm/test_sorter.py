"""The suffix sorter on texts far larger than what it may hold."""

import tracemalloc

import numpy as np
import pytest

from barloom.llm import suffixes


def doubled(n, words=400, seed=5):
    """Two copies of a text of words that differ every 200 characters."""
    rng = np.random.default_rng(seed)
    some = [rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8).tobytes() + b" " for _ in range(words)]
    half = np.frombuffer(b"".join(some[i] for i in rng.zipf(1.3, n) % words)[: n // 2], np.uint8).astype(np.int64)
    other = half.copy()
    other[::200] ^= 1
    return np.concatenate([half, other])


def sorted_with(text, **scratch):
    with suffixes.Scratch(**scratch) as files:
        got = list(suffixes.suffix_array(text, files))
        return *(np.concatenate([g[k] for g in got]) for k in (0, 1)), files.n


@pytest.mark.parametrize("n", [3000, 40000])
def test_small_limits_give_the_same_order(n):
    text = doubled(n)
    one = sorted_with(text)
    for limits in ({"held": 500, "batch": 100, "base": 50}, {"held": 2000, "batch": 4000, "base": 300}):
        sa, lcp, _ = sorted_with(text, **limits)
        assert np.array_equal(sa, one[0]) and np.array_equal(lcp[1:], one[1][1:])


def test_memory_and_files_are_bounded():
    held, peaks = 1 << 14, []
    for n in (1 << 17, 1 << 19):  # 8 and 32 times what may be held
        text = doubled(n)
        tracemalloc.start()
        with suffixes.Scratch(held=held, batch=1 << 12, base=1 << 13) as scratch:
            k = sum(len(at) for at, _ in suffixes.suffix_array(text, scratch))
            files = scratch.n
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert k == n and files <= 60 * n // held
        peaks.append(most)
    assert peaks[1] < 2 * peaks[0] and peaks[1] < 4 << 20  # a text four times as long; lists of run files grow a little
