"""op7 on texts that one boilerplate passage glues into a single candidate component of many chunks."""

import os
import random
from collections import Counter

import numpy as np

from barloom.llm import common, jaccard

DOCS = "doc_id long, text string"


def corpus(n: int = 300) -> list[tuple[int, str]]:
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        own = [word() for _ in range(40)]
        rows.append((i, " ".join(own[:20] + passage + own[20:])))
    for i in range(0, 40, 4):  # near copies: a word at the end goes, and again
        rows.append((n + i, rows[i][1].rsplit(" ", 1)[0]))
        rows.append((n + i + 1, rows[i][1].rsplit(" ", 2)[0]))
    return rows


def all_pairs(rows):
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    least = [i for i, _ in rows]
    for _ in range(3):
        for a in range(len(rows)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    return Counter((i, len(s), c) for (i, _), s, c in zip(rows, sets, least))


def test_glued_texts_are_not_copied_to_every_chunk(spark, monkeypatch):
    rows = corpus()
    met, plain = spark.sparkContext.accumulator(0), jaccard.groups_links

    def counting(k, percent):
        run = plain(k, percent)

        def tally(it):
            for batch in it:
                met.add(batch.num_rows)
                yield batch

        return lambda it: run(tally(it))

    monkeypatch.setattr(jaccard, "groups_links", counting)
    # with a sketch this small every bucket looks alike, as in large inputs: the passage passes for rare
    got = jaccard.join(spark.createDataFrame(rows, DOCS), bits=4, few=8, chunk=2000)
    assert Counter(tuple(r) for r in got.collect()) == all_pairs(rows)
    assert 0 < met.value <= 2 * len(rows)


def test_apart_keeps_every_link_and_drops_what_cannot_link(spark):
    rows = corpus()
    big = spark.createDataFrame([(i, 7, t) for i, t in rows], "node long, component long, text string")
    group = {r["node"]: r["component"] for r in jaccard.apart(big, 5, 80, 8).collect()}
    linked = Counter(c for _, _, c in all_pairs(rows).elements())
    for i, _, c in all_pairs(rows):
        if linked[c] > 1:
            assert group[i] == group[c]
    assert len(group) < 60


def test_filter_stops_no_key(spark):
    keys = np.random.default_rng(2).integers(-(2**63), 2**63, 20000)
    held = common.key_filter(spark.createDataFrame([(int(x),) for x in keys[:4000]], "key long"))
    assert common.passes(keys[:4000], held).all()
    assert common.passes(keys[4000:], held).mean() < 0.02
    assert not common.passes(keys, common.key_filter(spark.range(0).toDF("key"))).any()


def test_steps_are_removed_once_done(spark):
    import os

    step = common.materialise(spark.range(3), "gone")
    path = step.step_path.removeprefix("file:")
    assert os.path.isdir(path)
    common.let_go(spark, step)
    assert not os.path.exists(path)


def test_finished_steps_leave_no_files(spark):
    shared = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    jaccard.keep_one(spark.createDataFrame(corpus(60), DOCS)).collect()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before}
    assert left <= {"edges", "jaccard-named", "jaccard-rest"}
