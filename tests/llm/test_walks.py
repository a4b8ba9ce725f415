"""The sampled embedding as the finder: recall by kind of edit, blocks of items, repeated and long rows."""

import random

import pytest
from test_operators import frame, prose

from barloom.llm import decontam


@pytest.mark.parametrize("kind", ["substitute", "insert", "delete"])
def test_recall_of_items_with_as_many_edits_as_allowed(kind):
    rng = random.Random(51)
    found = {}
    for words in (4, 10, 25, 60, 140, 400):
        items = [decontam.normal(prose(rng, words)) for _ in range(12)]
        found[words] = decontam.recall(items, kind, 36, rng)
    assert min(found.values()) >= 0.9, found


def test_blocks_give_the_same_as_one_and_rows_may_repeat(spark):
    rng = random.Random(52)
    items = [(k, prose(rng, 20)) for k in range(10)] + [(10, "a b"), (None, prose(rng, 20)), (11, prose(rng, 400))]
    rows = [(k, prose(rng, 30) + " " + (t or "").upper() + " " + prose(rng, 30), "s") for k, t in items]
    rows += [rows[0], rows[0], (None, rows[1][1], "s"), (0, "clean under a used id", "s"), (50, None, "s"), (51, "", "s")]
    rows += [(60, prose(rng, 20000) + " " + items[3][1] + " " + prose(rng, 20000), "s"), (61, " ".join(t for _, t in items), "s")]
    bench = spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], "item_id long, text string, doc_id string, found string")
    docs = frame(spark, rows).repartition(3)
    one = sorted(map(str, decontam.leaks(docs, bench).collect()))
    assert sorted(map(str, decontam.leaks(docs, bench, block_bytes=500).collect())) == one
    got = {r["doc_id"]: r["item_ids"] for r in decontam.leaks(docs.where("doc_id >= 50"), bench).collect()}
    assert got[50] == got[51] == [] and got[60] == [3] and got[61] == [*range(12), None]
    clean = sorted(map(str, decontam.keep(docs, bench).collect()))
    assert clean == sorted(map(str, decontam.keep(docs, bench, block_bytes=500).collect())) and len(clean) == 3
