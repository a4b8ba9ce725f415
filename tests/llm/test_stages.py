"""Every stage of the pipeline on rows of all kinds, on an empty table and beside columns of clashing names."""

import os
import random
from collections import Counter

import pytest
from test_operators import frame, key, linked_components, prose, small_corpus

from barloom.llm import decontam, packing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(71)
    path = tmp_path_factory.mktemp("stages")
    spark.createDataFrame([(i, i % 2, None, "clash") for i in range(20)] + [(None, 1, 0, "clash"), (5, None, 0, "clash")], "doc_id long, quality int, toxic int, text string").write.parquet(str(path / "labels.parquet"))
    items = [(1, small_corpus()[6][1]), (None, prose(rng, 20)), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_on_rows_of_all_kinds(spark, folder):
    import corpus_pipeline as cp

    rows = small_corpus()
    docs = frame(spark, rows).repartition(3).cache()
    stages = dict(cp.STAGES)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.fieldNames() == docs.schema.fieldNames(), name
        got = Counter(map(tuple, out.collect()))
        assert set(got) <= set(map(tuple, docs.collect())), name
    near = [r["doc_id"] for r in stages["n-gram Jaccard join"](spark, docs, folder).collect()]
    groups = {c[2] for c in linked_components(rows) if c[1]}
    assert {key(i) for i in near} >= {key(g) for g in groups}
    item = decontam.normal(rows[6][1])
    clean = Counter((r["doc_id"], r["text"]) for r in stages["benchmark decontamination"](spark, docs, folder).collect())
    want = Counter((i, t) for i, t, _ in rows if decontam.distance(item, decontam.normal(t or "") or b" ") > decontam.edits(len(item)))
    assert clean == want
    if os.path.exists(packing.VOCABULARY):
        starts = Counter(d for r in stages["token-ID / binary output"](spark, docs, folder).collect() for d, s in zip(r["doc_ids"], r["doc_starts"]) if s == 0)
        assert starts == Counter(i for i, _, _ in rows)


def test_stages_on_an_empty_table(spark, folder):
    import corpus_pipeline as cp

    none = frame(spark, [])
    for name, stage in cp.STAGES:
        if name.startswith("token") and not os.path.exists(packing.VOCABULARY):
            continue
        assert stage(spark, none, folder).count() == 0, name
