"""The pipeline's stages on a small table, each judged on its own input."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for n, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < len(cp.STAGES) - 1:
            assert docs.columns == columns, name
            now = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert now <= ids
            ids = now
        seen.append(docs.count())
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] <= seen[2]
    assert {d for r in docs.select("doc_ids").collect() for d in r["doc_ids"]} == ids
    assert "op8_pareto_mix" in __import__("__spark_entry__").queries()
