"""Rows that repeat an id, or are there many times over."""

import random
from collections import Counter

import pytest
from test_operators import frame, prose, words

from barloom.llm import mixing


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7 if i < 600 else 1000 + i, lambda i: i // 3])
def test_mix_takes_any_number_of_rows_that_share_an_id(spark, ids):
    rng = random.Random(31)
    text = prose(rng, 10)
    rows = [(ids(i), text, "s") for i in range(1000)] + [(ids(i), prose(rng, 10), "t") for i in range(500)]
    for df in (frame(spark, rows).repartition(3), frame(spark, rows).repartition(7)):
        got = mixing.mix(df).collect()
        assert len(got) == len(rows)
        for source in ("s", "t"):
            of = [r for r in got if r["source"] == source]
            assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 5
        repeated = mixing.repeat(df).collect()
        assert sum(len(words(r["text"])) for r in repeated) == sum(r["taken"] for r in got)
        assert set(map(tuple, repeated)) <= set(map(tuple, df.collect()))
        assert Counter((r["doc_id"], r["source"]) for r in repeated) == Counter({(r["doc_id"], r["source"]): 0 for r in got}) + Counter(x for r in got for x in [(r["doc_id"], r["source"])] * r["copies"])


def test_mix_equals_its_sql_where_rows_repeat(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(32)
    some = [prose(rng, rng.randint(1, 12)) for _ in range(6)]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "", *some]), rng.choice([None, "a", "b"])) for _ in range(800)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = Counter(duckdb.sql(mixing.ORACLE).fetchall())
    got = Counter((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(frame(spark, rows).repartition(3)).collect())
    rounded = lambda c: Counter({(a, b, s, round(t, 6), k): n for (a, b, s, t, k), n in c.items()})
    assert rounded(got) == rounded(want)
