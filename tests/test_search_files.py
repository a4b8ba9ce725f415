"""Formula breeding and bar files."""

import numpy as np
import pytest

from barloom.functions import vocabulary
from barloom.plans import search
from barloom.sources import files


def test_bred_formulas_are_feasible():
    rng = np.random.default_rng(0)
    made = [search.random_formula(rng, n) for n in (1, 2, 5, 8) for _ in range(40)]
    assert all(vocabulary.feasible(list(t)) for t in made)
    assert all(vocabulary.feasible(list(search.mutate(rng, t))) for t in made)
    assert all(vocabulary.feasible(list(search.cross(rng, a, b))) for a, b in zip(made[-40:], made[-39:]))


def test_search_is_repeatable(spark):
    rng = np.random.default_rng(1)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 230)))
    rows = [("a", i, float(x), float(x * 1.01), float(x * 0.99), float(x), 1.0 + i % 5) for i, x in enumerate(c)]
    panel = spark.createDataFrame(rows, "symbol string, time long, open double, high double, low double, close double, volume double").cache()
    one, two = (search.Search(panel, length=2, population=4, elites=2).run(2) for _ in range(2))
    assert one == two and len(one) == 2 and one[0][1] >= one[1][1]


def test_files(spark, tmp_path):
    assert files.label("/x/XAU_USD_H1_note.parquet") == ("XAU_USD", "H1") and files.label("a.csv") == ("a", "")
    assert files.label("XAU_ZZZ.parquet") == ("XAU", "ZZZ") and files.label("A_B_1day_live_x.csv") == ("A_B", "D1") and files.label("EUR_daily.csv") == ("EUR", "D1")
    assert [files.timeframe(x) for x in ("60m", "H7", "1-min", "240min", "monthly", " 4h ")] == ["H1", "H7", "M1", "H4", "MN1", "H4"]
    df = spark.createDataFrame([(1700000000 + 60 * (i % 4), 1.0, 2.0, 0.5, float(i), 3) for i in range(6)], "time long, open double, high double, low double, close double, tick_volume long")
    path = str(tmp_path / "ABC_M1.parquet")
    files.save(df.coalesce(1), path)
    files.save(df.coalesce(1), path)
    got = files.load(spark, path).orderBy("time").collect()
    assert [r["close"] for r in got] == [4.0, 5.0, 2.0, 3.0] and got[0]["symbol"] == "ABC" and got[0]["volume"] == 3.0
    assert files.load(spark, path, since=1700000060).count() == 2
    assert files.load(spark, path, unit="ms").agg({"time": "max"}).first()[0] == 1700000
    assert [p.rsplit("/", 1)[-1] for p in files.lookup(spark, str(tmp_path), "abc", "1min")] == ["ABC_M1.parquet"] and files.lookup(spark, str(tmp_path), "abc", "H1") == []
    assert sorted(p.name for p in tmp_path.iterdir()) == ["ABC_M1.parquet"]
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "x.json"))
    r = files.continuity(files.load(spark, path), files.load(spark, path).selectExpr("symbol", "time + 240 AS time", "open", "high", "low", "close", "volume"), 60).first()
    assert r["fits"] and r["extends"] and r["gap"] == "ok"
