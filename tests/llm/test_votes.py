"""Quality votes against plain loops over all labelled documents."""

import math
import random
from collections import Counter

import numpy as np
from test_operators import frame, prose

from barloom.llm import quality


def plain_scores(rows, labels, model):
    """Each text against every fitted vector, one product after the other."""
    z, ones, votes = model["z"].astype(float), model["ones"], model["votes"].astype(float)
    out = []
    for _, t, _ in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        counts = quality.terms(raw, np.array([0, len(raw)]))
        if not counts.any():
            out.append(0.0)
            continue
        v = quality.weighed(counts, model["idf"])[0].astype(float) @ model["projection"].astype(float)
        v /= math.sqrt(sum(x * x for x in v))
        near = sorted(((sum(a * b for a, b in zip(v, w)), k) for k, w in enumerate(z)), reverse=True)[: quality.NEIGHBOURS]
        weight = {k: math.exp(quality.SHARPNESS * (s - near[0][0])) * votes[k] for s, k in near}
        out.append(sum(w for k, w in weight.items() if ones[k]) / sum(weight.values()))
    return out


def test_votes_against_plain_loops(spark):
    rng = random.Random(41)
    noisy = lambda n: " ".join(w + rng.choice(["", "", "$$", "!!1"]) for w in prose(rng, n).split())
    rows = [(i, noisy(rng.randint(20, 60)) if i % 3 else prose(rng, 40).upper(), "s") for i in range(240)] + [(900, None, None), (901, " \n", "s"), (None, prose(rng, 30), "s"), (3, prose(rng, 30), "t")]
    labels = [(i, int(rng.random() < (0.8 if i % 3 else 0.2)), 0) for i in range(0, 240, 2)]
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(df, lab)
    assert len(model["z"]) == sum(1 for i, _, _ in labels if __import__("zlib").crc32(str(i).encode()) % 4 != 2)
    got = Counter((r["doc_id"], round(r["score"], 3)) for r in quality.score(df, lab).collect())
    want = Counter((i, round(s, 3)) for (i, _, _), s in zip(rows, plain_scores(rows, labels, model)))
    assert sum((got & want).values()) >= len(rows) - 3  # rounding at the third digit


def test_fit_is_bounded_where_an_id_repeats(spark):
    rng = random.Random(42)
    rows = [(i, prose(rng, 20) if i % 2 else prose(rng, 20).upper(), "s") for i in range(60)] + [(5, f"again {k % 7}", "s") for k in range(10000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(7, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")  # 9: clashing labels
    models = [quality.train(frame(spark, rows).repartition(n), labels, fit_rows=40) for n in (2, 5)]
    assert len(models[0]["z"]) <= 40 and np.array_equal(models[0]["z"], models[1]["z"])
