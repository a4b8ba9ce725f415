"""Cases in which an operator once did less than its whole job."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_operators import frame, key, linked_components, prose

from barloom.llm import common, decontam, jaccard, license, mixing, packing, quality


def test_licences_across_blank_lines_and_within_lines(spark):
    rng = random.Random(21)

    def wrapped(text):
        w = text.split()
        return "\n".join(" * " + " ".join(w[i : i + 11]) for i in range(0, len(w), 11))

    def clauses(text):
        for cut in ("1. Redist", "2. Redist", "3. Neither", "THIS SOFTWARE IS PROVIDED BY"):
            text = text.replace(cut, "\n\n" + cut)
        return "\n\n".join(wrapped(p) for p in text.split("\n\n"))

    bsd2, bsd3 = license.TEMPLATES["BSD-2-Clause"][0], license._BSD_3
    agpl, lgpl, gpl = (license._gnu(k, "3")[0] for k in ("Affero General Public License", "Lesser General Public License", "General Public License"))
    around = lambda t: prose(rng, 40) + "\n\n" + t + "\n\n" + prose(rng, 40)
    rows = [
        (1, around("Copyright (c) 2020, A Person\n\n" + clauses(bsd2 + " " + license._BSD_WARRANTY)), None),
        (2, "Copyright (c) 2020, A Person\n\n" + clauses(bsd3 + " " + license._BSD_WARRANTY), None),
        (3, around(bsd3), None),
        (4, around(clauses(bsd2)), None),
        (5, around(agpl), None),
        (6, around(wrapped(lgpl)), None),
        (7, around(gpl), None),
        (8, prose(rng, 30) + " Foo is released under the MIT License, see the file. " + prose(rng, 30), None),
        (9, wrapped(" ".join(license._gnu("Affero General Public License", "3")[1].split())), None),
        (10, around("MIT License\n\n" + wrapped(license._MIT) + "\n\n" + wrapped(license._MIT_WARRANTY)) + "\n\n" + gpl, None),
        (11, "\n\n".join([license._MIT] * 300), None),
        (12, prose(rng, 3000) + " license " * 3000, None),
    ]
    got = {r["doc_id"]: r for r in license.scan(frame(spark, rows)).collect()}
    want = [["BSD-2-Clause"], ["BSD-3-Clause"], ["BSD-3-Clause"], ["BSD-2-Clause"], ["AGPL-3.0"], ["LGPL-3.0"], ["GPL-3.0"], ["MIT"], ["AGPL-3.0"], ["GPL-3.0", "MIT"], ["MIT"], []]
    assert [got[i]["licenses"] for i in range(1, 13)] == want
    assert got[5]["dices"] == [1.0]


def test_licence_windows_against_all_windows():
    rng = random.Random(22)
    known = license.Templates({"A": ("a b c d e f g h",), "B": ("a b c d x f g h i",)}, license.DICE)
    for _ in range(200):
        words = [rng.choice("abcdefghix") if rng.random() < 0.3 else "abcdefgh"[k % 8] for k in range(rng.randint(0, 40))]
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        pairs = list(zip(words, words[1:]))
        most = 0.0
        for text in ("a b c d e f g h", "a b c d x f g h i"):
            t = set(zip(text.split(), text.split()[1:]))
            for s in range(len(pairs)):
                for e in range(s, len(pairs)):
                    u = set(pairs[s : e + 1])
                    most = max(most, 2 * len(u & t) / (len(u) + len(t)))
        got = known.scan(raw, np.array([0, len(raw)]))[0]
        assert bool(got) == (most >= license.DICE) and (not got or max(got.values()) <= most)


def test_all_windows_that_meet_the_gram_bound_are_looked_at():
    rng = random.Random(23)

    def letters(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    items = decontam.Items([(0, letters(81).encode()), (1, letters(400).encode())])
    text = items.texts[1].decode()
    missed = 0
    for _ in range(128):
        b, at = list(text), rng.randint(8, 150)
        for _ in range(items.limit[1]):
            b[at] = "#"
            at += rng.randint(9, 11)
        before = letters(rng.randint(0, 200))
        raw = np.frombuffer((before + "".join(b).replace("#", "0") + letters(rng.randint(0, 200))).encode(), np.uint8)
        data, _ = decontam.normal_chunk(raw, np.array([0, len(raw)]))
        hit = items.filter[decontam.spot(decontam.grams(data))]
        missed += len(before) not in items.near(hit, np.concatenate([[0], np.cumsum(hit)]))
    assert missed == 0


def test_short_items_are_found_with_edits():
    rng = random.Random(24)

    def letters(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    words = [[letters(rng.randint(2, 7)) for _ in range(rng.randint(5, 9))] for _ in range(60)]
    items = [(k, decontam.normal(" ".join(w))) for k, w in enumerate(words)]
    texts, want = [], []
    for k, item in items:
        for how in range(3):
            b, at = item.decode(), rng.randrange(1, len(item) - 1)
            b = (b[:at] + "0" + b[at + 1 :], b[:at] + "0" + b[at:], b[:at] + b[at + 1 :])[how]
            texts.append(f"{letters(30)}. {b.upper()}? {letters(30)}")
            want.append((k, how))
    assert all(20 <= len(t) < 64 for _, t in items)
    got = decontam.Items(items).scan(pa.array(texts))
    assert [x for x in want if x[0] not in dict(got[want.index(x)])] == []
    assert decontam.Items([(0, b"nineteen bytes long")]).scan(pa.array(["nineteen bytes l0ng", "nineteen bytes long"])) == [[], [(0, 0)]]


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    rng = random.Random(25)
    groups = []
    for ids in ([None] * 4, [7] * 3, [7, 7, 3], [9, None, None], [None], [7]):
        base = prose(rng, 120).split()
        texts = [" ".join(w if j != 13 * k else "changed" for j, w in enumerate(base)) for k in range(len(ids))]
        texts[-1] = texts[-1].upper().replace("Ü", "ü") if len(ids) > 2 else texts[-1]
        groups.append([(i, t, "s") for i, t in zip(ids, texts)])
    rows = [r for g in groups for r in g] + [(7, groups[1][0][1], "a"), (7, groups[1][0][1], "z"), (None, None, "s"), (None, "", "b")]
    docs = frame(spark, rows).repartition(3)
    got = [(r["doc_id"], r["text"], r["source"]) for r in jaccard.keep_one(docs).collect()]
    for g in groups:
        low = min((2**63 - 1 if i is None else i) for i, _, _ in g)
        of = [r for r in got if r[1] in {t for _, t, _ in g}]
        assert len(of) == 1 and (2**63 - 1 if of[0][0] is None else of[0][0]) == low
    assert len([r for r in got if not r[1]]) == 1 and len(got) == len(groups) + 1
    assert all(s == "a" for _, t, s in got if t == groups[1][0][1])
    again = [(r["doc_id"], r["text"], r["source"]) for r in jaccard.keep_one(frame(spark, rows[::-1]).repartition(5)).collect()]
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_pipeline_run_against_brute_force(spark, tmp_path):
    if not os.path.exists(packing.VOCABULARY):
        pytest.skip("no vocabulary file here")
    import corpus_pipeline

    rng = random.Random(26)
    items = [(k, prose(rng, 30)) for k in range(3)]
    good = lambda n: prose(rng, n)
    bad = lambda n: " ".join(f"{w}$$$" for w in prose(rng, n).upper().split())
    rows = [(i, good(60) if i % 3 else bad(60), "ab"[i % 2]) for i in range(150)]
    base = good(100)
    rows += [(200 + k, " ".join(w if j != 17 * k else "changed" for j, w in enumerate(base.split())), "a") for k in range(5)]
    rows += [(None, base + " end", "b"), (300, None, "a"), (301, "", "b"), (302, good(50), "a")]
    rows += [(302, rows[-1][1], "b")] * 3
    rows += [(310 + k, good(40) + " " + t.upper() + " " + good(40), "b") for k, t in items]
    docs = frame(spark, rows).repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [r for r in rows if r[1] and "$$$" not in r[1]]
    group = {}
    for a in kept:  # linked by brute force, two at a time
        for b in kept:
            if a[1] is not b[1] and sum(linked_components([(1, a[1], ""), (2, b[1], "")]).values()) and {c[2] for c in linked_components([(1, a[1], ""), (2, b[1], "")])} == {1}:
                group.setdefault(a[1], {a[1]}).add(b[1])
    first = [r for r in kept if not any(key(o[0]) < key(r[0]) for o in kept if o[1] in group.get(r[1], ()))]
    first = sorted(set(first), key=lambda r: (key(r[0]), r[2]))
    first = [r for n, r in enumerate(first) if not n or first[n - 1][:2] != r[:2]]
    normal = [decontam.normal(t) for _, t in items]
    clean = [r for r in first if all(decontam.distance(n, decontam.normal(r[1])) > decontam.edits(len(n)) for n in normal)]
    assert len(kept) > len(first) > len(clean) == 102
    want = Counter(r["doc_id"] for r in mixing.repeat(frame(spark, clean)).collect())

    before = set(os.listdir(common.shared_dir(spark).removeprefix("file:")))
    got = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.update(d for d, s in zip(r["doc_ids"], r["doc_starts"]) if s == 0)
    assert got == want
    new = set(os.listdir(common.shared_dir(spark).removeprefix("file:"))) - before
    assert sorted(x.rsplit("-", 1)[0] for x in new if x.startswith("pipeline-")) == [f"pipeline-{n}" for n in range(5)]


def test_document_frequencies_are_of_all_documents(spark):
    rng = random.Random(27)
    rows = [(i, prose(rng, 40) if i % 2 else prose(rng, 40).upper(), "s") for i in range(60)] + [(100 + i, f"zzqx {i} qqzz", "s") for i in range(200)] + [(400, None, None), (401, "", "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    raw = [(t or "").encode() for _, t, _ in rows]
    has = quality.terms(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])) > 0
    want = np.log((1 + len(rows)) / (1 + has.sum(axis=0))) + 1
    for df in (frame(spark, rows), frame(spark, rows).repartition(7)):
        assert np.allclose(quality.train(df, labels, fit_rows=20)["idf"], want)
