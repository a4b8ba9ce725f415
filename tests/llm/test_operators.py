"""Each text operator against brute force on small tables that hold nulls, empty and long texts, ties and repeated rows."""

import gzip
import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import types as T

from barloom.llm import components, crosspoly, decontam, jaccard, license, mixing, packing, quality, seedextend, sufdedup, suffixes, warc

SEPARATORS = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, source string, n_words string, tag int, size long, component string"
"""Documents with extra columns whose names operators use themselves."""


def prose(rng, n):
    return " ".join(rng.choice(["the", "an", "river", "stone", "über", "wind", "mill", "of", "seven", "grey"]) + str(rng.randint(0, 30)) for _ in range(n))


def small_corpus():
    rng = random.Random(7)
    shared = prose(rng, 60)
    texts = [None, "", " \t\n", "one", "a b c", prose(rng, 200), shared]
    for _ in range(12):
        texts.append(prose(rng, rng.randint(5, 80)) + "\n" + shared + " " + prose(rng, rng.randint(0, 50)))
    base = prose(rng, 120)
    for k in range(8):
        w = base.split()
        w[k * 11] = "changed"
        texts.append(" ".join(w))
    texts += [base, base, base.upper(), "same " * 400, "same " * 400, prose(rng, 3000), "x" * 5000, "x" * 3000 + "y"]
    rows = [(i, t, ["b", "a", None, "c"][i % 4]) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "b"), (None, texts[6], "z"), (3, "another text under one id " * 10, "b")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 3, 4, "clash") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, small_corpus()).repartition(3).cache()


def words(text):
    out, cur = [], ""
    for c in text or "":
        if c in SEPARATORS:
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out + ([cur] if cur else [])


def key(i):
    return 2**63 - 1 if i is None else i


def unique_docs(rows):
    """One document per (id, text): rows that repeat both are the same document."""
    return sorted({(key(i), t or "") for i, t, _ in rows})


def test_seed_extend_against_all_windows(docs):
    rows = small_corpus()
    first = {}
    for i, t in unique_docs(rows):
        w = words(t)
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (i, p))
    want = Counter()
    for i, t, _ in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] != (key(i), p):
                gone[p : p + 20] = True
        want[(i, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in seedextend.dedup(docs).collect())
    assert got == want


@pytest.mark.parametrize("scratch", [{}, {"held": 64, "batch": 32, "base": 8}, {"runs": 2}])
def test_suffix_dedup_against_all_strings(docs, scratch):
    rows = small_corpus()
    count = Counter()
    for _, t, _ in rows:  # a row that is there twice repeats itself
        b = (t or "").encode()
        count.update(b[p : p + 400] for p in range(len(b) - 399))
    want = Counter()
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        gone = gone[:-1]
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    assert Counter(tuple(r) for r in sufdedup.dedup(docs, **scratch).collect()) == want


@pytest.mark.parametrize("scratch", [{}, {"held": 8, "batch": 4, "base": 2}])
def test_suffix_array_with_common_prefixes(scratch):
    rng = np.random.default_rng(1)
    for trial in range(120):
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 100)))
        t = np.concatenate([t, t[: len(t) // 2], t]) if trial % 3 else np.repeat(t, 4)
        with suffixes.Scratch(**scratch) as files:
            got = list(suffixes.suffix_array(t.astype(np.int64), files))
        sa, lcp = (np.concatenate([g[k] for g in got]).tolist() for k in (0, 1))
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert sa == want
        for a, b, n in zip(want, want[1:], lcp[1:]):
            x, y = t[a:].tolist(), t[b:].tolist()
            k = next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert k == n


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked_components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    low = {}
    for n, (i, _, _) in enumerate(rows):
        low[find(n)] = min(low.get(find(n), 2**63), key(i))
    return Counter((i, len(s), None if low[find(n)] == 2**63 - 1 else low[find(n)]) for n, ((i, _, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("how", [{}, {"few": 2}, {"chunk": 300}, {"few": 1, "chunk": 200, "bits": 17}])
def test_jaccard_join_against_all_pairs(docs, how):
    assert Counter(tuple(r) for r in jaccard.join(docs, **how).collect()) == linked_components(small_corpus())


def test_jaccard_keeps_one_of_each_group(docs):
    rows = [r for r in small_corpus() if r[0] is not None]
    kept = [r["doc_id"] for r in jaccard.keep_one(docs).collect() if r["doc_id"] is not None]
    want = {c[2] for c in linked_components(rows) if c[1]} | {i for i, t, _ in rows if not shingles(t)}
    assert sorted(set(kept)) == sorted(want)
    assert jaccard.keep_one(docs).columns == docs.columns


def test_components_of_long_and_starlike_graphs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000, 5000)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect())
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(60)}}


def test_mix_comes_near_its_targets(spark, docs):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 60)), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(600)] + [(9000, None, None), (9001, "", "empty")]
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    total = sum(len(words(t)) for _, t, _ in rows)
    by = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by.setdefault(r["source"], []).append(r)
    assert abs(sum(rs[0]["target"] for rs in by.values()) - 1.5 * total) < 1e-6
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 60
    again = Counter((r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(5)).collect())
    assert again == Counter((r["doc_id"], r["taken"]) for r in got)
    repeated = Counter(r["doc_id"] for r in mixing.repeat(df).collect())
    assert repeated == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    assert mixing.repeat(docs).columns == docs.columns


def test_archives_round_trip(spark):
    html = ["<p>é</p>", None, "", "line\r\n\r\nWARC/1.1\r\n\r\nend\n", "<p>é</p>", "x" * 200000, "<p>é</p>", "\n\n"]
    rows = [(i, "http://a b/ü?q=%20" if i % 2 else None, h, "clash") for i, h in enumerate(html)] + [(None, "u", "<p>é</p>", "clash"), (0, "u", "<p>é</p>", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").repartition(3)
    import base64

    first = {}
    for i, _, h, _ in rows:
        first[h or ""] = min(first.get(h or "", 2**63), key(i))
    for version in (1, 2, None):
        got = warc.warc_rows(spark, warc.arc_to_warc(spark, warc.write_arc(pages, version))).collect()
        assert len(got) == len(rows)
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter(
            (i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h, _ in rows
        )
        kinds = Counter(r["record_type"] for r in got)
        assert kinds == {"response": len(first), "revisit": len(rows) - len(first)}
        assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {0, 1}


def test_arc_records_must_have_their_declared_length():
    import io

    good = warc.arc_version_block(2, "f") + b"\n" + warc.arc_header(2, "http://x y/", 3) + b"\nabc\n"
    assert [b for _, _, b in warc.read_arc(io.BytesIO(good))] == [b"abc"]
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(good[:-3])))
    assert warc.opened(gzip.compress(good)).read() == good


def test_rows_are_packed_without_loss(spark, docs):
    try:
        lines = open(packing.VOCABULARY, "rb").read()
    except OSError:
        pytest.skip("no vocabulary file here")
    enc = packing.encoder(lines)
    got = packing.pack(docs, row=64, buffer=1000).collect()
    pieces = Counter()
    whole = {}
    for r in got:
        ids = np.frombuffer(r["input_ids"], "<u2")
        assert len(ids) == 64 and r["cu_seqlens"][-1] == r["n_tokens"]
        assert (ids[r["n_tokens"] :] == packing.END).all()
        pos = packing.positions(r["position_resets"], 64)
        for k, (d, s) in enumerate(zip(r["doc_ids"], r["doc_starts"])):
            a, b = r["cu_seqlens"][k : k + 2]
            assert pos[a:b].tolist() == list(range(b - a))
            pieces[(d, s, tuple(ids[a:b].tolist()))] += 1
            whole[d] = whole.get(d, 0) + b - a
    want = Counter()
    for i, t, _ in small_corpus():
        ids = [*enc.encode_ordinary(t or ""), packing.END]
        want.update((i, s, tuple(ids[s : s + 64])) for s in range(0, len(ids), 64))
    assert pieces == want


def test_best_fit_decreasing_against_a_plain_search():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 80))]
        free = []
        for n in sorted(lengths, reverse=True):
            able = [f for f in range(len(free)) if free[f] >= n]
            if able:
                free[min(able, key=lambda f: free[f])] -= n
            else:
                free.append(40 - n)
        rows = packing.best_fit(lengths, 40)
        assert sorted(p for r in rows for p in r) == list(range(len(lengths)))
        assert sorted(40 - sum(lengths[p] for p in r) for r in rows) == sorted(free)


def test_quality_learns_from_one_fold_only(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        t = prose(rng, 60) if good else " ".join(f"{w}$$$" for w in prose(rng, 60).upper().split())
        rows.append((i, t, "s"))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(1000, None, None), (1001, "", "s"), (None, prose(rng, 40), "s"), (1002, prose(rng, 20000), "s")]
    df, lab = frame(spark, rows), spark.createDataFrame([*labels, (1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(df, lab, fit_rows=120).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["predicted"] == int(i % 3 > 0) for i in range(400))
    assert got[1000]["score"] == got[1001]["score"] == quality.NO_TERMS and 0 <= got[1002]["score"] <= 1
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    flipped = lab.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2 THEN 1 - quality ELSE quality END AS quality")
    assert {r["doc_id"]: r["score"] for r in quality.score(df, flipped, fit_rows=120).collect()} == {i: r["score"] for i, r in got.items()}
    kept = quality.keep(df, lab, fit_rows=120)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got.values())
    assert quality.score(df, lab.limit(0)).where("score <> 1").count() == 0


def test_licences_in_lines_runs_and_whole_texts(spark):
    rng = random.Random(2)
    mit = license.TEMPLATES["MIT"][1]
    broken = mit[:200].rsplit(" ", 1)[0] + "\n" + mit[len(mit[:200].rsplit(" ", 1)[0]) + 1 :]
    rows = [
        (1, prose(rng, 50) + "\nReleased under the MIT license\n" + prose(rng, 40), None),
        (2, mit.upper(), None),
        (3, prose(rng, 30) + "\n" + broken + "\n" + prose(rng, 30), None),
        (4, prose(rng, 500), None),
        (5, None, None),
        (6, "licensed", None),
        (7, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.", None),
    ]
    got = {r["doc_id"]: r for r in license.scan(frame(spark, rows)).collect()}
    assert [got[i]["licenses"] for i in range(1, 8)] == [["MIT"], ["MIT"], ["MIT"], [], [], [], ["CC-BY-NC-4.0", "GPL-3.0"]]
    assert got[2]["best"] == "MIT" and got[2]["dices"] == [1.0]


def test_decontamination_against_exact_distances(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, 30)) for k in range(12)] + [(50, "tiny"), (51, None), (52, "..."), (None, prose(rng, 20))]
    rows = [(0, None, None), (1, "", None), (2, prose(rng, 400), None), (3, "a TINY, thing", None), (4, "tinytiny", None)]
    edited = []
    for k in range(30):
        i, t = items[k % 12]
        b = list(decontam.normal(t).decode())
        for _ in range(rng.randint(0, decontam.edits(len(b)))):
            b[rng.randrange(len(b))] = rng.choice("abcxyz")
        rows.append((100 + k, prose(rng, 50) + "\n" + "".join(b).upper() + "! " + prose(rng, 50), None))
        edited.append((100 + k, i))
    df, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.leaks(df, bench).collect()}
    normal = [(i, decontam.normal(t)) for i, t in items if t and decontam.normal(t)]
    found = missed = 0
    for d, t, _ in rows:
        text = decontam.normal(t or "")
        want = {i for i, n in normal if (len(n) >= decontam.GRAM and decontam.distance(n, text) <= decontam.edits(len(n))) or (b" " + n + b" ") in b" " + text + b" "}
        have = set(got[d]["item_ids"])
        assert have <= want
        found, missed = found + len(have), missed + len(want - have)
    assert missed <= 0.05 * found and all(i in got[d]["item_ids"] for d, i in edited[:1])
    assert decontam.keep(df, bench).count() == sum(not r["contaminated"] for r in got.values())
    assert decontam.leaks(df, bench.limit(0)).where("contaminated").count() == 0


def test_myers_distance():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = random.Random(1)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(2))
        assert decontam.distance(a, b) == plain(a, b)


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(60):
        v = rng.normal(size=24)
        for j in range(1 + k % 6):
            rows.append((len(rows), (v + rng.normal(size=24) * 0.03 * (j > 1)).tolist(), k % 3))
    rows += [(len(rows), rows[0][1], 0), (5, rows[5][1], rows[5][2])]
    n = len(rows)
    rows += [(n + 1, None, 0), (n + 2, [0.0] * 24, 0), (n + 3, [float("nan")] * 24, 0), (n + 4, [None] + [1.0] * 23, 0), (n + 5, rows[0][1], None), (n + 6, [], 0), (n + 7, [1.0, 2.0], 0), (None, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", T_lit())

    def able(r):
        v = r[1]
        return r[2] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a, b in combinations(range(len(rows)), 2):
        x, y = rows[a], rows[b]
        if able(x) and able(y) and x[2] == y[2] and len(x[1]) == len(y[1]):
            u, v = np.array(x[1]), np.array(y[1])
            if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, r in enumerate(rows):
        low[find(k)] = min(low.get(find(k), 2**63), key(r[0]))
    want = Counter((r[0], links[k], None if low[find(k)] == 2**63 - 1 else low[find(k)], key(r[0]) == low[find(k)]) for k, r in enumerate(rows))
    for how in ({}, {"chunk": 2}):
        assert Counter(tuple(r) for r in crosspoly.near(df, **how).collect()) == want


def T_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (seedextend.dedup(none), sufdedup.dedup(none), jaccard.join(none), jaccard.keep_one(none), mixing.mix(none), mixing.repeat(none), quality.score(none, labels), quality.keep(none, labels)):
        assert df.count() == 0
    for df in (decontam.leaks(none, bench), decontam.keep(none, bench), license.scan(none), warc.round_trip(pages), crosspoly.near(vecs)):
        assert df.count() == 0
    assert isinstance(none.schema, T.StructType)


def test_vectors_of_the_large_fixture_are_recalled(spark):
    import os

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    df = spark.read.parquet(path)
    rows = df.collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r["label"] for r in rows])
    linked = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r["n_links"] for r in crosspoly.near(df).collect()}
    found, there = sum(got.values()), int(linked.sum())
    assert found <= there and found >= 0.9 * there
