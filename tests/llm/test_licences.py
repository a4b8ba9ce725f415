"""Every template is found as it is, wrapped, on one line and inside other text; rows of all kinds."""

import random

from test_operators import frame, prose

from barloom.llm import license


def test_whole_texts_name_their_licence(spark):
    rng = random.Random(61)
    cases = [(name, max(texts, key=len)) for name, texts in sorted(license.TEMPLATES.items())]
    assert len(cases) >= 30

    def wrapped(t):
        w = t.split()
        return "\n".join(" * " + " ".join(w[i : i + 9]) for i in range(0, len(w), 9))

    forms = [lambda t: t, wrapped, lambda t: " ".join(t.upper().split()), lambda t: prose(rng, 60) + " " + t + " " + prose(rng, 60)]
    rows = [(100 * k + j, form(t), "s") for k, (_, t) in enumerate(cases) for j, form in enumerate(forms)]
    got = {r["doc_id"]: r for r in license.scan(frame(spark, rows)).collect()}
    assert [(i, got[i]["best"]) for i, _, _ in rows if got[i]["best"] != cases[i // 100][0]] == []
    assert all(max(got[i]["dices"]) > 0.97 for i, _, _ in rows)


def test_rows_of_all_kinds(spark):
    rng = random.Random(62)
    mit = license.TEMPLATES["MIT"][2]
    rows = [(1, "", "s"), (2, None, "s"), (None, mit, "s"), (3, mit, "s"), (3, mit, "s"), (3, "clean", "s"), (4, prose(rng, 30000) + " " + mit + " " + prose(rng, 30000), "s")]
    got = sorted((str(r["doc_id"]), r["licenses"]) for r in license.scan(frame(spark, rows)).collect())
    assert got == [("1", []), ("2", []), ("3", []), ("3", ["MIT"]), ("3", ["MIT"]), ("4", ["MIT"]), ("None", ["MIT"])]
    tied = license.scan(frame(spark, [(1, "one two three four five", "s")]), {"B": ("one two three four five",), "A": ("one two three four five",)}).first()
    assert tied["licenses"] == ["A", "B"] and tied["best"] == "A"
