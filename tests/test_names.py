"""Close names against all pairs, and misheard names of meetings."""

import random

import pytest

from quillspark.operators import names as N


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def score(a, b):
    return max(2 * lcs(a, b) / (len(a) + len(b)), N.jaro_winkler(a, b) if " " not in a + b else 0.0)


def names_of(rng, n, letters="abcd", longest=9):
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
    return [" ".join(word() for _ in range(rng.choice((1, 1, 1, 2, 3)))) for _ in range(n)]


@pytest.mark.parametrize("floor", [0.67, 0.7, 0.8, 0.92])
def test_close_pairs_lose_none(spark, floor):
    rng = random.Random(int(floor * 100))
    left, right = names_of(rng, 120) + names_of(rng, 60, "abcdefghij", 12), names_of(rng, 120) + names_of(rng, 60, "abcdefghij", 12)
    for x in left[:60]:  # edited copies
        y = list(x)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(y))
            y[i : i + 1] = rng.choice(([], [y[i], "e"], ["é"], y[i : i + 2][::-1] or ["z"]))
            y = y or ["a"]
        right.append("".join(y).strip() or "q")
    right = [" ".join(x.split()) or "q" for x in right]
    want = {(a, b) for a in set(left) for b in set(right) if a != b and abs(a.count(" ") - b.count(" ")) <= 1 and score(a, b) >= floor}
    frames = [spark.createDataFrame([(x,) for x in [*xs, None, "", xs[0]]], "x string") for xs in (left, right)]
    got = N.close_pairs(*frames, "x", "x", floor).collect()
    assert {(r["p"], r["v"]) for r in got} == want and len(got) == len(want) > 30
    assert all(abs(r["score"] - score(r["p"], r["v"])) < 1e-12 for r in got)


def test_close_pairs_of_nothing(spark):
    none = spark.createDataFrame([], "x string")
    assert N.close_pairs(none, none, "x", "x").count() == 0
    with pytest.raises(ValueError):
        N.close_pairs(none, none, "x", "x", 0.5)


def test_surfaces(spark):
    docs = spark.createDataFrame([(1, "Musco Sports met Ann Lee. Ann Lee's car\nAnn LEE spoke"), (2, None), (3, "")], "m int, t string")
    got = {(r["meeting"], r["norm"]): (r["surface"], r["n"]) for r in N.surfaces(docs, "m", "t").collect()}
    assert got[(1, "musco sports")] == ("Musco Sports", 1) and got[(1, "ann lee")] == ("Ann LEE", 2) and got[(1, "ann lees")] == ("Ann Lee's", 1)
    assert got[(1, "ann")] == ("Ann", 3) and {m for m, _ in got} == {1}
    assert (1, "lee ann") not in got  # a full stop ends a run


def test_misheard_and_proposals(spark):
    lexicon = spark.createDataFrame([("Susan Buse",), ("Mayor Michelle Harris",), (None,)], "name string")
    written = spark.createDataFrame([(1, "Musco Sports Lighting and Shaw Park, Solberger"), (2, "Musco Sports Lighting"), (3, None)], "m int, t string")
    spoken = spark.createDataFrame(
        [
            (1, "so Moscow Sports Lighting came; then Susan Busey left. Susan spoke, Musco Sports Lighting too"),
            (1, "Shah Park is near Shaw Parks and the Sollberger house"),
            (2, "here Moscow Sports Lighting again, Shah Park"),
            (3, "Moscow Sports Lighting, Michele Harris"),
            (4, None),
        ],
        "m int, t string",
    )
    names = N.vocabulary(lexicon, written, "name", "m", "t")
    found = N.misheard(spoken, names, "m", "t").cache()
    got = {(r["meeting"], r["mangled"]): (r["canonical"], r["source"], r["confidence"]) for r in found.collect()}
    assert got == {
        (1, "moscow sports lighting"): ("Musco Sports Lighting", "written", "high"),
        (1, "susan busey"): ("Susan Buse", "lexicon", "high"),
        (1, "shah park"): ("Shaw Park", "written", "high"),
        (1, "sollberger"): ("Solberger", "written", "review"),
        (2, "moscow sports lighting"): ("Musco Sports Lighting", "written", "high"),
        (3, "michele harris"): ("Mayor Michelle Harris", "lexicon", "high"),
    }
    known = spark.createDataFrame([("Susan Busey",)], "mangled string")
    assert "susan busey" not in {r["mangled"] for r in N.misheard(spoken, names, "m", "t", known).collect()}
    p = {r["mangled"]: r for r in N.proposals(found).collect()}["moscow sports lighting"]
    assert (p["meetings"], p["occurrences"], p["confidence"], p["rivals"], p["evidence"]) == (2, 2, "high", 0, "1,2")


def test_two_names_for_one_form_are_for_review(spark):
    lexicon = spark.createDataFrame([("Anna Millers",), ("Anna Miller",)], "name string")
    spoken = spark.createDataFrame([(1, "Anna Mollers spoke")], "m int, t string")
    none = spark.createDataFrame([], "m int, t string")
    names = N.vocabulary(lexicon, none, "name", "m", "t")
    got = N.misheard(spoken, names, "m", "t").collect()
    assert [(r["mangled"], r["canonical"], r["confidence"]) for r in got] == [("anna mollers", "Anna Millers", "high" if score("anna mollers", "anna miller") < score("anna mollers", "anna millers") - 0.05 else "review")]
    rows = spark.createDataFrame([(1, "x", "A", "lexicon", 0.9, 1, "high"), (2, "x", "B", "lexicon", 0.95, 2, "high")], "meeting int, mangled string, canonical string, source string, score double, n long, confidence string")
    r = N.proposals(rows).collect()[0]
    assert (r["canonical"], r["confidence"], r["rivals"], r["occurrences"], r["evidence"]) == ("B", "review", 1, 3, "2,1")


def test_pairs_of_groups_use_their_own_lengths(spark):
    said = [(1, "ramirez"), (1, "ramires jones"), (2, "ramirez"), (2, "oakwood"), (3, "oakwood"), (None, "oakwood")]
    own = [(1, "ramires"), (1, "ramirez jones"), (2, "oakwod"), (2, "ann lee"), (4, "oakwod"), (None, "oakwod")]
    a, b = (spark.createDataFrame(x, "meeting long, norm string") for x in (said, own))
    got = N.close_pairs(a, b, "norm", "norm", 0.8, "meeting")
    assert "collect_set" in got._jdf.queryExecution().optimizedPlan().toString()  # lengths of a group, not of all
    score = lambda p, v: max(2 * N.common_letters(p, v) / len(p + v), N.jaro_winkler(p, v) if " " not in p + v else 0.0)
    want = {(g, p, v) for g, p in said for h, v in own if g is not None and g == h and p != v and abs(p.count(" ") - v.count(" ")) <= 1 and score(p, v) >= 0.8}
    assert {(r["meeting"], r["p"], r["v"]) for r in got.collect()} == want and len(want) >= 3
