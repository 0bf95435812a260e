"""Stems, and the search by words against a plain evaluation of its queries."""

import math
import re

import pytest

from quillspark.functions.stem import with_stem
from quillspark.operators import search
from quillspark.session import Kept

# Words and stems that the algorithm's description gives.
STEMS = dict(zip(*[iter("""caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split())] * 2, strict=True))


def test_stems(spark):
    words = [*STEMS, "é", "ab", "x1ing", "", None]
    got = with_stem(spark.createDataFrame([(w, 1, 2) for w in words], "word string, w int, stem int"), "word")
    assert got.columns == ["word", "w", "stem"]
    for r in got.collect():
        assert r["stem"] == STEMS.get(r["word"], r["word"]) and r["w"] == 1


TEXTS = {1: "The quick foxes were jumping over lazy dogs", 2: "A fox jumped. The dog slept; dogs sleep", 3: "state of the art, state art of", 4: "quick quick quick dog", 5: "", 6: None, 7: "Über-Straße naïve: FOX"}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame([*TEXTS.items(), (None, "fox")], "doc_id long, text string")
    search.write_index(docs, path, "doc_id", "text", buckets=4, spread=2)
    return search.read_index(spark, path, buckets=4)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("jumps fox", {1, 2}), ("quick -jumping", {4}), ("quick or sleeping", {1, 2, 4}), ('"state of the art"', {3}), ('"state the art"', set()), ('"state art"', {3}),
        ("-fox", {3, 4, 5, 6}), ('fox -"lazy dog"', {2, 7}), ('"lazy dogs', {1}), ("the of", set()), ("", set()), ("or", set()), ("- -", set()), ("fox or", {1, 2, 7}),
        ("naïve", {7}), ("über-straße", {7}), ("DOG or ART -quick", {1, 2, 3, 4}), ("nothing", set()), ('-"the of" fox', {1, 2, 7}),
    ],
)
def test_queries(index, query, want):
    assert {r["id"] for r in search.search(index, query).collect()} == want


def test_scores_order_and_partitions(index):
    got = [(r["id"], r["score"]) for r in search.search(index, "quick or dog").collect()]
    count = lambda t: sum(w in ("quick", "dog", "dogs") for w in re.findall(r"\w+", (t or "").lower()))
    want = sorted(((i, round(count(t) / (1 + math.log10(max(1, len(re.findall(r"\w+", t))))), 9)) for i, t in TEXTS.items() if t and count(t)), key=lambda r: (-r[1], r[0]))
    assert got == want
    assert len(search.search(index, "quick or dog", top=1).collect()) == 1
    plan = search.search(index, "quick")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan)  # only the partitions of the query's stems


def test_fan_out(index):
    got = {r["id"]: r for r in search.fan_out(index, "fox", ["dogs", "the", "fox", "quick"]).collect()}
    assert set(got) == {1, 2, 4, 7} and got[1]["lists"] == 3 and got[4]["first_list"] == 1 and got[7]["lists"] == 1
    with pytest.raises(ValueError, match="nothing to look for"):
        search.fan_out(index, "the", ["dogs"])
    # expansions alone may fail to say anything
    assert {r["id"] for r in search.fan_out(index, "fox", ["of", ""]).collect()} == {1, 2, 7}


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "i")
    search.write_index(spark.createDataFrame([], "doc_id long, text string"), path, "doc_id", "text", buckets=2, spread=1)
    index = search.read_index(spark, path, buckets=2)
    assert search.search(index, "fox").count() == search.search(index, "-fox").count() == 0


def test_words_are_stemmed_once_for_all_documents(spark):
    """The stems' expressions stand after the distinct words, not on each document's words; rows that share an id are one document."""
    docs = spark.createDataFrame([(1, "dogs dog"), (1, "a dog"), (2, "Dogs, dogs; cats"), (3, ""), (4, None), (None, "dog")], "doc_id long, text string")
    rows = search.postings(docs, "doc_id", "text")
    assert sorted((r["id"], r["stem"], r["positions"]) for r in rows.collect()) == [(1, "a", [0]), (1, "dog", [0]), (1, "dog", [1]), (1, "dog", [1]), (2, "cat", [2]), (2, "dog", [0, 1])]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [word" in plan[plan.index("endswith" if "endswith" in plan else "EndsWith") :] and "LIKE _%" not in plan
    with Kept(spark, "stems") as kept:
        got = sorted(tuple(r) for r in search.stem_counts(docs, "doc_id", "text", kept).collect())
    assert got == [("a", 1, 1, 0), ("cat", 1, 1, 2), ("dog", 2, 5, 1)]
