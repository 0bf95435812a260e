"""Intents of questions, and the figures that answer them."""

from quillspark.operators.answers import Vocabulary, answers, evidence, intents

V = Vocabulary({"balance": ("fund balance",), "spent": ("spend", "spent")}, {"function": {"Roads": ("roads?", "streets?"), "Parks": ("parks?",)}, "fund": {"General": ("general",)}})
FIGURES = "category string, dimension string, label string, fund string, year string, amount double, position int, reference int"


def test_intents(spark):
    qs = ["What did we spend on STREETS and parks in 2020?", "spent from the general fund", "spend in total since 2001", "road spend per pupil", "we spend well", "parkour spends", "general fund balance of roads", None, ""]
    got = [(r["category"], r["dimension"], r["labels"], r["fiscal_year"]) for r in intents(spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "i int, q string"), "q", V).orderBy("i").collect()]
    assert got == [
        ("spent", "function", ["Parks", "Roads"], "2019-2020"),
        ("spent", "fund", ["General"], None),
        ("spent", "total", ["total"], None),
        (None, None, None, None),
        (None, None, None, None),
        (None, None, None, None),
        ("balance", "function", ["Roads"], None),
        (None, None, None, None),
        (None, None, None, None),
    ]


def test_answers(spark):
    rows = [
        ("spent", "function", "Parks", "A", "2019-2020", 10.0, 2, None),
        ("spent", "function", "Parks", "B", "2019-2020", 1234.5, 3, 30),
        ("spent", "function", "Parks", "B", "2019-2020", 1.0, 4, 20),
        ("spent", "function", "Roads", "A", "2019-2020", 5.0, 1, 7),
        ("spent", "function", "Roads", "A", "2020-2021", 6.0, 1, 8),
        ("spent", "total", "total", "A", "2020-2021", 6.0, 1, None),
        ("income", "function", "Roads", "A", "2020-2021", 9.0, 1, 9),
    ]
    figures = spark.createDataFrame(rows, FIGURES)
    qs = spark.createDataFrame([(1, "spend on roads and parks 2020"), (2, "spend on roads and parks 2020"), (3, "spend on roads"), (4, "total spend"), (5, None), (6, "spend on roads 2007")], "i int, q string")
    got = {r["i"]: (r["path"], [e.split(" - ")[1] for e in r["evidence"]]) for r in answers(qs, "q", figures, V).collect()}
    both = [e for e in got[1][1]]
    assert got[1] == got[2] and got[1][0] == "figures" and both[0].startswith("Parks (A+B, spent): ") and both[0].endswith(" [30]") and both[1].endswith(" [7]")
    assert [e[-3:] for e in got[3][1]] == ["[8]", "[7]"]
    assert got[4] == ("text", []) and got[5] == ("text", []) and got[6] == ("text", [])  # nothing cited, nothing asked, no such year
    first = evidence(intents(qs, "q", V), figures, 1).collect()
    assert sorted((r["label"], r["place"], float(r["amount"])) for r in first) == [("Parks", 1, 1245.5), ("Roads", 1, 6.0)]
    assert answers(qs, "q", spark.createDataFrame([], FIGURES), V).where("path = 'figures'").count() == 0
