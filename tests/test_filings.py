"""Filings of our own making: read, reconciled, and one broken in each way."""

import pytest

from quillspark.operators.filings import AllRows, Balance, Block, CrossFoot, PartOf, Quotient, accepted, figures, line_items, reconcile

FUNDS = Block("funds", ("Funds", "Group", "Line"), "code", {"general": "g", "debt": "d"}, "sum")
STATED = Block("stated", ("Stated",), "code", {"total": "amount"})
SITES = Block("sites", ("Sites", "Detail"), "site", {"federal": "fed", "local": "loc"}, "all")
RATES = Block("rates", ("Rates", "R"), "id", {"value": "v"})
BLOCKS = [FUNDS, STATED, SITES, RATES]
CHECKS = [
    CrossFoot("rows", FUNDS, ("beg", "rev", "exp", "end"), 0.0),
    Balance("forward", {("funds", "beg"): 1, ("funds", "rev"): 1, ("funds", "exp"): -1, ("funds", "in"): 1, ("funds", "end"): -1}, ("general", "debt", "total"), frozenset({("funds", "in")})),
    Balance("same", {("funds", "rev"): 1, ("stated", "rev"): -1}, ("total",)),
    AllRows("sites", "sites", ("funds", "exp"), ("total",), 1.0),
    PartOf("tree", "sites", {"a1": "a", "a2": "a", "a21": "a2"}, ("federal",)),
    Quotient("rate", ("rates", "15", "value"), ("rates", "17", "value"), ("rates", "r", "value"), 0.9, 0.0001),
]
GOOD = """<?xml version="1.0"?><Report xmlns="urn:x"><Funds><Group><Line code="beg" g="$1,000.00" d="(50.00)" sum="950.00"/>
<Line code="rev" g="500" d="60.10" sum="560.10"/></Group><Group><Line code="exp" g="200" d="-" sum="$200.00"/><Line code="in" g="0" d="5" sum="5"/>
<Line code="end" g="1300" d="15.10" sum="1,315.10"/><Line g="7" d="7" sum="7"/></Group></Funds><Stated code="rev" amount="560.10"/>
<Sites><Detail site="a" fed="30" loc="70" all="100"/><Detail site="a1" fed="10" loc="10" all="20"/><Detail site="a2" fed="20" loc="20" all="40"/><Detail site="a21" fed="20" loc="20" all="40"/></Sites>
<Rates><R id="15" v="100.00"/><R id="17" v="400.00"/><R id="r" v="22.50%"/></Rates></Report>"""
BROKEN = {
    2: ('sum="560.10"', 'sum="560.11"', {("rows", "rev"), ("forward", "total"), ("same", "total")}),
    3: ('d="15.10" sum="1,315.10"', 'd="15.20" sum="1,315.20"', {("forward", "debt"), ("forward", "total")}),
    4: ('<Stated code="rev" amount="560.10"/>', "", {("same", "total")}),
    5: ('v="22.50%"', 'v="22.60%"', {("rate", "")}),
    6: ('v="400.00"', 'v="-"', {("rate", "")}),
    7: ('site="a21" fed="20"', 'site="a21" fed="19"', {("tree", "a2/federal")}),
    8: ('code="beg" g="$1,000.00"', 'code="beg" g="n/a"', {("rows", "beg"), ("forward", "general")}),
    9: ('<Stated code="rev" amount="560.10"/>', '<Stated code="rev" amount="560.10"/><Stated code="rev" amount="0"/>', {("same", "total")}),
    10: ('all="100"', 'all="103"', {("sites", "total")}),
}


@pytest.fixture(scope="module")
def checked(spark):
    docs = [(1, GOOD)] + [(k, GOOD.replace(a, b)) for k, (a, b, _) in BROKEN.items()] + [(20, GOOD[:300]), (21, None), (22, ""), (23, "<Report/>")]
    df = spark.createDataFrame(docs, "id int, xml string")
    cells = figures(df, "id", "xml", BLOCKS).cache()
    return df, cells, reconcile(df, cells, "id", CHECKS).cache()


def test_figures(checked):
    got = {(r["block"], r["row"], r["column"]): float(r["amount"]) for r in checked[1].where("id = 1").collect()}
    assert len(got) == 15 + 1 + 12 + 3
    assert got[("funds", "beg", "debt")] == -50 and got[("funds", "exp", "debt")] == 0 and got[("funds", "end", "total")] == 1315.10 and got[("rates", "r", "value")] == 0.225
    assert checked[1].where("id >= 20").count() == 0
    assert [r["raw"] for r in checked[1].where("amount IS NULL").collect()] == ["n/a"]


def test_every_break_is_told(checked):
    failed = {}
    for r in checked[2].where("NOT holds").collect():
        failed.setdefault(r["id"], set()).add((r["check"], r["at"]))
    # sites a, a1, a2 and a21 sum up to 200 where the parents count too
    assert {k: v for k, v in failed.items() if k < 20} == {k: v for k, (_, _, v) in BROKEN.items()}
    assert all(len(failed[k]) == 4 + 3 + 1 + 1 + 2 + 1 for k in (20, 21, 22, 23))
    difference = {(r["id"], r["check"], r["at"]): r["difference"] for r in checked[2].collect()}
    assert difference[(3, "forward", "debt")] == -0.1 and difference[(6, "rate", "")] is None and difference[(1, "rate", "")] == 0


def test_accepted_items(checked):
    good = accepted(checked[1], checked[2], "id")
    assert {r["id"] for r in good.select("id").distinct().collect()} == {1}
    items = {(r["row"], r["column"]): (float(r["amount"]), r["quote"]) for r in line_items(good, "id", ["funds"]).collect()}
    assert items[("beg", "debt")] == (-50.0, "beg, debt: -$50.00") and items[("beg", "general")] == (1000.0, "beg, general: $1,000.00")
    assert ("exp", "debt") not in items and not any(c == "total" for _, c in items)


def test_no_filings(spark):
    none = spark.createDataFrame([], "id int, xml string")
    cells = figures(none, "id", "xml", BLOCKS)
    assert cells.count() == 0 and reconcile(none, cells, "id", CHECKS).count() == 0


def test_items_parse_no_filing_twice(spark):
    """The cells are written once, by the parsing; the checks and the items read them."""
    from quillspark.plans import filings as plans

    plan = plans.filing_items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_xml" not in plan and "XmlToStructs" not in plan
