"""Queries over XML filings that are written out from each customer's orders, and SQL that knows the figures from the orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import filings
from quillspark.operators.filings import Balance, Block, CrossFoot, PartOf, Quotient
from quillspark.session import Kept
from quillspark.sources.tables import table

SUMMARY = Block("summary", ("Summary", "Group", "Line"), "code", {"urgent": "u", "other": "o"}, "sum")
STATED = Block("stated", ("Stated",), "code", {"total": "amount"})
SHARE = Block("share", ("Rates", "Rate"), "code", {"value": "v"})
BLOCKS = [SUMMARY, STATED, SHARE]
CHECKS = [
    CrossFoot("rows", SUMMARY, ("F", "O", "P", "all")),
    PartOf("parts", "summary", {s: "all" for s in "FOP"}, ("urgent", "other", "total")),
    Balance("same", {("summary", "all"): 1, ("stated", "all"): -1}, ("total",)),
    Quotient("rate", ("summary", "all", "urgent"), ("summary", "all", "total"), ("share", "urgent", "value")),
]


def written(spark: SparkSession, d: str) -> DataFrame:
    """(custkey, xml): orders by status and urgency as one filing a customer; open ones are negative. Some filings are wrong by the customer's number."""
    o = table(spark, d, "orders")
    amount = F.col("o_totalprice").cast("decimal(18,2)") * F.when(F.col("o_orderstatus") == "O", -1).otherwise(1)
    urgent = F.col("o_orderpriority").rlike("^[12]")
    cell = lambda s, u: F.coalesce(F.sum(F.when((F.col("o_orderstatus") == s) & (urgent if u else ~urgent), amount)), F.lit(0)).cast("decimal(18,2)").alias(f"{s}{int(u)}")
    by = o.where(F.col("o_orderstatus").isin("F", "O", "P")).groupBy(F.col("o_custkey").alias("custkey")).agg(*[cell(s, u) for s in "FOP" for u in (True, False)])
    k = F.col("custkey")

    def money(c: Column) -> Column:
        return F.when(c < 0, F.concat(F.lit("("), F.format_number(-c, 2), F.lit(")"))).when(c == 0, "-").otherwise(F.concat(F.lit("$"), F.format_number(c, 2)))

    def line(code: str, u: Column, o: Column) -> Column:
        return F.concat(F.lit(f'<Line code="{code}" u="'), money(u), F.lit('" o="'), money(o), F.lit('" sum="'), money(u + o), F.lit('"/>'))

    lines = [line(s, F.col(f"{s}1"), F.col(f"{s}0")) for s in "FOP"]
    u, other = (sum((F.col(f"{s}{n}") for s in "OP"), F.col(f"F{n}")) for n in (1, 0))
    lines[2] = F.when(k % 17 == 7, F.regexp_replace(lines[2], 'u="[^"]*"', 'u="n/a"')).otherwise(lines[2])
    whole = F.when(k % 13 == 5, "").otherwise(line("all", u, other))
    stated = money(u + other + F.when(k % 11 == 3, F.lit(0.01).cast("decimal(3,2)")).otherwise(F.lit(0).cast("decimal(3,2)")))
    share = F.coalesce(F.round(100 * u.cast("double") / F.nullif((u + other).cast("double"), F.lit(0.0)), 4), F.lit(0.0))
    xml = F.concat(F.lit('<Report xmlns="urn:orders"><Summary><Group>'), lines[0], lines[1], F.lit("</Group><Group>"), lines[2], whole, F.lit('</Group></Summary><Stated code="all" amount="'), stated, F.lit('"/><Rates><Rate code="urgent" v="'), F.format_string("%.4f", share), F.lit('%"/></Rates>'), F.when(k % 19 == 2, "").otherwise("</Report>"))
    return by.select("custkey", xml.alias("xml"))


def _checked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = written(spark, d)
    cells = filings.figures(docs, "custkey", "xml", BLOCKS)
    return cells, filings.reconcile(docs, cells, "custkey", CHECKS)


def filing_figures(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d)[0].where("block <> 'share'").select("custkey", "block", "row", "column", F.col("amount").cast("decimal(18,2)").alias("amount"))


def filing_failures(spark: SparkSession, d: str) -> DataFrame:
    """The checks that don't hold; a rate may be negative or above 1, which no percent states, so it is not asked here."""
    return _checked(spark, d)[1].where("NOT holds AND check <> 'rate'").select("custkey", "check", "at", F.col("difference").cast("decimal(18,2)").alias("difference"))


def filing_items(spark: SparkSession, d: str) -> DataFrame:
    docs = written(spark, d)
    cells = Kept(spark, "filings").keep(filings.figures(docs, "custkey", "xml", BLOCKS), "cells")  # both the checks and the items read them
    checked = filings.reconcile(docs, cells, "custkey", CHECKS)
    return filings.line_items(filings.accepted(cells, checked.where("check <> 'rate'"), "custkey"), "custkey", ["summary"])


QUERIES = {f.__name__: f for f in (filing_figures, filing_failures, filing_items)}

_CELLS = """
b AS (SELECT o_custkey AS k, o_orderstatus AS s, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'urgent' ELSE 'other' END AS c, CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END AS a FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')),
g AS (SELECT k, r, c, coalesce(CAST(sum(a) FILTER (b.s = r OR r = 'all') AS DECIMAL(18,2)), 0) AS a FROM b, (VALUES ('F'), ('O'), ('P'), ('all')) AS v(r) GROUP BY k, r, c),
f AS (SELECT k, r, c, coalesce(a, 0) AS a FROM (SELECT DISTINCT k FROM b) CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('all')) AS v(r) CROSS JOIN (VALUES ('urgent'), ('other')) AS u(c) LEFT JOIN g USING (k, r, c)),
w AS (SELECT k, 'summary' AS block, r, c, CASE WHEN k % 17 = 7 AND r = 'P' AND c = 'urgent' THEN NULL ELSE a END AS a, a AS real FROM f
      UNION ALL SELECT k, 'summary', r, 'total', sum(a), sum(a) FROM f GROUP BY k, r
      UNION ALL SELECT k, 'stated', 'all', 'total', sum(a) + CASE WHEN k % 11 = 3 THEN 0.01 ELSE 0 END, sum(a) FROM f WHERE r = 'all' GROUP BY k),
x AS (SELECT k AS custkey, block, r AS row, c AS "column", CAST(a AS DECIMAL(18,2)) AS amount FROM w WHERE k % 19 <> 2 AND NOT (k % 13 = 5 AND block = 'summary' AND r = 'all'))"""

_FAILURES = """
e AS (SELECT DISTINCT k AS custkey FROM b),
p AS (SELECT custkey, 'rows' AS "check", r AS "at", r AS needed, CASE r WHEN 'P' THEN custkey % 17 = 7 WHEN 'all' THEN custkey % 13 = 5 ELSE false END AS bad FROM e, (VALUES ('F'), ('O'), ('P'), ('all')) AS v(r)
      UNION ALL SELECT custkey, 'parts', 'all/' || c, NULL, custkey % 13 = 5 OR c = 'urgent' AND custkey % 17 = 7 FROM e, (VALUES ('urgent'), ('other'), ('total')) AS u(c)
      UNION ALL SELECT custkey, 'same', 'total', NULL, custkey % 13 = 5 OR custkey % 11 = 3 FROM e),
d AS (SELECT custkey, 'rows' AS "check", row AS "at", sum(CASE WHEN "column" = 'total' THEN -amount ELSE amount END) AS d FROM x WHERE block = 'summary' GROUP BY custkey, row
      UNION ALL SELECT custkey, 'parts', 'all/' || "column", sum(CASE WHEN row = 'all' THEN -amount ELSE amount END) FROM x WHERE block = 'summary' GROUP BY custkey, "column"
      UNION ALL SELECT custkey, 'same', 'total', sum(CASE WHEN block = 'stated' THEN -amount ELSE amount END) FROM x WHERE row = 'all' AND "column" = 'total' GROUP BY custkey)"""

ORACLES = {
    "filing_figures": f"WITH {_CELLS} SELECT * FROM x",
    "filing_failures": f'WITH {_CELLS}, {_FAILURES} SELECT custkey, "check", "at", CAST(d AS DECIMAL(18,2)) AS difference FROM p LEFT JOIN d USING (custkey, "check", "at") WHERE bad OR custkey % 19 = 2',
    "filing_items": f"""WITH {_CELLS}, {_FAILURES} SELECT custkey, block, row, "column", amount, row || ', ' || "column" || ': ' || CASE WHEN amount < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', CAST(floor(abs(amount)) AS BIGINT)) || '.' || lpad(CAST(CAST(abs(amount) * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0') AS quote
FROM x WHERE block = 'summary' AND "column" <> 'total' AND amount <> 0 AND custkey NOT IN (SELECT custkey FROM p WHERE bad OR custkey % 19 = 2)""",
}
