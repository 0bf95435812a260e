"""Questions of customers after figures of orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import answers
from quillspark.sources.tables import table

VOCABULARY = answers.Vocabulary(
    {"spent": ("spend", "spent", "cost of"), "income": ("income", "revenues?")},
    {"urgency": {"URGENT": ("urgent",), "HIGH": ("high",), "LOW": ("low",)}},
)


def figures(spark: SparkSession, d: str) -> DataFrame:
    """Orders as figures of an urgency and of the total; the fund is the customer's number mod 3."""
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    y = F.year("o_orderdate")
    base = o.select(
        F.when(F.col("o_orderstatus") == "F", "spent").otherwise("income").alias("category"), F.explode(F.array(F.struct(F.lit("urgency").alias("dimension"), F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("label")), F.struct(F.lit("total").alias("dimension"), F.lit("total").alias("label")))).alias("l"),
        F.concat(F.lit("fund "), F.pmod("o_custkey", F.lit(3)).cast("string")).alias("fund"), F.concat((y - 1).cast("string"), F.lit("-"), y.cast("string")).alias("year"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("reference"),
    )
    return base.select("category", "l.dimension", "l.label", "fund", "year", "amount", "position", "reference")


def questions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    forms = ["How much did we SPEND on urgent and low orders?", "income from high orders", "What was the total cost of orders", "total revenue per pupil", "Who spends at all? Lowest prices", "overall income in 2001"]
    return table(spark, d, "customer").select("c_custkey", F.get(F.array(*[F.lit(f) for f in forms]), F.pmod(k, F.lit(len(forms))).cast("int")).alias("query"))


def figure_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.evidence(answers.intents(questions(spark, d), "query", VOCABULARY), figures(spark, d))
    return rows.select("category", "place", "label", "year", "amount", "funds", "reference")


def figure_answers(spark: SparkSession, d: str) -> DataFrame:
    out = answers.answers(questions(spark, d), "query", figures(spark, d), VOCABULARY)
    return out.select("c_custkey", "path", "category", F.array_join("labels", "+").alias("labels"), "fiscal_year", F.size("evidence").cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (figure_evidence, figure_answers)}

_SHOWN = """
f AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'spent' ELSE 'income' END AS category, regexp_replace(o_orderpriority, '^[0-9]-', '') AS label, 'fund ' || o_custkey % 3 AS fund, (year(o_orderdate) - 1) || '-' || year(o_orderdate) AS year, o_totalprice AS amount, o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'O')),
r AS (SELECT category, label, year, CAST(sum(CAST(amount AS DECIMAL(28,2))) AS DECIMAL(28,2)) AS amount, string_agg(DISTINCT fund, '+' ORDER BY fund) AS funds, min(k) FILTER (k % 2 = 0) AS reference
      FROM (SELECT * FROM f UNION ALL SELECT category, 'total', fund, year, amount, k FROM f) GROUP BY ALL HAVING reference IS NOT NULL),
i AS (SELECT * FROM (VALUES (0, 'spent', 'LOW+URGENT', NULL), (1, 'income', 'HIGH', NULL), (2, 'spent', 'total', NULL), (5, 'income', 'total', '2000-2001')) AS v(m, category, labels, fiscal_year)),
e AS (SELECT i.m, i.category, r.label, r.year, r.amount, r.funds, r.reference, row_number() OVER (PARTITION BY i.m ORDER BY r.year DESC, r.label) AS place
      FROM i JOIN r ON i.category = r.category AND list_contains(string_split(i.labels, '+'), r.label) AND (i.fiscal_year IS NULL OR i.fiscal_year = r.year) WHERE i.m IN (SELECT c_custkey % 6 FROM customer))"""

ORACLES = {
    "figure_evidence": f"WITH {_SHOWN} SELECT category, CAST(place AS INTEGER) AS place, label, year, amount, funds, reference FROM e WHERE place <= 12",
    "figure_answers": f"""WITH {_SHOWN}, n AS (SELECT m, count(*) AS n FROM e WHERE place <= 12 GROUP BY m)
SELECT c_custkey, CASE WHEN n > 0 THEN 'figures' ELSE 'text' END AS path, category, labels, CASE WHEN c_custkey % 6 = 5 THEN '2000-2001' END AS fiscal_year, coalesce(n, 0) AS n FROM customer LEFT JOIN i ON i.m = c_custkey % 6 LEFT JOIN n ON n.m = c_custkey % 6""",
}
