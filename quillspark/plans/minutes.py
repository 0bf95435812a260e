"""Queries over minutes that are written out from orders, and the SQL that knows the votes from the orders themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import minutes
from quillspark.sources.tables import table


def written(spark: SparkSession, d: str) -> DataFrame:
    """Minutes of each order: as lines, as a council's or a board's prose by the order's number; some without a vote."""
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    yes, no = F.pmod(k, F.lit(7)), F.pmod(k, F.lit(5))
    words = F.array(*[F.lit(w) for w in minutes.NUMBERS])
    status, pay = F.col("o_orderstatus"), F.concat(F.lit(" to pay order "), text(k), F.lit(" in full"))
    tally = F.concat(text(yes), F.lit("-"), text(no))
    roll = F.lit("Votes: Ann Lee-aye, Bo Ray-no, Cy Day-aye")
    end = F.when(status == "F", F.concat(F.lit("Motion Carries "), tally)).when(status == "O", F.concat(roll, F.lit("\nFailed"))).otherwise(roll)
    lines = F.concat(F.lit("1.\nOrders\nMotion"), pay, F.lit(".\nMoved by: Clerk "), text(F.pmod(k, F.lit(100))), F.lit("\nSeconded by: Customer "), text(F.col("o_custkey")), F.lit("\n"), end, F.lit("\n2.\nPage 1 of 1\n"))
    said = F.when(status == "F", F.concat(F.lit("The motion passed "), tally, F.lit(" on a voice vote."))).when(status == "O", F.lit("The motion failed on a roll call vote: Alderman Bo - Nay; Councilmember Ann - Aye; and Mayor Ray - Nay.")).otherwise(F.lit("Nothing was decided."))
    council = F.concat(F.lit("The council met. Motion made by Councilmember Ann"), pay, F.lit(". Alderman Bo seconded. "), said)
    ended = F.when(status == "F", F.concat(F.lit("The motion carried with "), F.get(words, yes.cast("int")), F.lit(" votes in favor and "), F.get(words, no.cast("int")), F.lit(" opposed."))).otherwise("The motion was tabled later.")
    board = F.concat(F.lit("The board met. Ann Lee made a motion"), pay, F.lit(". Bo Ray seconded the motion. "), ended)
    form = F.pmod(k, F.lit(4))
    return table(spark, d, "orders").select(k, F.when(form == 0, lines).when(form == 1, council).when(form == 2, board).otherwise(F.col("o_orderpriority")).alias("text"))


def minutes_votes(spark: SparkSession, d: str) -> DataFrame:
    return minutes.extract_votes(written(spark, d), "o_orderkey", "text")


def minutes_audit(spark: SparkSession, d: str) -> DataFrame:
    docs = written(spark, d)
    return minutes.audit(docs, minutes.extract_votes(docs, "o_orderkey", "text"), "o_orderkey", "text")


QUERIES = {f.__name__: f for f in (minutes_votes, minutes_audit)}

_KNOWN = """
o AS (SELECT o_orderkey, o_custkey, o_orderstatus AS s, o_orderkey % 4 AS f, CAST(o_orderkey % 7 AS INTEGER) AS y, CAST(o_orderkey % 5 AS INTEGER) AS n FROM orders),
v AS (SELECT o_orderkey, CAST(1 AS BIGINT) AS motion_no, CASE f WHEN 0 THEN 'Motion to pay order ' || o_orderkey || ' in full.' WHEN 1 THEN 'Motion made by Councilmember Ann to pay order ' || o_orderkey || ' in full' ELSE 'Ann Lee made a motion to pay order ' || o_orderkey || ' in full' END AS motion,
      CASE f WHEN 0 THEN 'Clerk ' || o_orderkey % 100 WHEN 1 THEN 'Councilmember Ann' ELSE 'Ann Lee' END AS moved_by, CASE f WHEN 0 THEN 'Customer ' || o_custkey WHEN 1 THEN 'Alderman Bo' ELSE 'Bo Ray' END AS seconded_by,
      CASE WHEN s = 'O' THEN 'failed' ELSE 'passed' END AS result, CASE WHEN s = 'P' THEN 'derived' ELSE 'stated' END AS basis,
      CASE WHEN s = 'F' THEN y WHEN f = 0 THEN 2 ELSE 1 END AS yes, CASE WHEN s = 'F' THEN n WHEN f = 0 THEN 1 ELSE 2 END AS no, 0 AS abstain, CASE f WHEN 0 THEN 'lines' WHEN 1 THEN 'council' ELSE 'board' END AS form
      FROM o WHERE f = 0 OR f = 1 AND s <> 'P' OR f = 2 AND s = 'F')"""

ORACLES = {
    "minutes_votes": f"WITH {_KNOWN} SELECT * FROM v",
    "minutes_audit": f"""WITH {_KNOWN}, d AS (SELECT CASE f WHEN 0 THEN 'lines' WHEN 1 THEN 'council' WHEN 2 THEN 'board' ELSE 'none' END AS form FROM o)
SELECT form, count(*) AS documents, CASE WHEN form = 'none' THEN 0 ELSE count(*) END AS openings, (SELECT count(*) FROM v WHERE v.form = d.form) AS votes FROM d GROUP BY form""",
}
