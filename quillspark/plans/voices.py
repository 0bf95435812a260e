"""Queries over labelled voices, roll calls and quotes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import quotes, rollcall, timeline, voices
from quillspark.sources.tables import table


def coherent_cores(spark: SparkSession, d: str) -> DataFrame:
    out = voices.coherent_cores(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.12, 3)
    return out.select("label", "vec_id", F.round("mean_cosine", 6).alias("mean_cosine"), F.round("to_medoid", 6).alias("to_medoid"), "medoid", "core")


POINTS = [0.0, 0.02, 0.04, 0.05, 0.06, 0.08, 0.1]


def left_out_points(spark: SparkSession, d: str) -> DataFrame:
    """Line items as predictions scored by discount, right where returned; suppliers are left out in turn."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") < 6, F.col("l_discount").cast("double")).alias("score"), (F.col("l_returnflag") == "R").alias("right"))
    return voices.left_out_points(rows, "l_suppkey", "score", "right", POINTS, 0.3345)


def merge_harm(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.pmod("vec_id", F.lit(60)).alias("node"), F.when(F.col("vec_id") % 11 > 0, F.col("label")).alias("label"))
    merges = rows.select("node").distinct().select(F.col("node").alias("a"), F.pmod(F.col("node") * 7 + 1, F.lit(60)).alias("b"))
    return voices.merge_harm(rows, "node", "label", merges)


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as a meeting's: ten conversations a meeting, the users' long turns name members, others answer."""
    t = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 10).alias("meeting"), (F.pmod("conv_id", F.lit(10)) * 1000 + F.col("turn")).alias("at"), F.length("text").alias("n"), "role")
    from pyspark.sql import Window

    t = t.withColumn("i", F.row_number().over(Window.partitionBy("meeting").orderBy("at", "role", "n")))
    speaker = F.when(F.col("role") == "user", F.concat(F.lit("clerk"), F.pmod("n", F.lit(3)).cast("string"))).otherwise(F.concat(F.lit("voice"), F.pmod("n", F.lit(40)).cast("string")))
    return t.select("meeting", "i", speaker.alias("cluster"), F.when((F.col("role") == "user") & (F.col("n") % 4 > 0), F.pmod("n", F.lit(29))).alias("subject"), ((F.col("role") != "user") & (F.col("n") % 3 > 0)).alias("answer"))


def rollcall_regions(spark: SparkSession, d: str) -> DataFrame:
    return rollcall.regions(_turns(spark, d), "meeting", "i", "cluster", "subject", "answer", max_gap=3, tail=2)


def rollcall_accepted(spark: SparkSession, d: str) -> DataFrame:
    found = rollcall.regions(_turns(spark, d), "meeting", "i", "cluster", "subject", "answer", max_gap=3, tail=2)
    return rollcall.accepted(found, "meeting", "i", "cluster", "subject", least=2, slack=3)


def quotes_cited(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as passages; each document is quoted by its second line, and by its first two together."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    rows = docs.select(F.col("doc_id").alias("document_id"), F.posexplode("l").alias("chunk_index", "content")).select("document_id", "chunk_index", "content", (F.col("document_id") * 100_000 + F.col("chunk_index")).alias("chunk_id"))
    given = docs.where("size(l) > 1").select(F.col("doc_id").alias("document_id"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("l")[1].alias("t")), F.struct(F.lit(1).alias("k"), F.concat(F.col("l")[0], F.lit(" "), F.col("l")[1]).alias("t")))).alias("q"))
    return quotes.cite(given.select("document_id", (F.col("document_id") * 2 + F.col("q.k")).alias("quote_id"), F.col("q.t").alias("text")), rows)


def motions_matched(spark: SparkSession, d: str) -> DataFrame:
    """Orders as motions (their comment's stand-in: priority, clerk's number, status), spoken with a word changed."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("meeting"), "o_orderkey", F.concat_ws(" ", F.lit("pay"), "o_orderpriority", F.year("o_orderdate").cast("string"), F.lit("for customer"), F.col("o_custkey").cast("string"), F.lit("in status"), "o_orderstatus").alias("motion"))
    spoken = o.where("o_orderkey % 3 = 0").select("meeting", F.col("o_orderkey").alias("turn"), F.concat(F.lit("well "), F.regexp_replace("motion", "for customer", "to")).alias("said"))
    return rollcall.match_motions(spoken, o, "meeting", "turn", "said", "o_orderkey", "motion", 0.7)


def motions_attributed(spark: SparkSession, d: str) -> DataFrame:
    got = motions_matched(spark, d).select("meeting", "o_orderkey", (F.col("turn") % 11).alias("cluster"))
    movers = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("meeting"), "o_orderkey", (F.col("o_orderkey") % 11 + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("subject"))
    return rollcall.attributed(got, movers, "meeting", "o_orderkey", "cluster", "subject")


def nearest_of_any(spark: SparkSession, d: str) -> DataFrame:
    """Purchases and the session, of up to two days and overlapping others, that they lie in or nearest to."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("start"))
    points = e.where("event_type = 'purchase'").withColumn("end", F.col("start") + 1)
    spans = e.where("event_type = 'signup'").withColumn("end", F.col("start") + F.pmod("event_id", F.lit(48)) * 3.6e9).withColumnRenamed("event_id", "signup")
    return timeline.nearest_of_any(points, spans, "user_id", "event_id", "signup", 8.64e10).select("event_id", F.col("label").alias("signup"))


QUERIES = {f.__name__: f for f in (coherent_cores, left_out_points, merge_harm, rollcall_regions, rollcall_accepted, quotes_cited, motions_matched, motions_attributed, nearest_of_any)}

_TURNS = """
o AS (SELECT conv_id // 10 AS meeting, (conv_id % 10) * 1000 + turn AS pos, length(text) AS n, role FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY pos, role, n) AS i FROM o),
t AS (SELECT meeting, i, CASE WHEN role = 'user' THEN 'clerk' || n % 3 ELSE 'voice' || n % 40 END AS cluster, CASE WHEN role = 'user' AND n % 4 > 0 THEN n % 29 END AS subject, role <> 'user' AND n % 3 > 0 AS answer FROM p),
b AS (SELECT *, last_value(CASE WHEN subject IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY meeting ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t),
g AS (SELECT *, count(*) FILTER (subject IS NOT NULL AND (before IS NULL OR i - before > 3)) OVER (PARTITION BY meeting ORDER BY i) AS g FROM b),
k AS (SELECT meeting, g, cluster FROM g WHERE subject IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT meeting, g, min(i) AS first, max(i) AS last FROM g JOIN k USING (meeting, g, cluster) WHERE subject IS NOT NULL GROUP BY meeting, g HAVING count(DISTINCT subject) >= 3),
f AS (SELECT meeting, first AS region, i, cluster, CASE WHEN k.cluster IS NOT NULL AND subject IS NOT NULL THEN 'call' WHEN k.cluster IS NULL AND answer THEN 'answer' END AS kind, subject
      FROM g JOIN r USING (meeting, g) LEFT JOIN k USING (meeting, g, cluster) WHERE i BETWEEN first AND last + 2),
found AS (SELECT meeting, region, i, cluster, kind, CASE WHEN kind = 'call' THEN subject END AS subject FROM f WHERE kind IS NOT NULL)"""

_ANCHORS = ", ".join([f"CASE WHEN len(w) > {n} THEN w[1 : {n}] END" for n in quotes.LADDER] + [f"CASE WHEN len(w) > {n} THEN w[-{n} :] END" for n in quotes.LADDER])
_W = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"

ORACLES = {
    "coherent_cores": """
WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
s AS (SELECT a.label, a.vec_id, b.vec_id AS other, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.label = b.label),
m AS (SELECT label, vec_id, round(coalesce(avg(c) FILTER (vec_id <> other), 0), 9) AS mean_cosine FROM s GROUP BY label, vec_id),
best AS (SELECT label, vec_id AS medoid FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY mean_cosine DESC, vec_id) = 1),
n AS (SELECT s.label, s.vec_id, round(c, 9) AS c, medoid FROM s JOIN best ON best.label = s.label AND s.other = best.medoid),
z AS (SELECT label, count(*) FILTER (c >= 0.12 OR vec_id = medoid) AS size FROM n GROUP BY label)
SELECT label, vec_id, round(mean_cosine, 6) AS mean_cosine, round(c, 6) AS to_medoid, vec_id = medoid AS medoid, (c >= 0.12 OR vec_id = medoid) AND size >= 3 AS core FROM n JOIN m USING (label, vec_id) JOIN z USING (label)""",
    "left_out_points": f"""
WITH p AS (SELECT l_suppkey AS g, CASE WHEN l_linenumber < 6 THEN CAST(l_discount AS DOUBLE) END AS s, l_returnflag = 'R' AS r FROM lineitem),
t AS (SELECT unnest({POINTS}) AS threshold), gs AS (SELECT g, count(*) AS total FROM p GROUP BY g),
x AS (SELECT gs.g, gs.total, threshold, count(*) FILTER (p.g <> gs.g AND s >= threshold) AS n, count(*) FILTER (p.g <> gs.g AND s >= threshold AND r) AS r, count(*) FILTER (p.g <> gs.g) AS rest,
      count(*) FILTER (p.g = gs.g AND s >= threshold) AS predicted, count(*) FILTER (p.g = gs.g AND s >= threshold AND r) AS correct FROM gs, t, (SELECT g, s, r FROM p) p GROUP BY ALL)
SELECT g AS l_suppkey, CAST(threshold AS DOUBLE) AS threshold, round(r / n, 6) AS rest_precision, round(r / rest, 6) AS rest_recall, predicted, correct, total FROM x WHERE n > 0 AND r / n >= 0.3345
QUALIFY row_number() OVER (PARTITION BY g ORDER BY r / rest DESC, threshold DESC) = 1""",
    "merge_harm": """
WITH v AS (SELECT vec_id % 60 AS node, CASE WHEN vec_id % 11 > 0 THEN label END AS label FROM embeddings), m AS (SELECT DISTINCT node AS a, (node * 7 + 1) % 60 AS b FROM v),
w AS (SELECT node, sum(n) - max(n) AS wrong FROM (SELECT node, label, count(*) AS n FROM v WHERE label IS NOT NULL GROUP BY ALL) GROUP BY node),
j AS (SELECT a, b, label, count(*) AS n FROM m JOIN v ON v.node IN (m.a, m.b) WHERE label IS NOT NULL GROUP BY ALL),
x AS (SELECT a, b, sum(n) - max(n) AS wrong, count(*) > 1 AS ambiguous FROM j GROUP BY a, b)
SELECT m.a, m.b, CAST(coalesce(x.wrong, 0) - coalesce(wa.wrong, 0) - CASE WHEN m.a = m.b THEN 0 ELSE coalesce(wb.wrong, 0) END AS BIGINT) AS harm, coalesce(x.ambiguous, false) AS ambiguous
FROM m LEFT JOIN x USING (a, b) LEFT JOIN w wa ON wa.node = m.a LEFT JOIN w wb ON wb.node = m.b""",
    "rollcall_regions": f"WITH {_TURNS} SELECT * FROM found",
    "rollcall_accepted": f"""
WITH {_TURNS},
c AS (SELECT *, max(CASE WHEN kind = 'call' THEN i END) OVER (PARTITION BY meeting, region ORDER BY i) AS call FROM found),
a AS (SELECT meeting, region, call, min(i) AS i FROM c WHERE kind = 'answer' AND call IS NOT NULL GROUP BY ALL),
b2 AS (SELECT a.meeting, a.region, x.subject, y.cluster FROM a JOIN found x ON x.meeting = a.meeting AND x.region = a.region AND x.i = a.call JOIN found y ON y.meeting = a.meeting AND y.region = a.region AND y.i = a.i),
h AS (SELECT meeting, region, count(DISTINCT subject) AS called, count(DISTINCT cluster) FILTER (kind = 'answer') AS heard FROM found GROUP BY ALL),
ok AS (SELECT meeting, region FROM b2 JOIN h USING (meeting, region) GROUP BY meeting, region, called, heard HAVING count(*) >= 2 AND count(DISTINCT (cluster, subject)) = count(DISTINCT cluster) AND count(DISTINCT (cluster, subject)) = count(DISTINCT subject) AND heard <= called + 3)
SELECT meeting, region, cluster, subject, count(*) AS bound FROM b2 JOIN ok USING (meeting, region) GROUP BY ALL""",
    "quotes_cited": f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id AS document_id, i - 1 AS chunk_index, ' ' || array_to_string({_W.format('l[i]')}, ' ') || ' ' AS content FROM l, unnest(range(1, len(l) + 1)) AS u(i)),
q AS (SELECT doc_id AS document_id, doc_id * 2 AS quote_id, {_W.format('l[2]')} AS w FROM l WHERE len(l) > 1 UNION ALL SELECT doc_id, doc_id * 2 + 1, {_W.format("l[1] || ' ' || l[2]")} FROM l WHERE len(l) > 1),
e AS (SELECT document_id, quote_id, [w, {_ANCHORS}] AS a FROM q WHERE len(w) > 0),
s AS (SELECT document_id, quote_id, i - 1 AS step, ' ' || array_to_string(a[i], ' ') || ' ' AS anchor FROM e, unnest(range(1, len(a) + 1)) AS u(i) WHERE a[i] IS NOT NULL),
h AS (SELECT document_id, quote_id, step, count(*) AS n, min(chunk_index) AS at0 FROM s JOIN c USING (document_id) WHERE contains(content, anchor) GROUP BY ALL)
SELECT quote_id, document_id, CAST(step AS INTEGER) AS step, document_id * 100000 + at0 AS chunk_id FROM h WHERE step = 0 OR n = 1 QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY step) = 1""",
    "nearest_of_any": """
WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS s FROM events), p AS (SELECT user_id, event_id, s, s + 1 AS e FROM e WHERE event_type = 'purchase'),
q AS (SELECT user_id, event_id AS signup, s, s + event_id % 48 * 3600000000 AS e FROM e WHERE event_type = 'signup'),
b AS (SELECT p.event_id, signup, row_number() OVER (PARTITION BY p.event_id ORDER BY greatest(least(p.e, q.e) - greatest(p.s, q.s), 0) DESC, greatest(q.s - p.e, p.s - q.e, 0), q.s, q.e, signup) AS n FROM p JOIN q ON q.user_id = p.user_id)
SELECT p.event_id, signup FROM p LEFT JOIN b ON b.event_id = p.event_id AND n = 1""",
}

_SPOKEN = """
o AS (SELECT o_custkey % 50 AS meeting, o_orderkey, list_distinct(regexp_extract_all(lower(concat_ws(' ', 'pay', o_orderpriority, year(o_orderdate), 'for customer', o_custkey, 'in status', o_orderstatus)), '[\\p{L}\\p{N}]+')) AS w FROM orders),
s AS (SELECT o_custkey % 50 AS meeting, o_orderkey AS turn, list_distinct(regexp_extract_all(lower(concat_ws(' ', 'well pay', o_orderpriority, year(o_orderdate), 'to', o_custkey, 'in status', o_orderstatus)), '[\\p{L}\\p{N}]+')) AS w FROM orders WHERE o_orderkey % 3 = 0),
p AS (SELECT s.meeting, turn, o_orderkey, round(2 * len(list_intersect(s.w, o.w)) / (len(s.w) + len(o.w)), 9) AS similarity FROM s JOIN o USING (meeting)),
k AS (SELECT *, rank() OVER (PARTITION BY meeting, turn ORDER BY similarity DESC) AS k FROM p WHERE similarity >= 0.7),
f AS (SELECT meeting, turn, o_orderkey, similarity FROM k WHERE k = 1 QUALIFY count(*) OVER (PARTITION BY meeting, turn) = 1)"""
ORACLES["motions_matched"] = f"WITH {_SPOKEN} SELECT * FROM f"
ORACLES["motions_attributed"] = f"""
WITH {_SPOKEN}, x AS (SELECT meeting, turn % 11 AS cluster, o_orderkey % 11 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS subject, count(DISTINCT o_orderkey) AS n FROM f GROUP BY ALL)
SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY meeting, cluster) = 1 AND count(*) OVER (PARTITION BY meeting, subject) = 1"""
