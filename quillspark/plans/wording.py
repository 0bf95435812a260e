"""Queries over wording and speech, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import wording
from quillspark.session import Kept
from quillspark.sources.tables import table


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat_ws("/", "lang", F.pmod("doc_id", F.lit(6)).cast("string")).alias("author"))
    return wording.delta_ranks(docs, "doc_id", "author", "text", 40, Kept(spark, "wording"), person_block=8, sample_block=512)


def nearest_wording(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d).select("doc_id", "author", "n_words", *[F.round(c, 6).alias(c) for c in ("delta", "second", "own")])


def wording_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return wording.accuracy_by_words(_ranks(spark, d), "author", [50, 200, 1000])


def passages_spoken(spark: SparkSession, d: str) -> DataFrame:
    """Turns as timed segments of their conversation; passages are two neighbouring turns of one, with their first words lost."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    segments = t.select(F.col("conv_id").alias("document_id"), (F.col("turn") * 1000).alias("start_ms"), "text")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("more"))
    both = t.join(nxt, ["conv_id", "turn"]).select(F.col("conv_id").alias("document_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.concat(F.lit("lost words "), F.expr("substring(text, 12)"), F.lit(" "), "more").alias("content"))
    return wording.spoken_at(both, segments, probe=4, least=6).withColumnRenamed("start", "start_ms")


QUERIES = {f.__name__: f for f in (nearest_wording, wording_accuracy, passages_spoken)}

_RANKS = """
d AS (SELECT doc_id, concat_ws('/', lang, doc_id % 6) AS author, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
o AS (SELECT doc_id, author, len(w) AS n, w FROM d WHERE len(w) > 0),
x AS (SELECT doc_id, unnest(w) AS word FROM o),
v AS (SELECT word FROM x GROUP BY word ORDER BY count(*) DESC, word LIMIT 40),
c AS (SELECT doc_id, word, count(*) AS c FROM x JOIN v USING (word) GROUP BY ALL),
g AS (SELECT o.doc_id, author, n, word, coalesce(c, 0) AS c FROM o CROSS JOIN v LEFT JOIN c USING (doc_id, word)),
sd AS (SELECT word, CASE WHEN stddev_pop(c / n) > 0 THEN stddev_pop(c / n) ELSE 1 END AS sd FROM g GROUP BY word),
p AS (SELECT author AS other, word, sum(c) AS pc FROM g GROUP BY ALL),
pn AS (SELECT author AS other, sum(n) AS pn, count(*) AS m FROM o GROUP BY author),
dl AS (SELECT doc_id, author, n, other, round(avg(abs(c / n - (pc - CASE WHEN author = other THEN c ELSE 0 END) / (pn - CASE WHEN author = other THEN n ELSE 0 END)) / sd), 9) AS delta
       FROM g JOIN p USING (word) JOIN pn USING (other) JOIN sd USING (word) WHERE author <> other OR m > 1 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY delta, other) AS k FROM dl),
r AS (SELECT doc_id, author, n AS n_words, max(other) FILTER (k = 1) AS nearest, max(delta) FILTER (k = 1) AS delta, max(delta) FILTER (k = 2) AS second, max(delta) FILTER (other = author) AS own FROM k GROUP BY ALL HAVING count(*) FILTER (other = author) > 0)"""

ORACLES = {
    "nearest_wording": f"WITH {_RANKS} SELECT doc_id, author, n_words, round(delta, 6) AS delta, round(second, 6) AS second, round(own, 6) AS own FROM r",
    "wording_accuracy": f"WITH {_RANKS} SELECT CASE WHEN n_words >= 1000 THEN 1000 WHEN n_words >= 200 THEN 200 WHEN n_words >= 50 THEN 50 ELSE 0 END AS words, count(*) AS n, CAST(count(*) FILTER (nearest = author) AS BIGINT) AS hits, round(count(*) FILTER (nearest = author) / count(*), 6) AS accuracy FROM r GROUP BY 1",
    "passages_spoken": """
WITH t AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM conversations WHERE text IS NOT NULL),
s AS (SELECT conv_id, string_agg(array_to_string(w, ' '), ' ' ORDER BY turn) FILTER (len(w) > 0) AS whole FROM t GROUP BY conv_id),
e AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM t),
l AS (SELECT conv_id, turn, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o) AS run, lead(word, 3) OVER o AS last FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY turn, i)),
f AS (SELECT conv_id, run, min(turn) * 1000 AS t FROM l WHERE last IS NOT NULL GROUP BY ALL),
p AS (SELECT a.conv_id, a.turn, regexp_extract_all(lower('lost words ' || substring(a.text, 12) || ' ' || b.text), '[\\p{L}\\p{N}]+') AS w FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL),
q AS (SELECT conv_id, turn, k AS place, w[CAST(floor(len(w) * share) AS BIGINT) + 1 : CAST(floor(len(w) * share) AS BIGINT) + 4] AS probe FROM p, (VALUES (0, 0.0), (1, 0.25), (2, 0.5)) AS u(k, share) WHERE len(w) >= 6)
SELECT q.conv_id AS document_id, q.conv_id * 1000 + turn AS chunk_id, place, t AS start_ms FROM q JOIN f ON f.conv_id = q.conv_id AND f.run = array_to_string(probe, ' ') WHERE len(probe) = 4
QUALIFY row_number() OVER (PARTITION BY q.conv_id, turn ORDER BY place) = 1""",
}
