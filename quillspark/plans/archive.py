"""Queries of archive reads over orders (documents), line items (votes), customers (people), events (turns), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import display, text
from quillspark.operators import archive
from quillspark.sources.tables import table

KINDS = ["1-URGENT", "2-HIGH"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents: every tenth is replaced by the next, every thirteenth has no day."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    day = F.when(k % 13 != 0, F.to_date("o_orderdate"))
    provenance = F.when(k % 4 == 0, "minutes").when(k % 4 == 1, "filename").when(k % 4 == 2, "manual")
    return o.select(k.alias("id"), (F.col("o_custkey") % 7).alias("body"), F.col("o_orderpriority").alias("kind"), day.alias("day"), F.when(k % 10 == 3, k + 1).alias("replaces_id"), provenance.alias("provenance"), F.col("o_custkey").alias("person"))


_DOCS = """d AS (SELECT o_orderkey AS id, o_custkey % 7 AS body, o_orderpriority AS kind, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS day,
 CASE WHEN o_orderkey % 10 = 3 THEN o_orderkey + 1 END AS replaces_id, CASE o_orderkey % 4 WHEN 0 THEN 'minutes' WHEN 1 THEN 'filename' WHEN 2 THEN 'manual' END AS provenance, o_custkey AS person FROM orders)"""


def _votes(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    return line.select(F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("vote_id"), (F.col("l_suppkey") % 40).alias("member"), (F.col("l_partkey") % 7).alias("body"), F.col("l_returnflag").alias("outcome"), F.to_date("l_shipdate").alias("shipped"))


_VOTES = "v AS (SELECT l_orderkey AS document_id, l_orderkey * 8 + l_linenumber AS vote_id, l_suppkey % 40 AS member, l_partkey % 7 AS body, l_returnflag AS outcome, CAST(l_shipdate AS DATE) AS shipped FROM lineitem)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Events as turns of a cluster (the user) in a meeting (the day); the value is the length in seconds."""
    e = table(spark, d, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("meeting"), F.col("user_id").alias("cluster"), F.col("event_type").alias("label"), start.alias("start"), (start + 60_000_000).alias("end"), F.col("value").alias("seconds"))


_TURNS = "t AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS meeting, user_id AS cluster, event_type AS label, epoch_us(ts) AS start, epoch_us(ts) + 60000000 AS \"end\", value AS seconds FROM events)"
_day = lambda c="day": F.col(c).cast("string").alias(c)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query and the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(f"WITH {_DOCS} SELECT id, body, kind FROM d WHERE replaces_id IS NULL")
def current_documents(spark, d):
    return archive.current(_docs(spark, d)).select("id", "body", "kind")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'")
def name_pattern(spark, d):
    return archive.named_like(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "%RING%")


@query(f"WITH {_DOCS} SELECT id, CAST(day AS VARCHAR) AS day FROM d WHERE body = 3 AND kind = '2-HIGH' ORDER BY day DESC NULLS LAST, id LIMIT 50")
def browse_newest(spark, d):
    return archive.newest(archive.scoped(_docs(spark, d), body=3, kind="2-HIGH"), 50).select("id", _day())


@query(f"WITH {_DOCS} SELECT id, CAST(day AS VARCHAR) AS day FROM d WHERE replaces_id IS NULL AND kind IN ('1-URGENT', '2-HIGH') AND day >= DATE '1998-01-01' ORDER BY day DESC, id LIMIT 100")
def recent_feed(spark, d):
    return archive.recent(_docs(spark, d), KINDS, F.lit("1998-01-01").cast("date"), 100).select("id", _day())


@query(f"WITH {_DOCS} SELECT id, kind FROM d WHERE replaces_id IS NULL AND body = 2 AND kind IN ('1-URGENT', '2-HIGH') AND day = (SELECT max(day) FROM d WHERE body = 2)")
def meeting_bundle(spark, d):
    docs = _docs(spark, d)
    last = docs.where("body = 2").agg(F.max("day")).head()[0]
    return archive.meeting_bundle(docs, 2, F.lit(last), KINDS).select("id", "kind")


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'F')")
def guarded_figures(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return archive.guarded(o, "o_orderpriority", "o_orderstatus", {"1-URGENT": "O", "5-LOW": "F"})


@query("SELECT l_orderkey, l_linenumber, l_suppkey AS subject_id FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def publishable_edges(spark, d):
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("subject_id"), (F.col("l_linestatus") == "F").alias("projection_complete"))
    subjects = table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject_id"), (F.col("s_acctbal") > 0).alias("publishable"))
    return archive.publishable(edges, subjects).select("l_orderkey", "l_linenumber", "subject_id")


@query("""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{00A0}\\x{0085}\\x{000B}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, contains(t, substr(t, length(t) // 3 + 1, 80) || CASE WHEN doc_id % 3 = 0 THEN '#no' ELSE '' END) AS verbatim FROM n""")
def verbatim_passages(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    t = text.squeeze(F.col("text"))
    chunk = F.concat(F.substring(t, F.floor(F.char_length(t) / 3).cast("int") + 1, F.lit(80)), F.when(F.col("doc_id") % 3 == 0, "#no").otherwise(""))
    return archive.verbatim(docs.select("doc_id", chunk.alias("chunk")), docs, "doc_id", "chunk", "text").select("doc_id", "verbatim")


@query(f"WITH {_TURNS} SELECT cluster FROM (SELECT meeting || '/' || cluster AS cluster, min(label) AS evidence, bool_or(label = 'error') AS hit FROM t GROUP BY meeting, t.cluster) WHERE evidence <> 'click' AND NOT hit")
def without_minors(spark, d):
    t = _turns(spark, d).withColumn("cluster", F.concat_ws("/", "meeting", F.col("cluster").cast("string")))
    clusters = t.groupBy("cluster").agg(F.min("label").alias("evidence"))
    return archive.without_minors(clusters.where("evidence <> 'click'"), t, "error", text="label").select("cluster")


@query(f"WITH {_TURNS}, s AS (SELECT meeting, cluster, sum(CAST(seconds * 100 AS BIGINT)) AS size FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY size DESC, cluster) AS place FROM s WHERE size >= 2000) SELECT meeting, cluster, CAST(size AS BIGINT) AS size, place FROM r WHERE place <= 3")
def negative_picks(spark, d):
    size = F.sum(F.round(F.col("seconds") * 100, 0).cast("long"))
    s = _turns(spark, d).groupBy("meeting", "cluster").agg(size.alias("size"))
    return archive.longest_per(s, ["meeting"], "size", "cluster", 3, 2000).select("meeting", "cluster", "size", F.col("place").cast("long").alias("place"))


@query(f"WITH {_DOCS}, {_VOTES} SELECT s_name AS subject, document_id, CAST(vote_id AS VARCHAR) AS vote_ref, 'voted' AS edge, CAST(day AS VARCHAR) AS day, outcome FROM (SELECT DISTINCT document_id, vote_id, member FROM v) e JOIN supplier ON s_suppkey = member JOIN d ON d.id = document_id AND replaces_id IS NULL JOIN (SELECT DISTINCT document_id, vote_id, outcome FROM v) x USING (document_id, vote_id)")
def cited_timeline(spark, d):
    v = _votes(spark, d).withColumn("vote_ref", F.col("vote_id").cast("string"))
    edges = v.select("document_id", "vote_ref", F.col("member").alias("subject_id"), F.lit("voted").alias("edge")).distinct()
    subjects = table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject_id"), F.col("s_name").alias("subject"))
    out = archive.cited_timeline(edges, subjects, _docs(spark, d), v.select("document_id", "vote_ref", "outcome").distinct())
    return out.select("subject", "document_id", "vote_ref", "edge", _day(), "outcome")


@query(f"WITH {_VOTES} SELECT vote_id, member, body FROM v WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 40 = member AND s_nationkey % 7 = body)")
def seated_votes(spark, d):
    members = table(spark, d, "supplier").select((F.col("s_suppkey") % 40).alias("member"), (F.col("s_nationkey") % 7).cast("long").alias("body"))
    return archive.seated_votes(_votes(spark, d), members).select("vote_id", "member", "body")


@query(f"WITH {_DOCS}, {_VOTES} SELECT vote_id, id, coalesce(kind, '') AS kind, coalesce(CAST(day AS VARCHAR), '') AS day FROM (SELECT vote_id, document_id + 5 AS id FROM v) r LEFT JOIN d USING (id)")
def enriched_results(spark, d):
    rows = _votes(spark, d).select("vote_id", (F.col("document_id") + 5).alias("id"))
    return archive.enriched(rows, _docs(spark, d), "id", ["kind", "day"])


@query("SELECT s_nationkey AS body, s_suppkey AS subject_id, CASE WHEN s_acctbal > 5000 THEN 'chair' ELSE 'member' END AS role, coalesce(lower(c_name), 's' || s_suppkey) AS slug FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 30")
def public_roster(spark, d):
    s = table(spark, d, "supplier")
    memberships = s.select(F.col("s_nationkey").alias("body"), F.col("s_suppkey").alias("subject_id"), F.when(F.col("s_acctbal") > 5000, "chair").otherwise("member").alias("role"))
    subjects = s.select(F.col("s_suppkey").alias("subject_id"), (F.col("s_suppkey") * 30).alias("person_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), F.lower("c_name").alias("slug"))
    return archive.roster(memberships, subjects, people)


@query(f"WITH {_DOCS}, {_VOTES} SELECT vote_id, CAST(day AS VARCHAR) AS day FROM (SELECT DISTINCT vote_id, document_id FROM v) v JOIN d ON d.id = document_id WHERE replaces_id IS NULL AND d.body = 4 ORDER BY d.day DESC NULLS LAST, vote_id LIMIT 200")
def current_votes(spark, d):
    v = _votes(spark, d).select("vote_id", "document_id").distinct()
    return archive.votes_of_current(v, _docs(spark, d), 4, 200).select("vote_id", _day())


@query(f"WITH {_TURNS}, w AS (SELECT meeting || '/' || k AS window_id, meeting, epoch_us(CAST(meeting AS TIMESTAMP)) + k * 21600000000 AS since, epoch_us(CAST(meeting AS TIMESTAMP)) + (k + 1) * 21600000000 AS until FROM (SELECT DISTINCT meeting FROM t), range(4) AS r(k)) SELECT window_id, cluster, min(start) AS first FROM t JOIN w USING (meeting) WHERE start < until AND \"end\" > since GROUP BY ALL")
def clusters_in_windows(spark, d):
    t = _turns(spark, d)
    midnight = F.unix_micros(F.col("meeting").cast("timestamp"))
    w = t.select("meeting").distinct().select("meeting", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    w = w.select(F.concat_ws("/", "meeting", F.col("k").cast("string")).alias("window_id"), "meeting", (midnight + F.col("k") * 21600000000).alias("since"), (midnight + (F.col("k") + 1) * 21600000000).alias("until"))
    return archive.clusters_between(t.select("meeting", "cluster", "start", "end"), w, "meeting")


@query(f"WITH {_DOCS} SELECT person, min(kind) AS kind FROM d WHERE kind IS NOT NULL AND id % 3 = 0 GROUP BY person HAVING count(DISTINCT kind) = 1")
def inherited_values(spark, d):
    return archive.unanimous(_docs(spark, d).where("id % 3 = 0"), "person", "kind")


@query(f"WITH {_VOTES} SELECT document_id AS vote_id, array_to_string(list_sort(list(DISTINCT member)), ',') AS members, array_to_string(list_sort(list(DISTINCT body)), ',') AS matters FROM v GROUP BY document_id")
def vote_maps(spark, d):
    v = _votes(spark, d)
    edges = v.select(F.col("document_id").alias("vote_id"), F.lit("member").alias("kind"), F.col("member").alias("target")).unionByName(v.select(F.col("document_id").alias("vote_id"), F.lit("matter").alias("kind"), F.col("body").alias("target")))
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return archive.vote_maps(edges).select("vote_id", flat("members"), flat("matters"))


@query(f"WITH {_VOTES} SELECT member, outcome, count(*) AS n, CAST(min(shipped) AS VARCHAR) AS first_day, CAST(max(shipped) AS VARCHAR) AS last_day FROM v GROUP BY ALL")
def member_summary(spark, d):
    return archive.member_summary(_votes(spark, d), ["member", "outcome"], "shipped").select("member", "outcome", "n", _day("first_day"), _day("last_day"))


@query(f"WITH {_DOCS} SELECT person, body, count(*) AS terms, CAST(min(day) AS VARCHAR) AS since, CASE WHEN bool_and(replaces_id IS NULL) THEN CAST(max(CASE WHEN replaces_id IS NULL THEN day + 365 END) AS VARCHAR) END AS until, bool_or(replaces_id IS NOT NULL) AS open FROM d WHERE day IS NOT NULL GROUP BY ALL")
def person_dossier(spark, d):
    m = _docs(spark, d).where("day is not null").select("person", "body", F.col("day").alias("start"), F.when(F.col("replaces_id").isNull(), F.date_add("day", 365)).alias("end"))
    return archive.dossier(m).select("person", "body", "terms", _day("since"), _day("until"), "open")


@query(f"WITH {_DOCS} SELECT body, CAST(day AS VARCHAR) AS day, bool_or(kind = '1-URGENT') AS has_minutes, bool_or(kind = '2-HIGH') AS has_transcript, arg_min(id, CASE kind WHEN '1-URGENT' THEN 0 ELSE 1 END * 1000000000000 + id) FILTER (kind IN ('1-URGENT', '2-HIGH')) AS summary_id FROM d WHERE day IS NOT NULL GROUP BY body, d.day")
def meeting_list(spark, d):
    return archive.meeting_list(_docs(spark, d), {"has_minutes": "1-URGENT", "has_transcript": "2-HIGH"}, KINDS).select("body", _day(), "has_minutes", "has_transcript", "summary_id")


_RESULT = """t AS (SELECT document_id, count(*) FILTER (outcome = 'A') AS ayes, count(*) FILTER (outcome = 'R') AS noes FROM v GROUP BY 1),
s AS (SELECT t.*, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' END AS stated, CASE WHEN ayes > noes THEN 'passed' WHEN ayes < noes THEN 'failed' END AS counted FROM t JOIN orders ON o_orderkey = document_id)"""


@query(f"WITH {_VOTES}, {_RESULT} SELECT document_id, coalesce(stated, counted) AS result, CASE WHEN NOT coalesce(stated <> counted, false) THEN ayes END AS ayes, CASE WHEN NOT coalesce(stated <> counted, false) THEN noes END AS noes FROM s")
def vote_results(spark, d):
    t = archive.tally(_votes(spark, d), ["document_id"], "outcome", {"ayes": "A", "noes": "R"})
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "failed").alias("stated"))
    return archive.inferred_result(t.join(o, "document_id"), "stated", "ayes", "noes").select("document_id", "result", "ayes", "noes")


@query("SELECT c_mktsegment, n, row_number() OVER (ORDER BY list_position(['MACHINERY', 'BUILDING', 'FURNITURE'], c_mktsegment)) AS place FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) WHERE c_mktsegment IN ('MACHINERY', 'BUILDING', 'FURNITURE')")
def themes_in_order(spark, d):
    n = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return archive.fixed_order(n, "c_mktsegment", ["MACHINERY", "BUILDING", "FURNITURE"], ["c_mktsegment"]).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_TURNS}, r AS (SELECT cluster, event_id, row_number() OVER (PARTITION BY cluster ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY cluster) AS m FROM t) SELECT cluster, event_id FROM r WHERE m <= 5 OR k IN (0, (2 * (m - 1) + 4) // 8, (4 * (m - 1) + 4) // 8, (6 * (m - 1) + 4) // 8, m - 1)")
def even_sample(spark, d):
    return archive.even_sample(_turns(spark, d).select("cluster", "event_id"), ["cluster"], "event_id", 5)


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 9 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, o_orderstatus AS "before", s AS now, CASE WHEN o_orderstatus IS NULL THEN 'gained' WHEN s IS NULL THEN 'lost' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE o_orderstatus IS DISTINCT FROM s""")
def run_delta(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    now = o.where("o_orderkey % 9 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return archive.run_delta(o.where("o_orderkey % 11 <> 0"), now, "o_orderkey", "o_orderstatus")


@query(f"WITH {_VOTES}, p AS (SELECT document_id, list_sort(list(DISTINCT member) FILTER (outcome = 'A')) AS a, list_sort(list(DISTINCT member)) AS c FROM v GROUP BY 1) SELECT document_id, coalesce(array_to_string(a, ','), '') AS present, array_to_string(list_filter(c, lambda x: a IS NULL OR NOT list_contains(a, x)), ',') AS silent FROM p")
def roll_union(spark, d):
    v = _votes(spark, d)
    heard = v.select("document_id", F.array("member").alias("called"), F.when(F.col("outcome") == "A", F.array("member")).otherwise(F.expr("cast(array() as array<bigint>)")).alias("answered"))
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return archive.roll_union(heard, "document_id", "called", "answered").select("document_id", flat("present"), flat("silent"))


@query("SELECT tier, count(o_orderkey) AS n, round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(o_orderkey), 0), 6) AS recall FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('9-NONE')) AS t(tier) LEFT JOIN orders ON o_orderpriority = tier GROUP BY tier")
def tier_recall(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderpriority").alias("tier"), (F.col("o_orderstatus") == "F").alias("right"))
    return archive.tier_recall(s, ["1-URGENT", "2-HIGH", "3-MEDIUM", "9-NONE"])


_VERDICT = "n AS (SELECT meeting, cluster, label, count(*) AS frames FROM t GROUP BY ALL HAVING count(*) >= 2), w AS (SELECT meeting, cluster, any_value(label) AS label, max(frames) AS frames FROM n GROUP BY meeting, cluster HAVING count(*) = 1)"


@query(f"WITH {_TURNS}, {_VERDICT} SELECT * FROM w")
def cluster_verdicts(spark, d):
    return archive.cluster_verdict(_turns(spark, d), ["meeting", "cluster"], "label", 2)


@query(f"WITH {_TURNS}, {_VERDICT} SELECT meeting, label, count(*) AS clusters FROM w GROUP BY ALL HAVING count(*) > 1")
def label_caps(spark, d):
    return archive.label_caps(archive.cluster_verdict(_turns(spark, d), ["meeting", "cluster"], "label", 2), "meeting", "label", 1)


@query(f"WITH {_TURNS} SELECT cluster, CAST(sum(\"end\" - start) // 1000000 AS BIGINT) AS seconds FROM t GROUP BY cluster")
def span_seconds(spark, d):
    return _turns(spark, d).groupBy("cluster").agg(F.expr("sum(end - start) div 1000000").alias("seconds"))


@query(f"WITH {_TURNS}, e AS (SELECT cluster, count(DISTINCT meeting) AS m, count(DISTINCT label) AS c, count(*) AS n FROM t GROUP BY 1) SELECT count(*) AS labels, CAST(count(*) FILTER (m > 1) AS BIGINT) AS recurring, CAST(count(*) FILTER (c > 1) AS BIGINT) AS cross_condition, CAST(sum(n) AS BIGINT) AS samples FROM e")
def benchmark_shape(spark, d):
    return archive.benchmark_shape(_turns(spark, d), "cluster", "meeting", "label")


@query(r"""WITH t AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents), c AS (SELECT source, token, count(*) AS c FROM t GROUP BY ALL),
v AS (SELECT token FROM c GROUP BY token ORDER BY sum(c) DESC, token LIMIT 40), g AS (SELECT source, sum(c) AS s FROM c GROUP BY 1),
x AS (SELECT g.source, v.token, coalesce(c, 0) / s AS rate FROM g CROSS JOIN v LEFT JOIN c ON c.source = g.source AND c.token = v.token), o AS (SELECT token, avg(rate) AS m, stddev_pop(rate) AS sd FROM x GROUP BY 1)
SELECT x.source, x.token, round(rate, 6) AS rate, round(CASE WHEN sd > 0 THEN (rate - m) / sd ELSE 0 END, 4) AS z FROM x JOIN o ON o.token = x.token""")
def token_profile(spark, d):
    docs = table(spark, d, "documents").select("source", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))
    return archive.token_profile(docs, "source", "tokens", 40).select("source", "token", F.round("rate", 6).alias("rate"), F.round("z", 4).alias("z"))


@query("""WITH c AS (SELECT l_orderkey AS row, l_linenumber AS col, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem), t AS (SELECT o_orderkey AS row, CAST(round(o_totalprice * 100) AS BIGINT) AS stated FROM orders)
SELECT coalesce(s.row, t.row) AS "row", total, stated, coalesce(total, 0) - coalesce(stated, 0) AS gap FROM (SELECT row, CAST(sum(v) AS BIGINT) AS total FROM c GROUP BY 1) s FULL JOIN t ON t.row = s.row""")
def cross_foot(spark, d):
    cents = lambda c: F.round(F.col(c) * 100, 0).cast("long")
    cells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), cents("l_extendedprice").alias("v"))
    totals = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), cents("o_totalprice").alias("stated"))
    return archive.cross_foot(cells, "row", "col", "v", totals).select("row", "total", "stated", "gap")


@query("""WITH y AS (SELECT o_custkey % 20 AS fund, year(o_orderdate) AS y, count(*) AS opening, count(*) FILTER (o_orderstatus = 'F') AS change FROM orders GROUP BY ALL),
x AS (SELECT *, CASE WHEN lag(y) OVER w = y - 1 THEN lag(opening + change) OVER w END AS expected FROM y WINDOW w AS (PARTITION BY fund ORDER BY y))
SELECT fund, CAST(y AS INTEGER) AS y, opening, expected, expected IS NULL OR expected = opening AS ok FROM x""")
def roll_forward(spark, d):
    y = table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("fund"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("opening"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("change"))
    return archive.roll_forward(y, ["fund"], "y", "opening", "change").select("fund", "y", "opening", "expected", "ok")


@query("""WITH s AS (SELECT user_id AS q, event_type AS arm, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY ALL), f AS (SELECT q FROM s GROUP BY q HAVING count(DISTINCT arm) = 5)
SELECT arm, count(*) AS queries, round(avg(v), 4) AS mean FROM s WHERE q IN (SELECT q FROM f) GROUP BY arm""")
def arm_means(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("query"), F.col("event_type").alias("arm")).agg(F.sum(F.round(F.col("value") * 100, 0).cast("long")).alias("value"))
    return archive.arm_means(s, 5).select("arm", "queries", F.round("mean", 4).alias("mean"))


@query("""WITH p AS (SELECT p_size AS k, count(*) FILTER (p_type = 'ECONOMY') / count(*) AS guard, count(*) / 1.0 AS score FROM part GROUP BY 1), f AS (SELECT unnest([0.1, 0.2, 0.9]) AS floor),
r AS (SELECT floor, k, score, row_number() OVER (PARTITION BY floor ORDER BY score DESC, k) AS n FROM p JOIN f ON guard >= floor) SELECT CAST(floor AS DOUBLE) AS floor, k, CAST(score AS DOUBLE) AS score FROM r WHERE n = 1""")
def best_above_floors(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_size").alias("k")).agg((F.sum((F.col("p_type") == "ECONOMY").cast("long")) / F.count("*")).alias("guard"), F.count("*").cast("double").alias("score"))
    return archive.best_above(p, [0.1, 0.2, 0.9], "guard", "score", "k")


@query(f"""WITH {_DOCS}, e AS (SELECT kind, person, id, row_number() OVER (PARTITION BY kind, person ORDER BY day DESC NULLS LAST, id) AS n, day FROM d), x AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY day DESC NULLS LAST, id) AS place FROM e WHERE n <= 4)
SELECT kind, id, place FROM x WHERE place <= 16""")
def digest_evidence(spark, d):
    out = archive.caps_per(_docs(spark, d), "kind", "person", [F.desc_nulls_last("day"), F.asc("id")], 4, 16)
    return out.select("kind", "id", F.col("place").cast("long").alias("place"))


@query("""WITH v AS (SELECT o_orderkey AS k, o_orderstatus AS label FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE o_orderstatus END AS label, o_orderkey % 5 = 0 AS locked FROM orders WHERE o_orderkey % 7 <> 0)
SELECT v.k, v.label, CASE WHEN s.label IS NULL THEN 'insert' WHEN s.label = v.label THEN 'agree' WHEN locked THEN 'guarded' ELSE 'conflict' END AS action FROM v LEFT JOIN s ON s.k = v.k""")
def verdict_actions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("label"))
    stored = o.where("k % 7 <> 0").select("k", F.when(F.col("k") % 3 == 0, "Z").otherwise(F.col("label")).alias("label"), (F.col("k") % 5 == 0).alias("locked"))
    return archive.verdict_actions(o.where("k % 2 = 0"), stored, ["k"]).select("k", "label", "action")


@query(f"WITH {_DOCS}, r AS (SELECT id, first_value(id) OVER (PARTITION BY person ORDER BY provenance IS NULL, day DESC NULLS LAST, id) AS replaces_id FROM d) SELECT id, replaces_id FROM r WHERE id <> replaces_id")
def supersession_plan(spark, d):
    return archive.supersession_plan(_docs(spark, d).select("id", "person", "provenance", "day"), "person", [F.col("provenance").isNull(), F.desc_nulls_last("day"), F.asc("id")])


@query(f"WITH {_DOCS} SELECT DISTINCT body, CAST(day AS VARCHAR) AS day FROM d WHERE provenance IN ('minutes', 'manual') AND day IS NOT NULL")
def trusted_calendar(spark, d):
    return archive.trusted_dates(_docs(spark, d), ["minutes", "manual"])[0].select("body", _day())


@query(f"WITH {_DOCS}, c AS (SELECT DISTINCT body, day FROM d WHERE provenance IN ('minutes', 'manual') AND day IS NOT NULL) SELECT id, body, CAST(day AS VARCHAR) AS day FROM d WHERE coalesce(provenance, '') NOT IN ('minutes', 'manual') AND day IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.body = d.body AND c.day = d.day)")
def untrusted_dates(spark, d):
    return archive.trusted_dates(_docs(spark, d), ["minutes", "manual"])[1].select("id", "body", _day())


@query(f"WITH {_DOCS}, r AS (SELECT id, day, provenance, CASE provenance WHEN 'minutes' THEN 3 WHEN 'manual' THEN 2 WHEN 'filename' THEN 1 ELSE 0 END AS k FROM d) SELECT id, CAST(CASE WHEN k < 2 AND id % 2 = 1 THEN DATE '2001-01-01' ELSE day END AS VARCHAR) AS day, CASE WHEN k < 2 AND id % 2 = 1 THEN 'manual' ELSE provenance END AS provenance, k < 2 AND id % 2 = 1 AS redated FROM r")
def redated_documents(spark, d):
    docs = _docs(spark, d).select("id", "day", "provenance")
    inferred = docs.where("id % 2 = 1").select("id", F.lit("2001-01-01").cast("date").alias("day"), F.lit("manual").alias("provenance"))
    return archive.redated(docs, inferred, {"minutes": 3, "manual": 2, "filename": 1}).select("id", _day(), "provenance", "redated")


@query("SELECT l_orderkey, count(*) AS failed FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'R')")
def wholesale_failures(spark, d):
    runs = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("outcome"))
    return archive.wholesale_failure(runs, "l_orderkey", "outcome")


@query("""WITH o AS (SELECT l_orderkey AS doc, l_linenumber AS i, any_value(l_returnflag || l_linestatus) AS t FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_returnflag || l_linestatus) = 1),
h AS (SELECT a.doc, a.i, count(*) AS n, min(b.i) AS only_, max(CASE WHEN b.i = a.i THEN b.i END) AS same FROM o a JOIN o b ON a.doc = b.doc AND a.t = b.t AND b.i <> 2 GROUP BY ALL)
SELECT o.doc, o.i AS "index", CASE WHEN n = 1 THEN only_ ELSE same END AS new_index FROM o LEFT JOIN h ON h.doc = o.doc AND h.i = o.i""")
def canonical_chunks(spark, d):
    t = F.concat("l_returnflag", "l_linestatus")
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("index")).agg(F.min(t).alias("text"), F.countDistinct(t).alias("n")).where("n = 1").drop("n")
    return archive.canonical_chunks(line, line.where("index <> 2"))


@query("SELECT o_orderpriority, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, round(avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))), 6) AS mean_lag FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def coverage_lag(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderpriority", F.to_date("o_orderdate").alias("day"), F.to_date("l_shipdate").alias("posted"))
    return archive.coverage_lag(rows, "o_orderpriority", "day", "posted").select("o_orderpriority", _day("first_day"), _day("last_day"), "days", F.round("mean_lag", 6).alias("mean_lag"))


@query("""WITH c AS (SELECT lower(p_name) AS k, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS s, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, s) AS i, sum(n) OVER (PARTITION BY k) AS total FROM c)
SELECT k, s, n, CAST(total AS BIGINT) AS total, CAST(len(string_split(k, ' ')) AS INTEGER) AS tokens FROM r WHERE i = 1""")
def frequent_surfaces(spark, d):
    c = table(spark, d, "part").select(F.lower("p_name").alias("k"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("s")).groupBy("k", "s").agg(F.count("*").alias("n"))
    return archive.surfaces(c, "k", "s", "n")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 50 AS a, l_partkey % 50 + CAST(l_quantity AS BIGINT) AS b FROM lineitem)
SELECT doc, a, b FROM s WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.doc = s.doc AND x.a <= s.a AND x.b >= s.b AND (x.a < s.a OR x.b > s.b))""")
def longest_spans(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 50).alias("a"), (F.col("l_partkey") % 50 + F.col("l_quantity").cast("long")).alias("b")).distinct()
    return archive.longest_only(s, "doc", "a", "b")


@query(f"WITH {_TURNS} SELECT event_id, CASE WHEN c_acctbal > 3000 THEN c_name ELSE 'Speaker ' || cluster END AS speaker FROM t LEFT JOIN customer ON c_custkey = cluster")
def reader_transcript(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("cluster"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 3000, "confirmed").otherwise("low").alias("confidence"))
    return archive.transcript(_turns(spark, d).select("event_id", "cluster"), ids, ["confirmed", "inferred_high"]).select("event_id", "speaker")


@query("""SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock,
 right(CAST(year(o_orderdate) - 1 AS VARCHAR), 2) || '-' || right(CAST(year(o_orderdate) AS VARCHAR), 2) AS short_year, '#q' || lpad(lower(to_hex(o_orderkey)), CAST(greatest(4, length(to_hex(o_orderkey))) AS INTEGER), '0') AS display_id,
 CASE WHEN o_totalprice <= m THEN m WHEN o_totalprice <= 2 * m THEN 2 * m WHEN o_totalprice <= 5 * m THEN 5 * m ELSE 10 * m END AS ceiling
FROM (SELECT *, CAST(floor(o_totalprice / 10) AS BIGINT) AS s, CAST(pow(10, length(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)) - 1) AS DOUBLE) AS m FROM orders)""")
def display_forms(spark, d):
    o = table(spark, d, "orders")
    year = F.year("o_orderdate")
    return o.select("o_orderkey", display.clock(F.col("o_totalprice") / 10).alias("clock"), display.short_year(F.concat_ws("-", (year - 1).cast("string"), year.cast("string"))).alias("short_year"), display.display_id(F.lit(""), F.col("o_orderkey")).alias("display_id"), display.nice_ceiling(F.col("o_totalprice")).alias("ceiling"))


@query("SELECT p_partkey, lower(b) IN (a, a || 's') OR a = lower(b) || 's' AS trivial FROM (SELECT p_partkey, replace(p_name, ' ', '') AS a, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '') || 's' WHEN 1 THEN replace(p_name, ' ', '') ELSE replace(p_name, ' ', '') || 'x' END AS b FROM part)")
def trivial_variants(spark, d):
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("s"))).when(F.col("p_partkey") % 3 == 1, F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).otherwise(F.concat("p_name", F.lit("x")))
    return table(spark, d, "part").select("p_partkey", display.trivial_variant(F.col("p_name"), other).alias("trivial"))


@query("SELECT o_orderkey, (o_custkey % 7) || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || lower(o_orderpriority) || '|' || (year(o_orderdate)) || ' budget' AS key FROM orders")
def cluster_keys(spark, d):
    title = F.concat(F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "  Budget FINAL.pdf").otherwise(" budget.html"))
    return table(spark, d, "orders").select("o_orderkey", display.cluster_key(F.col("o_custkey") % 7, F.to_date("o_orderdate"), F.col("o_orderpriority"), title).alias("key"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN CAST(NULL AS VARCHAR) ELSE strftime(CASE WHEN o_orderkey % 6 = 4 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END, '%Y-%m-%d') END AS day FROM orders""")
def days_in_names(spark, d):
    day = F.to_date("o_orderdate")
    form = lambda f: F.date_format(day, f)
    k = F.col("o_orderkey") % 6
    name = F.when(k == 0, F.concat(F.lit("Minutes "), form("yyyy-MM-dd"), F.lit(".pdf"))).when(k == 1, F.concat(F.lit("Meeting of "), form("MMM d, yyyy"))).when(k == 2, F.concat(F.lit("BOE_"), form("MMddyyyy"))).when(k == 3, F.concat(F.lit("agenda "), form("M.d.yyyy"))).when(k == 4, form("MMMyyyy")).otherwise("no date here 13.45.2020")
    return table(spark, d, "orders").select("o_orderkey", display.day_in_name(name, (1985, 2035)).cast("string").alias("day"))


@query(r"""WITH r AS (SELECT p_partkey, p_name AS q, regexp_matches(p_name, '\bring\b') AS a, regexp_matches(p_name, '\bred\b') AS b FROM part)
SELECT p_partkey, CASE WHEN a AND b THEN regexp_replace(q, '\bring\b', 'hoop', 'g') || '|' || regexp_replace(q, '\bred\b', 'crimson', 'g') WHEN a THEN regexp_replace(q, '\bring\b', 'hoop', 'g') WHEN b THEN regexp_replace(q, '\bred\b', 'crimson', 'g') ELSE '' END AS variants FROM r""")
def query_corrections(spark, d):
    pairs = F.array(*[F.struct(F.lit(a).alias("mangled"), F.lit(b).alias("canonical")) for a, b in (("ring", "hoop"), ("red", "crimson"))])
    return table(spark, d, "part").select("p_partkey", F.array_join(display.corrected_queries(F.col("p_name"), pairs), "|").alias("variants"))


@query("""WITH w AS (SELECT p_partkey, p_retailprice AS d, CAST(greatest(ceil(p_retailprice / 300), 1) AS BIGINT) AS n FROM part), k AS (SELECT *, CASE WHEN n > 1 AND d - (n - 1) * 300 < 30 THEN n - 1 ELSE n END AS k FROM w)
SELECT p_partkey, k AS windows, round(d - (k - 1) * 300, 4) AS last FROM k""")
def duration_windows(spark, d):
    w = display.windows(F.col("p_retailprice"), 300.0, 30.0)
    return table(spark, d, "part").select("p_partkey", w.alias("w")).select("p_partkey", F.size("w").cast("long").alias("windows"), F.round(F.element_at("w", -1)["length"], 4).alias("last"))
