"""Queries of analysis steps over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import vectors as V
from quillspark.operators import analysis
from quillspark.plans.records_sql import _CENTROIDS, _V
from quillspark.session import Kept
from quillspark.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT DISTINCT round(p, 6) AS threshold FROM (SELECT unnest(quantile_cont(value, [i / 79.0 FOR i IN range(80)])) AS p FROM events)")
def candidate_thresholds(spark, d):
    return analysis.thresholds(table(spark, d, "events"), "value", Kept(spark, "thresholds"), 80)


_UNIT = "w AS (SELECT vec_id, label, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS e FROM v WHERE list_dot_product(e, e) > 0), " + _CENTROIDS.replace("FROM v", "FROM w")


@query(f"WITH {_V}, {_UNIT} SELECT vec_id, w.label, round(list_cosine_similarity(e, c), 6) AS score, round(list_cosine_similarity(e, c), 6) >= 0.40 AS kept FROM w JOIN c ON c.label = w.label")
def vetted_positives(spark, d):
    return analysis.vet_positives(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query(f"WITH {_V}, {_UNIT}, s AS (SELECT w.vec_id, c.label, round(list_cosine_similarity(e, c), 6) AS score FROM w, c WHERE w.vec_id % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS n FROM s) SELECT vec_id, label, score, CASE WHEN score >= 0.3 THEN 'quarantined' WHEN score >= 0.2 THEN 'near' ELSE 'clean' END AS state FROM r WHERE n = 1")
def quarantined_negatives(spark, d):
    e = table(spark, d, "embeddings")
    c = V.mean_vectors(e.where("label is not null").select("label", V.unit(F.col("embedding")).alias("embedding")), ["label"], "embedding").select("label", "centroid")
    return analysis.quarantine(e.where("vec_id % 3 = 0"), c, "vec_id", "embedding", 0.3, 0.2)


@query("""WITH r AS (SELECT l_suppkey AS q, l_orderkey * 8 + l_linenumber AS item, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem)
SELECT DISTINCT q, item FROM r WHERE rank <= 20 AND (q, item) NOT IN (SELECT l_suppkey, l_orderkey * 8 + l_linenumber FROM lineitem WHERE l_linestatus = 'F' AND l_partkey % 2 = 0)""")
def pooled_items(spark, d):
    from pyspark.sql import Window

    line = table(spark, d, "lineitem")
    item = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item")
    w = Window.partitionBy("l_suppkey", "l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    ranked = line.select(F.col("l_suppkey").alias("q"), item, F.row_number().over(w).alias("rank"))
    judged = line.where("l_linestatus = 'F' and l_partkey % 2 = 0").select(F.col("l_suppkey").alias("q"), item)
    return analysis.pool(ranked, judged, "q", "item", "rank", 20)


_ASKED = "CASE o_orderkey % 4 WHEN 0 THEN 'revenue in ' || year(o_orderdate) || ' for ' || o_orderpriority WHEN 1 THEN 'budget vs actual ' || year(o_orderdate) WHEN 2 THEN 'how much was spent since ' || year(o_orderdate) ELSE 'who spoke about ' || o_orderpriority END"


@query(f"""WITH q AS (SELECT o_orderkey, year(o_orderdate) AS y, {_ASKED} AS query FROM orders)
SELECT o_orderkey, query, CASE o_orderkey % 4 WHEN 0 THEN 'revenue' WHEN 1 THEN 'budget_vs_actual' WHEN 2 THEN 'expenditure' ELSE 'text' END AS intent, CASE WHEN o_orderkey % 4 < 2 AND y >= 2000 THEN (y - 1) || '-' || y END AS fiscal_year FROM q""")
def finance_route(spark, d):
    o, y = table(spark, d, "orders"), F.year("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 4
    asked = F.when(k == 0, F.concat(F.lit("revenue in "), y, F.lit(" for "), F.col("o_orderpriority"))).when(k == 1, F.concat(F.lit("budget vs actual "), y)).when(k == 2, F.concat(F.lit("how much was spent since "), y)).otherwise(F.concat(F.lit("who spoke about "), F.col("o_orderpriority")))
    return analysis.route(o.select("o_orderkey", asked.alias("query")), "query")


@query("SELECT o_orderkey, year(o_orderdate) || ' ' || o_orderpriority || ': $' || format('{:,}', CAST(round_even(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS BIGINT)) || ' [q' || o_custkey || ']' AS evidence FROM orders")
def rendered_evidence(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.concat(F.lit("q"), F.col("o_custkey").cast("string")).alias("ref"))
    return analysis.render(o, "year", "o_orderpriority", "amount", "ref").select("o_orderkey", "evidence")


@query("""WITH h AS (SELECT l_suppkey AS q, l_partkey AS item, l_linenumber AS variant, l_quantity AS rank FROM lineitem), f AS (SELECT q, item, min(variant * 1000 + rank) AS f FROM h GROUP BY ALL)
SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY f, item) AS place FROM f""")
def merged_variants(spark, d):
    h = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("variant"), F.col("l_quantity").alias("rank"))
    return analysis.merged_variants(h, "q", "item", "variant", "rank").withColumn("place", F.col("place").cast("long"))


@query("""WITH h AS (SELECT o_custkey AS q, o_orderkey AS item, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS s, -o_orderkey AS rrf FROM orders), m AS (SELECT *, CASE WHEN count(s) OVER (PARTITION BY q) = count(*) OVER (PARTITION BY q) THEN s ELSE rrf END AS k FROM h)
SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY k DESC, item) AS place FROM m""")
def reranked_or_fused(spark, d):
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("item"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("s"), (-F.col("o_orderkey")).cast("double").alias("rrf"))
    return analysis.reranked(h, "q", "item", "s", "rrf").select("q", "item", F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 100000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def enrollable_clusters(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "person")
    officials = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("person"))
    return analysis.enrollable(o, officials, "person", "o_orderstatus", "o_orderpriority", "o_totalprice", ["F", "P"], ["1-URGENT", "2-HIGH"], 100000).select("o_orderkey")


@query("""WITH RECURSIVE d AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_name || p_brand END AS k1, CASE WHEN p_partkey % 3 = 0 THEN p_name || p_type || p_size END AS k2, CASE WHEN p_partkey % 50 < 2 THEN p_partkey // 50 END AS k3 FROM part),
s AS (SELECT id, min(id) OVER (PARTITION BY k1) AS a FROM d WHERE k1 IS NOT NULL UNION SELECT id, min(id) OVER (PARTITION BY k2) FROM d WHERE k2 IS NOT NULL UNION SELECT id, min(id) OVER (PARTITION BY k3) FROM d WHERE k3 IS NOT NULL),
e AS (SELECT a, id AS b FROM s UNION SELECT id, a FROM s), r(a, b) AS (SELECT id, id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS id, min(b) AS component FROM r GROUP BY a""")
def components_of_signals(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    signals = [[F.when(F.col("id") % 5 == 0, F.concat("p_name", "p_brand"))], [F.when(F.col("id") % 3 == 0, F.col("p_name")), F.col("p_type"), F.col("p_size")], [F.when(F.col("id") % 50 < 2, F.floor(F.col("id") / 50))]]
    return analysis.components_of_signals(p, "id", signals, Kept(spark, "signals"))


@query("SELECT o_orderkey AS html_id, o_orderkey + 1 AS pdf_id FROM orders a WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 <> 4 AND EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_orderkey + 1 AND b.o_totalprice > a.o_totalprice AND b.o_orderkey % 10 <> 3)")
def html_pdf_twins(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    docs = o.select(k.alias("id"), F.concat(F.lit("f"), k.cast("string"), F.when(k % 2 == 0, ".HTM").otherwise(".pdf")).alias("file"), F.col("o_totalprice").alias("length"), F.when((k % 10 == 3) | (k % 10 == 4), k + 1).alias("replaces_id"))
    return analysis.twins(o.select(k.alias("html_id"), (k + 1).alias("pdf_id")), docs)


@query("SELECT DISTINCT 'm' || l_suppkey % 30 AS matter, l_orderkey AS chunk, 'c' || l_orderkey AS citation_id FROM lineitem WHERE l_orderkey % 3 <> 0")
def mention_edges(spark, d):
    refs = table(spark, d, "lineitem").select(F.concat(F.lit("m"), (F.col("l_suppkey") % 30).cast("string")).alias("matter"), F.col("l_orderkey").alias("chunk"))
    cited = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))).alias("citation_id"))
    return analysis.mention_edges(refs, cited)


@query("SELECT event_id, user_id AS subject FROM events JOIN customer ON c_custkey = user_id WHERE event_id % 2 = 0")
def name_only_turns(spark, d):
    named = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    turns = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), named, F.lit(".  "))).otherwise(F.concat(named, F.lit(" speaks"))).alias("text"))
    index = table(spark, d, "customer").select(F.lower("c_name").alias("phrase"), F.col("c_custkey").alias("subject"))
    return analysis.name_only(turns, index, "text", "phrase").select("event_id", "subject")


@query("SELECT lower(replace(p_name, ' ', '-')) AS slug, min(p_name) AS p_name, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS bodies FROM part GROUP BY 1")
def built_rosters(spark, d):
    from quillspark.functions import text

    p = table(spark, d, "part").select(text.slug(F.col("p_name")).alias("slug"), "p_name", "p_brand")
    return analysis.rosters(p, "slug", "p_name", "p_brand").withColumn("bodies", F.array_join("bodies", ","))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')")
def stale_rows(spark, d):
    stored = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return analysis.stale(stored, table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])


@query("WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('7:' || p_partkey), p_partkey) AS r FROM part) SELECT p_partkey, row_number() OVER (ORDER BY r, md5('7:' || p_brand), p_brand) AS place FROM r")
def spread_order(spark, d):
    return analysis.spread(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", "7", Kept(spark, "spread")).select("p_partkey", F.col("place").cast("long").alias("place"))


@query("SELECT p_partkey, CASE WHEN p_size < 100 AND 2 * p_size < 60 THEN CASE WHEN p_size > 0 THEN '0:start|' || p_size || ':middle|' || 2 * p_size || ':end' ELSE '0:end' END WHEN p_size < 60 THEN '0:start|' || p_size || ':middle' ELSE '0:start' END AS chapters FROM part")
def chapters_kept(spark, d):
    s = F.col("p_size").cast("string")
    raw = F.concat(F.lit('[{"t": 0, "title": "start"}, {"t": '), (F.col("p_size") * 2).cast("string"), F.lit(', "title": "end"}, {"t": '), s, F.lit(', "title": "middle"}, {"t": '), s, F.lit(', "title": "twice"}, {"t": -4, "title": "x"}, {"t": 3, "title": " "}]'))
    rows = table(spark, d, "part").select("p_partkey", raw.alias("chapters"), F.lit(60).alias("length"))
    shown = F.array_join(F.transform("chapters", lambda c: F.concat_ws(":", c["t"].cast("string"), c["title"])), "|")
    return analysis.valid_chapters(rows, "chapters", "length").select("p_partkey", shown.alias("chapters"))


@query("WITH n AS (SELECT length(CAST(c_custkey AS VARCHAR)) AS g, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer WHERE c_custkey % 7 = 3 GROUP BY 1) SELECT o_orderkey FROM orders JOIN n ON g = length(CAST(o_orderkey AS VARCHAR)) WHERE o_orderkey BETWEEN lo - 5 AND hi + 5")
def mintable_numbers(spark, d):
    known = table(spark, d, "customer").where("c_custkey % 7 = 3").select(F.col("c_custkey").alias("o_orderkey"))
    return analysis.mintable(table(spark, d, "orders").select("o_orderkey"), known, "o_orderkey", 5)


@query(r"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(upper(p_name), ' ', '  ') ELSE p_name END AS t FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(t, '\bred\s+ring\b', 'Crimson Hoop', 'gi'), '\bring\b', 'Hoop', 'gi'), '\bred\b', 'Crimson', 'gi') AS canonical,
 CAST(len(regexp_extract_all(t, '(?i)\b(?:red\s+ring|ring|red)\b')) AS INTEGER) AS audits FROM r""")
def canonical_texts(spark, d):
    t = F.when(F.col("p_partkey") % 2 == 0, F.replace(F.upper("p_name"), F.lit(" "), F.lit("  "))).otherwise(F.col("p_name"))
    rules = [("ring", "Hoop"), ("red ring", "Crimson Hoop"), ("red", "Crimson")]
    return analysis.canonicalised(table(spark, d, "part").select("p_partkey", t.alias("t")), "t", rules).select("p_partkey", "canonical", F.size("audits").alias("audits"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-(0.5 + 0.1 * l_quantity - 8.0 * l_discount))), 6) AS probability FROM lineitem")
def calibrated_scores(spark, d):
    line = table(spark, d, "lineitem")
    return analysis.logit_scores(line, {"l_quantity": 0.1, "l_discount": -8.0}, 0.5).select("l_orderkey", "l_linenumber", "l_partkey", F.round("probability", 6).alias("probability"))


def _pairs(keys: str) -> str:
    return f"(SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {keys}))"


@query("SELECT " + ", ".join(f"{_pairs(k + ', l_linenumber')} AS {n}_within, {_pairs(k)} - {_pairs(k + ', l_linenumber')} AS {n}_across" for n, k in (("node", "l_suppkey"), ("truth", "l_returnflag, l_orderkey"), ("both", "l_suppkey, l_returnflag, l_orderkey"))))
def pair_counts(spark, d):
    line = table(spark, d, "lineitem").withColumn("truth", F.concat_ws(":", "l_returnflag", F.col("l_orderkey").cast("string")))
    return analysis.pair_counts(line, "l_suppkey", "truth", "l_linenumber")
