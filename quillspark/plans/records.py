"""Queries over orders, line items, customers, events and embeddings, in the roles of figures, votes, terms, turns and voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import vectors as V
from quillspark.operators import evaluation, finance, graph, identity, linking, retrieval, timeline, versions
from quillspark.session import Kept
from quillspark.sources.tables import table
from quillspark.streaming import limits

# --- retrieval over vectors -------------------------------------------------------------------------------------------


def query_vector(spark: SparkSession, d: str, vec_id: int) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


def knn_top50(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.semantic_search(table(spark, d, "embeddings"), query_vector(spark, d, 0), "vec_id", "embedding", 0.05)
    return hits.select("id", F.round("similarity", 6).alias("similarity"))


def _two_lists(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.ranked(retrieval.semantic_search(e, query_vector(spark, d, 0), "vec_id", "embedding", 0.05), "similarity", "semantic", 0).unionByName(
        retrieval.ranked(retrieval.semantic_search(e, query_vector(spark, d, 1), "vec_id", "embedding", 0.05), "similarity", "keyword", 1)
    )


def rrf_two_lists(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(_two_lists(spark, d))


def rank_demotion(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.fuse(_two_lists(spark, d)).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    out = retrieval.demote(fused, [F.desc("rrf"), F.asc("first_list"), F.asc("first_rank")], F.coalesce(F.col("label").isin(1, 3), F.lit(False)))
    return out.select("id", "before", "place", "demoted").where("place <= 20")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: documents with the vector of the same number (the pairing is made up; the tables share no key)."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return retrieval.hybrid_search(docs.join(e, "doc_id"), query_vector(spark, d, 0), "the that", "doc_id", "embedding", "text", "lang", ("fr",), 0.05, texts=docs).select("place", "id", "kind", "rrf", "semantic_rank", "keyword_rank")


# --- voices ------------------------------------------------------------------------------------------------------------


def _best(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("meeting", F.pmod("vec_id", F.lit(7)))
    best = linking.best_people(e, "label", "meeting", "embedding", "vec_id", Kept(spark, "people"))
    return best.join(e.select("vec_id", F.col("label").alias("truth")), "vec_id")


def label_match(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("vec_id", "person", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "truth")


GRID = ([0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1], [0.0, 0.002, 0.01])


def match_sweep(spark: SparkSession, d: str) -> DataFrame:
    return linking.sweep(_best(spark, d), *GRID)


def match_frontier(spark: SparkSession, d: str) -> DataFrame:
    points = match_sweep(spark, d).where("margin_min = 0.0 and predictions > 0")
    return evaluation.pareto(points).select("threshold", "precision", "recall")


def match_quality(spark: SparkSession, d: str) -> DataFrame:
    b = _best(spark, d).select("truth", F.when(F.col("score") >= 0.005, F.col("person")).alias("predicted"))
    return evaluation.macro_precision(b)


def gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    rules = [(F.col("score") < 0.0, "below_floor"), (F.col("margin") < 0.002, "ambiguous"), (F.col("person") != F.col("truth"), "conflict")]
    return linking.gate(_best(spark, d), rules).groupBy("decision").agg(F.count("*").alias("n"))


def asnorm_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the first of its label, normalised by the labels' centroids as the cohort."""
    e = table(spark, d, "embeddings")
    cohort = V.mean_vectors(e.where(F.col("label").isNotNull()), ["label"], "embedding").select((-1 - F.col("label")).cast("long").alias("vec_id"), F.col("centroid").alias("embedding"))
    first = e.groupBy("label").agg(F.min("vec_id").alias("a"), F.min_by("embedding", "vec_id").alias("va"))
    pairs = e.join(first, "label").where("vec_id <> a").select("a", F.col("vec_id").alias("b"), V.cosine(F.col("va"), F.col("embedding")).alias("score"))
    out = linking.asnorm(pairs, e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), cohort, "vec_id", "embedding", 5)
    return out.select("a", "b", F.round("score", 6).alias("score"), F.round("z", 4).alias("z"))


def _nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = V.mean_vectors(e.where(F.col("label").isNotNull()), ["label"], "embedding").select("label", "centroid")
    best = linking.closest(e.withColumnRenamed("label", "truth"), c, ["vec_id", "truth"], "embedding")
    return best.select("vec_id", F.col("truth").alias("label"), F.col("label").alias("cluster"))


def clustering_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.clustering(_nearest_centroid(spark, d), "cluster", "label")


def constrained_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Complete linkage inside a label's vectors; those of one meeting stay apart."""
    e = table(spark, d, "embeddings").where("label is not null").withColumn("meeting", F.pmod("vec_id", F.lit(7)))
    return linking.complete_linkage(e, "label", "vec_id", "embedding", 0.2, "meeting", Kept(spark, "linkage"))


def linkage_points(spark: SparkSession, d: str) -> DataFrame:
    """Linkage of all vectors in ten groups at several thresholds, judged by their labels within and across conditions."""
    e = table(spark, d, "embeddings").withColumn("grp", F.pmod("vec_id", F.lit(10))).withColumn("meeting", F.pmod("vec_id", F.lit(70)))
    nodes = linking.linkage_sweep(e, "grp", "vec_id", "embedding", [0.1, 0.2, 0.3, 0.4, 0.6, 0.9], "meeting", Kept(spark, "linkage"))
    judged = nodes.join(e.select("vec_id", "label", (F.col("vec_id") % 20 < 10).alias("condition")), "vec_id")
    return linking.sweep_metrics(judged, "node", "label", "condition")


def spread_sample(spark: SparkSession, d: str) -> DataFrame:
    return linking.farthest_points(table(spark, d, "embeddings").where("label is not null"), "label", "vec_id", "embedding", 5, Kept(spark, "spread"))


def name_variants(spark: SparkSession, d: str) -> DataFrame:
    """Part types and brands as phrases against the vocabulary of part names."""
    p = table(spark, d, "part")
    vocab = p.select(F.explode(F.split("p_name", " ")).alias("name")).unionByName(p.select(F.lower("p_type").alias("name")))
    phrases = p.select(F.explode(F.split("p_name", " ")).alias("w")).select(F.concat("w", F.lit("s")).alias("phrase"))
    return linking.fuzzy_names(phrases, vocab, "phrase", "name", 0.7)


# --- figures ------------------------------------------------------------------------------------------------------------


def yearly_totals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return finance.yearly_totals(o, F.year("o_orderdate"), F.col("o_orderstatus"), F.col("o_totalprice"), {"final": "F", "open": "O"})


def status_share(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return finance.shares(o, F.nullif("o_orderstatus", F.lit("P")), F.col("o_totalprice"))


def cited_share(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return finance.cited_shares(o, F.col("o_orderpriority"), F.col("o_totalprice"), F.struct("o_orderdate", "o_orderkey"), F.col("o_orderkey"))


def stack_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return finance.stack(rows, F.col("n_name"), F.year("o_orderdate"), F.col("o_totalprice"))


def _figures(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    price, off, tax = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    one = F.lit(1).cast("decimal(4,2)")
    net = price * (one - off)
    bases = F.array(*[F.struct(F.lit(b).alias("basis"), a.cast("decimal(28,6)").alias("amount")) for b, a in (("gross", price), ("net", net), ("taxed", net * (one + tax)))])
    return line.select(F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("fund"), F.explode(bases).alias("b")).select("year", "fund", "b.*")


def budget_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    return finance.budget_vs_actual(_figures(spark, d), ["year", "fund"], F.col("basis"), F.col("amount"), ("gross", "net", "taxed"))


def component_trend(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return finance.component_trend(o, F.year("o_orderdate"), F.col("o_totalprice"), F.struct("o_orderdate", "o_orderkey"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))


def fund_roll_up(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_linestatus").alias("subcategory"), "l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber")
    return finance.roll_up(rows, ["year", "subcategory"], F.col("l_extendedprice"), F.col("l_returnflag"), F.struct("l_orderkey", "l_linenumber"), F.col("l_orderkey"))


def reconcile_orders(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_extendedprice")
    totals = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    return finance.reconcile(parts, totals, ["key"], "l_extendedprice", "o_totalprice")


def planned_and_actual(spark: SparkSession, d: str) -> DataFrame:
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return finance.planned_and_actual(line.select(F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("amount")), o.select(F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("amount")))


# --- scopes, terms, versions --------------------------------------------------------------------------------------------


def scope_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders of customers of one segment that have a line returned."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where(retrieval.optional(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]))
    line = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    day = retrieval.date_range(F.col("o_orderdate"), "1996-01-01")
    return o.where(day).join(c, o["o_custkey"] == c["c_custkey"], "left_semi").join(line, o["o_orderkey"] == line["l_orderkey"], "left_semi").select("o_orderkey", "o_custkey")


def coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    """Days with orders on which nothing was shipped, and customers' first days among them."""
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_custkey")
    shipped = table(spark, d, "lineitem").where("l_returnflag = 'A' and l_linestatus = 'O'").select(F.to_date("l_shipdate").alias("day")).distinct()
    return o.join(shipped, "day", "left_anti").groupBy("day").agg(F.count("*").alias("orders"), F.min("o_custkey").alias("first_customer")).select(F.col("day").cast("string").alias("day"), "orders", "first_customer")


def validity_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Orders as mentions of a customer in a body (priority); each status is a subject seated from its first to its last order there."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("name_key"), F.col("o_orderpriority").alias("body"), F.col("o_orderdate").alias("day"), "o_orderstatus")
    roster = o.groupBy("name_key", "body", F.col("o_orderstatus").alias("subject_id")).agg(F.min("day").alias("start"), F.when(F.count("*") > 1, F.max("day")).alias("end"))
    return graph.resolve_names(o.select(F.col("o_orderkey").alias("mention_id"), "name_key", "body", "day"), roster)


def member_vote_edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders as roll calls: line items are members with their votes; the first line's part moves."""
    line = table(spark, d, "lineitem").where("l_linenumber is not null")
    member = F.struct(F.col("l_suppkey").cast("string").alias("name"), F.when(F.col("l_returnflag") == "R", "No").otherwise("Aye").alias("vote"))
    votes = line.groupBy(F.col("l_orderkey").alias("vote_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", member.alias("m")))), lambda s: s["m"]).alias("members"), F.min_by(F.col("l_partkey").cast("string"), F.struct("l_linenumber", "l_partkey")).alias("moved_by"), F.lit(None).cast("string").alias("seconded_by"))
    return graph.vote_edges(votes).groupBy("vote_id", "edge").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def version_chains(spark: SparkSession, d: str) -> DataFrame:
    """Each order is replaced by the customer's next of its priority; chains of more than sixteen steps stay unresolved."""
    from pyspark.sql import Window

    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    return versions.resolve_versions(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), nxt.alias("replaces_id")))


def draft_final_pairs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    kind = F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "final").otherwise("other")
    return versions.draft_final_pairs(o, ["o_custkey", "y"], kind, "o_orderkey")


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    new = o.where("o_orderpriority <> '1-URGENT'").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")))
    return o.where("o_orderpriority <> '5-LOW'").drop("o_orderpriority"), new.drop("o_orderpriority")


def three_way_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return versions.three_way(*_snapshots(spark, d), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


def upsert_guarded(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return versions.upsert(old, new, ["o_orderkey"], F.col("o_totalprice") > 250000)


def restored_origins(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the priority of their orders in a year, where it is the only one."""
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority")
    keys = o.select("o_custkey", "year").distinct().withColumn("key", F.concat_ws(":", "o_custkey", "year"))
    return graph.restore_origin(keys, o.select(F.concat_ws(":", "o_custkey", "year").alias("key"), "o_orderpriority"), "key", "o_orderpriority").select("key", "o_orderpriority")


def expectations(spark: SparkSession, d: str) -> DataFrame:
    rules = {"has_price": F.col("o_totalprice") > 0, "known_status": F.col("o_orderstatus").isin("F", "O", "P"), "not_urgent": F.col("o_orderpriority") != "1-URGENT"}
    return graph.broken_rules(table(spark, d, "orders"), rules)


def identity_merge(spark: SparkSession, d: str) -> DataFrame:
    """Orders as stored identities, line items as proposals by another reader."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    tier = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderpriority") < "3", "inferred_high").otherwise("inferred_low")
    stored = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("subject"), tier.alias("confidence"), F.when(F.col("o_orderpriority") == "5-LOW", "roll").otherwise("intro").alias("basis"))
    proposed = line.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_suppkey").alias("subject"), F.when(F.count("*") > 1, "inferred_high").otherwise("inferred_low").alias("confidence"), F.lit("roll").alias("basis"))
    return identity.persist(stored, proposed, ["k"], "roll").groupBy("action").agg(F.count("*").alias("n"), F.sum("subject").alias("subjects"))


def roster_proposals(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("meeting"), F.col("l_returnflag").alias("subject"), F.col("l_quantity").alias("strength"))
    return identity.propose(line, ["meeting"], "subject", "strength")


# --- events in time -----------------------------------------------------------------------------------------------------


def _turns(spark: SparkSession, d: str, kind: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type") == kind).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("start"))
    return timeline.windows(e, "user_id", "start", ["start", "event_id"])


def interval_max_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Each view lasts until the user's next view, each click until the next click, the last an hour."""
    left, right = _turns(spark, d, "view"), _turns(spark, d, "click")
    right = right.withColumn("end", F.when(F.col("end") == float("inf"), F.col("start") + 3.6e9).otherwise(F.col("end")))
    out = timeline.max_overlap(left, right.withColumnRenamed("event_id", "click"), "user_id", "event_id", "click", width=8.64e10)
    return out.select("event_id", F.col("label").alias("click"), F.col("overlap").cast("long").alias("overlap"))


def nearest_turn(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("start")).withColumn("end", F.col("start") + 1)
    spans = _turns(spark, d, "signup").withColumn("end", F.least("end", F.col("start") + 3.6e9)).withColumnRenamed("event_id", "signup")
    return timeline.nearest_span(points, spans, "user_id", "event_id", "signup").select("event_id", F.col("label").cast("long").alias("signup"))


def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return timeline.gap_groups(e, "user_id", F.col("t"), 43_200_000_000).groupBy("user_id", "island").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))


def evidence_scores(spark: SparkSession, d: str) -> DataFrame:
    return linking.evidence_score(table(spark, d, "events"), ["user_id"], "event_type", "value")


def keep_best_event(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return identity.keep_best(e, ["user_id", "event_type"], [F.col("value"), -F.col("event_id")])


def quota_month(spark: SparkSession, d: str) -> DataFrame:
    out = limits.quota(table(spark, d, "events"), "user_id", "ts", "month", 60)
    return out.select("user_id", F.date_format("period", "yyyy-MM").alias("period"), "n", "over")


def daily_cap(spark: SparkSession, d: str) -> DataFrame:
    out = limits.quota(table(spark, d, "events"), "user_id", "ts", "day", 3)
    return out.select("user_id", F.date_format("period", "yyyy-MM-dd").alias("period"), "n", "over")


def window_limiter(spark: SparkSession, d: str) -> DataFrame:
    return limits.window_limit(table(spark, d, "events"), "user_id", "event_id", "ts", 86_400.0, 3)


def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders ranked by price, graded by priority; grade null where the order is open."""
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    grade = F.when(F.col("o_orderstatus") != "O", 5 - F.substring("o_orderpriority", 1, 1).cast("int"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return evaluation.ranking(o.select(F.col("o_custkey").alias("query"), rank.alias("rank"), grade.alias("grade")), 5)


QUERIES = {f.__name__: f for f in (
    knn_top50, rrf_two_lists, rank_demotion, hybrid_search, label_match, match_sweep, match_frontier, match_quality, gate_decisions, asnorm_scores,
    clustering_metrics, constrained_linkage, linkage_points, spread_sample, name_variants, yearly_totals, status_share, cited_share, stack_matrix, budget_vs_actual,
    component_trend, fund_roll_up, reconcile_orders, planned_and_actual, scope_semi_join, coverage_gap, validity_resolve, member_vote_edges,
    version_chains, draft_final_pairs, three_way_reconcile, upsert_guarded, restored_origins, expectations, identity_merge, roster_proposals,
    interval_max_overlap, nearest_turn, gap_islands, evidence_scores, keep_best_event, quota_month, daily_cap, window_limiter, ranking_metrics,
)}
