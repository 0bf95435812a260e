"""SQL for the queries of records.py, in DuckDB's dialect."""

from __future__ import annotations

_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_COS = "list_cosine_similarity({}, {})"


def _list(q: int) -> str:
    return f"(SELECT v.vec_id AS id, list_cosine_similarity(v.e, q.e) AS s FROM v, (SELECT e FROM v WHERE vec_id = {q}) q WHERE list_cosine_similarity(v.e, q.e) >= 0.05 ORDER BY s DESC, id LIMIT 50)"


_FUSED = f"""{_V},
l AS (SELECT 0 AS list_no, row_number() OVER (ORDER BY s DESC, id) AS rank, id FROM {_list(0)} UNION ALL SELECT 1, row_number() OVER (ORDER BY s DESC, id), id FROM {_list(1)}),
f AS (SELECT id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(rank) FILTER (list_no = 0) AS semantic_rank, min(rank) FILTER (list_no = 1) AS keyword_rank,
      min(list_no) AS first_list, arg_min(rank, list_no) AS first_rank FROM l GROUP BY id)"""

_SCORES = f"""{_V},
p AS (SELECT a.vec_id, b.label AS person, avg(list_cosine_similarity(a.e, b.e)) AS score FROM v a JOIN v b ON a.vec_id % 7 <> b.vec_id % 7 AND b.label IS NOT NULL GROUP BY ALL),
r AS (SELECT vec_id, person, round(score, 9) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, person) AS n, lead(round(score, 9)) OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, person) AS second FROM p),
best AS (SELECT r.vec_id, person, score, round(score - coalesce(second, 0), 9) AS margin, label AS truth FROM r JOIN v ON v.vec_id = r.vec_id WHERE n = 1)"""

_SWEEP = """
g AS (SELECT t AS threshold, m AS margin_min FROM unnest([0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1]) AS a(t), unnest([0.0, 0.002, 0.01]) AS b(m)),
s AS (SELECT threshold, margin_min, count(*) FILTER (score >= threshold AND margin >= margin_min) AS predictions, count(*) FILTER (score >= threshold AND margin >= margin_min AND person = truth) AS correct, count(truth) AS total FROM best, g GROUP BY ALL),
sweep AS (SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(margin_min AS DOUBLE) AS margin_min, predictions, round(CASE WHEN predictions > 0 THEN correct / predictions ELSE 1.0 END, 6) AS precision, round(correct / total, 6) AS recall FROM s)"""

_CENTROIDS = """
flat AS (SELECT label, i, avg(e[i]) AS x FROM v, unnest(range(1, len(e) + 1)) AS t(i) WHERE label IS NOT NULL GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY i) AS c FROM flat GROUP BY label)"""

_SNAP = """
o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'),
n AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT')"""

_M = "CAST(sum(CAST({} AS DECIMAL(28,2))) AS DECIMAL(28,2))"

ORACLES = {
    "knn_top50": f"WITH {_V} SELECT id, round(s, 6) AS similarity FROM {_list(0)}",
    "rrf_two_lists": f"WITH {_FUSED} SELECT id, CAST(rrf AS DOUBLE) AS rrf, CAST(semantic_rank AS INTEGER) AS semantic_rank, CAST(keyword_rank AS INTEGER) AS keyword_rank, first_list, CAST(first_rank AS INTEGER) AS first_rank FROM f",
    "rank_demotion": f"""WITH {_FUSED},
b AS (SELECT f.*, coalesce(label IN (1, 3), false) AS demoted, row_number() OVER (ORDER BY rrf DESC, first_list, first_rank) AS before FROM f JOIN v ON v.vec_id = f.id),
p AS (SELECT *, row_number() OVER (ORDER BY before + CASE WHEN demoted THEN 5 ELSE 0 END, demoted, before) AS place FROM b)
SELECT id, CAST(before AS INTEGER) AS before, CAST(place AS INTEGER) AS place, demoted FROM p WHERE place <= 20""",
    "hybrid_search": """
WITH i AS (SELECT d.doc_id AS id, text, lang, CAST(embedding AS DOUBLE[]) AS e FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
sem AS (SELECT id, list_cosine_similarity(e, q) AS s FROM i, q WHERE list_cosine_similarity(e, q) >= 0.05 ORDER BY s DESC, id LIMIT 50),
w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM i),
k AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'that')) AS b FROM w),
kw AS (SELECT id, round((a + b) / (1 + log10(n)), 9) AS s FROM k WHERE a > 0 AND b > 0 ORDER BY s DESC, id LIMIT 50),
l AS (SELECT 0 AS list_no, row_number() OVER (ORDER BY s DESC, id) AS rank, id FROM sem UNION ALL SELECT 1, row_number() OVER (ORDER BY s DESC, id), id FROM kw),
f AS (SELECT id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(rank) FILTER (list_no = 0) AS semantic_rank, min(rank) FILTER (list_no = 1) AS keyword_rank, min(list_no) AS fl, arg_min(rank, list_no) AS fr FROM l GROUP BY id),
b AS (SELECT f.*, lang AS kind, coalesce(lang = 'fr', false) AS demoted, row_number() OVER (ORDER BY rrf DESC, fl, fr) AS before FROM f JOIN i ON i.id = f.id),
p AS (SELECT *, row_number() OVER (ORDER BY before + CASE WHEN demoted THEN 5 ELSE 0 END, demoted, before) AS place FROM b)
SELECT CAST(place AS INTEGER) AS place, id, kind, CAST(rrf AS DOUBLE) AS rrf, CAST(semantic_rank AS INTEGER) AS semantic_rank, CAST(keyword_rank AS INTEGER) AS keyword_rank FROM p WHERE place <= 20""",
    "label_match": f"WITH {_SCORES} SELECT vec_id, person, round(score, 6) AS score, round(margin, 6) AS margin, truth FROM best",
    "match_sweep": f"WITH {_SCORES}, {_SWEEP} SELECT * FROM sweep",
    "match_frontier": f"""WITH {_SCORES}, {_SWEEP},
pts AS (SELECT * FROM sweep WHERE margin_min = 0.0 AND predictions > 0)
SELECT threshold, precision, recall FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE (b.precision > a.precision AND b.recall >= a.recall) OR (b.precision >= a.precision AND b.recall > a.recall) OR (b.precision = a.precision AND b.recall = a.recall AND b.threshold > a.threshold))""",
    "match_quality": f"""WITH {_SCORES},
b AS (SELECT truth, CASE WHEN score >= 0.005 THEN person END AS predicted FROM best),
e AS (SELECT predicted, count(*) AS n, count(*) FILTER (predicted = truth) AS ok FROM b WHERE predicted IS NOT NULL GROUP BY predicted)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS predictions, CAST(coalesce(sum(ok), 0) AS BIGINT) AS correct, round(coalesce(avg(ok / n), 1.0), 6) AS macro_precision, round(coalesce(sum(ok) / (SELECT count(truth) FROM b), 0), 6) AS recall FROM e""",
    "gate_decisions": f"""WITH {_SCORES}
SELECT CASE WHEN score < 0 THEN 'below_floor' WHEN margin < 0.002 THEN 'ambiguous' WHEN person <> truth THEN 'conflict' ELSE 'accepted' END AS decision, count(*) AS n FROM best GROUP BY 1""",
    "asnorm_scores": f"""WITH {_V}, {_CENTROIDS},
f AS (SELECT label, min(vec_id) AS a FROM v GROUP BY label),
p AS (SELECT f.a, v.vec_id AS b, {_COS.format('x.e', 'v.e')} AS score FROM v JOIN f ON f.label = v.label JOIN v x ON x.vec_id = f.a WHERE v.vec_id <> f.a),
s AS (SELECT vec_id, c.label AS k, {_COS.format('v.e', 'c.c')} AS s FROM v, c),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k DESC) AS n FROM s),
m AS (SELECT vec_id, avg(s) AS mu, stddev_pop(s) + 1e-8 AS sd FROM n WHERE n <= 5 GROUP BY vec_id)
SELECT p.a, p.b, round(score, 6) AS score, round(((score - x.mu) / x.sd + (score - y.mu) / y.sd) / 2, 4) AS z FROM p JOIN m x ON x.vec_id = p.a JOIN m y ON y.vec_id = p.b""",
    "clustering_metrics": f"""WITH {_V}, {_CENTROIDS},
s AS (SELECT vec_id, v.label AS l, c.label AS k, row_number() OVER (PARTITION BY vec_id ORDER BY round({_COS.format('v.e', 'c.c')}, 9) DESC, c.label) AS n FROM v, c),
a AS (SELECT vec_id, l, k AS c FROM s WHERE n = 1 AND l IS NOT NULL),
cell AS (SELECT c, l, CAST(count(*) AS DOUBLE) AS n FROM a GROUP BY ALL),
pc AS (SELECT c, sum(n) AS nc, max(n) AS mc FROM cell GROUP BY c), pl AS (SELECT l, sum(n) AS nl, max(n) AS ml, sum(n * (n - 1) / 2) AS hit FROM cell GROUP BY l),
t AS (SELECT sum(n) AS total, sum(n * (n - 1) / 2) AS both_, sum(n * n / nc) / sum(n) AS bp, sum(n * n / nl) / sum(n) AS br FROM cell JOIN pc USING (c) JOIN pl USING (l)),
x AS (SELECT t.*, (SELECT sum(mc) FROM pc) / total AS purity, (SELECT sum(ml) FROM pl) / total AS coverage, both_ / (SELECT sum(nc * (nc - 1) / 2) FROM pc) AS p, both_ / (SELECT sum(nl * (nl - 1) / 2) FROM pl) AS r, (SELECT avg(hit / (nl * (nl - 1) / 2)) FROM pl WHERE nl > 1) AS macro FROM t)
SELECT round(purity, 6) AS purity, round(coverage, 6) AS coverage, round(p, 6) AS pair_precision, round(r, 6) AS pair_recall, round(2 * p * r / (p + r), 6) AS pair_f1, round(bp, 6) AS bcubed_precision, round(br, 6) AS bcubed_recall, round(2 * bp * br / (bp + br), 6) AS bcubed_f1, round(macro, 6) AS macro_recall FROM x""",
    "yearly_totals": f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, coalesce(sum(CAST(o_totalprice AS DECIMAL(28,2))) FILTER (o_orderstatus = 'F'), 0)::DECIMAL(28,2) AS final, coalesce(sum(CAST(o_totalprice AS DECIMAL(28,2))) FILTER (o_orderstatus = 'O'), 0)::DECIMAL(28,2) AS "open" FROM orders GROUP BY 1""",
    "status_share": f"""WITH s AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'Unspecified' ELSE o_orderstatus END AS label, {_M.format('o_totalprice')} AS amount FROM orders GROUP BY 1)
SELECT label, amount, round(100 * CAST(amount AS DOUBLE) / CAST((SELECT sum(amount) FROM s) AS DOUBLE), 6) AS percent FROM s""",
    "cited_share": f"""WITH s AS (SELECT o_orderpriority AS label, {_M.format('o_totalprice')} AS amount, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS reference FROM orders GROUP BY 1)
SELECT label, amount, round(100 * CAST(amount AS DOUBLE) / CAST((SELECT sum(amount) FROM s) AS DOUBLE), 6) AS percent, reference FROM s""",
    "stack_matrix": f"""WITH c AS (SELECT n_name AS series, CAST(year(o_orderdate) AS INTEGER) AS year, {_M.format('o_totalprice')} AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
t AS (SELECT series, CAST(sum(amount) AS DECIMAL(28,2)) AS series_total FROM c GROUP BY series), p AS (SELECT *, CAST(row_number() OVER (ORDER BY series_total DESC, series) AS INTEGER) AS place FROM t)
SELECT c.series, year, amount, series_total, place FROM c JOIN p ON p.series = c.series""",
    "budget_vs_actual": """WITH l AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS fund, CAST(l_extendedprice AS DECIMAL(12,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS o, CAST(l_tax AS DECIMAL(4,2)) AS t FROM lineitem),
g AS (SELECT year, fund, CAST(sum(p) AS DECIMAL(28,2)) AS original, CAST(sum(CAST(p * (1 - o) AS DECIMAL(28,6))) AS DECIMAL(28,2)) AS final, CAST(sum(CAST(p * (1 - o) * (1 + t) AS DECIMAL(28,6))) AS DECIMAL(28,2)) AS actual FROM l GROUP BY ALL)
SELECT *, CAST(actual - final AS DECIMAL(28,2)) AS variance FROM g""",
    "component_trend": f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year, {_M.format('o_totalprice')} AS amount, arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS reference FROM orders GROUP BY 1",
    "fund_roll_up": f"""SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_linestatus AS subcategory, {_M.format('l_extendedprice')} AS amount, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS funds, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS reference FROM lineitem GROUP BY 1, 2""",
    "reconcile_orders": f"""WITH p AS (SELECT l_orderkey AS key, {_M.format('l_extendedprice')} AS parts FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey AS key, CAST(o_totalprice AS DECIMAL(28,2)) AS stated FROM orders)
SELECT coalesce(p.key, t.key) AS key, parts, stated, coalesce(abs(parts - stated) <= 0.005, false) AS agrees FROM p FULL JOIN t ON t.key = p.key""",
    "planned_and_actual": f"""SELECT CAST(year(l_shipdate) AS INTEGER) AS year, 'actual' AS kind, {_M.format('l_extendedprice')} AS amount FROM lineitem GROUP BY 1 UNION ALL SELECT CAST(year(o_orderdate) AS INTEGER), 'planned', {_M.format('o_totalprice')} FROM orders GROUP BY 1""",
    "scope_semi_join": """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= '1996-01-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
    "coverage_gap": """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS orders, min(o_custkey) AS first_customer FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O') GROUP BY 1""",
    "validity_resolve": """
WITH r AS (SELECT o_custkey, o_orderpriority AS body, o_orderstatus AS subject_id, min(o_orderdate) AS s, CASE WHEN count(*) > 1 THEN max(o_orderdate) END AS e FROM orders GROUP BY ALL),
h AS (SELECT o_orderkey AS mention_id, count(DISTINCT subject_id) FILTER (o_orderdate >= s AND (e IS NULL OR o_orderdate <= e)) AS n, min(subject_id) FILTER (o_orderdate >= s AND (e IS NULL OR o_orderdate <= e)) AS subject_id, count(subject_id) AS known
      FROM orders o LEFT JOIN r ON r.o_custkey = o.o_custkey AND r.body = o.o_orderpriority GROUP BY o_orderkey)
SELECT mention_id, n, CASE WHEN n = 1 THEN subject_id END AS subject_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' WHEN known > 0 THEN 'out_of_term' ELSE 'unknown' END AS status FROM h""",
    "member_vote_edges": """
WITH l AS (SELECT l_orderkey AS vote_id, CAST(l_suppkey AS VARCHAR) AS name, CASE WHEN l_returnflag = 'R' THEN 'no' ELSE 'aye' END AS vote, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'No' ELSE 'Aye' END) AS n FROM lineitem WHERE l_linenumber IS NOT NULL),
e AS (SELECT vote_id, name, 'voted_' || vote AS edge FROM l WHERE n = 1 UNION ALL SELECT l_orderkey, arg_min(CAST(l_partkey AS VARCHAR), (l_linenumber, l_partkey)), 'moved' FROM lineitem WHERE l_linenumber IS NOT NULL GROUP BY 1)
SELECT vote_id, edge, count(*) AS n, min(name) AS first_name FROM e GROUP BY ALL""",
    "version_chains": """
WITH c AS (SELECT o_orderkey AS id, last_value(o_orderkey) OVER w AS last, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS steps FROM orders
  WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT id, CASE WHEN steps <= 16 THEN last ELSE id END AS canonical_id, steps BETWEEN 1 AND 16 AS superseded FROM c""",
    "draft_final_pairs": """SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, min(o_orderkey) FILTER (o_orderstatus = 'O') AS draft_id, min(o_orderkey) FILTER (o_orderstatus = 'F') AS final_id FROM orders GROUP BY 1, 2 HAVING count(*) FILTER (o_orderstatus = 'O') = 1 AND count(*) FILTER (o_orderstatus = 'F') = 1""",
    "three_way_reconcile": f"""WITH {_SNAP} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'stale' WHEN o.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus AND o.o_totalprice IS NOT DISTINCT FROM n.o_totalprice THEN 'same' ELSE 'update' END AS action FROM o FULL JOIN n ON n.o_orderkey = o.o_orderkey""",
    "upsert_guarded": f"""WITH {_SNAP} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_totalprice > 250000 OR n.o_orderkey IS NULL THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus, CASE WHEN o.o_totalprice > 250000 OR n.o_orderkey IS NULL THEN o.o_totalprice ELSE n.o_totalprice END AS o_totalprice FROM o FULL JOIN n ON n.o_orderkey = o.o_orderkey""",
    "restored_origins": """SELECT o_custkey || ':' || year(o_orderdate) AS key, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS o_orderpriority FROM orders GROUP BY 1""",
    "expectations": """SELECT 'has_price' AS rule, count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) AS n FROM orders UNION ALL SELECT 'known_status', count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O', 'P'), false)) FROM orders UNION ALL SELECT 'not_urgent', count(*) FILTER (NOT coalesce(o_orderpriority <> '1-URGENT', false)) FROM orders""",
    "identity_merge": """
WITH s AS (SELECT o_orderkey AS k, o_custkey AS subject, CASE WHEN o_orderstatus = 'F' THEN 3 WHEN o_orderpriority < '3' THEN 2 ELSE 1 END AS t, CASE WHEN o_orderpriority = '5-LOW' THEN 'roll' ELSE 'intro' END AS basis FROM orders),
p AS (SELECT l_orderkey AS k, min(l_suppkey) AS subject, CASE WHEN count(*) > 1 THEN 2 ELSE 1 END AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
a AS (SELECT CASE WHEN s.k IS NULL THEN 'insert' WHEN s.t = 3 THEN 'locked' WHEN p.k IS NULL THEN CASE WHEN s.basis = 'roll' THEN 'retract' ELSE 'keep' END WHEN s.basis = 'roll' OR p.t > s.t THEN 'update' ELSE 'keep' END AS action, s.subject AS old, p.subject AS new FROM s FULL JOIN p ON p.k = s.k)
SELECT action, count(*) AS n, CAST(sum(CASE WHEN action IN ('insert', 'update') THEN new WHEN action IN ('locked', 'keep') THEN old END) AS BIGINT) AS subjects FROM a GROUP BY action""",
    "roster_proposals": """SELECT l_orderkey AS meeting, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS subject, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_quantity) END AS strength, count(DISTINCT l_returnflag) > 1 AS contested FROM lineitem GROUP BY 1""",
    "interval_max_overlap": """
WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS s, lead(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS e FROM events),
l AS (SELECT user_id, event_id, s, coalesce(e, 9e18) AS e FROM e WHERE event_type = 'view'), r AS (SELECT user_id, event_id AS click, s, coalesce(e, s + 3600000000) AS e FROM e WHERE event_type = 'click'),
b AS (SELECT l.event_id, click, least(l.e, r.e) - greatest(l.s, r.s) AS o, r.s, r.e FROM l JOIN r ON r.user_id = l.user_id AND least(l.e, r.e) > greatest(l.s, r.s)),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY o DESC, s, e, click) AS n FROM b)
SELECT l.event_id, click, CAST(coalesce(o, 0) AS BIGINT) AS overlap FROM l LEFT JOIN n ON n.event_id = l.event_id AND n = 1""",
    "nearest_turn": """
WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS s, lead(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS e FROM events),
p AS (SELECT user_id, event_id, s, s + 1 AS e FROM e WHERE event_type = 'purchase'), q AS (SELECT user_id, event_id AS signup, s, least(coalesce(e, 9e18), s + 3600000000) AS e FROM e WHERE event_type = 'signup'),
b AS (SELECT p.event_id, signup, row_number() OVER (PARTITION BY p.event_id ORDER BY greatest(least(p.e, q.e) - greatest(p.s, q.s), 0) DESC, greatest(q.s - p.e, p.s - q.e, 0), q.s, q.e, signup) AS n FROM p JOIN q ON q.user_id = p.user_id)
SELECT p.event_id, signup FROM p LEFT JOIN b ON b.event_id = p.event_id AND n = 1""",
    "gap_islands": """
WITH t AS (SELECT user_id, epoch_us(ts) AS t FROM events),
m AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 43200000000 THEN 1 ELSE 0 END AS f FROM t),
i AS (SELECT user_id, t, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m)
SELECT user_id, island, count(*) AS n, max(t) - min(t) AS span FROM i GROUP BY ALL""",
    "evidence_scores": """
WITH f AS (SELECT user_id, event_type, max(value) + 0.3 * (sum(value) - max(value)) AS v FROM events GROUP BY ALL)
SELECT user_id, round(CAST(sum(v) AS DOUBLE), 6) AS score, count(*) AS families FROM f GROUP BY user_id""",
    "keep_best_event": "SELECT user_id, event_type, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY ALL",
    "quota_month": "SELECT user_id, strftime(ts, '%Y-%m') AS period, count(*) AS n, count(*) > 60 AS over FROM events GROUP BY ALL",
    "daily_cap": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS period, count(*) AS n, count(*) > 3 AS over FROM events GROUP BY 1, 2",
    "window_limiter": """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w(user_id, event_id, n, start, place) AS (SELECT user_id, event_id, n, t, 1 FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - w.start >= 86400000000 THEN e.t ELSE w.start END, CASE WHEN e.t - w.start >= 86400000000 THEN 1 ELSE w.place + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT event_id, CAST(place AS BIGINT) AS place, place <= 3 AS allowed FROM w""",
    "ranking_metrics": """
WITH o AS (SELECT o_custkey AS query, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, CASE WHEN o_orderstatus <> 'O' THEN 5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS grade FROM orders),
g AS (SELECT *, pow(2, coalesce(grade, 0)) - 1 AS gain FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gain DESC, rank) AS best FROM g),
s AS (SELECT query, coalesce(sum(gain / log2(rank + 1)) FILTER (rank <= 5), 0) AS dcg, coalesce(sum(gain / log2(best + 1)) FILTER (best <= 5), 0) AS ideal, min(rank) FILTER (grade >= 1) AS first, count(*) FILTER (grade >= 1 AND rank <= 5) AS found, count(*) FILTER (grade >= 1) AS relevant, bool_and(rank > 5 OR grade IS NOT NULL) AS covered FROM b GROUP BY query)
SELECT query, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg, round(coalesce(1.0 / first, 0), 6) AS mrr, round(found / nullif(relevant, 0), 6) AS recall, covered FROM s""",
}


def _spread(n: int) -> str:
    """Farthest points by unrolled steps: each takes, in a label, the vector whose highest cosine with those before is least."""
    steps = ["x AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL)", "c0 AS (SELECT label, min(vec_id) AS vec_id, 0 AS place FROM x GROUP BY label)", "s0 AS (SELECT * FROM c0)"]
    for k in range(1, n):
        near = f"SELECT x.label, x.vec_id, max(round(list_dot_product(x.e, y.e) / greatest(x.n * y.n, 1e-12), 9)) AS near FROM x JOIN s{k - 1} s ON s.label = x.label JOIN x y ON y.vec_id = s.vec_id WHERE x.vec_id NOT IN (SELECT vec_id FROM s{k - 1}) GROUP BY ALL"
        steps += [f"c{k} AS (SELECT label, vec_id, {k} AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY near, vec_id) AS r FROM ({near})) WHERE r = 1)", f"s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM c{k})"]
    return f"WITH {_V}, {', '.join(steps)} SELECT label, vec_id, place FROM s{n - 1}"


ORACLES["spread_sample"] = _spread(5)
