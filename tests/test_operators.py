"""Small hand-made cases for the operators, the traps above all."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import vectors as V
from quillspark.operators import evaluation, extract, finance, graph, identity, linking, quality, retrieval, timeline, versions
from quillspark.operators.components import connected_components
from quillspark.session import Kept
from quillspark.sources import tables
from quillspark.streaming import limits


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).head()["x"]


def test_text_functions(spark):
    assert one(spark, X.squeeze(F.col("t")), t=" a  b\n c ") == "a b c"
    assert one(spark, X.citation_form(F.col("t")), t="Die  STRAße") == "die strasse"
    assert one(spark, X.mask_digits(F.col("t")), t="a 12-3") == "a XX-X"
    assert one(spark, X.name_key(F.col("t")), t="Hon. Dr.  Ann Smith–Jones") == "ann smith-jones"
    assert one(spark, X.speech_form(F.col("t")), t="Don't  STOP!") == "dont stop"
    assert one(spark, X.slug(F.col("t")), t=" A b/C ") == "a-b-c"
    assert one(spark, X.sentences(F.col("t")), t="One. Two!  Three? x") == ["One.", "Two!", "Three?", "x"]
    assert one(spark, X.sentences(F.col("t")), t="  0 none. 10 one 1 ") == ["0 none.", "10 one 1"]  # blanks go, not the digits of a sentence's number
    assert one(spark, X.query_terms(F.col("t"), ("the",)), t="The cat, the hat; at cat") == ["cat", "hat"]
    assert one(spark, X.fiscal_year(F.col("t")), t="spending in 2021") == "2020-2021"
    assert one(spark, X.fiscal_year(F.col("t")), t="trend since 2021") is None
    assert one(spark, X.rate(F.col("t")), t="25.98%") == pytest.approx(0.2598)
    assert one(spark, X.exotic_ratio(F.col("t")), t="ab–Ж") == 0.25
    assert one(spark, X.document_type(F.col("t")), t="Board_Minutes_2020.pdf") == "minutes"
    assert one(spark, X.pii_findings(F.col("t")), t="123-45-6789, DOB: 1/2/1990, 123456789") == ["XXX-XX-XXXX", "DOB: X/X/XXXX"]


@pytest.mark.parametrize("text,value", [("$1,234.50", "1234.50"), ("(12)", "-12.00"), ("-", "0.00"), ("7", "7.00")])
def test_money(spark, text, value):
    assert str(one(spark, X.money(F.col("t")), t=text)) == value


def test_money_refuses_other_text(spark):
    with pytest.raises(Exception, match="no amount"):
        one(spark, X.money(F.col("t")), t="n/a")


@pytest.mark.parametrize("name,day", [("x 2020-02-29 y", dt.date(2020, 2, 29)), ("2020-02-30", None), ("3/4/2021", dt.date(2021, 3, 4)), ("March 5, 2019 agenda", dt.date(2019, 3, 5)), ("f_1970-01-01", None)])
def test_dates(spark, name, day):
    assert one(spark, X.parse_date(F.regexp_replace("t", "_", " ")), t=name) == day


def test_source_ref(spark):
    ref = X.source_ref(F.col("t"), {"docs.example.org": "id"})
    assert one(spark, ref, t="HTTPS://Example.ORG/A/b/?utm=1#x") == "https://example.org/A/b"
    assert one(spark, ref, t="http://docs.example.org/v?z=1&id=9") == "http://docs.example.org/v?id=9"
    assert one(spark, ref, t="no url") == "no url"


def test_citation_ids_count_repeats(spark):
    df = spark.createDataFrame([(1, 0, "Aye."), (1, 1, "aye."), (1, 2, "No.")], "d int, i int, t string")
    out = versions.chunk_ordinals(df, "d", "t", "i").withColumn("c", X.citation_id(F.lit("k"), F.col("t"), F.col("ordinal")))
    got = rows(out, "i", "ordinal", "c")
    assert [g[1] for g in got] == [0, 1, 0] and len({g[2] for g in got}) == 3 and all(len(g[2]) == 8 for g in got)


def test_cosine_of_zero_is_null(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1.0), None]


def test_fusion_ties_follow_the_first_list(spark):
    lists = spark.createDataFrame([(0, "semantic", 1, 5), (1, "keyword", 1, 9), (1, "keyword", 2, 5)], "list_no int, kind string, rank int, id int")
    got = {r["id"]: r for r in retrieval.fuse(lists).collect()}
    assert got[5]["rrf"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9) and got[5]["semantic_rank"] == 1 and got[9]["semantic_rank"] is None
    moved = retrieval.demote(spark.createDataFrame([(1, 9.0, True), (2, 8.0, False), (3, 7.0, True), (4, 6.0, False), (5, 5.0, False), (6, 4.0, False)], "id int, s double, d boolean"), [F.desc("s")], F.col("d"), by=3)
    assert [r["id"] for r in moved.orderBy("place").collect()] == [2, 4, 1, 5, 6, 3]


def test_citations(spark):
    known = spark.createDataFrame([("aaaaaaaa",)], "citation_id string")
    answers = spark.createDataFrame([(1, 0, "Yes [#qaaaaaaaa]"), (1, 1, "No [#qaaaaaaaa] [#qbbbbbbbb]"), (1, 2, "short one"), (1, 3, "one two three four five six seven eight nine")], "answer_id int, position int, sentence string")
    assert rows(retrieval.verify_citations(answers, known), "position") == [(0,), (2,)]
    chunks = spark.createDataFrame([("a", 1, 10, True), ("a", 1, 11, False), ("b", 1, 12, True), ("b", 2, 13, True)], "citation_id string, document_id int, chunk_id int, current boolean")
    refs = spark.createDataFrame([("a",), ("b",), ("c",)], "ref string")
    assert {r["ref"]: r["chunk_id"] for r in retrieval.resolve_citations(refs, chunks).collect()} == {"a": 10, "b": None, "c": None}


def test_versions(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 99), *[(100 + i, 101 + i) for i in range(20)], (120, None)], "id int, replaces_id int")
    got = {r["id"]: (r["canonical_id"], r["superseded"]) for r in versions.resolve_versions(df).collect()}
    assert got[1] == (3, True) and got[3] == (3, False)
    assert got[4] == (4, False) and got[6] == (6, False)  # a cycle, a dangling pointer
    assert got[104] == (120, True) and got[103] == (103, False)  # sixteen steps, and seventeen


def test_identity_ladder(spark):
    stored = spark.createDataFrame([(1, 7, "u1", "h1", "f1"), (2, 7, "u2", "h2", "f2")], "id int, entity_id int, source_ref string, content_hash string, source_file string")
    new = spark.createDataFrame([(7, "u1", "h9", "x"), (7, "", "h2", "x"), (7, "u3", "h2", "zz"), (7, "", "h3", "f1"), (8, "u1", "h1", "f1")], "entity_id int, source_ref string, content_hash string, source_file string")
    got = sorted((r["entity_id"], r["source_ref"], r["content_hash"], r["match_id"] or 0, r["action"]) for r in versions.identity_ladder(new, stored).collect())
    assert got == [(7, "", "h2", 2, "skipped"), (7, "", "h3", 1, "updated"), (7, "u1", "h9", 1, "updated"), (7, "u3", "h2", 0, "new"), (8, "u1", "h1", 0, "new")]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (50, None), (200, 200)], "a long, b long")
    got = dict(rows(connected_components(edges, Kept(spark, "t")), "id", "component"))
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100 and got[200] == 200 and 50 not in got
    assert connected_components(edges.limit(0), Kept(spark, "t")).count() == 0


def test_name_resolution_filters_terms_before_counting(spark):
    day = dt.date(2020, 5, 1)
    roster = spark.createDataFrame([("smith", 1, 10, dt.date(2019, 1, 1), None), ("smith", 1, 11, dt.date(2015, 1, 1), dt.date(2018, 1, 1)), ("lee", 1, 12, None, None), ("lee", 1, 13, None, None), ("kay", 1, 14, dt.date(2021, 1, 1), None)], "name_key string, body int, subject_id int, start date, end date")
    names = spark.createDataFrame([(1, "smith", 1, day), (2, "lee", 1, day), (3, "kay", 1, day), (4, "zoe", 1, day), (5, "smith", 2, day)], "mention_id int, name_key string, body int, day date")
    got = {r["mention_id"]: (r["status"], r["subject_id"]) for r in graph.resolve_names(names, roster).collect()}
    assert got == {1: ("resolved", 10), 2: ("ambiguous", None), 3: ("out_of_term", None), 4: ("unknown", None), 5: ("unknown", None)}


def test_vote_edges_keep_the_first_of_a_repeated_name(spark):
    votes = spark.createDataFrame([(1, [("A", "Aye"), ("B", "No"), ("A", "No")], "B", None)], "vote_id int, members array<struct<name:string,vote:string>>, moved_by string, seconded_by string")
    assert rows(graph.vote_edges(votes), "name", "edge") == [("A", "voted_aye"), ("B", "moved"), ("B", "voted_no")]


def test_timeline(spark):
    left = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 20.0, math.inf), (1, 3, 11.0, 12.0)], "g int, id int, start double, end double")
    right = spark.createDataFrame([(1, "a", 0.0, 5.0), (1, "b", 5.0, 10.0), (1, "c", 19.0, 30.0)], "g int, label string, start double, end double")
    got = {r["id"]: (r["label"], r["overlap"]) for r in timeline.max_overlap(left, right, "g", "id", "label", width=4.0).collect()}
    assert got == {1: ("a", 5.0), 2: ("c", 10.0), 3: (None, 0.0)}  # a tie goes to the earlier span
    near = timeline.nearest_span(spark.createDataFrame([(1, 1, 11.0, 12.0), (1, 2, 17.0, 18.0)], "g int, id int, start double, end double"), right, "g", "id", "label")
    assert rows(near, "id", "label") == [(1, "b"), (2, "c")]
    runs = timeline.runs(spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, None), (1, 4, None), (1, 5, "x")], "g int, t int, l string"), "g", ["t"], "l")
    assert [r["n"] for r in runs.orderBy("run").collect()] == [2, 2, 1]


def test_finance(spark):
    df = spark.createDataFrame([("a", 1.1), ("", 2.2), (None, 3.3)], "k string, v double")
    assert {r["label"]: str(r["amount"]) for r in finance.shares(df, F.col("k"), F.col("v")).collect()} == {"a": "1.10", "Unspecified": "5.50"}
    assert finance.shares(df.withColumn("v", F.lit(0.0)), F.col("k"), F.col("v")).count() == 0
    wide = spark.createDataFrame([(1, "o", 5.0), (1, "f", 6.0), (1, "a", 7.0), (2, "o", 1.0)], "y int, b string, v double")
    got = finance.budget_vs_actual(wide, ["y"], F.col("b"), F.col("v"), ("o", "f", "a")).collect()
    assert len(got) == 1 and float(got[0]["variance"]) == 1.0
    parts, totals = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0)], "k int, p double"), spark.createDataFrame([(1, 5.0), (3, 1.0)], "k int, t double")
    assert rows(finance.reconcile(parts, totals, ["k"], "p", "t"), "k", "agrees") == [(1, True), (2, False), (3, False)]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, 0), ("q", 2, 2), ("q", 3, None), ("z", 1, 0)], "query string, rank int, grade int")
    got = {r["query"]: r for r in evaluation.ranking(ranked, 2).collect()}
    assert got["q"]["ndcg"] == pytest.approx((3 / math.log2(3)) / 3, abs=1e-6) and got["q"]["mrr"] == 0.5 and got["q"]["recall"] == 1.0
    assert got["z"]["recall"] is None and got["z"]["ndcg"] == 0.0
    c = evaluation.clustering(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, None)], "c int, l string"), "c", "l").head()
    assert c["purity"] == 0.75 and c["pair_precision"] == pytest.approx(1 / 3, abs=1e-6) and c["pair_recall"] == 0.5 and c["macro_recall"] == 0.5
    none = evaluation.macro_precision(spark.createDataFrame([("a", None)], "truth string, predicted string")).head()
    assert none["macro_precision"] == 1.0 and none["recall"] == 0.0
    points = spark.createDataFrame([(0.1, 0.5, 0.9), (0.2, 0.5, 0.8), (0.3, 0.9, 0.4), (0.4, 0.9, 0.4)], "threshold double, precision double, recall double")
    assert rows(evaluation.pareto(points), "threshold") == [(0.1,), (0.4,)]


def test_linking(spark):
    s = spark.createDataFrame([(1, "p", 1, [1.0, 0.0]), (2, "p", 2, [1.0, 0.0]), (3, "q", 1, [0.0, 1.0]), (4, "q", 2, [0.6, 0.8])], "id int, person string, meeting int, v array<double>")
    got = {(r["id"], r["person"]): r["score"] for r in linking.person_scores(s, "person", "meeting", "v", "id").collect()}
    assert got[1, "p"] == pytest.approx(1.0) and got[1, "q"] == pytest.approx(0.6) and got[3, "q"] == pytest.approx(0.8)
    best = linking.best_with_margin(spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.7), (2, "a", 0.5)], "k int, l string, s double"), "k", "l", "s")
    assert rows(best, "k", "l", "margin") == [(1, "a", pytest.approx(0.2)), (2, "a", 0.5)]
    nodes = linking.complete_linkage(s.withColumn("g", F.lit(1)), "g", "id", "v", 0.5, "meeting")
    assert rows(nodes, "id", "node") == [(1, 1), (2, 1), (3, 3), (4, 3)]
    assert rows(linking.farthest_points(s.withColumn("g", F.lit(1)), "g", "id", "v", 2), "id") == [(1,), (3,)]
    assert linking.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and linking.jaro_winkler("a", "b") == 0.0
    calls = spark.createDataFrame([(1, "call", 1, "x"), (1, "answer", 2, "x"), (1, "call", 3, "y"), (1, "call", 4, "z"), (1, "answer", 5, "z")], "g int, kind string, pos int, tok string")
    assert rows(linking.align_calls(calls, "g", "kind", "pos", "tok"), "call", "answer") == [(1, 2), (4, 5)]
    ev = linking.evidence_score(spark.createDataFrame([(1, "f", 0.5), (1, "f", 0.4), (1, "g", 0.2)], "k int, fam string, v double"), ["k"], "fam", "v").head()
    assert ev["score"] == pytest.approx(0.5 + 0.3 * 0.4 + 0.2)
    grid = linking.sweep(spark.createDataFrame([("a", "a", 0.5, 0.2), ("b", "a", 0.4, 0.1)], "person string, truth string, score double, margin double"), [0.3, 0.45, 0.9], [0.0])
    assert {r["threshold"]: (r["predictions"], r["precision"], r["recall"]) for r in grid.collect()} == {0.3: (2, 0.5, 0.5), 0.45: (1, 1.0, 0.5), 0.9: (0, 1.0, 0.0)}
    assert linking.operating_point(grid, 0.9).head()["threshold"] == 0.45


def test_identity(spark):
    stored = spark.createDataFrame([(1, 5, "confirmed", "a"), (2, 5, "inferred_low", "roll"), (3, 6, "inferred_low", "a"), (4, 6, "inferred_high", "a")], "k int, subject int, confidence string, basis string")
    new = spark.createDataFrame([(1, 9, "inferred_high", "roll"), (3, 9, "inferred_high", "roll"), (4, 9, "inferred_high", "roll"), (5, 9, "inferred_low", "roll")], "k int, subject int, confidence string, basis string")
    assert rows(identity.persist(stored, new, ["k"], "roll"), "k", "action") == [(1, "locked"), (2, "retract"), (3, "update"), (4, "keep"), (5, "insert")]
    low = identity.demote_contested(stored.withColumn("m", F.lit(1)), ["m"], "subject")
    assert rows(low, "k", "confidence")[3] == (4, "inferred_low") and rows(low, "k", "confidence")[0] == (1, "confirmed")
    frames = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "b"), (2, "b")], "c int, l string")
    assert rows(identity.verdict(frames, "c", "l", 2), "c", "l") == [(1, "a")]


def test_extract(spark):
    text = "Motion by A. Jones, seconded by Lee to approve the plan. Ayes: 5 Nays: 2 Motion by Kim to table it. Ayes 3 Nays 3"
    got = extract.parse_votes(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t").orderBy("motion_no").collect()
    assert [(r["moved_by"], r["yes"], r["no"], r["result"]) for r in got] == [("A. Jones", 5, 2, "passed"), ("Kim", 3, 3, None)]
    body = " ".join(f"Word{i} is here." for i in range(300))
    parts = extract.passages(body)
    assert len(parts) > 3 and parts[1].startswith(" ".join(body.split(". ")[0:0]) or "Word") and parts[0].split(". ")[-1].rstrip(".") in parts[1]
    assert extract.passages("") == [] and [t for t, _ in extract.sections("# One\nx\n# Two\ny")] == ["One", "Two"]
    rules = extract.build_rules(spark.createDataFrame([("Smyth", "Smith"), ("smyth", "Smithe"), ("Lea", "Lee"), ("lee", "Lee")], "mangled string, canonical string"))
    assert rows(rules, "mangled", "canonical") == [("lea", "Lee")]


def test_audit(spark):
    df = spark.createDataFrame([(1, "ok"), (2, ""), (3, None), (4, "a\x01b"), (5, "123-45-6789"), (6, "Ã©t")], "doc_id int, t string")
    assert rows(quality.audit(df, "doc_id", "t"), "doc_id", "issue") == [(2, "empty"), (3, "empty"), (4, "control_characters"), (5, "pii"), (6, "mojibake")]


def test_limits_and_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate((0, 10, 59, 60, 61, 200))], "u int, e int, ts timestamp")
    assert [p for _, p, _ in rows(limits.window_limit(ev, "u", "e", "ts", 60.0, 2), "e", "place", "allowed")] == [1, 2, 3, 1, 2, 1]
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = limits.stream_window_limit(stream, "u", "ts", 60.0, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["place"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("t").collect()] == [1, 2, 3, 1, 2, 1]


def test_readers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id,decision\n1,yes\n2,\n")
    assert rows(tables.read_decisions(spark, str(tmp_path / "d.csv"), "id int, decision string"), "id") == [(1,), (2,)]
    (tmp_path / "m.json").write_text('[{"url": "a"}, {"url": "b"}]')
    assert tables.read_manifest(spark, str(tmp_path / "m.json"), "url string").count() == 2
    (tmp_path / "f.xml").write_text("<r><row><fund>A</fund><amount>(1,200)</amount></row><row><fund>B</fund><amount>-</amount></row></r>")
    got = tables.read_xml_records(spark, str(tmp_path / "f.xml"), "row", "fund string, amount string").withColumn("v", X.money(F.col("amount")))
    assert [(f, float(v)) for f, v in rows(got, "fund", "v")] == [("A", -1200.0), ("B", 0.0)]
    (tmp_path / "t.md").write_text("# x")
    assert rows(tables.read_text_files(spark, str(tmp_path), "*.md"), "extension", "content") == [("md", "# x")]


def test_fuzzy_names_against_all_pairs(spark):
    def score(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        jw = linking.jaro_winkler(a, b) if " " not in a + b else 0
        return max(2 * row[-1] / (len(a) + len(b)), jw)

    phrases = ["kalderons", "jon", "abc", "new yrok", "ünal öz", "a b c", "smiht", "lavander", "xyz", "ro"]
    names = ["calderon", "jonathan", "bca", "new york", "york", "unal oz", "a b", "smith", "lavender", "abc", "zyxw", "orr", "smith jones"]
    want = {}
    for p in phrases:
        near = [(score(p, v), v) for v in names if v != p and abs(p.count(" ") - v.count(" ")) <= 1]
        s, v = max(near)
        if s >= 0.7:
            want[p] = (v, round(s, 6))
    got = linking.fuzzy_names(spark.createDataFrame([(p,) for p in phrases], "p string"), spark.createDataFrame([(v,) for v in names], "v string"), "p", "v", 0.7)
    assert {r["p"]: (r["v"], r["score"]) for r in got.collect()} == want and want["kalderons"][0] == "calderon" and want["jon"][0] == "jonathan"


def test_complete_linkage_against_brute_force(spark):
    rng = random.Random(4)
    items = [(k, k % 3, k % 5, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)]
    unit = {k: [x / sum(y * y for y in v) ** 0.5 for x in v] for k, _, _, v in items}
    cos = lambda a, b: sum(x * y for x, y in zip(unit[a], unit[b], strict=True))
    want = {}
    for g in range(3):
        nodes = [{k} for k, h, _, _ in items if h == g]
        meeting = {k: m for k, _, m, _ in items}
        while True:
            best = max(((min(cos(a, b) for a in x for b in y), -min(x), -min(y)) + (x, y) for i, x in enumerate(nodes) for y in nodes[i + 1 :] if not {meeting[a] for a in x} & {meeting[b] for b in y}), default=None, key=lambda t: t[:3])
            if best is None or best[0] < 0.2:
                break
            nodes = [n for n in nodes if n not in best[3:]] + [best[3] | best[4]]
        want |= {k: min(n) for n in nodes for k in n}
    df = spark.createDataFrame(items, "id int, g int, meeting int, v array<double>")
    assert dict(rows(linking.complete_linkage(df, "g", "id", "v", 0.2, "meeting"), "id", "node")) == want


def test_display_forms(spark):
    from quillspark.functions import display as D

    one = lambda c, **k: spark.createDataFrame([tuple(k.values())], list(k)).select(c.alias("r")).head()["r"] if k else spark.range(1).select(c.alias("r")).head()["r"]
    assert [one(D.usd(F.lit(x))) for x in (1234567.4, -0.4, -12.6)] == ["$1,234,567", "$0", "$-13"] and one(D.usd_m(F.lit(29791234.0))) == "$29.79M"
    assert [one(D.nice_ceiling(F.lit(x))) for x in (0.0, 0.5, 3.0, 20.0, 21.0, 612.0)] == [1.0, 1.0, 5.0, 20.0, 50.0, 1000.0]
    assert [one(D.clock(F.lit(x))) for x in (5, 65, 3605, -1)] == ["0:05", "1:05", "1:00:05", ""]
    assert [one(D.short_year(F.lit(x))) for x in ("2023-2024", "FY24")] == ["23-24", "FY24"]
    assert one(D.first_sentence(F.lit("Dr. Who spoke to the board. Then it rained."))) == "Dr. Who spoke to the board."
    assert [one(D.display_id(F.lit(r), F.lit(8140))) for r in ("a3f91c08", "")] == ["#qa3f91c08", "#q1fcc"] and one(D.display_id(F.lit(""))) == "#unknown"
    assert one(D.snippet("t", "s", 5), t="the quick brown fox", s="brown") == "…uick brown fox" and one(D.snippet("t", "s"), t="abc", s="x") == ""
    assert one(D.annual_schedule(F.lit("2024-2025 Board of Education Meetings"))) and not one(D.annual_schedule(F.lit("2024-03-02 minutes")))
    assert [str(one(D.day_in_name(F.lit(x), (1985, 2035)))) for x in ("Apr 12, 2023", "11.16.22", "10-29-25", "06242020", "Feb2025", "2024-2025 plan", "12.10.2025", "none")] == ["2023-04-12", "2022-11-16", "2025-10-29", "2020-06-24", "2025-02-01", "2024-07-01", "2025-12-10", "None"]
    assert [one(D.confidence(F.lit(a), F.lit(b), F.lit(s), 0.92, 0.8, 0.88)) for a, b, s in (("shah park", "shaw park", 0.85), ("abcd efgh", "ijkl mnop", 0.81), ("yorg", "york", 0.9), ("x y", "p q", 0.5))] == ["high", "review", "review", None]
    assert one(D.title_of(F.lit("a/b/Board_Minutes-May.pdf"))) == "Board Minutes May"


def test_money_and_names_as_the_filings_write_them(spark):
    got = spark.createDataFrame([("",), (" ",), ("(1,200)",), ("-",), (None,)], "x string").select(X.money(F.col("x")).alias("v"), "x").collect()
    assert [None if r["v"] is None else float(r["v"]) for r in got] == [0.0, 0.0, -1200.0, 0.0, None]
    names = spark.createDataFrame([("Mayor Dr. Anne  Smith - Jones",), ("Strauß, Max",)], "x string").select(X.name_key(F.col("x")).alias("k")).collect()
    assert [r["k"] for r in names] == ["anne smith-jones", "strauss max"]


def test_components_on_random_graphs_and_without_end(spark, monkeypatch):
    from quillspark.operators import components

    monkeypatch.setattr(components, "CONTRACT", 1)  # so that the rounds have something to do
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7), (200, 200)]
    rng.shuffle(edges)
    want = {v: v for e in edges for v in e}
    for _ in range(len(want)):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    assert dict(rows(connected_components(df, Kept(spark, "cc")), "id", "component")) == want
    assert connected_components(df.limit(0), Kept(spark, "cc")).count() == 0
    with pytest.raises(RuntimeError):
        connected_components(df, Kept(spark, "cc"), max_rounds=1)


def test_a_shared_folder_must_be_named():
    from quillspark.session import shared_dir

    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"getConf": lambda self: Conf()})()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_pairs_that_sketches_rule_out_fetch_no_sets(spark):
    rng = random.Random(8)
    often, rows = [f"often{k}" for k in range(60)], []
    for k in range(60):  # all share rare tokens of their first ones, few agree
        own = [f"x{k}y{j}" for j in range(80)]
        rows.append((k, " ".join(["rare1", "rare2", *rng.sample(often, 20), *own]), "b"))
    rows += [(100 + k, rows[k][1] + " more", "b") for k in range(5)] + [(200, "same " * 300 + " ".join(f"w{j}" for j in range(40)), "b")]
    sets = {k: set(t.split()) for k, t, _ in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "id int, t string, g string")
    assert {(r["a"], r["b"]) for r in versions.near_duplicate_pairs(df, "id", "t", ["g"]).collect()} == want and len(want) == 5
    hashed = df.select("id", F.lit(1).cast("long").alias("bucket"), F.transform(F.array_distinct(F.split("t", " ")), lambda t: F.xxhash64(t)).alias("tokens"))
    cut = versions.prefixes(hashed, versions.token_counts(hashed), 85)
    side = lambda c: cut.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    left = {(r["a"], r["b"]) for r in versions.may_agree(side("a").crossJoin(side("b")).where("a < b"), 85).collect()}
    assert want <= left and len(left) < 50
    for r in cut.collect():
        assert len(r["prefix"]) == r["n"] - -(-r["n"] * 85 // 100) + 1 and sum(r["sketch"]) == r["n"]


def test_near_pairs_of_copies_are_all_listed(spark):
    words = [f"w{k}" for k in range(60)]
    text = lambda drop: " ".join(w for w in words if w not in drop)
    rows = [(k, text(()), "b") for k in range(12)] + [(20 + k, text(("w1",)), "b") for k in range(5)] + [(30, text([f"w{j}" for j in range(9)]), "b"), (31, text(()), "c"), (32, text(()), None), (33, text(("w1",)) + " W2", "b")]
    rows += [(3, " ".join(f"v{k}" for k in range(40)), "b"), (40, " ".join(f"v{k}" for k in range(40)), "b"), (5, text(()), "b")]  # ids that occur twice
    sets = [(k, set(t.lower().split()), g) for k, t, g in rows]
    want = sorted((x[0], y[0], round(len(x[1] & y[1]) / len(x[1] | y[1]), 6)) for x in sets for y in sets if x[0] < y[0] and x[2] == y[2] is not None and 100 * len(x[1] & y[1]) >= 85 * len(x[1] | y[1]))
    df = spark.createDataFrame(rows, "id int, t string, g string")
    for copies in (1024, 3):
        assert sorted(tuple(r) for r in versions.near_duplicate_pairs(df, "id", "t", ["g"], copies=copies).collect()) == want
    from quillspark.operators.components import connected_components
    from quillspark.session import Kept

    with Kept(spark, "t") as kept:
        parts = [{r["id"]: r["component"] for r in connected_components(e, kept).collect()} for e in (versions.near_duplicate_links(df, "id", "t", ["g"]), spark.createDataFrame(want, "a int, b int, j double"))]
    assert parts[0] == parts[1] and versions.near_duplicate_links(df, "id", "t", ["g"]).count() < len(want) / 3
