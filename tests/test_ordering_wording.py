"""Ranks in ranges, percentiles, wording distances and times of passages against plain loops."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import display
from quillspark.operators import analysis, extract, ordering, wording
from quillspark.session import Kept


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 2, 2, 2, None]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, __tie long").repartition(5)
    with Kept(spark, "t") as kept:
        got = ordering.ranked(df, [F.col("x").desc_nulls_last(), F.col("__tie")], kept)
        assert got.columns == ["g", "x", "__tie", "rank"]
        want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [(r["g"], r["x"], r["__tie"]) for r in sorted(got.collect(), key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got.collect()) == list(range(1, 501))
        each = ordering.ranked(df, [F.col("x").asc_nulls_first(), F.col("__tie")], kept, by=["g"]).collect()
        for g in ("a", "b", None):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            assert [(r["x"], r["__tie"]) for r in sorted((r for r in each if r["g"] == g), key=lambda r: r["rank"])] == [r[1:] for r in mine]
            assert sorted(r["rank"] for r in each if r["g"] == g) == list(range(1, len(mine) + 1))
        # one value for all rows doesn't make one range of them
        same = ordering.ranked(spark.range(4000).select(F.lit(1).alias("x")).repartition(3), [F.col("x")], kept)
        assert sorted(r["rank"] for r in same.collect()) == list(range(1, 4001))
        assert ordering.ranked(df.limit(0), [F.col("x")], kept).count() == 0


def test_percentiles(spark):
    rng = random.Random(2)
    x = [rng.choice([rng.random(), 0.5]) for _ in range(333)]
    with Kept(spark, "t") as kept:
        got = {r["threshold"] for r in analysis.thresholds(spark.createDataFrame([(v,) for v in [*x, None]], "s double"), "s", kept, 11).collect()}
        assert got == {round(float(v), 6) for v in np.quantile(x, np.linspace(0, 1, 11))}
        assert analysis.thresholds(spark.createDataFrame([], "s double"), "s", kept).count() == 0
        assert [r["threshold"] for r in analysis.thresholds(spark.createDataFrame([(2.0,)], "s double"), "s", kept).collect()] == [2.0]


def test_spread_keeps_subjects_apart(spark):
    rows = [("a", k) for k in range(5)] + [("b", k) for k in range(5, 9)] + [("c", 20), (None, 30)]
    with Kept(spark, "t") as kept:
        got = analysis.spread(spark.createDataFrame(rows, "s string, i int"), "s", "i", "x", kept).collect()
    order = [r["s"] for r in sorted(got, key=lambda r: r["place"])]
    assert sorted(r["place"] for r in got) == list(range(1, 12)) and all(a != b for a, b in zip(order[:-2], order[1:-1], strict=True))


def test_names_of_schedules_and_twins(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).head()["r"]
    key = lambda t: one(display.cluster_key(F.lit(3), F.lit("2024-05-01T10:00"), F.lit(" Minutes "), F.lit(t)))
    assert key("a/Plan_Final  v2.PDF") == key("plan.html") == "3|2024-05-01|minutes|plan" and key("Plan B draft rev12") == "3|2024-05-01|minutes|plan b"
    assert one(display.cluster_key(*[F.lit(None).cast("string")] * 4)) == "|||"
    assert [one(display.annual_schedule(F.lit(x))) for x in ("2024_2025 calendar", "2024 2026 calendar", "2024-2025 budget", "calendar 2024", "Meetings 2025 - 2026", "", None)] == [True, False, False, False, True, False, False]
    day = lambda x, today: str(one(display.day_in_name(F.lit(x), (1985, 2035), F.to_date(F.lit(today)))))
    assert [day(x, "2024-01-01") for x in ("20251210", "06242020", "20231210", "2030-01-02", "12_10_2025")] == ["None", "2020-06-24", "2023-12-10", "2030-01-02", "2025-12-10"]


def test_wording_against_a_plain_loop(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(60):
        person = f"p{k % 7}" if k < 58 else ("alone" if k == 58 else None)
        liked = vocab[(k % 7) * 3 : (k % 7) * 3 + 6]
        rows.append((k, person, " ".join(rng.choice(vocab + liked * 3) for _ in range(rng.choice([5, 40, 120])))))
    rows += [(100, "p1", ""), (101, "p1", None), (None, "p1", "w1 w2")]
    ok = [(i, p, re.findall(r"\w+", t)) for i, p, t in rows if i is not None and p is not None and t]
    every = [w for _, _, ws in ok for w in ws]
    top = sorted(set(every), key=lambda w: (-every.count(w), w))[:12]
    rate = lambda ws: np.array([ws.count(w) / len(ws) for w in top])
    sd = np.std([rate(ws) for _, _, ws in ok], axis=0)
    sd[sd == 0] = 1
    want = {}
    for i, p, ws in ok:
        scores = []
        for q in sorted({x[1] for x in ok}):
            rest = [w for j, r, x in ok if r == q and j != i for w in x]
            if rest:
                scores.append((round(float(np.mean(np.abs(rate(ws) - rate(rest)) / sd)), 9), q))
        own = [d for d, q in scores if q == p]
        if own:
            scores.sort()
            want[i] = (p, len(ws), scores[0][1], scores[0][0], scores[1][0], own[0])
    df = spark.createDataFrame(rows, "id long, who string, said string")
    for persons, block in ((512, 2048), (2, 11)):
        with Kept(spark, "t") as kept:
            ranks = wording.delta_ranks(df, "id", "who", "said", 12, kept, persons, block)
            got = {r["id"]: tuple(r)[1:] for r in ranks.collect()}
            assert set(got) == set(want) and 58 not in got
            for i, x in want.items():
                assert got[i][:2] == x[:2] and got[i][3:] == pytest.approx(x[3:], abs=1e-8)
            hits = sum(r[0] == r[2] for r in got.values())
            told = wording.accuracy_by_words(ranks, "who", [40]).collect()
            assert sum(r["n"] for r in told) == len(want) and sum(r["hits"] for r in told) == hits > 0.3 * len(want)


def test_times_of_passages(spark):
    segments = [(1, 0, "one two three"), (1, 5000, "four five, six"), (1, 9000, "seven eight nine ten"), (1, 12000, "one two three four five six"), (2, 100, "one two three four"), (1, None, "zero"), (None, 3, "x")]
    passages = [(1, 10, "Three four FIVE six seven eight"), (1, 11, "lost lost lost eight nine ten one"), (1, 12, "no such words here at all"), (1, 13, "too short"), (2, 14, "three four five six seven eight"), (1, 15, "one two three four five six"), (1, 16, None)]
    got = wording.spoken_at(spark.createDataFrame(passages, "document_id long, chunk_id long, content string"), spark.createDataFrame(segments, "document_id long, start_ms long, text string"), probe=3, least=6)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10, 0, 0), (1, 11, 2, 9000), (1, 15, 0, 0)]


def test_distances_by_small_pieces(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, "abc"[k % 3], " ".join(rng.choice(["of", "the", "and", "to", "rare" + str(k)]) for _ in range(rng.choice([1, 9, 40])))) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, who string, said string").repartition(2)
    got = []
    for piece, least in ((1 << 18, 1_024), (16, 2)):
        monkeypatch.setattr(wording, "PIECE", piece)
        monkeypatch.setattr(wording, "ROWS", least)
        with Kept(spark, "t") as kept:
            got.append(sorted(tuple(r) for r in wording.delta_ranks(df, "id", "who", "said", 4, kept).collect()))
    assert got[0] == got[1] and len(got[0]) == 60


def test_passages_are_handed_on_in_pieces(monkeypatch):
    monkeypatch.setattr(extract, "HELD", 100)
    texts = ["One two three. " * k for k in range(40)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"id": pa.array([*range(41), None]), "text": texts})
    got = list(extract.passage_batches(iter([batch]), 10))
    rows = [r for b in got for r in zip(*b.to_pydict().values(), strict=True)]
    assert rows == [(d, k, "", p) for d, x in enumerate(texts) for k, p in enumerate(extract.passages(x or "", 10))]
    assert len(got) > 10 and max(sum(map(len, b.to_pydict()["content"][:-1])) for b in got) < 100
