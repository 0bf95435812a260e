"""Coherent cores, left-out operating points, wrong merges, roll calls and citations against plain walks."""

import collections
import random

import numpy as np
import pytest

from quillspark.operators import quotes, rollcall, timeline, voices


def test_cores_against_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    rows, vec = [], {}
    for g in ("a", "b", "c", "lone"):
        centre = rng.normal(size=5)
        for k in range({"a": 25, "b": 6, "c": 2, "lone": 1}[g]):
            v = rng.normal(size=5) * 0.7 + (centre if k % 4 else -centre)
            rows.append((g, len(rows), [float(x) for x in v], 1))
            vec[len(rows) - 1] = v / np.linalg.norm(v)
    cohort = [[float(x) for x in v] for v in rng.normal(size=(9, 5))]
    unit = np.array(cohort) / np.linalg.norm(cohort, axis=1, keepdims=True)
    extra = [(None, 900, [1.0] * 5, 1), ("a", None, [1.0] * 5, 1), ("a", 901, None, 1), ("a", 902, [1.0, float("inf"), 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows + extra, "g string, id long, v array<double>, u int")
    frame = spark.createDataFrame([(c,) for c in cohort], "c array<double>")
    for z in (None, 1.2):
        got = {r["id"]: r for r in voices.coherent_cores(df, "g", "id", "v", 0.4, 3, frame if z else None, "c", z).collect()}
        assert set(got) == set(vec)
        for g in ("a", "b", "c", "lone"):
            ids = [r[1] for r in rows if r[0] == g]
            mean = {i: round((sum(float(vec[i] @ vec[j]) for j in ids) - 1) / (len(ids) - 1), 9) if len(ids) > 1 else 0.0 for i in ids}
            medoid = min(ids, key=lambda i: (-mean[i], i))
            core = []
            for i in ids:
                near, s = float(vec[i] @ vec[medoid]), unit @ vec[i]
                core += [i] * bool(i == medoid or (near >= 0.4 if z is None else (near - s.mean()) / s.std() >= z))
            for i in ids:
                r = got[i]
                assert r["mean_cosine"] == pytest.approx(mean[i], abs=1e-8) and r["medoid"] == (i == medoid) and r["core"] == (len(core) >= 3 and i in core)


def test_left_out_points_against_sweeps(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcd"), rng.choice([None, *[k / 10 for k in range(11)]]), rng.random() < 0.6) for _ in range(300)] + [(None, 0.5, True), ("e", None, True)]
    steps = [k / 10 for k in range(0, 11, 2)]
    got = {r["g"]: tuple(r)[1:] for r in voices.left_out_points(spark.createDataFrame(rows, "g string, s double, ok boolean"), "g", "s", "ok", [*steps, 0.2], 0.55).collect()}
    want = {}
    for g in "abcde":
        rest, own, best = [r for r in rows if r[0] not in (None, g)], [r for r in rows if r[0] == g], None
        for t in steps:
            hit = [r for r in rest if r[1] is not None and r[1] >= t]
            if hit and sum(r[2] for r in hit) / len(hit) >= 0.55:
                p, q = sum(r[2] for r in hit) / len(hit), sum(r[2] for r in hit) / len(rest)
                best = max(best or (-1, 0), (q, t, p))
        if best is None:
            continue
        mine = [r for r in own if r[1] is not None and r[1] >= best[1]]
        want[g] = (best[1], round(best[2], 6), round(best[0], 6), len(mine), sum(r[2] for r in mine), len(own))
    assert got == want and len(want) > 2


def test_merge_harm(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "b"), (3, None), (4, "a")]
    merges = [(1, 2), (1, 4), (1, 1), (3, 3), (3, 4), (2, 9), (1, 2)]
    got = {(r["a"], r["b"]): (r["harm"], r["ambiguous"]) for r in voices.merge_harm(spark.createDataFrame(rows, "node int, label string"), "node", "label", spark.createDataFrame(merges, "a int, b int")).collect()}
    assert got == {(1, 2): (1, True), (1, 4): (0, True), (1, 1): (0, True), (3, 3): (0, False), (3, 4): (0, False), (2, 9): (0, False)}


def walk(turns, max_gap, tail, clerk_calls, members, least, slack):
    """The rule as a walk over one meeting's turns (i, cluster, subject, answer)."""
    turns = [t for t in turns if t[1] is not None]
    groups, last = [], None
    for t in turns:
        if t[2] is not None:
            if last is None or t[0] - last > max_gap:
                groups.append([])
            groups[-1].append(t)
            last = t[0]
    found, names = [], []
    for g in groups:
        n = collections.Counter(t[1] for t in g)
        clerks = {c for c in n if n[c] >= clerk_calls}
        calls = [t for t in g if t[1] in clerks]
        if len({t[2] for t in calls}) < members:
            continue
        first, end = calls[0][0], calls[-1][0] + tail
        answers = [t for t in turns if first <= t[0] <= end and t[1] not in clerks and t[3]]
        # a call of the next region's group bounds nothing: tails don't reach it
        found += [(first, t[0], t[1], "call", t[2]) for t in calls] + [(first, t[0], t[1], "answer", None) for t in answers]
        bound = []
        for k, c in enumerate(calls):
            stop = calls[k + 1][0] if k + 1 < len(calls) else end + 1
            between = [t for t in answers if c[0] < t[0] < stop]
            if between:
                bound.append((between[0][1], c[2]))
        pairs = set(bound)
        if len(bound) >= least and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and len({t[1] for t in answers}) <= len({t[2] for t in calls}) + slack:
            names += [(first, a, b, bound.count((a, b))) for a, b in pairs]
    return found, names


def test_roll_calls_against_a_walk(spark):
    rng = random.Random(8)
    rows, want, named = [], [], []
    for m in range(60):
        turns, n_voices = [], rng.choice([3, 6, 12])
        for i in range(rng.choice([0, 5, 30, 80])):
            calm = (i // 12) % 2
            call = rng.random() < (0.05 if calm else 0.5)
            cluster = rng.choice(["clerk", "clerk", "chair", None]) if call else f"v{i % n_voices}" if rng.random() < 0.7 else "chair"
            turns.append((i, cluster, rng.randrange(6) if call else None, rng.random() < 0.7 and not call))
        rows += [(m, *t) for t in turns]
        found, names = walk(turns, 4, 3, 2, 3, 2, 2)
        want += [(m, *f) for f in found]
        named += [(m, *n) for n in names]
    df = spark.createDataFrame([*rows, (None, 1, "c", 1, True)], "m int, i int, c string, s int, a boolean")
    found = rollcall.regions(df, "m", "i", "c", "s", "a", max_gap=4, tail=3)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    got = rollcall.accepted(found, "m", "i", "c", "s", least=2, slack=2)
    assert sorted(tuple(r) for r in got.collect()) == sorted(named) and named
    votes = spark.createDataFrame([(r[0], r[1], 0) for r in named], "m int, region int, n_members int")
    assert rollcall.accepted(found, "m", "i", "c", "s", votes, least=2, slack=0).count() == 0
    with pytest.raises(ValueError, match="tail"):
        rollcall.regions(df, "m", "i", "c", "s", "a", max_gap=2, tail=3)


def test_citations(spark):
    w = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    passages = [(1, 10, 0, w(0, 40) + "."), (1, 11, 1, w(40, 80)), (1, 12, 2, "Shared opening of eight words is here now " + w(90, 99)), (1, 13, 3, "shared opening of eight words is here now " + w(100, 109)), (2, 20, 0, w(0, 40)), (1, 14, 4, None), (1, 15, 5, "tiny note"), (1, 16, 6, "tiny note again")]
    given = {
        1: (1, "W5, w6 w7", (0, 10)), 2: (1, w(30, 50), (4, 10)), 3: (1, w(200, 210) + " " + w(41, 60), (6, 11)), 4: (1, "shared opening of eight words is here now xx yy", None), 5: (2, w(3, 20), (0, 20)),
        6: (1, "tiny note", (0, 15)), 7: (1, "", None), 8: (3, "w1 w2", None), 9: (1, None, None), 10: (1, "w1 w", None), 11: (1, "note", (0, 15)),
    }
    df = spark.createDataFrame([(q, d, t) for q, (d, t, _) in given.items()] + [(1, 1, "W5, w6 w7"), (None, 1, "w5")], "quote_id long, document_id long, text string")
    chunks = spark.createDataFrame(passages, "document_id long, chunk_id long, chunk_index int, content string")
    got = {r["quote_id"]: (r["step"], r["chunk_id"]) for r in quotes.cite(df, chunks).collect()}
    assert got == {q: x for q, (_, _, x) in given.items() if x}
    assert quotes.cite(df.limit(0), chunks).count() == 0 and quotes.cite(df, chunks.limit(0)).count() == 0


def test_citations_by_document_and_by_seeds_agree(spark):
    w = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    chunks = spark.createDataFrame([(d, 10 * d + i, i, t) for d in (1, 2, 3) for i, t in enumerate([w(0, 30), w(20, 60), "Same words " + w(5, 14), "same words", None])], "document_id long, chunk_id long, chunk_index int, content string")
    given = [(1, 1, w(22, 50)), (2, 1, w(3, 9)), (3, 1, w(90, 99) + " " + w(40, 50)), (4, 1, "same words"), (4, 1, "Same, words"), (5, 2, w(25, 29)), (6, 2, w(21, 80)), (7, 3, "nothing"), (None, 1, "w1"), (8, None, "w1")]
    df = spark.createDataFrame(given, "quote_id long, document_id long, text string")
    by_document = quotes.cite(df, chunks)
    plan = by_document._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in plan  # the runs of words of passages are not dealt out
    want = sorted(tuple(r) for r in by_document.collect())
    assert len(want) == 6
    for few in (0, 2):
        assert sorted(tuple(r) for r in quotes.cite(df, chunks, few=few).collect()) == want


def test_motions_against_all_pairs(spark):
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(25)]
    spoken = [(rng.randrange(3), k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 8, 15])))) for k in range(80)]
    votes = [(rng.randrange(3), k, " ".join(rng.sample(vocab, rng.choice([1, 4, 8, 12])))) for k in range(60)]
    votes += [(m, 100 + k, t + " extra") for m, k, t in spoken[:20]] + [(0, 300, None), (None, 301, "w1"), (0, 302, "")]
    spoken += [(0, None, "w1"), (0, 400, None)]
    want = {}
    for m, k, t in spoken:
        if m is None or k is None or not t:
            continue
        a, scores = set(t.split()), []
        for n, v, x in votes:
            if n == m and x:
                b = set(x.split())
                scores.append((round(2 * len(a & b) / (len(a) + len(b)), 9), v))
        good = [s for s in scores if s[0] >= 0.6]
        if good and sum(s[0] == max(good)[0] for s in good) == 1:
            want[k] = (max(good)[1], max(good)[0])
    got = rollcall.match_motions(spark.createDataFrame(spoken, "m int, k int, t string"), spark.createDataFrame(votes, "m int, v int, x string"), "m", "k", "t", "v", "x", 0.6)
    assert {r["k"]: (r["v"], r["similarity"]) for r in got.collect()} == want and len(want) > 15
    pairs = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "c"), (1, 5, "c"), (2, 1, "a"), (2, 9, "z")], "m int, v int, c string")
    movers = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, 11), (1, 4, 12), (1, 5, 13), (2, 1, 14), (2, 9, None)], "m int, v int, s int")
    assert sorted(tuple(r) for r in rollcall.attributed(pairs, movers, "m", "v", "c", "s").collect()) == [(1, "a", 10, 2), (1, "b", 11, 1), (2, "a", 14, 1)]


def test_motions_meet_on_words_of_both_sides(spark, monkeypatch):
    """Texts of one wording that differ in a number meet on the number alone, not on words that one side has or all have."""
    n = 150
    spoken = [(1, k, f"well pay 1995 to {k} in status") for k in range(n)]
    votes = [(1, k, f"pay 1995 for customer {k} in status") for k in range(n)]
    intersect = rollcall.F.array_intersect
    seen = spark.sparkContext.accumulator(0)

    def counted(a, b):
        def note(x):
            seen.add(1)
            return x

        return intersect(rollcall.F.udf(note, "array<string>")(a), b)

    monkeypatch.setattr(rollcall.F, "array_intersect", counted)
    got = rollcall.match_motions(spark.createDataFrame(spoken, "m int, k int, t string"), spark.createDataFrame(votes, "m int, v int, x string"), "m", "k", "t", "v", "x", 0.7)
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(k, k) for k in range(n)]
    assert n <= seen.value <= 8 * n  # all pairs are n * n


def test_nearest_of_overlapping_spans(spark):
    rng = random.Random(13)
    at = lambda: float(rng.randrange(40))
    points = [(rng.randrange(3), k, s, s + rng.choice([0.0, 1.0, 5.0])) for k in range(70) for s in [at()]] + [(9, 900, 1.0, 2.0), (None, 901, 1.0, 2.0), (0, 902, None, 2.0)]
    spans = [(rng.randrange(3), f"s{k}", s, s + rng.choice([1.0, 3.0, 30.0])) for k in range(25) for s in [at()]] + [(0, "null", None, 3.0)]
    want = {}
    for g, k, s, e in points:
        mine = [(-max(min(e, b) - max(s, a), 0.0), max(a - e, s - b, 0.0), a, b, x) for h, x, a, b in spans if h == g and None not in (g, a, b, s, e)]
        want[k] = min(mine)[-1] if mine else None
    got = timeline.nearest_of_any(spark.createDataFrame(points, "g int, k int, start double, end double"), spark.createDataFrame(spans, "g int, label string, start double, end double"), "g", "k", "label", 4.0)
    assert {r["k"]: r["label"] for r in got.collect()} == want
