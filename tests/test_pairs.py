"""All pairs in blocks, and the calibrator over them, against plain loops."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from quillspark.operators import linking, merging, pairs
from quillspark.session import Kept

SCHEMA = "vec_id long, label string, meeting int, condition string, seconds double, v array<double>"


def made(n=90, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 6))
    rows = []
    for k in range(n):
        label = None if k % 17 == 0 else "abcde"[k % 5]
        v = centres[k % 5] + rng.normal(size=6) * 0.8
        rows.append((k, label, k % 4, "xy"[k % 2], float(1 + k % 30), [float(x) for x in v]))
    return [*rows, (200, "a", 1, "x", 1.0, None), (201, "a", 1, "x", 1.0, [1.0, float("nan")]), (202, "b", 1, "y", 2.0, [0.0] * 6), (None, "b", 1, "y", 2.0, [1.0] * 6), (203, "c", 1, "y", 2.0, [1.0, 2.0])]


def cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n else 0.0


def good(rows):
    return [r for r in rows if r[0] is not None and r[5] is not None and len(r[5]) == 6]


@pytest.mark.parametrize("block_rows", [1000, 13])
def test_pairs_in_blocks(spark, block_rows):
    rows = made()
    df, ok = spark.createDataFrame(rows, SCHEMA), good(rows)
    want = sorted((a[0], b[0], a[1], b[1], round(cos(a[5], b[5]), 9)) for a, b in itertools.combinations(ok, 2) if a[1] and b[1] and a[1] != b[1] and cos(a[5], b[5]) >= 0.3)
    with Kept(spark, "t") as kept:
        got = pairs.cross_label_pairs(df, "vec_id", "label", "v", 0.3, kept, block_rows).collect()
        assert sorted((r["a"], r["b"], r["label_a"], r["label_b"], round(r["cosine"], 9)) for r in got) == want and want
        told = {r["label"]: (r["items"], r["links"], round(r["highest"], 9)) for r in pairs.collapse_suspects(df, "vec_id", "label", "v", 0.3, kept, block_rows).collect()}
        ends = [(x[k], x[k + 2], x[4]) for x in want for k in (0, 1)]
        assert told == {b: (len({i for i, x, _ in ends if x == b}), sum(x == b for _, x, _ in ends), max(s for _, x, s in ends if x == b)) for b in {x for _, x, _ in ends}}
        near = {(r["vec_id"], r["place"]): (r["other"], r["cosine"]) for r in pairs.nearest(df, "vec_id", "v", 4, kept, block_rows).collect()}
        for a in ok:
            best = sorted(((-round(cos(a[5], b[5]), 9), b[0]) for b in ok if b[0] != a[0]))[:4]
            assert [(near[a[0], k + 1][0], round(near[a[0], k + 1][1], 8)) for k in range(4)] == [(i, round(-s, 8)) for s, i in best]
        assert pairs.cross_label_pairs(df.limit(0), "vec_id", "label", "v", 0.3, kept).count() == pairs.nearest(df.limit(0), "vec_id", "v", 2, kept).count() == 0


def plain_fit(rows, cohort, top, ridge, without=None):
    """The same regression by a plain Newton loop over a list of pairs."""
    stats = {}
    for r in rows:
        s = sorted(cos(r[5], c) for c in cohort)[-top:]
        stats[r[0]] = (np.mean(s), np.std(s) + 1e-8)
    x, y = [], []
    for a, b in itertools.combinations(rows, 2):
        if a[1] is None or b[1] is None or a[2] == b[2] or without in (a[1], b[1]):
            continue
        s = cos(a[5], b[5])
        (ma, sa), (mb, sb) = stats[a[0]], stats[b[0]]
        x.append([s, ((s - ma) / sa + (s - mb) / sb) / 2, float(a[3] != b[3]), math.log1p(min(a[4], b[4]))])
        y.append(float(a[1] == b[1]))
    x, y = np.array(x), np.array(y)
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-12] = 1
    z = np.column_stack([np.ones(len(x)), (x - mean) / std])
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, held = np.zeros(5), ridge * np.diag([0.0, 1, 1, 1, 1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + held, z.T @ (weight * (y - p)) - held @ w)
    return w, mean, std, len(y), int(y.sum()), stats


@pytest.mark.parametrize("block_rows", [1000, 20])
def test_calibrator_against_a_plain_loop(spark, block_rows):
    rows = [r for r in good(made()) if r[0] < 200]
    cohort = [[float(x) for x in v] for v in np.random.default_rng(1).normal(size=(12, 6))]
    frame = spark.createDataFrame(rows, SCHEMA)
    with Kept(spark, "t") as kept:
        scored = pairs.with_cohort(frame, "v", spark.createDataFrame([(v,) for v in cohort], "c array<double>"), "c", 5)
        units = pairs.calibration_units(scored, "vec_id", "label", "meeting", "condition", "seconds", "v", kept, block_rows)
        fits = pairs.fit_calibrator(units, ridge=1.0, leave_out=["a", "d"])
        for f in fits:
            w, mean, std, n, same, stats = plain_fit(rows, cohort, 5, 1.0, f["label"] or "-")
            assert (f["pairs"], f["same"]) == (n, same)
            assert [f["bias"], *f["weights"]] == pytest.approx(w.tolist(), abs=1e-9)
            assert f["mean"] == pytest.approx(mean.tolist(), abs=1e-9) and f["std"] == pytest.approx(std.tolist(), abs=1e-9)
        got = {r["label"]: tuple(r)[1:] for r in pairs.held_out_outcomes(units, fits, 0.5).collect()}
        for f in fits[1:]:
            want = dict.fromkeys(("correct", "wrong", "ambiguous", "alone"), 0)
            for a in rows:
                if a[1] != f["label"]:
                    continue
                told = set()
                for b in rows:
                    if b[1] is None or a[2] == b[2] or a[0] == b[0]:
                        continue
                    s, (ma, sa), (mb, sb) = cos(a[5], b[5]), stats[a[0]], stats[b[0]]
                    x = np.array([s, ((s - ma) / sa + (s - mb) / sb) / 2, float(a[3] != b[3]), math.log1p(min(a[4], b[4]))])
                    if (x - f["mean"]) / f["std"] @ np.array(f["weights"]) + f["bias"] >= 0.5:
                        told.add(b[1])
                want["alone" if not told else "ambiguous" if len(told) > 1 else "correct" if told == {a[1]} else "wrong"] += 1
            assert got[f["label"]] == tuple(want.values())
        empty = pairs.fit_calibrator(units.limit(0))
        assert empty[0]["pairs"] == 0 and empty[0]["weights"] == [0.0] * 4
    with Kept(spark, "t") as kept, pytest.raises(ValueError, match="cohort"):
        pairs.MAX_COHORT, before = 3, pairs.MAX_COHORT
        try:
            pairs.with_cohort(frame, "v", spark.createDataFrame([(v,) for v in cohort], "c array<double>"), "c", 5)
        finally:
            pairs.MAX_COHORT = before


def test_best_people_in_blocks(spark):
    rows = [(i, label, meeting, v) for i, label, meeting, _, _, v in made() if i is None or i != 203]
    df = spark.createDataFrame([*rows, (300, "zed", 1, [1.0] * 6), (301, "a", None, [0.5] * 6)], "vec_id long, label string, meeting int, v array<double>")
    scores = linking.person_scores(df.where("v is not null and vec_id is not null and size(v) = 6"), "label", "meeting", "v", "vec_id")
    want = {r["vec_id"]: (r["label"], r["score"], r["margin"]) for r in linking.best_with_margin(scores.withColumnRenamed("person", "label"), "vec_id", "label", "score").collect()}
    for persons, block in ((256, 4096), (2, 10)):
        with Kept(spark, "t") as kept:
            got = {r["vec_id"]: tuple(r)[1:] for r in linking.best_people(df, "label", "meeting", "v", "vec_id", kept, persons, block).collect()}
        assert set(got) == set(want) and len(got) > 80
        for i, (label, score, margin) in want.items():
            assert got[i][1:] == pytest.approx((score, margin), abs=2e-9), i
            assert got[i][0] == label or margin < 1e-8


def test_linkage_by_parts_and_at_thresholds(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(120):
        centre = np.zeros(8)
        centre[k % 6] = 4
        rows.append((k, k % 2, k % 9, [float(x) for x in centre + rng.normal(size=8)]))
    df = spark.createDataFrame(rows, "id long, g int, meeting int, v array<double>")
    steps = [0.3, 0.6, 0.8]
    whole = {t: {(r["id"], r["node"]) for r in linking.complete_linkage(df, "g", "id", "v", t, "meeting").collect()} for t in steps}
    with Kept(spark, "t") as kept:
        for given in (None, kept):
            got = linking.linkage_sweep(df, "g", "id", "v", steps, "meeting", given).collect()
            assert {t: {(r["id"], r["node"]) for r in got if r["threshold"] == t} for t in steps} == whole
        parts = {r["id"]: r["part"] for r in linking.threshold_parts(df, "g", "id", "v", 0.6, kept, "meeting", block_rows=17).collect()}
        near = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and a[2] != b[2] and cos(a[3], b[3]) >= 0.6}
        reach = {k: k for k in range(120)}
        for _ in range(120):
            for a, b in near:
                reach[a] = reach[b] = min(reach[a], reach[b])
        assert parts == {k: r for k, r in reach.items() if any(k in e for e in near)}
        # labels as clusters of the sweep
        truth = spark.createDataFrame([(k, k % 6 if k % 13 else None, k % 4 < 2) for k in range(120)], "id long, label int, cond boolean")
        points = {r["threshold"]: r for r in linking.sweep_metrics(linking.linkage_sweep(df, "g", "id", "v", steps, "meeting").join(truth, "id"), "node", "label", "cond").collect()}
        for t in steps:
            node = dict(whole[t])
            pairs_of = [(node[a] == node[b], a % 6 == b % 6, (a % 4 < 2) != (b % 4 < 2)) for a, b in itertools.combinations([k for k in range(120) if k % 13], 2)]
            for name, every in (("f1", pairs_of), ("across_f1", [x for x in pairs_of if x[2]])):
                a, b, c = sum(x[0] for x in every), sum(x[1] for x in every), sum(x[0] and x[1] for x in every)
                p, r = (c / a if a else 1.0), (c / b if b else 1.0)
                assert points[t][name] == pytest.approx(2 * p * r / (p + r) if p + r else 0.0, abs=1e-6)
    monkeypatch.setattr(linking, "MAX_GROUP", 5)
    with pytest.raises(Exception, match="at most"):
        linking.complete_linkage(df, "g", "id", "v", 0.3).collect()


def test_blocks_and_tiles_are_bounded(spark, monkeypatch):
    assert pairs.block_count(0) == 1 and pairs.block_count(2048) == 2 and pairs.block_count(10_256) == pairs.BLOCKS - 5
    for n in (1 << 15, 1 << 19):  # rows move BLOCKS times at most, until a block is full
        assert pairs.block_count(n) == pairs.BLOCKS
    assert pairs.block_count(1 << 20) == (1 << 20) // pairs.MAX_BLOCK_ROWS
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6))
    x[40:60] = x[:20]  # ties go by id
    table = lambda i, j: pa.table({"i": [i] * 90, "j": [j] * 90, "block": [k % 2 for k in range(90)] if i != j else [0] * 90, "id": list(range(90)), "v": x.tolist()})
    for i, j in ((0, 0), (0, 1)):
        want = [sorted(zip(*(z.tolist() for z in pairs.block_pairs(table(i, j), 0.3)[:2]), strict=True))]
        monkeypatch.setattr(pairs, "TILE", 7)
        sizes = [len(s) for _, _, s in pairs.tiles(table(i, j), -1.0)]
        assert max(sizes) <= 49 and sum(sizes) == (90 * 89 // 2 if i == j else 45 * 45)
        want.append(sorted(zip(*(z.tolist() for z in pairs.block_pairs(table(i, j), 0.3)[:2]), strict=True)))
        assert want[0] == want[1]
        monkeypatch.undo()


def greedy_nodes(x, codes, steps):
    """The next merge is the best of all pairs; nodes as they are when the best falls below each step."""
    s = np.round(x @ x.T, 12)
    if codes is not None:
        s[codes[:, None] == codes[None, :]] = -np.inf
    np.fill_diagonal(s, -np.inf)
    node, out, todo = np.arange(len(x)), [], list(steps)
    while todo:
        i, j = divmod(int(s.argmax()), len(x))
        while todo and s[i, j] < todo[0] - 1e-13:
            out.append(node.copy())
            todo.pop(0)
        i, j = min(i, j), max(i, j)
        least = np.minimum(s[i], s[j])
        least[[i, j]] = -np.inf
        s[i] = s[:, i] = least
        s[j] = s[:, j] = -np.inf
        node[node == j] = i
    return np.stack(out, 1)


@pytest.mark.parametrize("tile", [512, 7])
def test_merging_by_rounds_is_the_greedy_course(monkeypatch, tile):
    rng = np.random.default_rng(tile)
    monkeypatch.setattr(merging, "TILE", tile)
    for k in range(60):
        n = int(rng.integers(1, 70))
        x = rng.normal(size=(n, int(rng.integers(2, 7))))
        x = x[rng.integers(0, 1 + n // 5, n)] if k % 3 == 0 else np.rint(x) if k % 3 == 1 else x  # equal pairs tie
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        codes = None if k % 4 == 0 else rng.integers(0, 1 + k % 8, n)
        monkeypatch.setattr(merging, "LEAST_NODES", 1 + k % 16)
        assert (merging.merged(x, codes, [0.8, 0.5, 0.2]) == greedy_nodes(x, codes, [0.8, 0.5, 0.2])).all()


def test_linkage_of_groups_beyond_the_old_limit(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5200, 8))
    rows = [(k, 0, k % 9, v) for k, v in enumerate(x.tolist())] + [(9000, None, 1, [1.0] * 8), (9001, 0, 1, None), (9002, 0, 1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, g int, meeting int, v array<double>").cache()
    with Kept(spark, "t") as kept:
        got = {(r["id"], r["threshold"]): r["node"] for r in linking.linkage_sweep(df, "g", "id", "v", [0.9, 0.6], "meeting", kept).collect()}
        want = merging.merged(x / np.linalg.norm(x, axis=1, keepdims=True), np.arange(5200) % 9, [0.9, 0.6])
        assert got == {(k, t): int(want[k, s]) for k in range(5200) for s, t in enumerate([0.9, 0.6])} | {(k, t): k for k in (9000, 9001, 9002) for t in (0.9, 0.6)}
        few = df.where("id < 60 or id >= 9000")
        whole = {tuple(r) for r in linking.linkage_sweep(few, "g", "id", "v", [0.9, 0.6], "meeting", kept).collect()}
        monkeypatch.setattr(linking, "MAX_PART", 58)  # the group is split, its parts are no larger
        assert {tuple(r) for r in linking.linkage_sweep(few, "g", "id", "v", [0.9, 0.6], "meeting", kept).collect()} == whole


def test_the_calibrator_takes_few_passes_over_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 6))
    rows = [(k, "abcde"[k % 5], k % 4, "xy"[k % 2], float(1 + k % 30), (centres[k % 5] + rng.normal(size=6) * 1.5).astype(np.float32).tolist()) for k in range(300)]
    cohort = rng.normal(size=(12, 6)).tolist()
    passes, slopes = [], pairs._slopes

    def counted(units, *rest):
        passes.append(units.where("i <> j").isEmpty())
        return slopes(units, *rest)

    monkeypatch.setattr(pairs, "_slopes", counted)
    monkeypatch.setattr(pairs, "PAIR_TILE", 11)
    with Kept(spark, "t") as kept:
        scored = pairs.with_cohort(spark.createDataFrame(rows, SCHEMA.replace("v array<double>", "v array<float>")), "v", spark.createDataFrame([(v,) for v in cohort], "c array<double>"), "c", 5)
        units = pairs.calibration_units(scored, "vec_id", "label", "meeting", "condition", "seconds", "v", kept, 100)
        assert units.schema["v"].dataType.simpleString() == "array<float>"
        for f in pairs.fit_calibrator(units, leave_out=["a", "nobody"]):
            w, mean, std, n, same, _ = plain_fit(rows, cohort, 5, 1.0, f["label"] or "-")
            assert (f["pairs"], f["same"]) == (n, same) and [f["bias"], *f["weights"]] == pytest.approx(w.tolist(), abs=1e-9)
            assert f["mean"] == pytest.approx(mean.tolist(), abs=1e-9) and f["std"] == pytest.approx(std.tolist(), abs=1e-9)
    assert passes.count(False) <= 4 and passes.count(True) > 0


def test_odds_of_near_fits_lose_no_bit():
    rng = np.random.default_rng(7)
    z = rng.normal(size=(5, 400)) * 3
    for apart in (0.0, 1e-9, 1e-4, 1e-2, 0.1, 3.0, 400.0):
        w = rng.normal(size=(1, 5)) + np.vstack([np.zeros((1, 5)), rng.normal(size=(4, 5)) * apart])
        with np.errstate(over="ignore"):
            want = np.exp(-w @ z)
        assert np.allclose(pairs.odds(w, z), want, rtol=1e-13, atol=0)
        assert np.allclose(pairs.odds(w[:1], z), want[:1], rtol=1e-13, atol=0)
