"""Conversation repair, mixing and resampling against brute force and their stated properties."""

import collections
import glob
import hashlib
import heapq
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import conversation_repair, mixing, resampling
from quillspark.llm import words as W
from quillspark.session import Kept

SF = "/root/testdata/sf0.001"
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


@pytest.mark.parametrize("module", [conversation_repair, resampling])
def test_queries_against_sql(spark, module):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, sql in module.ORACLES.items():
        got, want = module.QUERIES[name](spark, SF), c.sql(sql)
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        assert collections.Counter(tuple(r[x] for x in cols) for r in got.collect()) == collections.Counter(tuple(r[want.columns.index(x)] for x in cols) for r in want.fetchall())


# conversations


def faults_of(rows):
    """rows: (role, text) in order; the first fault of each."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(BLANK)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by uniform-cost search over edits, cheapest first, then by audit."""
    faults, form = faults_of(rows), re.compile(r"(s?(ua)+)?")
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, made = heapq.heappop(heap)
        roles = "".join(r[:1] or "?" for r, _ in made)
        if at == len(rows) and form.fullmatch(roles):
            return cost, audit, made
        if (at, roles[-1:], roles == "s", not roles) in done or not re.match(r"s?(ua)*u?$", roles):
            continue
        done.add((at, roles[-1:], roles == "s", not roles))
        for r in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", at, (*made, (r, ""))))
        if at < len(rows):
            (role, text), fault = rows[at], faults[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, made))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*made, (role, text))))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, (*made, (r, text))))


def summary_of(rows):
    """rows: (turn, role, text) with Nones; the expected summary."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    plain = [(r, x) for _, r, x in rows]
    turns = {t for t, _, _ in rows if t is not None}
    faults = collections.Counter(faults_of(plain))
    cost, audit, made = cheapest(plain)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain[:-1], plain[1:], strict=True))
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha)


ROWS = "conv_id long, turn long, role string, text string, cost string"


def test_repair_against_search(spark):
    rng = random.Random(4)
    convs = {}
    for k in range(150):
        n = rng.choice([0, 1, 2, 3, 5, 8, 12])
        convs[k] = [(rng.choice([None, *range(-1, n + 3)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b!", "c", "", " ", "d?\n ", "e. f", None, f"own {rng.random()}."])) for _ in range(n)]
    convs[200] = [(t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(6)]
    convs[None] = [(1, "system", "s."), (2, "user", "q?")]
    rows = [(c, *r, "clash") for c, x in convs.items() for r in x]
    got = conversation_repair.repair_summary(spark.createDataFrame(rows, ROWS)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {c: summary_of(x) for c, x in convs.items() if x}
    assert len(got) == sum(bool(x) for x in convs.values())
    # edited rows give the same audits and texts
    turns = conversation_repair.repaired_turns(spark.createDataFrame(rows, ROWS)).where("conv_id = 200").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in turns] == [("K", ("user", "assistant")[t % 2], f"turn {t}.") for t in range(6)]
    for r in conversation_repair.repaired_turns(spark.createDataFrame(rows, ROWS)).where("edit = 'I'").collect():
        assert r["before"] is None and r["turn"] is None and r["text"] == "" and r["role"] in ("user", "assistant")
    assert conversation_repair.repair_summary(spark.createDataFrame([], ROWS)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in (*range(12), None) for t in (*range(9), None)] + [(50, 1, None, None)]
    code = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    want = collections.Counter()
    for c, t, r, x in rows:
        r, x = r or " ", x or " "
        k = code(c, t)
        want[(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x, k != 0)] += 2 if k == 3 else 1
    got = conversation_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert collections.Counter(tuple(r) for r in got.select("conv_id", "turn", "role", "text", "present").collect()) == want
    gone = next(c for c in range(10_000) if code(c, 1) == 0)
    got = conversation_repair.repair_summary(conversation_repair.damage(spark.createDataFrame([(gone, 1, "user", "x.")], "conv_id long, turn long, role string, text string")), present="present").collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_conversation_over_many_batches(spark):
    """State is carried from batch to batch, both ways."""
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"text {t}" + "." * (t % 11 != 0)) for t in range(700)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
        got = conversation_repair.repair_summary(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert tuple(got[0])[1:] == summary_of([r[1:] for r in rows])


# mixing


def wanted_targets(sizes, weights=(5, 2, 1), most=3):
    total, open_, out = sum(sizes.values()), dict(sizes), {}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * open_.pop(s)
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 500), st.floats(0.01, 0.99), st.integers(1, 500), st.floats(0.01, 0.99), st.floats(0, 0.999))
def test_meeting_keeps_words_and_settles_one(m, p, n, q, u):
    a, b = mixing.meet((m, p), (n, q), u)
    assert 0 <= a <= 1 and 0 <= b <= 1 and (a in (0, 1) or b in (0, 1))
    assert m * a + n * b == pytest.approx(m * p + n * q, abs=1e-9 * (m + n))


def test_meeting_keeps_fractions_on_average():
    us = (np.arange(4000) + 0.5) / 4000
    for x, y in (((3, 0.2), (5, 0.7)), ((10, 0.9), (1, 0.5)), ((4, 0.5), (4, 0.5))):
        got = np.array([mixing.meet(x, y, u) for u in us]).mean(0)
        assert got == pytest.approx([x[1], y[1]], abs=2e-3)


def test_mix(spark):
    rng = random.Random(6)
    docs = []
    for k in range(3000):
        source = rng.choice(["hot"] * 12 + ["b", "B", "é", "tiny", None, ""])
        if source == "tiny" and k % 40:
            source = "hot"
        docs.append((k, " ".join("w" * rng.choice([1, 3]) for _ in range(rng.choice([0, 1, 5, 30, 200]))), source, 1))
    docs += [(9000, None, "b", 1), (9001, " \n", "void", 1), (None, "x y", "b", 1), (5000, "same row", "b", 1), (5000, "same row", "b", 1), (5001, "long " * 5000, "b", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, size long")
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    sizes, largest = collections.Counter(), collections.Counter()
    for _, x, s, _ in docs:
        sizes[s] += size(x)
        largest[s] = max(largest[s], size(x))
    want = wanted_targets(dict(sizes))
    own = {(d, size(x)): s for d, x, s, _ in docs}
    runs = []
    for leaf_rows, fan_in in ((1024, 256), (20, 2), (20, 2)):
        with Kept(spark, "mix") as kept:
            got = mixing.mix(frame, kept, leaf_rows=leaf_rows, fan_in=fan_in).collect()
        runs.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["copies"]) for r in got))
        assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((d, size(x)) for d, x, _, _ in docs)
        taken = collections.Counter()
        for r in got:
            s = own[(r["doc_id"], r["size"])]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9)
            rate = r["target"] / r["source_size"] if r["source_size"] else 0
            assert 0 <= r["copies"] <= 3 and (r["size"] == 0 and r["copies"] == 0 or math.floor(rate) <= r["copies"] <= math.ceil(rate))
            taken[s] += r["copies"] * r["size"]
        for s, x in want.items():
            assert abs(taken[s] - x) <= largest[s] / 2 + 1e-6
    assert runs[1] == runs[2] and runs[0] != runs[1]
    with Kept(spark, "mix") as kept:
        assert mixing.mix(frame.limit(0), kept).count() == 0
        # however the input is split
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["copies"]) for r in mixing.mix(frame.repartition(7), kept, leaf_rows=20, fan_in=2).collect()) == runs[1]


# resampling


def test_crc_of_words():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = np.sort(rng.integers(0, 4700, 200))
    ends = starts + rng.choice([0, 1, 2, 7, 47, 48, 49, 50, 300], 200)
    assert resampling.crc32_of(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    none = np.zeros(0, np.int64)
    assert len(resampling.crc32_of(data, none, none)) == 0


def brute_resample(docs, bench, percent, min_words, longest, buckets):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in x or ""))

    def features(x):
        w = words(x)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, x in docs:
        s.update(features(x))
    for _, x in bench:
        t.update(features(x))
    sums = sum(s.values()), sum(t.values())
    rows = []
    for d, x in docs:
        f = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (sums[0] + buckets) / ((s[b] + 1) * (sums[1] + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = collections.defaultdict(list)
    for k, r in enumerate(able[: percent * len(able) // 100]):
        ranks[tuple(r)].append(k + 1)
    return sorted((*map(str, r[:4]), str(ranks[tuple(r)].pop() if ranks[tuple(r)] else None)) for r in rows)


@pytest.mark.parametrize("setting", [(10, 20, 1, 10_000), (50, 0, 2, 97), (100, 5, 1, 1), (3, 20, 3, 5000)])
def test_resample_against_brute_force(spark, setting):
    rng = random.Random(7)
    vocab = ["Ab", "cd,", "éÀ", "x9", "日本", "y" * 70] + [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [(k, text(rng.choice([0, 5, 19, 20, 60, 300]))) for k in range(400)] + [(None, text(30)), (900, None), (901, "")]
    docs += [(950, "the very same words " * 10)] * 90  # repeated rows around any cutoff
    bench = [(k, text(25)) for k in range(10)] + [(50, None)]
    percent, min_words, longest, buckets = setting
    with Kept(spark, "resample") as kept:
        frame = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, score long")
        out = resampling.resample(frame, spark.createDataFrame(bench, "item_id long, text string"), kept, percent, min_words, longest, buckets)
        got = sorted(tuple(map(str, r)) for r in out.collect())
        assert [r[:4] for r in got] == [r[:4] for r in brute_resample(docs, bench, *setting)]
        want = brute_resample(docs, bench, *setting)
        rank = lambda rows: sorted((int(r[4]), r[0]) for r in rows if r[4] != "None")
        assert rank(got) == rank(want)
        assert resampling.resample(frame.limit(0), spark.createDataFrame(bench, "item_id long, text string"), kept).count() == 0
        assert resampling.resample(frame, spark.createDataFrame([], "item_id long, text string"), kept).count() == len(docs)


def test_bracket_widens(spark):
    """Where a sketch is far off, exact counts move the ends until the k-th lies between."""
    rows = spark.range(5000).select((F.col("id") % 7).alias("score"))
    scores = sorted((k % 7 for k in range(5000)), reverse=True)
    for k in (1, 13, 714, 715, 2500, 4999, 5000):
        low, high, above = resampling.bracket(rows, "score", k, 5000)
        assert low <= scores[k - 1] <= high and above == sum(s > high for s in scores) < k


def test_pieces_are_small_and_whole():
    """What a task works on at once is half a megabyte of text, unless one text has more; no row is lost."""
    texts = pa.array(["ab c " * (k % 700) for k in range(2000)] + ["x" * (1 << 20), None])
    parts = list(W.pieces(texts))
    assert [p[0] for p in parts] == [0, *(p[1] for p in parts[:-1])] and parts[-1][1] == len(texts)
    assert all(len(data) <= 1 << 19 or hi - lo == 1 for lo, hi, data, _ in parts)
    assert b"".join(data.tobytes() for _, _, data, _ in parts).decode() == "".join(x or "" for x in texts.to_pylist())
