"""Classifiers, the language model and the near-duplicate joins: held-out accuracy and brute force."""

import collections
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lattice_lm, near_dedup, quality, toxicity, vector_dedup


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(make, spark):
    rng = random.Random(3)
    words = [a + b for a in "ta ko mi re lu".split() for b in "na so ti pe du ma".split()]
    docs, labels = [], []
    for k in range(400):
        toxic, junk = k % 5 == 0, k % 4 == 0
        w = prose(rng, rng.randint(20, 120), words).split()
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vile", "scum"])
        docs.append((k, " ".join(x + "###" if junk and rng.random() < 0.8 else x for x in w)))
        labels.append((k, int(not junk), int(toxic)))
    docs += [(1000, None), (1001, ""), (1002, "x")]
    return make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_against_a_plain_loop(corpus, spark):
    docs, labels = corpus
    train = toxicity.training_rows(docs, labels, "toxic", F.lit(False), 10_000)
    rows = sorted((str(r["doc_id"]), sorted(plain_features(r["text"])), float(r["label"])) for r in train.collect())
    got = dict(toxicity.fit(train))
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        l1 = toxicity.L1 if i else 0.0
        return 0.0 if abs(z[i]) <= l1 else ((1 if z[i] > 0 else -1) * l1 - z[i]) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    rows.sort(key=lambda r: (r[0], np.array([0, *r[1]], "<i4").tobytes(), r[2]))
    for _ in range(toxicity.EPOCHS):
        for k in np.random.default_rng(7).permutation(len(rows)):
            _, idx, y = rows[k]
            w = {i: weight(i) for i in [0, *idx]}
            g = (1 / (1 + np.exp(-sum(w.values()))) - y) * (toxicity.POSITIVE if y else 1.0)
            for i in w:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in n if weight(i)}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, list(got.items())).collect()}
    for r in docs.collect():
        p = 1 / (1 + np.exp(-sum(want.get(i, 0.0) for i in {0} | plain_features(r["text"]))))
        assert abs(scored[r["doc_id"]] - p) < 1e-9


def plain_features(text):
    """Hashes of the words, the pairs and the pairs with a word between."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    import pyarrow as pa

    h = [int(toxicity.W.hashes(*toxicity.W.utf8(pa.array([x])), toxicity.W.ALNUM)[0][0]) for x in w]
    mask = (1 << toxicity.BITS) - 1
    mix = lambda x: int(toxicity.W.mix(np.array([x & (2**64 - 1)], np.uint64))[0])
    out = {x & mask | 1 for x in h}
    for gap, seed in ((1, 0x9FB21C651E98DF25), (2, 0xD6E8FEB86659FD93)):
        out |= {mix(h[i] * 3 + h[i + gap] * seed) & mask | 1 for i in range(len(h) - gap)}
    return out


def test_quality_against_a_plain_loop(corpus):
    import zstandard

    docs, labels = corpus
    bad, good, w = quality.train(docs, labels)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    named = docs.withColumn("size", F.lit(5)).withColumn("good", F.lit("g")).withColumn("bad", F.lit(None))
    out = quality.score(named, (bad, good, w))
    assert out.columns == [*named.columns, "score"] == quality.score(named, None).columns
    for r in out.collect():
        x, sums = texts[r["doc_id"]], []
        for raw in (bad, good):
            d = zstandard.ZstdCompressionDict(raw)
            c = zstandard.ZstdCompressor(dict_data=d, level=quality.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
            sums.append(sum(len(c.compress(x[i : i + quality.PIECE])) for i in range(0, len(x), quality.PIECE)))
        diff, sure = 20 * (sums[0] - sums[1]) / max(sum(sums), 1), len(x) / (len(x) + 64)
        z = w[0] + w[1] * diff * sure + w[2] * diff + w[3] * sure + w[4] * np.log(max(sum(sums), 1) / max(2 * len(x), 1)) * sure
        assert abs(r["score"] - 1 / (1 + np.exp(-min(35, max(-35, z))))) < 0.02 and (r["size"], r["good"], r["bad"]) == (5, "g", None)


def check(scored, held_out, labels, label, least):
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0
    rows = scored.where(held_out).join(labels, "doc_id").select("score", label).collect()
    assert len(rows) > 40
    assert np.mean([(r["score"] >= 0.5) == (r[label] == 1) for r in rows]) >= least


def test_toxicity(corpus):
    docs, labels = corpus
    scored = toxicity.score(docs.withColumn("score", F.lit("x")), toxicity.train(docs, labels))
    assert scored.count() == 403
    check(scored, toxicity.remainder("doc_id", 5) == 0, labels, "toxic", 0.9)
    empty = toxicity.fit(docs.limit(0).withColumn("label", F.lit(1)))
    assert empty == [] and toxicity.score(docs.limit(3), empty).select("score").distinct().head()["score"] == 0.5


def test_quality(corpus):
    docs, labels = corpus
    scored = quality.score(docs, quality.train(docs, labels))
    assert scored.count() == 403 and scored.columns == [*docs.columns, "score"]
    check(scored, toxicity.remainder("doc_id", 3) == 1, labels, "quality", 0.9)
    assert quality.train(docs, labels.where("quality = 1")) is None and quality.score(docs, None).where("score = 0.5").count() == 403


def tokens(x):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in x or "")) + [""]


def test_lattice_against_brute_force(spark, make, corpus):
    pieces, w = lattice_lm.vocabulary(P.path(lattice_lm.DEFAULT))
    lattice, score = lattice_lm.Lattice(pieces), dict(zip(pieces, w, strict=True))
    words = [x.encode() for x in ("the", "straße", "日本", "x", "a" * 70, "zzzqqq", "internationalization")]

    def brute(word):
        word, a = b" " + word, [0.0]
        for j in range(1, len(word) + 1):
            a.append(np.logaddexp.reduce([a[i] + score[word[i:j]] for i in range(j) if word[i:j] in score]))
        return a[-1] / np.log(10)

    assert np.allclose(lattice.log10(words, w), [brute(x) for x in words])
    docs = corpus[0].unionByName(make([(1000, "a  B\ta b"), (1003, "x" * 3000)]))
    out = lattice_lm.score(docs, P.path(lattice_lm.DEFAULT), toxicity.remainder("doc_id", 7) == 2, em_rounds=1).collect()
    rows = docs.withColumn("h", toxicity.remainder("doc_id", 7) == 2).collect()
    counts = collections.Counter(t for r in rows if not r["h"] for t in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((r["doc_id"], r["h"], len(tokens(r["text"])), sum(counts[t] > 0 for t in tokens(r["text"])), n, round(sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(r["text"])), 6)) for r in rows)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out)
    assert lattice_lm.score(docs.limit(0), P.path(lattice_lm.DEFAULT), F.lit(False)).count() == 0


def plain_forward(word, weight):
    """(forward sums, backward sums) over the segmentations of a word into pieces, as probabilities."""
    n = len(word)
    alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for j in range(1, n + 1):
        alpha[j] = sum(alpha[i] * weight[word[i:j]] for i in range(j) if word[i:j] in weight)
    for i in range(n - 1, -1, -1):
        beta[i] = sum(weight[word[i:j]] * beta[j] for j in range(i + 1, n + 1) if word[i:j] in weight)
    return alpha, beta


@pytest.mark.parametrize("rounds,window", [(0, 4096), (1, 4096), (3, 5)])
def test_document_score_is_a_plain_recursion(spark, make, monkeypatch, rounds, window):
    monkeypatch.setattr(lattice_lm, "WINDOW", window)
    texts = {0: "the cat the Dog", 1: "a dog", 2: "", 3: None, 4: "an unseen straße the internationalization", 5: "the the"}
    docs, held = make(list(texts.items())), F.col("doc_id") >= 4
    pieces, w = lattice_lm.vocabulary(P.path(lattice_lm.DEFAULT))
    own = dict(zip(pieces, np.exp(w), strict=True))
    train = [t.lower().split() for i, t in texts.items() if i < 4 and t] + [[], []]
    tf = collections.Counter(t for ts in train for t in ts)
    e0 = 1 / (len(pieces) + 1)
    end, weight = e0, {p: x * (1 - e0) for p, x in own.items()}
    for _ in range(rounds):
        uses = collections.Counter()
        for t, c in tf.items():
            word = b" " + t.encode()
            alpha, beta = plain_forward(word, weight)
            for i in range(len(word)):
                for j in range(i + 1, len(word) + 1):
                    if word[i:j] in weight:
                        uses[word[i:j]] += c * alpha[i] * weight[word[i:j]] * beta[j] / alpha[-1]
        total, share = sum(uses.values()) + 4, lattice_lm.PRIOR
        end = share * e0 + (1 - share) * 4 / total
        weight = {p: share * own[p] * (1 - e0) + (1 - share) * uses[p] / total for p in own}
    assert abs(end + sum(weight.values()) - 1) < 1e-9
    for r in lattice_lm.score(docs, P.path(lattice_lm.DEFAULT), held, em_rounds=rounds).collect():
        words = (texts[r["doc_id"]] or "").lower().split()
        want = sum(np.log10(plain_forward(b" " + t.encode(), weight)[0][-1]) for t in words) + np.log10(end)
        assert abs(r["score"] - want) < 1e-9, r


def test_long_words_take_little_memory():
    import tracemalloc

    pieces, w = lattice_lm.vocabulary(P.path(lattice_lm.DEFAULT))
    lattice = lattice_lm.Lattice(pieces)
    word, total = ("abc" * 50_000).encode(), np.zeros(len(pieces))
    tracemalloc.start()
    for _, x in lattice.groups([word]):
        lattice.expected(x, np.ones(1), w, total)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert abs(sum(total[k] * len(p) for k, p in enumerate(pieces)) - len(word) - 1) < 1


def test_fitted_weights_price_held_out_texts_better(corpus):
    docs, held = corpus[0], toxicity.remainder("doc_id", 7) == 2
    scores = [sum(r["score"] for r in lattice_lm.score(docs, P.path(lattice_lm.DEFAULT), held, em_rounds=k).where("held_out").collect()) for k in (0, 1, 3)]
    assert scores == sorted(scores) and scores[2] > 0.8 * scores[0], scores


def brute_components(docs, k, percent):
    sets = {}
    for i, x in docs:
        w = tokens(x)[:-1]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids, comp = sorted(sets), {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("small,few,levels", [(1024, 64, 4), (4, 2, 4), (4, 2, 1)])
def test_near_duplicates(spark, make, monkeypatch, small, few, levels):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "MAX_LEVELS", levels)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4000 if small == 4 else 32 << 20)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    passage = prose(rng, 60, vocab)
    docs = [(k, prose(rng, rng.randint(1, 80), vocab)) for k in range(40)]
    base = prose(rng, 150, vocab).split()
    for k in range(100, 160):  # a large group of near copies
        w = list(base)
        w[rng.randrange(len(w))] = f"e{k}"
        docs.append((k, " ".join(w)))
    docs += [(k, passage + " " + prose(rng, 70, vocab)) for k in range(200, 230)]  # one passage in many texts
    chain = prose(rng, 120, vocab).split()
    for k in range(300, 306):  # each is near the next, the ends are not near
        chain[(k - 300) * 20 % 120] = f"c{k}"
        chain[(k - 300) * 20 % 120 + 7] = f"d{k}"
        docs.append((k, " ".join(chain)))
    docs += [(400, docs[3][1]), (401, docs[3][1].upper()), (402, None), (403, ""), (404, "two words"), (405, " two\nwords "), (406, "one")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(make(docs), 3, 85).collect()}
    assert got == brute_components(docs, 3, 85)
    if small == 1024:
        assert near_dedup.near_duplicates(make([]), 3, 85).count() == 0


def test_near_duplicates_that_share_an_id(spark):
    rng = random.Random(9)
    long = prose(rng, 50, [f"w{i}" for i in range(300)])
    rows = [(1, long), (2, "another text of its own"), (2, long + " x"), (None, long), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(7)).withColumn("id", F.lit("x"))
    got = near_dedup.near_duplicates(df, 3, 85, carry=("text",)).collect()
    want = {(1, long, 1, True), (2, "another text of its own", 2, True), (2, long + " x", 1, False), (None, long, None, True), (3, None, 3, True)}
    assert {(r["doc_id"], r["text"], r["component_id"], r["kept"]) for r in got} == want and len(got) == 5


def test_forest_spans():
    rng = np.random.default_rng(2)
    for n, m in ((30, 20), (40, 200), (5, 1)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        label = rng.integers(0, n, n)
        keep = near_dedup.spanning_forest(a, b, rng.permutation(m), label)
        
        def comp(edges):
            root = label.copy()
            for _ in range(n):
                for x, y in edges:
                    lo, hi = sorted((root[x], root[y]))
                    root[root == hi] = lo
            return root.tolist()

        assert comp(list(zip(a, b, strict=True))) == comp(list(zip(a[keep], b[keep], strict=True)))
        assert len(keep) == len(set(label.tolist())) - len(set(comp(list(zip(a, b, strict=True)))))


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base[rng.integers(0, 12, 150)] + 0.09 * rng.normal(size=(150, 16)), rng.normal(size=(50, 16))])
    rows = [(i, [float(v) for v in r], int(i % 3)) for i, r in enumerate(x)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, [2 * v for v in rows[0][1]], 0), (503, rows[0][1], None), (504, None, 0), (505, [0.0] * 16, 0), (506, [float("nan")] + [1.0] * 15, 0), (507, [None] + [1.0] * 15, 0), (508, [1.0, 2.0], 0), (509, [1.0, 2.0], 0), (510, [], 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("x"))
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    near = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                near[i].add(j)
    comp = {i: rows[i][0] for i in near}
    for _ in range(len(rows)):
        comp = {i: min([comp[i], *[comp[j] for j in near[i]]]) for i in near}
    want = sorted((rows[i][0], len(near[i]), comp[i], rows[i][0] == comp[i]) for i in near)
    for blocks, cells in ((1024, 2048), (16, 20)):
        got = vector_dedup.link(df, block_rows=blocks, cell_rows=cells)
        assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()) == want
    assert vector_dedup.link(df.limit(0)).count() == 0


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.001]), (3, None), (4, [1.0, 0.0]), (4, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 5, 6, 7) for i, v in rows], "vec_id long, embedding array<double>, label int, __n int, v int")
    got = vector_dedup.link(df)
    assert got.columns == [*df.columns, "n_links", "component_id", "kept"]
    assert sorted((r["vec_id"], r["embedding"] or [], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()) == [
        (1, [0.0, 1.0], 1, 1, True), (1, [1.0, 0.0], 2, 1, True), (2, [0.0, 1.001], 1, 1, False), (3, [], 0, 3, True), (4, [1.0, 0.0], 2, 1, False), (4, [1.0, 0.0], 2, 1, False),
    ]
    assert {(r["__n"], r["v"]) for r in got.collect()} == {(6, 7)}
