"""The pipeline's stages by their effect, each against a plain version of its rule."""

import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from quillspark.llm import bpe


def test_stages(spark, make, tmp_path):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [(k, text(60)) for k in range(80)]
    docs += [(100 + k, docs[k][1] + " tail") for k in range(5)] + [(200, docs[7][1]), (201, None), (202, "")]
    docs += [(300 + k, text(40) + " scum vile " + text(10)) for k in range(40)]
    item = text(25)
    docs += [(400, text(20) + " " + item + " " + text(20)), (401, text(30) + " mail a.b@example.com now")]
    make(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(80)] + [(300 + k, 1, 1) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = now.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append({r["doc_id"] for r in now.collect()})
        assert k == len(corpus_pipeline.STAGES) - 1 or now.columns == columns
    clean = set(range(80)) | {201, 202, 401}
    assert clean | {100, 200, 400} <= seen[0] and not seen[0] & set(range(330, 340))
    assert clean | {400} <= seen[1] and not seen[1] & {100, 101, 102, 103, 104, 200}
    assert clean <= seen[2] and 400 not in seen[2] and seen[3] == seen[2] == seen[4]
    masked = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "out3")).collect()}
    assert "<email>" in masked[401]["text"] and masked[401]["n_chars"] == len(masked[401]["text"]) and masked[5]["text"] == docs[5][1]
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.DEFAULT)), special_tokens={})
    for r in now.collect():
        assert list(r["token_ids"]) == want.encode_ordinary(masked[r["doc_id"]]["text"] or "") and r["n_tokens"] == len(r["token_ids"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_last_stage_decodes(spark, make, tmp_path):
    texts = {1: "two words é😀", 2: "", 3: None}
    for r in corpus_pipeline.encoded(spark, make(list(texts.items())), str(tmp_path)).collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_stages_without_labels_and_with_repeated_rows(spark, make, tmp_path):
    rng = random.Random(5)
    text = " ".join(rng.choice([f"w{i}" for i in range(200)]) for _ in range(60))
    rows = [(1, text), (1, text), (1, text + " end"), (2, text + " tail"), (3, None), (3, None), (4, ""), (None, text), (5, "a text of its own words")]
    docs = make(rows)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.not_toxic(spark, docs, str(tmp_path)).count() == len(rows)
    for given, want in ((docs, {None: 1, 1: 1, 3: 2, 4: 1, 5: 1}), (docs.limit(0), {})):
        kept = corpus_pipeline.one_of_each(spark, given, str(tmp_path)).collect()
        assert {i: sum(r["doc_id"] == i for r in kept) for i in {r["doc_id"] for r in kept}} == want
        for name, stage in corpus_pipeline.STAGES[2:]:
            assert stage(spark, given, str(tmp_path)).count() == given.count(), name


def test_clashing_columns(spark, make, tmp_path):
    spark.createDataFrame([(k, 1, k % 2) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "ten words " * 6)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(k, f"text {k} of {'vile' if k % 2 else 'kind'} words") for k in range(20)], "doc_id long, text string")
    for c in ("score", "spans", "hit_runs", "kept", "label", "id", "node"):
        docs = docs.withColumn(c, docs["doc_id"] * 3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert all(r["score"] == r["node"] == 3 * r["doc_id"] for r in out.collect()), name


def test_unrelated_documents_of_one_id_stay(spark, make, tmp_path):
    rng = random.Random(11)
    words = lambda p: " ".join(f"{p}{rng.randrange(500)}" for _ in range(50))
    a, b, c = words("a"), words("b"), words("c")
    rows = [(2, a), (2, b), (3, a), (3, c), (4, c), (4, c), (5, b + " tail"), (2, a)]
    kept = corpus_pipeline.one_of_each(spark, make(rows), str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(2, a), (2, b), (3, c)])


def test_workers_keep_one_operators_tables():
    from quillspark.llm import bpe, workers

    bpe._ready((bpe.model_proto({bytes([b]): b for b in range(256)}), [bytes([b]) for b in range(256)], "."))
    assert len(workers.own("bpe")) == 1
    assert workers.own("near_dedup") == {} and set(workers._HELD) == {"near_dedup"}
    assert workers.own("bpe") == {}
