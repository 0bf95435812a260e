"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of a text's words, word pairs and pairs with one word between
(A-Z lowered), each with value 1, and a bias. FTRL-proximal (McMahan et al., "Ad Click Prediction: a View
from the Trenches") has a rate for each coordinate, and L1 leaves most weights at zero, so that the model is
a short list that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import words as W
from quillspark.llm.workers import own

BITS = 20
#: The model is fitted on at most about so many labelled rows, chosen by a hash of doc_id.
MAX_TRAIN_ROWS = 24_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
#: Each row of label 1 counts so many times: they are few, and a bias learnt from the others hides single words.
POSITIVE = 4.0
_U = np.uint64
_MASK = _U((1 << BITS) - 1)


def features(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of feature numbers (1 and up; 0 is the bias) and their row, not yet distinct."""
    h, first = W.hashes(data, offs, W.ALNUM)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    yield (h & _MASK | _U(1)).astype(np.int32), row
    for gap, seed in ((1, 0x9FB21C651E98DF25), (2, 0xD6E8FEB86659FD93)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            pair = W.mix(h[:-gap] * _U(3) + h[gap:] * _U(seed))
            yield (pair & _MASK | _U(1)).astype(np.int32)[same], row[gap:][same]


class Ftrl:
    """One learner. z and n are the sums of FTRL-proximal."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, idx: np.ndarray) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        l1 = np.where(idx == 0, 0.0, L1)  # the bias isn't held back
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, idx: np.ndarray, label: float) -> None:
        w = self.weights(idx)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (POSITIVE if label else 1.0)
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[idx] = n + g * g


def fit(train: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> list[tuple[int, float]]:
    """Weights that aren't zero, as (feature, weight). train has at most about MAX_TRAIN_ROWS rows.

    Rows without a label are left out; null texts are empty ones; repeated rows count each time; ties of doc_id are learnt in
    the order of their features. Without rows the model is empty: all scores are 0.5. The rows are bounded, so one task
    learns from all of them in turn; only their distinct features get there.
    """
    rows = train.where(F.col(label).isNotNull()).select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("x"), F.col(label).cast("double").alias("y"))

    def as_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("toxicity")
        for batch in batches:
            for lo, hi, data, offs in W.pieces(batch.column(1)):
                parts = list(features(data, offs))
                idx, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                key = np.unique(row.astype(np.int64) << BITS | idx)
                at = np.searchsorted(key >> BITS, np.arange(hi - lo + 1))
                idx = (key & (1 << BITS) - 1).astype("<i4")
                cells = pa.array([b"\0\0\0\0" + idx[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), cells, part.column(2)], names=["d", "f", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("toxicity")
        rows, labels, learner = [], [], Ftrl()
        for batch in batches:  # the features stay where Arrow has put them
            rows += [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(1)]
            labels += batch.column(2).to_pylist()
        order = np.random.default_rng(7).permutation(len(rows))
        for _ in range(EPOCHS):
            for i in order:
                learner.learn(rows[i], labels[i])
        idx = np.flatnonzero(learner.n)
        w = learner.weights(idx)
        yield pa.RecordBatch.from_arrays([pa.array(idx[w != 0]), pa.array(w[w != 0])], names=["feature", "weight"])

    sparse = rows.mapInArrow(as_features, "d string, f binary, y double").repartition(1).sortWithinPartitions("d", "f", "y")
    return [(r["feature"], r["weight"]) for r in sparse.mapInArrow(learn, "feature long, weight double").orderBy("feature").collect()]  # 2 ** BITS at most


def score(docs: DataFrame, model: list[tuple[int, float]], text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1 for each whole text; null and empty texts have the bias alone.

    A column of that name is replaced, all others stay, whatever their names and nulls. Rows are independent, so repeated
    rows are scored alike, an empty table gives an empty one, and there is no shuffle.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    at = docs.columns.index(text)
    value = spark.sparkContext.broadcast((np.array([i for i, _ in model], np.int32), np.array([w for _, w in model], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("toxicity")
        idx, w = value.value
        dense = np.zeros(1 << BITS)
        dense[idx] = w
        used = dense != 0
        for batch in batches:
            total = np.full(batch.num_rows, dense[0])
            for lo, hi, data, offs in W.pieces(batch.column(at)):
                keys = []
                for f, row in features(data, offs):
                    live = used[f]
                    keys.append(row[live].astype(np.int64) << BITS | f[live])
                key = np.unique(np.concatenate(keys))
                total[lo:hi] += np.bincount(key >> BITS, dense[key & (1 << BITS) - 1], hi - lo)
            p = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns, p], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), False)]))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: F.Column, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled rows that aren't held out, at most about `most`, chosen by a hash of doc_id; columns doc_id, text, label.

    Their ids are few, so the documents are filtered by a broadcast semi-join and the texts of others never move.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out).groupBy(doc_id).agg(F.max(label).alias("label"))
    n = chosen.count()
    if n > most:
        chosen = chosen.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("train")), F.lit(1 << 60)) < int(most / n * (1 << 60)))
    return docs.select(doc_id, text).join(F.broadcast(chosen), doc_id).dropDuplicates([doc_id, text])


def remainder(doc_id: str, by: int) -> F.Column:
    """crc32 of doc_id as text, mod `by`."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % by


def train(docs: DataFrame, labels: DataFrame) -> list[tuple[int, float]]:
    return fit(training_rows(docs, labels, "toxic", remainder("doc_id", 5) == 0, MAX_TRAIN_ROWS))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
