"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is cut into pieces of PIECE bytes, so that what a piece has in common with a dictionary counts
as much in a long text as in a short one; every piece is compressed with either dictionary. The sum of
the sizes with the bad dictionary less that with the good one, over their sum, is the normalised
difference. A logistic curve, fitted on labelled rows that are in neither dictionary, makes it a probability.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.toxicity import remainder, training_rows

#: The model is fitted on at most about so many labelled rows, chosen by a hash of doc_id.
MAX_TRAIN_ROWS = 16_000
#: Of these, whole texts of at most about so many rows of each label make its dictionary, of at most so many bytes.
DICT_ROWS = 3_000
DICT_BYTES = 96 << 10
PIECE = 2048
LEVEL = 3

Model = tuple[bytes, bytes, tuple[float, ...]]
SIZES = ["__bad", "__good", "__size"]


def cut(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


class Sizes:
    """Compressed sizes of texts with the two dictionaries (bad, good)."""

    def __init__(self, bad: bytes, good: bytes):
        self.packers = []
        for raw in (bad, good):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: bytes) -> tuple[int, int]:
        bad, good = self.packers
        pieces = cut(text)
        return sum(len(bad.compress(p)) for p in pieces), sum(len(good.compress(p)) for p in pieces)


def inputs(bad: np.ndarray, good: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the curve is fitted over: a constant, the normalised difference, which for short texts is less sure,
    and how far the text was compressed at all: text that repeats itself gains little from either dictionary."""
    diff = (bad - good) / np.maximum(bad + good, 1)
    sure = size / (size + 64.0)
    ratio = np.log(np.maximum(bad + good, 1) / np.maximum(2 * size, 1))
    return np.stack([np.ones(len(diff)), 20 * diff * sure, 20 * diff, sure, ratio * sure], 1)


def dictionary(pieces: list[bytes]) -> bytes:
    """A zstandard dictionary of pieces; where zstandard can't train one of them, what they end with."""
    raw = b"".join(pieces)
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, len(raw) // 8)), pieces, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return raw[-DICT_BYTES:] or b"\0" * 8


def fit(train: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> Model | None:
    """(bad dictionary, good dictionary, curve); None where either label is missing.

    Half of the rows, by a hash of doc_id, at most about DICT_ROWS of each label, make the dictionaries, each label in a task
    of its own; the curve is fitted over the sizes of the other half, which come back as three numbers a row. Rows without
    a label are left out, null texts are empty, repeated rows count each time, ties of the order go by doc_id and text.
    """
    rows = train.where(F.col(label).isNotNull()).select(F.col(doc_id).cast("string").alias("d"), F.coalesce(text, F.lit("")).alias("x"), (F.col(label) > 0).cast("int").alias("y"))
    half = F.pmod(F.xxhash64("d", F.lit("half")), F.lit(2))
    n = {r["y"]: r["n"] for r in rows.where(half == 0).groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = reduce(lambda a, y: F.when(F.col("y") == y, int(min(1.0, DICT_ROWS / n[y]) * (1 << 60))).otherwise(a), sorted(n), F.lit(0))
    some = rows.where(half == 0).where(F.pmod(F.xxhash64("d", F.lit("dictionary")), F.lit(1 << 60)) < share)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.assign(o=[zlib.crc32(f"o{d}".encode()) for d in group["d"]]).sort_values(["o", "d", "x"])["x"]
        return pd.DataFrame({"y": [int(group["y"].iloc[0])], "b": [dictionary([p for x in ordered for p in cut(x.encode())])]})

    made = {r["y"]: bytes(r["b"]) for r in some.groupBy("y").applyInPandas(build, "y int, b binary").collect()}
    if len(made) < 2:
        return None
    bad, good = made[0], made[1]
    measured = measure(rows.where(half == 1), bad, good, "x").select("d", "y", *[F.col(c).alias(c[2:]) for c in SIZES]).collect()  # MAX_TRAIN_ROWS small rows
    if not measured:
        return bad, good, (0.0, 1.0, 0.0, 0.0, 0.0)
    measured.sort(key=tuple)
    y = np.array([r["y"] for r in measured], float)
    x = inputs(*(np.array([r[c] for r in measured], float) for c in ("bad", "good", "size")))
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) ** 0.5
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method with a little ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (weight * (p - y)) + 0.1 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return bad, good, tuple(w.tolist())


def measure(docs: DataFrame, bad: bytes, good: bytes, text: str = "text") -> DataFrame:
    """docs with the whole text's compressed sizes (__bad, __good) and its bytes (__size); null is empty."""
    spark = docs.sparkSession
    new = SIZES
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    at = docs.columns.index(text)
    value = spark.sparkContext.broadcast((bad, good))
    key = hashlib.blake2b(bad + b"\0" + good).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _READY.get(key)
        if sizes is None:
            _READY.clear()
            sizes = _READY[key] = Sizes(*value.value)
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(at).to_pylist()]
            found = [sizes(x) for x in raw]
            cols = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([len(x) for x in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *new])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType(), False) for c in new]]))


_READY: dict[bytes, Sizes] = {}


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of good quality for each whole text.

    Empty and null texts compress to nothing and get the curve's value at 0; without a model all get 0.5. Texts of any
    length are compressed whole; repeated rows are scored alike; an empty table gives an empty one. Columns __bad, __good,
    __size and `out` are replaced, others stay. No shuffle.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (*SIZES, out)]
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias(out))
    one, two, (a, b, c, d, e) = model
    found = measure(docs.select(*keep), one, two, text)
    bad, good, size = (F.col(c) for c in SIZES)
    diff = 20 * (bad - good) / F.greatest(bad + good, F.lit(1))
    sure = size / (size + 64.0)
    ratio = F.log(F.greatest(bad + good, F.lit(1)) / F.greatest(2 * size, F.lit(1)))
    z = F.lit(a) + F.lit(b) * diff * sure + F.lit(c) * diff + F.lit(d) * sure + F.lit(e) * ratio * sure
    return found.select(*keep, (1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))))).alias(out))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    return fit(training_rows(docs, labels, "quality", remainder("doc_id", 3) == 1, MAX_TRAIN_ROWS))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
