"""Byte-level BPE encoding and decoding through a sentencepiece model made from the ranks.

The model is written straight from the vocabulary, without training: one piece for each
entry, whose bytes are mapped to one character each, scored by its negative rank, with
identity normalisation. Then sentencepiece's merges are those of the rank file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.chunks import Memo
from quillspark.llm.words import pieces
from quillspark.llm.workers import own

#: Rank files beyond this are refused: the model is broadcast.
MAX_MODEL_BYTES = 64 << 20
#: Bytes of text whose words are numbered together.
PIECE = 4 << 20
DEFAULT = "byte_bpe_multi_50k.tiktoken"


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One field of a protocol buffer."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def byte_chars() -> list[str]:
    """One character for each byte, none of them white space: CJK ideographs from U+4E00 on."""
    return [chr(0x4E00 + b) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, a blank and the rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model: piece ids are the ranks; the unknown piece takes the id after them."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1")
    chars = byte_chars()
    out = []
    for word, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, "".join(chars[b] for b in word)) + _field(2, float(-rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, proto: bytes, words: list[bytes], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.words, self.pattern = words, regex.compile(pattern)
        self.rank = {w: i for i, w in enumerate(words)}
        self.chars = {b: c for b, c in enumerate(byte_chars())}
        self.tokens: dict[str, bytes] = {}
        # the memo's way of cutting texts is right for one pattern; any other goes over whole texts
        self.memo = Memo(lambda texts: [self._encode(x) for x in texts]) if pattern == public_tokenizers.PATTERN else None

    def _encode(self, text: str) -> bytes:
        known = self.tokens
        if len(known) > 1 << 18:
            known.clear()
        return b"".join([known.get(x) or self._token(x) for x in self.pattern.findall(text)])

    def _token(self, token: str) -> bytes:
        raw = token.encode()
        whole = self.rank.get(raw)  # a pre-token that is an entry needs no merges
        ids = [whole] if whole is not None else self.model.encode(raw.decode("latin-1").translate(self.chars))
        out = np.array(ids, "<i4").tobytes()
        if len(token) <= 64:
            self.tokens[token] = out
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin); null is empty."""
        if self.memo is not None:
            return self.memo.batch(column)
        raw = [self._encode(x or "") for x in column.to_pylist()]
        return np.frombuffer(b"".join(raw), "<i4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.words.__getitem__, ids.tolist()))


def _ready(value: tuple[bytes, list[bytes], str]) -> ByteBpe:
    """One encoder in each Python worker."""
    key = hashlib.blake2b(value[0] + b"\0" + value[2].encode()).digest()
    ready = own("bpe")
    if key not in ready:
        ready[key] = ByteBpe(*value)
    return ready[key]


def encode_decode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", ids: str = "token_ids", decoded: str | None = "decoded") -> DataFrame:
    """docs with the ids of each whole text (array of int) and the bytes that they decode to.

    Columns that bear a result's name are replaced; all others stay. Null and empty texts
    have no ids. Rows are independent: there is no shuffle, and a hot source or repeated rows
    don't matter. A text of any length is encoded whole; one batch of rows is in memory at once.
    """
    spark = docs.sparkSession
    ranks = read_ranks(path)
    proto = model_proto(ranks)
    if len(proto) > MAX_MODEL_BYTES:
        raise ValueError(f"the model has {len(proto)} bytes, more than MAX_MODEL_BYTES")
    value = spark.sparkContext.broadcast((proto, sorted(ranks, key=ranks.get), pattern))
    new = [ids] + [decoded] * (decoded is not None)
    keep = [c for c in docs.columns if c not in new]
    at = keep.index(text)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + [T.StructField(c, T.BinaryType(), False) for c in new[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(value.value)
        for whole in batches:
            for lo, hi, _, _ in pieces(whole.column(at), PIECE):
                batch = whole.slice(lo, hi - lo)
                flat, begins = bpe.encode(batch.column(at))
                cols = [pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded is not None:
                    cols.append(pa.array([bpe.decode(flat[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *new])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_decode(docs, public_tokenizers.path(DEFAULT))
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLES: dict[str, str] = {}
