"""Token ids in patched frame-of-reference files.

A file row holds the ids of a run of whole documents: a payload of blocks of 128 ids and
the positions of the documents in it. In a block the least id is taken off, the rest is
packed at the width that the PERCENTILE-th of its values needs, and values that need more
bits are stored whole in the block's exception list. The payload begins with a directory,
the start of each block, so that any range of ids is read without decoding what is before.
The rows are stored as Parquet: written by tasks through Spark's committer, they survive lost
executors, and any store that Spark writes to can hold them.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quillspark.llm.chunks import Memo
from quillspark.llm.words import pieces
from quillspark.llm.workers import own
from quillspark.session import Kept

BLOCK = 128
PERCENTILE = 90
#: A file row is closed at so many ids, after a whole document.
ROW_IDS = 1 << 18
#: Ranges whose beginnings are broadcast; beyond, they are joined by a shuffle.
MAX_RANGES = 1 << 20
#: Bytes of text whose words are numbered together.
PIECE = 8 << 20
MAX_MODEL_BYTES = 64 << 20
DEFAULT = "byte_bpe_50k.json"
END_ID = 2
_MAGIC = 0x31524650

_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("n_exceptions", "u1"), ("n", "<u2")])


def packed_rows(x: np.ndarray, w: int) -> bytes:
    """The low w bits of each number of rows of BLOCK, one after another, little end first."""
    if w > 16:
        return np.packbits(((x[:, :, None] >> np.arange(w, dtype="<u4")) & 1).astype(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").tobytes()
    # eight numbers are w bytes of two words
    v = (x & np.uint32((1 << w) - 1)).astype("<u8").reshape(-1, 8)
    half = [v[:, k] | v[:, k + 1] << np.uint64(w) | v[:, k + 2] << np.uint64(2 * w) | v[:, k + 3] << np.uint64(3 * w) for k in (0, 4)]
    low, high = half if w == 16 else (half[0] | half[1] << np.uint64(4 * w), half[1] >> np.uint64(64 - 4 * w))
    return np.ascontiguousarray(np.stack([low, high], 1).view(np.uint8)[:, :w]).tobytes()


def unpacked_rows(x: np.ndarray, w: int) -> np.ndarray:
    """Rows of BLOCK numbers from rows of their packed bytes."""
    if w > 16:
        bits = np.unpackbits(x, axis=1, bitorder="little").reshape(len(x), BLOCK, w)
        value = np.zeros((len(x), BLOCK), "<u4")
        for k in range(w):
            value |= bits[:, :, k].astype("<u4") << np.uint32(k)
        return value
    wide = np.zeros((x.size // w, 16), np.uint8)
    wide[:, :w] = x.reshape(-1, w)
    low, high = wide.view("<u8").T
    if w < 16:
        low, high = low & np.uint64((1 << 4 * w) - 1), low >> np.uint64(4 * w) | high << np.uint64(64 - 4 * w)
    mask = np.uint64((1 << w) - 1)
    return np.stack([part >> np.uint64(k * w) & mask for part in (low, high) for k in range(4)], 1).astype("<u4").reshape(len(x), BLOCK)


def encode_blocks(ids: np.ndarray) -> bytes:
    """The payload for ids (unsigned 32-bit).

    magic, number of ids and of blocks, the blocks' starts, the blocks. A block: least value,
    width, number of exceptions, number of ids; packed values, little end first; positions (1 byte)
    and values (4 bytes) of exceptions.
    """
    ids = np.ascontiguousarray(ids, "<u4")
    n, nb = len(ids), -(-len(ids) // BLOCK)
    grid = np.empty(nb * BLOCK, "<u4")
    grid[:n] = ids
    if n:
        grid[n:] = ids[-1]  # the last block is padded, and its true length kept
    grid = grid.reshape(nb, BLOCK)
    least = grid.min(1) if nb else np.zeros(0, "<u4")
    rest = grid - least[:, None]
    at = np.partition(rest, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100] if nb else least
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.uint8)
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    count = over.sum(1)
    head = np.zeros(nb, _HEAD)
    head["least"], head["width"], head["n_exceptions"], head["n"] = least, width, count, BLOCK
    if nb:
        head["n"][-1] = n - (nb - 1) * BLOCK
    packed: list[bytes] = [b""] * nb
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            raw, size = packed_rows(rest[rows], int(w)), BLOCK * int(w) // 8
            for j, r in enumerate(rows.tolist()):
                packed[r] = raw[j * size : (j + 1) * size]
    where, which = np.nonzero(over)[1].astype(np.uint8).tobytes(), rest[over].astype("<u4").tobytes()
    ends = np.zeros(nb + 1, np.int64)
    np.cumsum(count, out=ends[1:])
    heads, e = head.tobytes(), ends.tolist()
    starts = np.zeros(nb, "<u4")
    sizes = _HEAD.itemsize + BLOCK * width.astype(np.int64) // 8 + 5 * count
    base = 12 + 4 * nb
    starts[:] = base + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if nb else 0
    body = b"".join([heads[8 * i : 8 * i + 8] + packed[i] + where[e[i] : e[i + 1]] + which[4 * e[i] : 4 * e[i + 1]] for i in range(nb)])
    return np.array([_MAGIC, n, nb], "<u4").tobytes() + starts.tobytes() + body


def decode_blocks(payload: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Ids lo to hi - 1 of a payload, from the blocks that hold them alone."""
    magic, n, nb = np.frombuffer(payload, "<u4", 3).tolist()
    if magic != _MAGIC:
        raise ValueError("this is no token payload")
    hi = n if hi is None else min(hi, n)
    if hi <= lo:
        return np.zeros(0, "<u4")
    first, last = lo // BLOCK, -(-hi // BLOCK)
    starts = np.frombuffer(payload, "<u4", nb, 12)[first:last].astype(np.int64)
    raw = np.frombuffer(payload, np.uint8)
    head = raw[starts[:, None] + np.arange(8)].copy().view(_HEAD).reshape(-1)
    out = np.zeros((last - first, BLOCK), "<u4")
    width = head["width"].astype(np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            out[rows] = unpacked_rows(raw[starts[rows][:, None] + 8 + np.arange(BLOCK * w // 8)], int(w))
    count = head["n_exceptions"].astype(np.int64)
    for r in np.flatnonzero(count).tolist():
        at, c = int(starts[r] + 8 + BLOCK * width[r] // 8), int(count[r])
        out[r, raw[at : at + c]] = np.frombuffer(payload, "<u4", c, at + c)
    out += head["least"][:, None]
    return out.reshape(-1)[lo - first * BLOCK : hi - first * BLOCK]


class _Encoder:
    """Ids of chunks. A chunk of letters after a blank is one pre-token, so it goes to the tokenizer's model at once."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.tokens = tokenizer, tokenizer.model.tokenize
        # the byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}
        self.blank = self.alphabet[0x20]

    def __call__(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        rest = []
        for c in chunks:
            word = c[1:]
            if c[0] == " " and word.isalpha():
                mapped = self.blank + word if word.isascii() else c.encode().decode("latin-1").translate(self.alphabet)
                out.append(array("i", [t.id for t in self.tokens(mapped)]).tobytes())
            else:
                rest.append(c)
                out.append(None)
        if rest:
            found = iter([array("i", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)])
            out = [next(found) if x is None else x for x in out]
        return out


def _memo(model: bytes) -> Memo:
    """One encoder in each Python worker."""
    key = hashlib.blake2b(model).digest()
    ready = own("token_files")
    if key not in ready:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        t = Tokenizer.from_str(model.decode())
        ready[key] = Memo(_Encoder(t), limit=1 << 20, apart=tuple(x.content for x in t.get_added_tokens_decoder().values()))
    return ready[key]


FILE_SCHEMA = T.StructType([
    T.StructField("range", T.IntegerType(), False),
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("ahead", T.LongType(), False),
    T.StructField("doc_ids", T.ArrayType(T.LongType()), False),
    T.StructField("doc_ends", T.ArrayType(T.LongType(), False), False),
    T.StructField("n_tokens", T.LongType(), False),
    T.StructField("payload", T.BinaryType(), False),
])


def write_token_files(docs: DataFrame, path: str, model_path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> None:
    """Encode every whole text, append end_id, and write the ids in ascending order of doc_id.

    Ids are the tokenizer's own, special tokens that stand in a text included. Rows are dealt out in ranges of doc_id, by
    default spark.sql.shuffle.partitions of them, and sorted inside; (range, seq) orders the file rows. Null texts are
    empty: they have the end id alone. Rows of the same doc_id and repeated rows lie side by side; a null doc_id comes
    first. Texts of any length are encoded whole. Other columns are not read. No rows give an empty table.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"the tokenizer has {len(model)} bytes, more than MAX_MODEL_BYTES")
    value = spark.sparkContext.broadcast(model)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, part, seq, ahead = _memo(value.value), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<i4")
        ids: list[np.ndarray] = []
        names: list = []
        ends: list[int] = []
        n = 0

        def row() -> pa.RecordBatch:
            cells = [[part], [seq], [ahead], [names], [ends], [n], [encode_blocks(np.concatenate(ids).view("<u4"))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=FILE_SCHEMA.names)

        for batch in batches:
            for lo, hi, _, _ in pieces(batch.column(1), PIECE):
                flat, begins = memo.batch(batch.column(1).slice(lo, hi - lo))
                for d, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    ids += [flat[a:b], end]
                    n += b - a + 1
                    names.append(d)
                    ends.append(n)
                    if n >= ROW_IDS:
                        yield row()
                        ids, names, ends, n, seq, ahead = [], [], [], 0, seq + 1, ahead + n
        if names:
            yield row()

    dealt = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").alias("x")).repartitionByRange(ranges, "d").sortWithinPartitions("d")
    dealt.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the files; ids are little-endian unsigned 32-bit.

    start counts the ids of all documents before: a file row keeps the ids before it in its range, and a running sum over
    one row for each range, of which there are as many as writing tasks, gives those before the range.
    With digest, (doc_id, start, n_tokens, ids_crc32) instead.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = files.groupBy("range").agg(F.sum("n_tokens").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = F.broadcast(base) if (files.agg(F.max("range")).head()[0] or 0) < MAX_RANGES else base
    rows = files.join(base, "range").select("doc_ids", "doc_ends", (F.col("ahead") + F.col("base")).alias("file_start"), "payload")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" if digest else READ_SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, ends, at, payload in zip(*(batch.column(k) for k in range(4)), strict=True):
                names, ends, at = names.as_py(), ends.as_py(), at.as_py()
                raw = decode_blocks(payload.as_buffer()).tobytes()
                starts = [0, *ends[:-1]]
                parts = [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
                last = pa.array([zlib.crc32(x) for x in parts], pa.int64()) if digest else pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([at + a for a in starts], pa.int64()), pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return rows.mapInArrow(run, schema)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{Kept(spark, 'token-files').root}/ids"
    write_token_files(docs, path, public_tokenizers.path(DEFAULT))
    return read_token_files(spark, path, digest=True)


QUERIES = {"op5_token_files": op5_token_files}
ORACLES: dict[str, str] = {}
