"""Language-model scores from a lattice of subwords.

The pieces of an existing vocabulary, and single bytes, make a lattice over every word (a blank before it); the
probability of a word is the sum over all segmentations, by a forward recursion in log space. Pieces don't go over
white space, so a text's log probability is the sum over its words and its end, which is a piece of its own. The
vocabulary's scores weight the segmentations; expectation-maximisation over all words of the training texts then moves
the pieces' weights to the corpus, in every round PRIOR parts of the vocabulary's own weights to 1 - PRIOR of the
expected uses. Nothing but the pieces' weights is learnt: a word the corpus holds is priced like any other.

Texts are packed into blocks of many documents, with the distinct words of the block and for each document the
numbers and counts of its words. What is shuffled is one row for each distinct word of a block, not for each of a
document: it joins the corpus counts and the words' probabilities, which are worked out once for each distinct word.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.toxicity import remainder
from quillspark.session import Kept

DEFAULT = "piece_bpe_32k.model"
#: A block is closed at so many distinct words or bytes of text. The larger, the fewer rows are shuffled for the same texts.
BLOCK_WORDS, BLOCK_BYTES = 1 << 18, 16 << 20
#: Words that the lattice takes at a time, so that those of one length are many.
BATCH_WORDS = 1 << 16
EM_ROUNDS = 3
#: Share of the vocabulary's own weights in the fitted ones.
PRIOR = 0.1
#: Bytes of a word whose arcs are in memory at once.
WINDOW = 4096
MAX_PIECES = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(99)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_R, _RI = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_NEG = -1e300


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces as bytes, log weights). 0x20 stands for the mark of a word's beginning; the 256 single bytes come first.

    A unigram vocabulary's scores are log probabilities. Those of a BPE vocabulary are negative ranks, which are read as
    a rank-frequency law: weight 1 / (2 + rank). Pieces that no word can hold (a mark inside, control pieces) are left out.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores = [bytes([b]) for b in range(256)], [np.nan] * 256
    at = {p: i for i, p in enumerate(pieces)}
    listed = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ranks = min(s for _, s in listed) < -1000
    for p, s in listed:
        raw = p.replace("▁", " ").encode()
        if b" " in raw[1:] or not raw:
            continue
        s = -np.log(2 - s) if ranks else s
        if raw in at:
            scores[at[raw]] = s
        else:
            at[raw] = len(pieces)
            pieces.append(raw)
            scores.append(s)
    w = np.array(scores)
    w = np.where(np.isnan(w), np.nanmin(w) - 2, w)
    if len(w) > MAX_PIECES:
        raise ValueError("the vocabulary is too large to broadcast")
    return pieces, w - np.log(np.exp(w).sum())


class Lattice:
    """All segmentations of words into pieces."""

    def __init__(self, pieces: list[bytes]):
        self.longest = max(map(len, pieces))
        by_len: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_len.setdefault(len(p), []).append(i)
        self.tables, self.maybe = {}, np.zeros(1 << 20, bool)
        for n, ids in by_len.items():
            x = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, n)
            key = self._prefix(x)[:, n]
            order = np.argsort(key)
            self.tables[n] = (key[order], np.array(ids)[order])
            self.maybe[W.mix(key) >> _U(44)] = True

    @staticmethod
    def _prefix(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        power = np.full(n, _R, np.uint64)
        if n:
            power[0] = 1
        total = np.zeros((len(x), n + 1), np.uint64)
        np.cumsum(_BYTE[x] * np.multiply.accumulate(power), axis=1, out=total[:, 1:])
        return total

    def arcs(self, x: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(i, j, rows, pieces) of the substrings of words of one length that are pieces, by j."""
        prefix, n, out = self._prefix(x), x.shape[1], []
        back = np.full(n, _RI, np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        for size, (keys, ids) in self.tables.items():
            if size > n:
                continue
            # all starts at once; most substrings are ruled out by one look into a table of bits
            key = ((prefix[:, size:] - prefix[:, : n + 1 - size]) * back[: n + 1 - size]).T
            start, rows = np.nonzero(self.maybe[W.mix(key) >> _U(44)])
            key = key[start, rows]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[at] == key
            start, rows, found = start[same], rows[same], ids[at[same]]
            cuts = np.searchsorted(start, np.arange(n + 2 - size))
            out += [(i, i + size, rows[a:b], found[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        return sorted(out, key=lambda arc: (arc[1], arc[0]))

    @staticmethod
    def _add(total: np.ndarray, j: int, rows: np.ndarray, value: np.ndarray) -> None:
        total[rows, j] = np.logaddexp(total[rows, j], value)

    def ending(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The arcs by their end, those of WINDOW ends at a time."""
        for s in range(0, x.shape[1], WINDOW):
            lo = max(0, s + 1 - self.longest)
            yield from ((lo + i, lo + j, rows, ids) for i, j, rows, ids in self.arcs(x[:, lo : s + WINDOW]) if lo + j > s)

    def beginning(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The arcs from the last beginning to the first, those of WINDOW beginnings at a time."""
        for s in reversed(range(0, x.shape[1], WINDOW)):
            arcs = self.arcs(x[:, s : s + WINDOW + self.longest - 1])
            yield from ((s + i, s + j, rows, ids) for i, j, rows, ids in sorted(arcs, key=lambda arc: -arc[0]) if i < WINDOW)

    def forward(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        alpha = np.full((len(x), x.shape[1] + 1), _NEG)
        alpha[:, 0] = 0
        for i, j, rows, ids in self.ending(x):
            self._add(alpha, j, rows, alpha[rows, i] + weights[ids])
        return alpha

    def expected(self, x: np.ndarray, counts: np.ndarray, weights: np.ndarray, total: np.ndarray) -> None:
        """Add the expected number of uses of each piece."""
        alpha = self.forward(x, weights)
        beta = np.full(alpha.shape, _NEG)
        beta[:, -1] = 0
        whole = alpha[:, -1]
        for i, j, rows, ids in self.beginning(x):
            on = weights[ids] + beta[rows, j]
            self._add(beta, i, rows, on)
            total += np.bincount(ids, np.exp(alpha[rows, i] + on - whole[rows]) * counts[rows], len(total))

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, bytes as a matrix) of words of one length, the mark of the beginning before each."""
        sizes = np.array([len(w) + 1 for w in words])
        order = np.argsort(sizes, kind="stable")
        lo = 0
        while lo < len(order):
            n = int(sizes[order[lo]])
            hi = min(int(np.searchsorted(sizes[order], n, "right")), lo + max(1, (1 << 19) // n))
            at = order[lo:hi]
            yield at, np.frombuffer(b"".join([b" " + words[k] for k in at]), np.uint8).reshape(-1, n)
            lo = hi

    def log10(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words))
        for at, x in self.groups(words):
            out[at] = self.forward(x, weights)[:, -1] / np.log(10)
        return out


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about BATCH_WORDS rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BATCH_WORDS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_READY: dict[str, tuple] = {}


def _ready(value: tuple) -> tuple:
    key = value[0]
    if key not in _READY:
        _READY.clear()
        _READY[key] = (Lattice(value[1]), value[1])
    return _READY[key]


BLOCKS = "block long, doc_ids array<long>, held array<boolean>, words array<string>, train_tf array<long>, ends binary, idx binary, tf binary"


def pack(docs: DataFrame, doc_id: str, text: str, held_out) -> DataFrame:
    """Blocks of documents: their distinct words with counts over training texts, and each document's words and counts."""

    def row(block: int, names: list, held: list, texts: list[np.ndarray], vocab: dict[bytes, int]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts])
        pair, tf = np.unique(np.repeat(np.arange(len(texts)) << 32, sizes) + np.concatenate(texts), return_counts=True)
        idx, doc = pair & (1 << 32) - 1, pair >> 32
        train = np.bincount(idx, tf * ~np.array(held)[doc], len(vocab)).astype(np.int64) if len(vocab) else np.zeros(0, np.int64)
        ends = np.searchsorted(doc, np.arange(1, len(texts) + 1)).astype("<i4")
        words = pa.array(list(vocab), pa.binary()).cast(pa.string())
        short = "<u2" if len(vocab) < 1 << 16 else "<u4"
        cells = [pa.array([block], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.ListArray.from_arrays([0, len(words)], words), pa.ListArray.from_arrays([0, len(words)], pa.array(train)), *[pa.array([x.tobytes()], pa.binary()) for x in (ends, idx.astype(short), tf.astype("<u4"))]]
        return pa.RecordBatch.from_arrays(cells, names=[c.split(" ")[0] for c in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def fresh() -> dict:
            words: dict = defaultdict()
            words.default_factory = words.__len__  # the next number
            return words

        block = TaskContext.get().partitionId() << 24  # numbers in a row are packed well
        names, held, texts, vocab, size = [], [], [], fresh(), 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                for d, x, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    raw = (x or "").encode().translate(_LOWER).split()
                    texts.append(np.fromiter(map(vocab.__getitem__, raw), np.int32, len(raw)))
                    names.append(d)
                    held.append(h)
                    size += len(x or "")
                    if len(vocab) >= BLOCK_WORDS or size >= BLOCK_BYTES:
                        yield row(block, names, held, texts, vocab)
                        names, held, texts, vocab, size, block = [], [], [], fresh(), 0, block + 1
        if names:
            yield row(block, names, held, texts, vocab)

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("x"), held_out.alias("h")).mapInArrow(run, BLOCKS)


def score(docs: DataFrame, model_path: str, held_out, doc_id: str = "doc_id", text: str = "text", em_rounds: int = EM_ROUNDS) -> DataFrame:
    """For each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out is a boolean column; rows where it is true or null are never learnt from. Null and empty texts have one token, their end.
    Repeated rows and ids are rows of their own. No rows give no rows; with no training rows the vocabulary's own weights
    are used and all counts are 0. Texts and words of any length are taken whole: of a word the arcs of WINDOW bytes are in
    memory at once, and two numbers for each byte. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    kept = Kept(spark, "lattice-lm")
    blocks = kept.keep(pack(docs, doc_id, text, F.coalesce(held_out, F.lit(True))), "blocks", compression="zstd")
    seen = blocks.select("block", F.posexplode(F.arrays_zip("words", "train_tf")).alias("pos", "w")).select("block", "pos", F.col("w.words").alias("word"), F.col("w.train_tf").alias("tf"))
    counts = kept.keep(seen.groupBy("word").agg(F.sum("tf").alias("c")), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).head()
    n_docs = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).head()[0] or 0
    n_words = sums["v"] or 0
    n, v = (sums["n"] or 0) + n_docs, n_words + (n_docs > 0)

    pieces, weights = vocabulary(model_path)
    key = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((key, pieces))
    own = np.exp(weights)
    end = 1 / (len(pieces) + 1)  # the vocabulary says nothing of a text's end
    weights = weights + np.log1p(-end)
    for _ in range(em_rounds if n_words else 0):
        now = spark.sparkContext.broadcast(weights)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            lattice, _ = _ready(shared.value)
            total = np.zeros(len(now.value))
            for batch in gathered(batches):
                tf = np.asarray(batch.column(1), np.float64)
                for at, x in lattice.groups([w.encode() for w in batch.column(0).to_pylist()]):
                    lattice.expected(x, tf[at], now.value, total)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "uses"])

        uses = np.zeros(len(pieces))
        for r in counts.where("c > 0").select("word", "c").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).orderBy("piece").collect():
            uses[r["piece"]] = r["uses"]  # MAX_PIECES rows at most
        fitted = uses.sum() + n_docs
        end = PRIOR / (len(pieces) + 1) + (1 - PRIOR) * n_docs / fitted
        weights = np.log(PRIOR * own * (1 - 1 / (len(pieces) + 1)) + (1 - PRIOR) * uses / fitted)
    log_end = np.log(end)
    final = spark.sparkContext.broadcast(weights)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, _ = _ready(shared.value)
        for batch in gathered(batches):
            lp = lattice.log10([w.encode() for w in batch.column(0).to_pylist()], final.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp)], names=["word", "c", "lp"])

    priced = kept.keep(counts.mapInArrow(price, "word string, c long, lp double"), "priced")
    kept.drop(counts)
    refs = seen.select("word", F.col("block").alias("of"), "pos").join(priced.hint("shuffle_merge"), "word").select("of", "pos", "c", "lp")
    bottom = float(n + v + 1)
    end_base, end_lp = float(np.log10((n_docs + 1) / bottom)), float(log_end / np.log(10))
    known_end = n_docs > 0

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        pos = np.asarray(right.column("pos"))
        c, lp = np.zeros(len(pos)), np.zeros(len(pos))
        c[pos], lp[pos] = np.asarray(right.column("c")), np.asarray(right.column("lp"))
        base = np.log10((c + 1) / bottom)
        for k in range(left.num_rows):
            names, held = left.column("doc_ids")[k].as_py(), left.column("held")[k].as_py()
            ends, tf = (np.frombuffer(left.column(x)[k].as_py(), t) for x, t in (("ends", "<i4"), ("tf", "<u4")))
            idx = left.column("idx")[k].as_py()
            idx = np.frombuffer(idx, "<u2" if len(idx) == 2 * len(tf) else "<u4")
            doc, tf = np.repeat(np.arange(len(names)), np.diff(ends, prepend=0)), tf.astype(np.float64)
            total = lambda x: np.bincount(doc, x, len(names))
            out.append(pa.table({
                "doc_id": pa.array(names, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array((total(tf) + 1).astype(np.int64)),
                "n_known": pa.array((total(tf * (c[idx] > 0)) + known_end).astype(np.int64)), "train_tokens": pa.array(np.full(len(names), n, np.int64)),
                "base_score": pa.array(total(tf * base[idx]) + end_base), "score": pa.array(total(tf * lp[idx]) + end_lp),
            }))
        return pa.concat_tables(out) if out else empty

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{x: pa.array([], pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")}, **{x: pa.array([], pa.float64()) for x in ("base_score", "score")}})
    return blocks.select("block", "doc_ids", "held", "ends", "idx", "tf").groupBy("block").cogroup(refs.groupBy("of")).applyInArrow(finish, kinds)


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, public_tokenizers.path(DEFAULT), remainder("doc_id", 7) == 2)


QUERIES = {"op8_lattice_lm": op8_lattice_lm}
ORACLES: dict[str, str] = {}
