"""Importance resampling towards a target's words: array-scored weights, Gumbel keys, a bracketed cutoff.

A pass over the texts turns each document into an array of hashed word buckets. The arrays give the buckets' counts, the
counts of corpus and target give each bucket's gain, and the gains, an array of fixed length, score the arrays again.
Who is drawn follows from one cutoff in the order of noisy scores: a quantile sketch proposes a bracket around it, exact
counts outside show whether it lies inside, and the bracket alone is sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.words import ALNUM, LOWER, pieces, spans
from quillspark.operators.ordering import fresh, ranked
from quillspark.session import Kept

#: Words of more bytes are hashed one by one, others all together byte by byte.
LONG_WORD = 48
#: Accuracy of the quantile sketch: the rank is off by at most one in so many rows.
SKETCH = 2_000
MAX_BUCKETS = 1 << 20


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & np.uint32(1), (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


_TABLE = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of data[start:end] of each word."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(np.minimum(size, LONG_WORD + 1).astype(np.uint8), kind="stable")[::-1]
    by_size = size[order]
    n_long = int(np.searchsorted(-by_size, -LONG_WORD, "left"))
    crc, at = out[order], starts[order]
    for j in range(int(by_size[n_long]) if n_long < len(order) else 0):
        hi = int(np.searchsorted(-by_size, -j, "left"))  # words of more than j bytes
        now = crc[n_long:hi]
        crc[n_long:hi] = _TABLE[(now ^ data[at[n_long:hi] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    crc = ~crc
    raw = data.tobytes() if n_long else b""
    for k in range(n_long):
        crc[k] = zlib.crc32(raw[at[k] : at[k] + by_size[k]])
    out[order] = crc
    return out


def run_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to `longest` words of each row, and where each row's begin."""
    single = (crc32_of(data, starts, ends) % np.uint32(buckets)).astype("<i4")
    if longest == 1:
        return single, first
    out, begins = [], [0]
    raw = data.tobytes()
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = [single[lo:hi]]
        words = [raw[a:b] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
        for n in range(2, longest + 1):
            own.append(np.array([zlib.crc32(b" ".join(words[k : k + n])) % buckets for k in range(len(words) - n + 1)], "<i4"))
        out += own
        begins.append(begins[-1] + sum(map(len, own)))
    return (np.concatenate(out) if out else single), np.array(begins)


def bucket_arrays(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000, out: str = "buckets") -> DataFrame:
    """docs without its text, with n_words (long) and the buckets (binary, little-endian 32-bit) of all its word runs.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` once A-Z is lowered. A run of up to `longest` words is joined by one
    blank and falls into the bucket of its crc32; repeats count. Null and empty texts have none. Rows are independent.
    """
    keep = [c for c in docs.columns if c not in (text, "n_words", out)]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("n_words", "long", False).add(out, "binary", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi, data, offs in pieces(whole.column(len(keep))):
                starts, ends, first = spans(data, offs, ALNUM)
                found, begins = run_buckets(LOWER[data], starts, ends, first, longest, buckets)
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((begins * 4).astype("<i8")), pa.py_buffer(found)]).cast(pa.binary())
                cols = [c.slice(lo, hi - lo) for c in whole.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first), pa.int64()), cells], names=[f.name for f in schema])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def bucket_counts(arrays: DataFrame, column: str, buckets: int) -> np.ndarray:
    """How often each bucket occurs: every task adds its own up first; `buckets` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            _, offs, data = batch.column(0).cast(pa.large_binary()).buffers()
            if data is not None:
                at = np.frombuffer(offs, np.int64)[batch.column(0).offset :]
                total += np.bincount(np.frombuffer(data, "<i4")[at[0] // 4 : at[batch.num_rows] // 4], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for b, n in arrays.select(F.col(f"`{column}`")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of the B buckets."""
    b = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (float(corpus.sum()) + b) / ((s + 1) * (float(target.sum()) + b)))).astype(np.int64)


def score_arrays(arrays: DataFrame, gain: np.ndarray, column: str = "buckets") -> DataFrame:
    """arrays without its buckets, with n_features and weight, the sum of its buckets' gains (long; no features, 0)."""
    value = arrays.sparkSession.sparkContext.broadcast(gain)  # MAX_BUCKETS numbers at most
    keep = [c for c in arrays.columns if c not in (column, "n_features", "weight")]
    schema = arrays.select(*[F.col(f"`{c}`") for c in keep]).schema.add("n_features", "long", False).add("weight", "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(len(keep)).cast(pa.large_binary())
            at = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1] // 4 if len(cells) else np.zeros(1, np.int64)
            flat = np.frombuffer(cells.buffers()[2] or b"", "<i4")[at[0] : at[-1]]
            total = np.concatenate([[0], np.cumsum(value.value[flat])])
            own = total[at[1:] - at[0]] - total[at[:-1] - at[0]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(at), pa.int64()), pa.array(own, pa.int64())], names=[f.name for f in schema])

    return arrays.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`")).mapInArrow(run, schema)


def gumbel(seed: int, key: Column) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256('seed:key'); a null key is the empty string."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def bracket(scores: DataFrame, score: str, k: int, n: int) -> tuple[int, int, int]:
    """(low, high, rows above high) with the k-th highest of n scores between low and high, both included.

    A quantile sketch proposes both ends; exact counts outside show whether the k-th lies between, else the end that is
    wrong moves out, twice as far each time, in the end to the extreme score.
    """
    share, off = 1 - k / n, 2 / SKETCH
    while True:
        ends = [max(0.0, share - off), min(1.0, share + off)]
        low, high = scores.agg(F.percentile_approx(score, ends, SKETCH)).head()[0]
        extreme = scores.agg(F.min(score), F.max(score)).head()
        low, high = (extreme[0] if ends[0] == 0 else low), (extreme[1] if ends[1] == 1 else high)
        above, below = scores.agg(F.count_if(F.col(score) > high), F.count_if(F.col(score) < low)).head()
        if above < k <= n - below:
            return low, high, above
        off *= 2


def draw_highest(rows: DataFrame, kept: Kept, k: int, n: int, eligible: Column, score: str = "score", ident: str = "doc_id", out: str = "rank") -> DataFrame:
    """rows with the rank (long) of each of the k highest scores among the n eligible rows; null for all others.

    Ties go to the smaller ident, a null one first; among rows that share both, which is drawn is left open, but not how
    many. The bracket's rows alone are sorted to find the cutoff, and the drawn rows to number them, both in ranges.
    """
    nothing = rows.withColumn(out, F.lit(None).cast("long"))
    if k < 1:
        return nothing
    able = rows.where(eligible)
    order = [F.col(f"`{score}`").desc(), F.col(f"`{ident}`").asc_nulls_first()]
    low, high, above = bracket(able, score, k, n)
    inside = ranked(able.where(F.col(score).between(low, high)).select(score, ident), order, kept)
    last = inside.where(F.col("rank") == k - above).head()
    same = F.col(f"`{ident}`").isNull() if last[ident] is None else F.col(f"`{ident}`").isNull() | (F.col(f"`{ident}`") <= F.lit(last[ident]))
    chosen = F.coalesce(eligible & ((F.col(score) > last[score]) | (F.col(score) == last[score]) & same), F.lit(False))
    numbered = ranked(rows.where(chosen), order, kept, out=out)  # equal rows at the cutoff may be more than are drawn
    numbered = numbered.withColumn(out, F.when(F.col(out) <= k, F.col(out)))
    return numbered.unionByName(nothing.where(~chosen))


def resample(docs: DataFrame, target: DataFrame, kept: Kept, percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, ident: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(ident, n_features, weight, score, rank) of every document; rank is that among the drawn, else null.

    Null and empty texts have weight 0 and are scored by their noise alone; they are drawn only if min_words is 0. Repeated
    rows count each time in the corpus and can be drawn each; a null ident is scored as the empty string. An empty target
    or corpus counts nothing. Other columns are not read. No rows give no rows. A text of any length is one array.
    """
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError("buckets must be between 1 and MAX_BUCKETS")
    arrays = kept.keep(bucket_arrays(docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("text")), longest=longest, buckets=buckets), "arrays", "zstd")
    wanted = bucket_arrays(target.select(F.col(f"`{target_text}`").alias("text")), longest=longest, buckets=buckets)
    gain = gains(bucket_counts(arrays, "buckets", buckets), bucket_counts(wanted, "buckets", buckets))
    scored = kept.keep(score_arrays(arrays, gain).withColumn("score", F.col("weight") + gumbel(seed, F.col("id"))), "scored")
    kept.drop(arrays)
    able = F.col("n_words") >= min_words
    n = scored.where(able).count()
    out = draw_highest(scored, kept, percent * n // 100, n, able, ident="id")
    return out.select(F.col("id").alias(ident), "n_features", "weight", "score", "rank")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target, Kept(spark, "resampling"))


QUERIES = {"op13_resampling": op13_resampling}

_WORDS = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
#: One step of crc32 by its polynomial, eight times for each byte value.
_BIT = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x"

ORACLES = {
    "op13_resampling": f"""
WITH RECURSIVE step AS (SELECT i, 0 AS k, i AS x FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, {_BIT} FROM step WHERE k < 8),
tab AS (SELECT list(x ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
f AS (SELECT doc_id, w, count(*) AS n FROM d GROUP BY ALL),
g AS (SELECT w, count(*) AS n FROM b GROUP BY ALL),
v AS (SELECT w, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(w) + 1), lambda j: CAST('0x' || hex(encode(w))[2 * j - 1 : 2 * j] AS BIGINT))), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])) AS c
      FROM (SELECT w FROM f UNION SELECT w FROM g), tab),
h AS (SELECT w, (4294967295 - c) % 10000 AS bucket FROM v),
s AS (SELECT bucket, sum(n) AS n FROM f JOIN h USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM g JOIN h USING (w) GROUP BY bucket),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT sum(n) FROM s) + 10000)) / (CAST(s.n + 1 AS DOUBLE) * (coalesce((SELECT sum(n) FROM t), 0) + 10000)))) AS BIGINT) AS gain
         FROM s LEFT JOIN t USING (bucket)),
own AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM f JOIN h USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
           FROM documents LEFT JOIN own USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= 10 * n // 100 THEN rank END AS BIGINT) AS rank FROM scored LEFT JOIN able USING (doc_id)
""",
}
