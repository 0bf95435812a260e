"""Benchmark decontamination: Wu-Manber search for windows of test items in documents.

The alphabet is words. Words of the test items have numbers, all other words share the number 0,
so a document is a row of numbers and a pattern a short row of numbers. For patterns of one length m
(all windows of 10 words; shorter items by their own length):
- a block is a pair of words (one word where m is 1). A table keyed by the block gives the shift: how far the
  window may move on because no pattern has this block nearer to its end; blocks in no pattern shift by m - 1;
- where the shift is 0, the bucket of the block, the suffix of the patterns in it, lists the candidates;
- candidates are compared word by word.
A batch is cut into lanes that overlap by m - 1 words, and all lanes are stepped at once with numpy.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import workers
from quillspark.operators.ordering import fresh
from quillspark.session import Kept

WINDOW = 10
#: Test items are searched in blocks of so many UTF-8 bytes of text; each block is broadcast by itself.
BLOCK_BYTES = 16 << 20
LANE = 512

_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(rb"[^\x20]+")


def split_words(text: str | None) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` as UTF-8; null has none."""
    return text.encode().translate(_KEEP).split(b" ") if text else []


class WuManber:
    """Search for patterns of one length over word numbers below n_words."""

    def __init__(self, patterns: np.ndarray, n_words: int):
        self.patterns, self.m, self.n_words = patterns, patterns.shape[1], n_words
        m, self.b = self.m, min(2, self.m)
        key = self._block(patterns[:, m - self.b : m] if self.b > 1 else patterns[:, -1:])
        # every block of every pattern with its distance from the end; the least distance counts
        blocks = np.concatenate([self._block(patterns[:, j : j + self.b]) for j in range(m - self.b + 1)])
        away = np.repeat(np.arange(m - self.b, -1, -1), len(patterns))
        order = np.lexsort((away, blocks))
        blocks, away = blocks[order], away[order]
        first = np.ones(len(blocks), bool)
        first[1:] = blocks[1:] != blocks[:-1]
        self.blocks, self.shift = blocks[first], away[first]
        by = np.argsort(key, kind="stable")
        self.order, key = by, key[by]
        self.bucket, self.begin = np.unique(key, return_index=True)
        self.end = np.append(self.begin[1:], len(key))

    def _block(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return x[:, 0] * self.n_words + x[:, 1] if x.shape[1] == 2 else x[:, 0]

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, start) of every occurrence; words below 0 are in no pattern."""
        m, n = self.m, len(words)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.arange(0, n - m + 1, LANE)
        stop = np.minimum(begin + LANE, n - m + 1)  # window starts of this lane end here
        at = begin.copy()
        safe = words.astype(np.int64)
        while len(at):
            last = safe[at + m - 1]
            if self.b == 2:
                prev = safe[at + m - 2]
                block = np.where((last > 0) & (prev > 0), prev * self.n_words + last, -1)
            else:
                block = np.where(last > 0, last, -1)
            k = np.minimum(np.searchsorted(self.blocks, block), len(self.blocks) - 1)
            known = self.blocks[k] == block
            # an unknown block ends m - 1 words on at the least; a word of no pattern lets it pass wholly
            step = np.where(known, self.shift[k], np.where(last > 0, m - self.b + 1, m))
            hit = known & (step == 0)
            if hit.any():
                self._compare(safe, at[hit], block[hit], found)
                step = np.maximum(step, 1)
            at = at + step
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _compare(self, words: np.ndarray, at: np.ndarray, block: np.ndarray, found: list) -> None:
        k = np.searchsorted(self.bucket, block)
        left = np.arange(len(at))
        place = self.begin[k]
        end = self.end[k]
        while len(left):  # one candidate of each bucket at a time
            p = self.order[place[left]]
            same = np.ones(len(left), bool)
            for j in range(self.m):  # most differ at once
                live = np.flatnonzero(same)
                if not len(live):
                    break
                same[live] = words[at[left[live]] + j] == self.patterns[p[live], j]
            if same.any():
                found.append((p[same], at[left[same]]))
            place[left] += 1
            left = left[place[left] < end[left]]


class Searcher:
    """Patterns of a block of test items, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocab: dict[bytes, int] = {}
        by: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in split_words(text) if w]
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                by[m][tuple(words[i : i + m])].add(item)
        self.tables = []
        for _, found in sorted(by.items()):
            self.tables.append((WuManber(np.array(list(found), np.int64), len(self.vocab) + 1), list(found.values())))

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """(number of words, hit runs of words, test items) of each text."""
        get, rows, counts = self.vocab.get, [], []
        for x in texts:
            words = [w for w in split_words(x) if w]
            rows.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            rows.append(np.full(1, -1, np.int32))  # no pattern goes over the end of a text
            counts.append(len(words))
        words = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        firsts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.array(counts, np.int64) + 1, out=firsts[1:])
        runs: dict[int, list] = defaultdict(list)
        items: dict[int, set] = defaultdict(set)
        for table, owners in self.tables:
            which, at = table.find(words)
            doc = np.searchsorted(firsts, at, "right") - 1
            for p, a, d in zip(which.tolist(), at.tolist(), doc.tolist(), strict=True):
                runs[d].append((a - int(firsts[d]), a - int(firsts[d]) + table.m))
                items[d] |= owners[p]
        for d, n in enumerate(counts):
            yield n, merge(runs.get(d, [])), items.get(d, set())


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of runs (start, end), in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_runs (array of (start, end), word positions), items (ids of test items as strings, sorted).

    Columns of docs that bear these names are replaced; all others stay. Null or empty texts have no words and no
    hits; items without words match nothing; repeated items count by their ids; a null id counts as the string
    'null'. No items: no hits; no documents, no rows; repeated rows have equal results. Texts of any length are read whole.
    The test items are searched in blocks of at most about block_bytes. One block is searched in a map over the rows alone.
    Of several, the first writes the rows under the shared folder with numbers of their own, each further one passes over
    their texts and writes its hits, and a join adds these up: one broadcast and one searcher are alive at a time, however
    many blocks there are.
    """
    spark = docs.sparkSession
    new = ["n_words", "hit_runs", "items"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    total = items.agg(F.sum(F.octet_length(item_text) + 16)).head()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    item = F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i")

    def block(k: int) -> list[tuple[str, str]]:
        # the windows of one item stay in one block
        part = items.where(F.pmod(F.xxhash64(F.col(item_id).cast("string"), item_text), F.lit(blocks)) == k) if blocks > 1 else items
        return [(r[0], r[1]) for r in part.where(F.col(item_text).isNotNull()).select(item, item_text).collect()]

    if blocks == 1:
        return searched(docs, text, block(0), window)[0]
    row, kept = fresh(docs, "row"), Kept(spark, "decontamination")
    first, value = searched(docs.withColumn(row, F.monotonically_increasing_id()), text, block(0), window)
    rows = kept.keep(first, "rows", "zstd")
    value.destroy()
    hits: list[DataFrame] = []
    for k in range(1, blocks):
        found, value = searched(rows.select(F.col(row).alias("row"), F.col(f"`{text}`").alias("text")), "text", block(k), window)
        hits.append(kept.keep(found.where(F.size("items") > 0).select("row", "hit_runs", "items"), f"hits{k}"))
        value.destroy()
    every = reduce(DataFrame.unionByName, hits).groupBy("row").agg(F.flatten(F.collect_list("hit_runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("more"))
    out = rows.join(every, rows[row] == every["row"], "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    runs = F.array_sort(F.concat("hit_runs", F.coalesce("runs", none)))

    def joined(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), longer).otherwise(F.concat(acc, F.array(x)))

    ids = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more", F.expr("cast(array() as array<string>)")))))
    merged = F.when(F.col("runs").isNull(), F.col("hit_runs")).otherwise(F.aggregate(runs, none, joined))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "n_words", merged.alias("hit_runs"), ids.alias("items"))


def searched(rows: DataFrame, text: str, listed: list[tuple[str, str]], window: int) -> tuple[DataFrame, Broadcast]:
    """rows with n_words, hit_runs and items of one block of test items, and the block's broadcast."""
    run_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_runs", run_type), T.StructField("items", T.ArrayType(T.StringType()))]
    at, runs_arrow = rows.columns.index(text), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    value = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = value.value
        ready = workers.own("decontamination")
        searcher = ready.get(key)
        if searcher is None:
            ready.clear()
            searcher = ready[key] = Searcher(own, window)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                found = list(searcher.search(batch.column(at).to_pylist()))
                cols = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in r] for _, r, _ in found], runs_arrow), pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "n_words", "hit_runs", "items"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields])), value


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
    )


QUERIES = {"op1_decontamination": op1_decontamination}

ORACLES = {
    "op1_decontamination": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
        FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM pat),
win AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS p FROM d, ms, unnest(range(1, len(w) - m + 2)) AS t(i)),
hit AS (SELECT doc_id, i, win.m AS m, item_id FROM win JOIN pat ON pat.m = win.m AND pat.p = win.p),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
""",
}
