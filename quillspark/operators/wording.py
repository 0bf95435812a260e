"""Who words things like this: stylometric distances, each sample against people without itself; and when a passage was spoken."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.search import words_of
from quillspark.session import Kept

#: Persons whose profiles meet a block of samples at once, and samples of such a block.
PERSON_BLOCK, SAMPLE_BLOCK = 512, 2_048
#: Words that a task counts at once, unless one text has more, and rows.
PIECE, ROWS = 1 << 18, 1_024
#: Where in a passage a probe begins, one after another; words of a probe; a passage has so many words at least.
PROBES, PROBE_WORDS, LEAST_WORDS = (0.0, 0.25, 0.5), 6, 8


def delta_ranks(samples: DataFrame, sample: str, person: str, text: str, top: int, kept: Kept, person_block: int = PERSON_BLOCK, sample_block: int = SAMPLE_BLOCK) -> DataFrame:
    """(sample, person, n_words, nearest, delta, second, own): the person whose wording is nearest to each sample's.

    The distance is the mean over the `top` most frequent words of all samples (ties by word) of the difference between the
    sample's rate of the word and the person's, in deviations of the word's rate over samples; a word whose rate is the same
    everywhere counts as it is. A person's rates are those of all their samples together, for a sample of their own without
    it: its counts are taken off. Samples whose person has no other are left out, and so is that person for them. delta and
    second are the distances (9 places) of the nearest and the next (null if alone), own that of the sample's person; ties
    go to the smaller person. Samples without words, a person or an id are left out. Sample ids are taken as unique.
    Blocks of samples meet blocks of persons, so no task holds more; the vocabulary has `top` words.
    """
    rows = samples.where(F.col(sample).isNotNull() & F.col(person).isNotNull()).select(F.col(sample).alias("s"), F.col(person).alias("p"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    rows = kept.keep(rows, "words")
    words = [r["word"] for r in rows.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top).collect()]  # `top` words
    at, k = {w: i for i, w in enumerate(words)}, len(words)
    kinds = rows.schema

    def count(batches):
        for whole in batches:
            offs, lo = np.asarray(whole.column(3).offsets).astype(np.int64), 0
            while lo < whole.num_rows:
                hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + PIECE, "right")) - 1), lo + ROWS)
                b = whole.slice(lo, hi - lo)
                begins = offs[lo : hi + 1] - offs[lo]
                out = np.zeros((b.num_rows, k))
                flat = whole.column(3).values.slice(offs[lo], begins[-1]).dictionary_encode()
                place = np.array([at[w] for w in flat.dictionary.to_pylist()], np.int64)[np.asarray(flat.indices)] if len(flat) else np.zeros(0, np.int64)
                np.add.at(out, (np.repeat(np.arange(b.num_rows), np.diff(begins)), place), 1)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * k, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), cells], names=["s", "p", "n", "c"])
                lo = hi

    # only the vocabulary's words go to Python, a bounded number at a time
    found = rows.select("s", "p", F.size("w").cast("long").alias("n"), F.filter("w", lambda x: x.isin(words)).alias("w"))
    counted = kept.keep(found.mapInArrow(count, T.StructType([kinds["s"], kinds["p"], T.StructField("n", T.LongType()), T.StructField("c", T.ArrayType(T.DoubleType()))])), "counts")
    rate = counted.select(F.posexplode(F.transform("c", lambda x: x / F.col("n"))).alias("i", "x"))
    spread = {r["i"]: r["sd"] for r in rate.groupBy("i").agg(F.stddev_pop("x").alias("sd")).collect()}  # `top` numbers
    sd = np.array([spread.get(i) or 1.0 for i in range(k)])
    each = counted.select("p", "n", F.posexplode("c").alias("i", "x"))
    sums = each.groupBy("p", "i").agg(F.sum("x").alias("x"))
    totals = counted.groupBy("p").agg(F.sum("n").alias("pn"), F.count("*").alias("m"))
    profiles = sums.groupBy("p").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("pc")).join(totals, "p")
    profiles = kept.keep(profiles, "profiles")
    n_p, n_s = totals.count(), counted.count()
    bp, bs = max(1, -(-n_p // person_block)), max(1, -(-n_s // sample_block))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = counted.withColumn("bs", block("s", bs)).withColumn("bp", F.explode(F.sequence(F.lit(0), F.lit(bp - 1))))
    right = profiles.withColumn("bp", block("p", bp)).withColumn("bs", F.explode(F.sequence(F.lit(0), F.lit(bs - 1))))
    schema = T.StructType([kinds["s"], kinds["p"], T.StructField("n", T.LongType()), T.StructField("other", kinds["p"].dataType), T.StructField("delta", T.DoubleType())])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.table({"s": a.column("s").slice(0, 0), "p": a.column("p").slice(0, 0), "n": pa.array([], pa.int64()), "other": a.column("p").slice(0, 0), "delta": pa.array([], pa.float64())})
        if not a.num_rows or not b.num_rows:
            return empty
        b = b.sort_by("p")
        as_rows = lambda t, c: np.asarray(t.column(c).combine_chunks().flatten(), float).reshape(t.num_rows, k)
        mine, theirs = as_rows(a, "c"), as_rows(b, "pc")
        n, pn, m = np.asarray(a.column("n"), float), np.asarray(b.column("pn"), float), np.asarray(b.column("m"))
        persons, own = b.column("p").to_pylist(), a.column("p").to_pylist()
        where = {x: j for j, x in enumerate(persons)}
        keep, other, delta = [], [], []
        for r in range(a.num_rows):
            f = mine[r] / n[r]
            d = (np.abs(f - theirs / pn[:, None]) / sd).mean(1)
            j = where.get(own[r])
            if j is not None:
                d[j] = np.inf if m[j] < 2 else (np.abs(f - (theirs[j] - mine[r]) / (pn[j] - n[r])) / sd).mean()
            d = np.round(d, 9)
            best = [x for x in np.argsort(d, kind="stable")[:2].tolist() if np.isfinite(d[x])]
            if j is not None and np.isfinite(d[j]) and j not in best:
                best.append(j)  # the sample's own person is told in any case
            for x in best:
                keep.append(r)
                other.append(x)
                delta.append(d[x])
        take = pa.array(keep, pa.int64())
        return pa.table({"s": a.column("s").take(take), "p": a.column("p").take(take), "n": a.column("n").take(take), "other": b.column("p").take(pa.array(other, pa.int64())), "delta": pa.array(delta, pa.float64())})

    found = left.groupBy("bs", "bp").cogroup(right.groupBy("bs", "bp")).applyInArrow(compare, schema)
    told = found.groupBy("s", "p", "n").agg(F.slice(F.array_sort(F.collect_list(F.struct("delta", "other"))), 1, 2).alias("b"), F.max(F.when(F.col("other") == F.col("p"), F.col("delta"))).alias("own"))
    out = told.where("own is not null")
    return out.select(F.col("s").alias(sample), F.col("p").alias(person), F.col("n").alias("n_words"), F.get("b", 0)["other"].alias("nearest"), F.get("b", 0)["delta"].alias("delta"), F.get("b", 1)["delta"].alias("second"), "own")


def accuracy_by_words(ranks: DataFrame, person: str, bounds: list[int]) -> DataFrame:
    """(words, n, hits, accuracy): how often the nearest is the sample's person, by the number of words; words is the bin's
    lower bound, the first bin begins at 0."""
    low = F.lit(0)
    for b in sorted(bounds):
        low = F.when(F.col("n_words") >= b, b).otherwise(low)
    hit = (F.col("nearest") == F.col(person)).cast("long")
    return ranks.groupBy(low.alias("words")).agg(F.count("*").alias("n"), F.sum(hit).alias("hits")).withColumn("accuracy", F.round(F.col("hits") / F.col("n"), 6))


def spoken_at(passages: DataFrame, segments: DataFrame, document: str = "document_id", passage: str = "chunk_id", text: str = "content", start: str = "start_ms", segment_text: str = "text", probe: int = PROBE_WORDS, places: tuple[float, ...] = PROBES, least: int = LEAST_WORDS) -> DataFrame:
    """(document, passage, place, start): when each passage begins to be spoken, by the first of its probes that is found.

    A probe is a run of `probe` words of the passage from a share of its words on; it is found where the same run stands in the
    document's segments, put together by start; the first such place counts and its segment's start is the time. Fewer words
    at the end of a passage are a probe of their own length only if whole; passages of fewer than `least` words have none.
    Words are compared in lower case. Runs meet by hash within a document: one row for each word spoken, no text is searched.
    """
    spoken = segments.where(F.col(document).isNotNull() & F.col(start).isNotNull()).select(F.col(document).alias("d"), F.col(start).alias("t"), F.posexplode(words_of(F.col(segment_text))).alias("i", "w"))
    order = Window.partitionBy("d").orderBy("t", "i")
    run = F.concat_ws(" ", *[F.lead("w", k).over(order) for k in range(probe)])
    placed = spoken.select("d", "t", run.alias("run"), F.lead("w", probe - 1).over(order).alias("whole")).where("whole is not null")
    first = placed.groupBy("d", F.xxhash64("run").alias("h"), "run").agg(F.min("t").alias("t"))
    w = words_of(F.col(text))
    rows = passages.where(F.col(passage).isNotNull()).select(F.col(document).alias("d"), F.col(passage).alias("c"), w.alias("w")).where(F.size("w") >= least)
    tried = F.array(*[F.slice("w", (F.floor(F.size("w") * F.lit(p)) + 1).cast("int"), F.lit(probe)) for p in places])
    each = rows.select("d", "c", F.posexplode(tried).alias("place", "probe")).where(F.size("probe") == probe)
    each = each.select("d", "c", "place", F.array_join("probe", " ").alias("run")).withColumn("h", F.xxhash64("run"))
    hits = each.join(first, ["d", "h", "run"]).groupBy("d", "c").agg(F.min(F.struct("place", "t")).alias("b"))
    return hits.select(F.col("d").alias(document), F.col("c").alias(passage), F.col("b.place").alias("place"), F.col("b.t").alias("start"))
