"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted the same number of times, a fraction above a whole number. The fractions are rounded
so that a source's words stay as they are: two documents meet, a random one gains words that the other loses, until one is
at a whole number; the other meets the next. Documents are dealt into leaves of bounded size by source and hash; what a
leaf leaves over, one document for each source, meets the remains of other leaves, level by level, in a reduction tree.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.ordering import ranked
from quillspark.session import Kept

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MAX_COPIES = 3
#: Documents of a source that a leaf holds on average.
LEAF = 1024
#: Remains that meet in a node of the tree.
FAN_IN = 256


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, kept: Kept, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MAX_COPIES, source: str = "source", size: str = "size") -> DataFrame:
    """(source, source_size, n_rows, weight, target) of each source of rows (source, size).

    The k-th source by code point, null last, weighs weights[k mod n]. The sources share `share` of all sizes by weight;
    where that is more than `most` times a source's size, the source gets that much and the excess is shared anew.
    The level that all sources below their limit reach (target / weight) is found by rounds over sums, one row each.
    """
    totals = sizes.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(size).alias("source_size"), F.count("*").alias("n_rows"))
    placed = ranked(totals, [F.col("source").asc_nulls_last()], kept, out="nth")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = placed.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most)
    wanted = (placed.agg(F.sum("source_size")).head()[0] or 0) * share
    level = None
    while True:  # each round caps one source more at least, or ends
        full = F.lit(False) if level is None else F.col("limit") < F.col("weight") * F.lit(level)
        capped, free, n = placed.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).head()
        if not free or (level is not None and n == before):
            break
        level, before = (wanted - (capped or 0)) / free, n
    target = F.col("limit").cast("double") if level is None else F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(float(level)))
    return placed.select("source", "source_size", "n_rows", "weight", target.alias("target"))


_DOC = "leaf string, hash long, id string, size long, source_size long, target double, part double"
_DEALT = _DOC + ", copies long"


def meet(x: list, y: list, u: float) -> tuple[float, float]:
    """New fractions of two documents (size, fraction): one at least is whole, and the words of both stay the same.

    The first gains words with such a chance that both keep their fractions on average.
    """
    (m, p), (n, q) = x, y
    up, down = min((1 - p) * m, q * n), min(p * m, (1 - q) * n)
    if u * (up + down) < down:  # the first gains
        return (1.0 if (1 - p) * m <= q * n else p + up / m), (0.0 if q * n <= (1 - p) * m else q - up / n)
    return (0.0 if p * m <= (1 - q) * n else p - down / m), (1.0 if (1 - q) * n <= p * m else q + down / n)


def _round(batches: Iterator[pd.DataFrame], seed: str, level: int, last: bool) -> Iterator[pd.DataFrame]:
    """Rows with `copies` where their fraction became whole; in each leaf the last open one has none.

    Rows come sorted by leaf, larger documents first: a large document that stays open has many small ones ahead to be
    settled with, so that what is left over is small. At the last level it is rounded to the nearer whole number.
    """
    names = [x.split()[0] for x in _DEALT.split(", ")]
    now, rng, open_row, out = None, None, None, []

    def settle(row: list) -> None:
        out.append((*row, math.floor(row[5] / row[4]) + int(row[6]) if row[3] else 0))

    def leave() -> None:
        if open_row is not None and last:
            settle([*open_row[:6], float(open_row[6] >= 0.5)])
        elif open_row is not None:
            out.append((*open_row, None))

    def frame() -> pd.DataFrame:
        f = pd.DataFrame(out, columns=names)
        out.clear()
        return f.assign(copies=f["copies"].astype("Int64"))

    for batch in batches:
        for values in batch.itertuples(index=False, name=None):
            row = list(values)
            if row[0] != now:
                leave()
                now, open_row, rng = row[0], None, random.Random(f"{seed}:{level}:{row[0]}")
            if not 0 < row[6] < 1:
                settle(row)
            elif open_row is None:
                open_row = row
            else:
                open_row[6], row[6] = meet((open_row[3], open_row[6]), (row[3], row[6]), rng.random())
                still = None
                for x in (open_row, row):
                    if 0 < x[6] < 1:
                        still = x
                    else:
                        settle(x)
                open_row = still
        if out:
            yield frame()
    leave()
    if out:
        yield frame()


def copies(rows: DataFrame, kept: Kept, most_rows: int, seed: str = "2024", leaf_rows: int = LEAF, fan_in: int = FAN_IN) -> DataFrame:
    """(id, size, source_size, target, copies) of rows (source_key, hash, id, size, source_size, n_rows, target).

    Each is taken target / source_size times on average, floor or ceiling, and every source keeps the words of its target
    but for half of one document, the last that was open. A leaf holds the documents of one source that fall to it by
    hash; rows that are equal in all share one, which its task streams. The random numbers come from the seed and the leaf,
    and rows are sorted before they meet, so reruns and retried tasks agree, however the input is split. most_rows is the
    greatest n_rows of a source. Documents of size 0 are not taken.
    """
    leaves = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / leaf_rows))
    at = F.pmod("hash", leaves)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.select(F.concat_ws(":", at.cast("string"), "source_key").alias("leaf"), "hash", "id", "size", "source_size", "target", (rate - F.floor(rate)).alias("part"))
    n, done, level = max(1, -(-most_rows // leaf_rows)), [], 0
    while True:
        last = n <= 1
        dealt = rows.repartition("leaf").sortWithinPartitions("leaf", F.desc("size"), "hash", "id")
        met = kept.keep(dealt.mapInPandas(lambda batches, level=level, last=last: _round(batches, seed, level, last), _DEALT), f"level{level}")
        done.append(met.where("copies is not null"))
        if last:
            break
        number = F.substring_index("leaf", ":", 1)
        node = F.concat(F.floor(number.cast("long") / fan_in).cast("string"), F.expr("substring(leaf, length(substring_index(leaf, ':', 1)) + 1)"))
        rows = met.where("copies is null").select(node.alias("leaf"), *met.columns[1:-1])
        n, level = -(-n // fan_in), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("leaf", "hash", "part")


def mix(docs: DataFrame, kept: Kept, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MAX_COPIES, seed: str = "2024", ident: str = "doc_id", text: str = "text", source: str = "source", leaf_rows: int = LEAF, fan_in: int = FAN_IN) -> DataFrame:
    """(ident, size, source_size, target, copies) of every document: how often the mix takes it.

    size is the number of words of the whole text (null and empty: 0, and no copies), source_size and target those of its
    source in words. A null source is a source, and comes last. Repeated rows and rows with the same or a null ident are
    documents of their own. Each source's words differ from its target by half of one of its documents at most.
    Other columns are not read. No rows, no rows. Empty sources have the target 0. most is a whole number.
    """
    body = F.col(f"`{text}`").cast("string")
    named = docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(body).alias("size"), F.xxhash64(F.col(f"`{ident}`"), body).alias("hash"))
    sized = kept.keep(named, "sized")
    aims = kept.keep(targets(sized, kept, weights, share, most), "targets")
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    per = aims.select(key(F.col("source")).alias("source_key"), "source_size", "target", "n_rows")
    rows = sized.select(key(F.col("source")).alias("source_key"), "hash", key(F.col("id").cast("string")).alias("id"), "size").join(per, "source_key")
    found = copies(rows, kept, aims.agg(F.max("n_rows")).head()[0] or 0, seed, leaf_rows, fan_in)
    own = F.when(F.col("id") != "", F.substring("id", 2, 1 << 30)).cast(named.schema["id"].dataType)
    return found.select(own.alias(ident), "size", "source_size", "target", "copies")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), Kept(spark, "mixing"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op12_mixing": op12_mixing}
ORACLES: dict[str, str] = {}
