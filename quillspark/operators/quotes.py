"""Passages that quotes come from: the whole quote if it stands in one, else the longest of its ends that points at a single one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.search import words_of
from quillspark.session import Kept

#: Words of the openings and closings that are tried, one after another.
LADDER = (24, 16, 12, 8)
#: Words by which an anchor and a passage meet before they are compared.
SEED = 4
#: Quotes of a document up to which each of its passages is searched for all their anchors.
FEW = 32


def anchors(quotes: DataFrame, quote: str, document: str, text: str, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """(quote, document, step, anchor): the whole quote (step 0), then openings and closings of fewer and fewer words.

    Anchors are arrays of lower-case words. A quote of n words has only anchors of fewer; repeated ones are left to the first.
    """
    w = words_of(F.col(text))
    opening = [F.when(F.size("w") > n, F.slice("w", 1, n)) for n in ladder]
    closing = [F.when(F.size("w") > n, F.slice("w", -n, n)) for n in ladder]
    rows = quotes.where(F.col(quote).isNotNull() & F.col(document).isNotNull()).select(F.col(quote).alias("quote"), F.col(document).alias("document"), w.alias("w")).where(F.size("w") > 0)
    rows = rows.select("quote", "document", F.posexplode(F.array(F.col("w"), *opening, *closing)).alias("step", "anchor")).where("anchor is not null")
    return rows.groupBy("quote", "document", "anchor").agg(F.min("step").alias("step"))


def _seed(words: Column, n: int) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, 1, n), " "))


def _runs(k: int) -> Column:
    """Hashes of all runs of k words of w."""
    return F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " ")))


def _spaced(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _by_seeds(tried: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(quote, document, step, at, chunk): anchors and the passages that hold them, in documents of any number of quotes; None without anchors.

    Anchors meet the runs of SEED words of their document's passages, shorter ones runs of their own length; then whole anchors are compared.
    """
    tried = tried.withColumn("k", F.least(F.size("anchor"), F.lit(SEED)))
    tried = tried.withColumn("seed", F.when(F.col("k") == SEED, _seed(F.col("anchor"), SEED)).otherwise(F.xxhash64(F.array_join("anchor", " "))))
    lengths = [r["k"] for r in tried.select("k").distinct().collect()]  # at most SEED
    met = None
    for k in sorted(lengths):
        runs = rows.where(F.size("w") >= k).select("document", "chunk", F.explode(_runs(k)).alias("seed")).distinct()
        part = tried.where(F.col("k") == k).select("quote", "document", "step", "seed").join(runs, ["document", "seed"]).select("quote", "document", "step", "chunk")
        met = part if met is None else met.unionByName(part)
    if met is None:
        return None
    both = met.join(tried.select("quote", "document", "step", "anchor"), ["quote", "document", "step"]).join(rows, ["document", "chunk"])
    return both.where(F.contains(_spaced(F.col("w")), _spaced(F.col("anchor")))).select("quote", "document", "step", "at", "chunk")


def cite(quotes: DataFrame, passages: DataFrame, quote: str = "quote_id", document: str = "document_id", text: str = "text", passage: str = "chunk_id", index: str = "chunk_index", passage_text: str = "content", ladder: tuple[int, ...] = LADDER, few: int = FEW, kept: Kept | None = None) -> DataFrame:
    """(quote, document, step, chunk): the passage of its document that each quote is cited to; quotes without one are left out.

    The whole quote (step 0) is cited to the first passage, by index, that holds it. Failing that, the first of the openings
    and then closings that stands in exactly one passage decides; an end that two passages share decides nothing, so that
    a quote is rather not cited than to the wrong place. Words are compared in lower case, without what is between them.
    Each passage is searched for all anchors of its document where that has at most `few` quotes; quotes and passages are
    then dealt by document once. In documents of more quotes they meet by seeds, so that a document of any size is no cross
    product; these documents are written once and kept belongs to the caller. Repeated quotes (same id) count once.
    """
    kept = kept or Kept(quotes.sparkSession, "quotes")
    given = quotes.where(F.col(quote).isNotNull() & F.col(document).isNotNull())
    large = kept.keep(given.groupBy(F.col(document).alias("document")).agg(F.count("*").alias("n")).where(F.col("n") > few).select("document"), "large")
    several = not large.isEmpty()
    rows = passages.where(F.col(passage).isNotNull() & F.col(document).isNotNull()).select(F.col(document).alias("document"), F.col(passage).alias("chunk"), F.col(index).alias("at"), words_of(F.col(passage_text)).alias("w"))
    to_large = lambda df, how: df.join(large.withColumnRenamed("document", document), document, how)
    tried = anchors((to_large(given, "left_anti") if several else given).repartition(document), quote, document, text, ladder)
    of = tried.groupBy("document").agg(F.collect_list(F.struct("quote", "step", _spaced(F.col("anchor")).alias("anchor"))).alias("tried"))
    found = rows.select("document", "chunk", "at", _spaced(F.col("w")).alias("w")).join(of.hint("merge"), "document")
    found = found.select("document", "chunk", "at", F.explode(F.filter("tried", lambda t: F.contains(F.col("w"), t["anchor"]))).alias("t")).select("t.quote", "document", "t.step", "at", "chunk")
    if several:
        more = _by_seeds(anchors(to_large(given, "left_semi"), quote, document, text, ladder), rows.join(large, "document", "left_semi"))
        found = found if more is None else found.unionByName(more)
    held = found.groupBy("quote", "document", "step").agg(F.count("*").alias("n"), F.min(F.struct("at", "chunk")).alias("c"))
    fit = held.where("step = 0 or n = 1").groupBy("quote", "document").agg(F.min(F.struct("step", F.col("c.chunk").alias("chunk"))).alias("b"))
    return fit.select(F.col("quote").alias(quote), F.col("document").alias(document), "b.step", F.col("b.chunk").alias(passage))
