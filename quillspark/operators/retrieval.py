"""Hybrid retrieval: vector and keyword lists, fused by reciprocal rank, demoted, cut and explained."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import vectors as V

RRF_K = 60
POOL = 50
DEMOTION = 5


def optional(column: Column, value) -> Column:
    """A filter that holds for all rows while the parameter is unset; a list stands for a set."""
    if value is None:
        return F.lit(True)
    return column.isin(*value) if isinstance(value, (list, tuple, set)) else column == value


def date_range(column: Column, start=None, end=None) -> Column:
    """Inclusive bounds; rows without a date go as soon as a bound is set."""
    out = F.lit(True)
    if start is not None:
        out = out & (column >= F.lit(start))
    return out & (column <= F.lit(end)) if end is not None else out


def semantic_search(items: DataFrame, query: DataFrame, item_id: str, vector: str, threshold: float = 0.35, top: int = POOL, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, similarity, and the columns to carry) of the items nearest to the one vector of query (column q): exact, over all items.

    query has one row, so the join with it is a broadcast of one vector. Ties go by id.
    """
    one = F.broadcast(query.select(F.col("q").alias("__q")).limit(1))
    scored = items.join(one).select(F.col(item_id).alias("id"), V.cosine(F.col(vector), F.col("__q")).alias("similarity"), *carry)
    return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(top)


def search_terms(query: str) -> list[str]:
    """Lower-case words of a query, its dashes taken as blanks."""
    for dash in "-‐‑‒–—−":
        query = query.replace(dash, " ")
    return list(dict.fromkeys(w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()))


def _is(term: str, x: Column) -> Column:
    return x == F.lit(term)


def keyword_search(items: DataFrame, query: str, item_id: str, text: str, top: int = POOL, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, and the columns to carry) of the items that hold every term: unstemmed; sum over terms of tf / (1 + log10(words)). Ties go by id.

    Terms are counted inside each row, so only matches leave the scan and only `top` rows reach the driver's sort.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    for t in search_terms(query):  # texts without a term aren't cut into words
        items = items.where(F.contains(F.lower(F.col(text)), F.lit(t)))
    rows = items.select(F.col(item_id).alias("id"), words.alias("w"), *carry)
    tf = [F.size(F.filter("w", partial(_is, t))) for t in search_terms(query)]
    if not tf:
        return rows.select("id", F.lit(0.0).alias("score"), *carry).limit(0)
    rows = rows.select("id", F.size("w").alias("n"), *carry, *[c.alias(f"t{i}") for i, c in enumerate(tf)])
    for i in range(len(tf)):
        rows = rows.where(F.col(f"t{i}") > 0)
    total = sum((F.col(f"t{i}") for i in range(len(tf))), F.lit(0))
    return rows.select("id", F.round(total / (1 + F.log10(F.col("n"))), 9).alias("score"), *carry).orderBy(F.desc("score"), "id").limit(top)


def ranked(hits: DataFrame, score: str, kind: str, list_no: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(list_no, kind, rank, id) of a list of at most a pool's size."""
    return hits.select(F.lit(list_no).alias("list_no"), F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(F.desc(score), "id")).alias("rank"), "id", *carry)


def fuse(lists: DataFrame, k: int = RRF_K, carry: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion: (id, rrf, best rank by kind, first_list). Ties go by the list first met, then the rank in it."""
    out = lists.groupBy("id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"),
        F.min(F.when(F.col("kind") == "semantic", F.col("rank"))).alias("semantic_rank"),
        F.min(F.when(F.col("kind") == "keyword", F.col("rank"))).alias("keyword_rank"),
        F.min(F.struct("list_no", "rank")).alias("first"),
        *[F.first(c).alias(c) for c in carry],
    )
    return out.select("id", "rrf", "semantic_rank", "keyword_rank", F.col("first.list_no").alias("first_list"), F.col("first.rank").alias("first_rank"), *carry)


def demote(hits: DataFrame, order: list[Column], demoted: Column, by: int = DEMOTION) -> DataFrame:
    """Places after demotion: demoted rows go back by so many; where places tie, rows that aren't demoted come first."""
    place = F.row_number().over(Window.orderBy(*order))
    moved = hits.withColumn("demoted", demoted).withColumn("before", place).withColumn("__to", F.col("before") + F.when(F.col("demoted"), by).otherwise(0))
    return moved.withColumn("place", F.row_number().over(Window.orderBy("__to", F.col("demoted").cast("int"), "before"))).drop("__to")


def hybrid_search(items: DataFrame, query: DataFrame, words: str, item_id: str, vector: str, text: str, kind: str, demoted_kinds: tuple[str, ...], threshold: float = 0.35, top: int = 20, texts: DataFrame | None = None) -> DataFrame:
    """Semantic and keyword pools, fused, demoted by kind and cut; the text's best sentence is joined after the cut.

    The pools carry the kind, so items are read once for each pool; texts (item_id, text) may be a narrower table than items.
    """
    of = F.col(kind).alias("item_kind")
    hits = [semantic_search(items.withColumn("item_kind", of), query, item_id, vector, threshold, carry=("item_kind",)), keyword_search(items.withColumn("item_kind", of), words, item_id, text, carry=("item_kind",))]
    lists = [ranked(h, score, name, k, ("item_kind",)) for k, (h, score, name) in enumerate(zip(hits, ("similarity", "score"), ("semantic", "keyword"), strict=True))]
    fused = fuse(lists[0].unionByName(lists[1]), carry=("item_kind",)).withColumnRenamed("item_kind", "kind")
    placed = demote(fused, [F.desc("rrf"), F.asc("first_list"), F.asc("first_rank")], F.coalesce(F.col("kind").isin(*demoted_kinds), F.lit(False)))
    cut = placed.where(F.col("place") <= top)
    parts = X.sentences(F.col(text))
    terms = F.array(*[F.lit(t) for t in search_terms(words)])
    shown = (items if texts is None else texts).select(F.col(item_id).alias("id"), F.col(text)).join(F.broadcast(cut), "id")  # `top` rows
    return shown.select("place", "id", "kind", "rrf", "semantic_rank", "keyword_rank", F.substring(F.get(parts, F.greatest(X.best_sentence(parts, terms), F.lit(0))), 1, 200).alias("snippet"))


def context_window(rows: DataFrame, group: str, order: str, n: int, text: str) -> DataFrame:
    """Each row's text with those of the n rows before and after."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-n, n)
    return rows.select("*", F.array_join(F.collect_list(F.col(text)).over(w), " | ").alias("context"))


def verify_citations(answers: DataFrame, known: DataFrame, answer_id: str = "answer_id", sentence: str = "sentence", position: str = "position", uncited_words: int = 8) -> DataFrame:
    """Sentences whose every cited id ([#q then 8 hex]) is known; those that cite nothing stay only if short."""
    cited = answers.withColumn("ids", F.array_distinct(F.regexp_extract_all(F.col(sentence), F.lit("#q([0-9a-f]{8})"), F.lit(1))))
    each = cited.select(answer_id, position, F.explode("ids").alias("citation_id"))
    missing = each.join(known.select("citation_id").distinct(), "citation_id", "left_anti").select(answer_id, position).distinct()
    short = F.size(F.split(F.trim(F.col(sentence)), r"\s+")) <= uncited_words
    return cited.join(missing, [answer_id, position], "left_anti").where((F.size("ids") > 0) | short).drop("ids")


def resolve_citations(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ref, chunk_id): the current chunk of an id; null where it lies in several documents or in none."""
    found = chunks.where("current").groupBy("citation_id").agg(F.countDistinct("document_id").alias("n"), F.min("chunk_id").alias("chunk_id"))
    return refs.join(found, refs["ref"] == found["citation_id"], "left").select("ref", F.when(F.col("n") == 1, F.col("chunk_id")).alias("chunk_id"))
