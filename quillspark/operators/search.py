"""Search by words: an inverted index with stems and positions as a partitioned table, and web-style queries over it.

A query holds words, "quoted phrases", -negated ones and `or`; `or` binds last. Words are stemmed; stop words count as places
inside phrases and nowhere else. A query reads the partitions that its stems fall into, and meets a document once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.stem import with_stem
from quillspark.operators.retrieval import fuse, ranked
from quillspark.session import Kept

WORD = r"[\p{L}\p{N}]+"
#: Words that no query looks for. A parameter: other languages have others.
STOP = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in", "is", "it", "its", "no", "not", "of", "on", "or", "she", "so", "that", "the", "their", "them", "then", "there", "they", "this", "to", "was", "we", "were", "will", "with", "you")
#: Partitions of an index: a power of two, so that it can grow.
BUCKETS = 256
#: Files of a partition at most: the documents of a frequent stem are dealt to so many tasks.
SPREAD = 8
TOP = 50
#: Words that a task groups at once, unless one text has more.
PIECE = 1 << 18


@dataclass(frozen=True)
class Atom:
    """A word or a phrase: stems and their places in it."""

    stems: tuple[str, ...]
    places: tuple[int, ...]
    negated: bool = False


@dataclass(frozen=True)
class Index:
    """postings (bucket, stem, id, positions), and documents (id, n_words), read from one folder."""

    postings: DataFrame
    documents: DataFrame
    buckets: int
    stop: tuple[str, ...]


def bucket_of(stem: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(buckets)).cast("int")


def words_of(text: Column) -> Column:
    """The lower-case words of a text in order; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _words(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, w): the words of each document that has any."""
    return docs.where(F.col(f"`{ident}`").isNotNull()).select(F.col(f"`{ident}`").alias("id"), words_of(F.col(f"`{text}`")).alias("w")).where(F.size("w") > 0)


def _forms(rows: DataFrame) -> DataFrame:
    """(id, word, positions) of rows (id, w): a row for each distinct word of a row, a bounded number of words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs = np.asarray(batch.column(1).offsets).astype(np.int64)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + PIECE, "right")) - 1)
                begins = offs[lo : hi + 1] - offs[lo]
                flat = batch.column(1).values.slice(offs[lo], begins[-1]).dictionary_encode()
                row = np.repeat(np.arange(hi - lo), np.diff(begins))
                key = row * len(flat.dictionary) + np.asarray(flat.indices)
                order = np.argsort(key, kind="stable")
                cut = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
                first = order[cut]
                at = pa.array((order - begins[row[order]]).astype(np.int32))
                positions = pa.ListArray.from_arrays(pa.array(np.append(cut, len(key)), pa.int32()), at)
                words = flat.dictionary.take(flat.indices.take(pa.array(first)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row[first])), words, positions], names=["id", "word", "positions"])
                lo = hi

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("word", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


def postings(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, stem, positions): where each stem stands in each document, words counted from 0; one row for each word form.

    Forms are put together inside the task that reads a text, without a shuffle; they meet the stems of the distinct words in
    one join, so that a word which many documents hold is stemmed once. It is merged: neither side is as small as its files.
    """
    rows = _words(docs, ident, text)
    stems = with_stem(rows.select(F.explode(F.array_distinct("w")).alias("word")).distinct(), "word")
    return _forms(rows).join(stems.hint("merge"), "word").select("id", "stem", "positions")


def stem_counts(docs: DataFrame, ident: str, text: str, kept: Kept) -> DataFrame:
    """(stem, documents, places, last): how many documents (distinct ids) and places each stem has, and the last place of all.

    Places are counted by word before anything moves, and each distinct word is stemmed once; the words are kept, and belong to
    the caller. What moves for the documents is one row for a document and form.
    """
    rows = _words(docs, ident, text)
    counts = rows.select(F.posexplode("w").alias("at", "word")).groupBy("word").agg(F.count("*").alias("places"), F.max("at").cast("long").alias("last"))
    words = kept.keep(with_stem(counts, "word"), "words")
    forms = rows.select("id", F.explode(F.array_distinct("w")).alias("word")).join(words.select("word", "stem").hint("merge"), "word")
    documents = forms.select("stem", "id").distinct().groupBy("stem").agg(F.count("*").alias("documents"))
    return documents.join(words.groupBy("stem").agg(F.sum("places").alias("places"), F.max("last").alias("last")), "stem").select("stem", "documents", "places", "last")


def write_index(docs: DataFrame, path: str, ident: str, text: str, buckets: int = BUCKETS, spread: int = SPREAD) -> None:
    """Write the index of all documents under path: postings by bucket of the stem, and each document's length.

    Null texts are documents without words; rows without an id are left out; ids are taken as unique. Stop words are in the
    index too: phrases need their places, and a query's stop words are the query's choice.
    """
    rows = postings(docs, ident, text).withColumn("bucket", bucket_of(F.col("stem"), buckets))
    dealt = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(spread)))
    dealt.sortWithinPartitions("bucket", "stem", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    docs.where(F.col(f"`{ident}`").isNotNull()).select(F.col(f"`{ident}`").alias("id"), F.size(words_of(F.col(f"`{text}`"))).alias("n_words")).write.parquet(f"{path}/documents")


def read_index(spark: SparkSession, path: str, buckets: int = BUCKETS, stop: tuple[str, ...] = STOP) -> Index:
    documents = spark.read.parquet(f"{path}/documents")
    schema = T.StructType([T.StructField("stem", T.StringType()), documents.schema["id"], T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("bucket", T.IntegerType())])
    return Index(spark.read.schema(schema).parquet(f"{path}/postings"), documents, buckets, stop)


def parse(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of (negated, words) of a query: words in quotes or joined by signs are a phrase.

    An unclosed quote ends with the query. A minus counts before a word or a quote, at the beginning or after a blank.
    Alternatives without anything are left out.
    """
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, quoted, plain in re.findall(r'(-?)"([^"]*)"?|([^\s"]+)', query):
        if plain.lower() == "or":
            out.append([])
            continue
        negated = bool(minus) or plain.startswith("-")
        found = re.findall(r"[^\W_]+", (quoted or plain).lower())
        if found:
            out[-1].append((negated, found))
    return [x for x in out if x]


def plan(spark: SparkSession, query: str, stop: tuple[str, ...] = STOP) -> list[list[Atom]]:
    """The alternatives of a query with stems in place of words; one small job stems its words."""
    parsed = parse(query)
    words = sorted({w for group in parsed for _, found in group for w in found})
    rows = with_stem(spark.createDataFrame([(w,) for w in words], "word string"), "word").collect() if words else []
    stems = {r["word"]: r["stem"] for r in rows}
    out = []
    for group in parsed:
        atoms = []
        for negated, found in group:
            kept = [(stems[w], k) for k, w in enumerate(found) if w not in stop]
            if kept:
                atoms.append(Atom(tuple(s for s, _ in kept), tuple(k for _, k in kept), negated))
        if atoms:
            out.append(atoms)
    return out


def search(index: Index, query: str, top: int = TOP) -> DataFrame:
    """(id, score) of the documents that match, best first: ties by id.

    The score is the number of times that the stems of its words (not those only negated) stand in the document, divided by
    1 + log10 of the document's length. A query of stop words alone matches nothing. A query that only negates reads the
    lengths of all documents, any other only what its stems have.
    """
    spark = index.postings.sparkSession
    groups = plan(spark, query, index.stop)
    if not groups:
        return index.documents.select("id", F.lit(0.0).alias("score")).limit(0)
    stems = sorted({s for g in groups for a in g for s in a.stems})
    wanted = {s for g in groups for a in g if not a.negated for s in a.stems}
    sizes = spark.createDataFrame([(s,) for s in stems], "stem string").select(bucket_of(F.col("stem"), index.buckets).alias("b")).distinct().collect()
    rows = index.postings.where(F.col("bucket").isin(*[r["b"] for r in sizes]) & F.col("stem").isin(*stems))
    places = {s: f"p{k}" for k, s in enumerate(stems)}
    found = rows.groupBy("id").agg(*[F.flatten(F.collect_list(F.when(F.col("stem") == s, F.col("positions")))).alias(c) for s, c in places.items()])

    def holds(atom: Atom) -> Column:
        first, *rest = zip(atom.stems, atom.places, strict=True)
        if not rest:
            ok = F.size(places[first[0]]) > 0
        else:
            ok = F.exists(places[first[0]], lambda x: reduce(lambda a, b: a & b, [F.array_contains(F.col(places[s]), x + (k - first[1])) for s, k in rest]))
        return ~ok if atom.negated else ok

    some = any(all(a.negated for a in g) for g in groups)
    if some:
        none = F.expr("cast(array() as array<int>)")
        found = index.documents.join(found, "id", "left").select("id", "n_words", *[F.coalesce(c, none).alias(c) for c in places.values()])
    matched = found.where(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [holds(a) for a in g]) for g in groups]))
    hits = reduce(lambda a, b: a + b, [F.size(places[s]) for s in sorted(wanted)], F.lit(0))
    scored = matched.select("id", hits.alias("hits"), *(["n_words"] if some else []))
    scored = scored if some else scored.join(index.documents, "id")
    return scored.select("id", F.round(F.col("hits") / (1 + F.log10(F.greatest(F.col("n_words"), F.lit(1)))), 9).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def fan_out(index: Index, primary: str, expansions: list[str], top: int = TOP) -> DataFrame:
    """The lists of a query and of its expansions, fused by reciprocal rank: (id, rrf, first_list, lists).

    Lists are numbered in the order given, the primary query is 0. A primary query without anything to look for is an
    error; expansions are a help only: those without anything to look for, and repeated ones, are left out.
    """
    spark = index.postings.sparkSession
    if not plan(spark, primary, index.stop):
        raise ValueError("the query holds nothing to look for")
    queries = [q for q in dict.fromkeys([primary, *expansions]) if q == primary or plan(spark, q, index.stop)]
    lists = [ranked(search(index, q, top), "score", "keyword", k) for k, q in enumerate(queries)]
    every = reduce(DataFrame.unionByName, lists)
    return fuse(every).select("id", "rrf", "first_list").join(every.groupBy("id").agg(F.count("*").alias("lists")), "id")
