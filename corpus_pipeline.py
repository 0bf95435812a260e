"""A training corpus from documents: five stages, each a job over all that the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written and read again as the next
stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontamination, near_dedup, pii, toxicity
from quillspark.session import Kept


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject: those that score below a half.

    The model learns from the labelled documents; where there are none, nothing is known and all stay.
    Null and empty texts and null ids are scored as empty texts; repeated rows are scored alike; no rows, no rows.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model:
        return docs
    names = [f"__c{i}" for i in range(len(docs.columns))]
    found = toxicity.score(docs.toDF(*names), model, text=names[docs.columns.index("text")], out="__toxicity").where("__toxicity < 0.5")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): that of the smallest doc_id.

    Groups are of texts, not of ids: rows that share an id but no group all stay. Where rows of one group share the smallest
    id, that of the least hash of the text stays, and of repeated rows one. Texts without words and rows without doc_id
    belong to no group and stay. No rows, no rows.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    rows = docs.toDF(*names)
    keyed = rows.select(F.col(own).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("__key"))
    found = near_dedup.near_duplicates(keyed, k=5, percent=80, carry=("__key",), group="__group").where("n_shingles > 0 and doc_id is not null")
    pairs = found.groupBy("__group", "doc_id", "__key").agg(F.count("*").alias("c"))
    best = pairs.groupBy("__group").agg(F.min(F.struct("doc_id", "__key", "c")).alias("b")).select(F.col("b.doc_id").alias("__id"), F.col("b.__key").alias("__best"), F.col("b.c").alias("c"))
    alone = pairs.join(best.where("c = 1"), (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__best")), "left_anti").select(F.col("doc_id").alias("__id"), F.col("__key").alias("__drop")).distinct()
    several = best.where("c > 1").select("__id", "__best")
    same_id = rows[own].cast("long") == F.col("__id")
    kept = rows.join(alone, same_id & (F.xxhash64(rows[text]) == F.col("__drop")), "left_anti")
    again = rows.join(several, same_id & (F.xxhash64(rows[text]) == F.col("__best")), "left_semi").dropDuplicates([own, text])
    return kept.unionByName(again).toDF(*docs.columns)


def not_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a test item.

    Null and empty texts hold none; without test items all stay; repeated rows stay or go together; no rows, no rows.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]  # whatever docs' columns are called, results don't clash with them
    found = decontamination.find_items(docs.toDF(*names), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text=names[docs.columns.index("text")])
    return found.where(F.size("hit_runs") == 0).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data or secrets replaced by its kind in angle brackets; n_chars follows the text.

    Null texts and ids stay null; repeated rows are masked alike; no rows, no rows.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    found = pii.searched(docs.toDF(*names), Kept(spark, "pii"), text=text)
    out = pii.decided(found, pii.fit(pii.tally(found))).withColumn(text, pii.masked(F.col(text), F.col("spans")))
    out = out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long"))) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and the sha256 of the bytes that the ids decode to, of each document.

    Null texts are empty ones, null ids and repeated rows stay as they are; no rows, no rows.
    """
    path = public_tokenizers.path(bpe.DEFAULT)
    return bpe.encode_decode(docs.select("doc_id", "text"), path).select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each),
    ("decontamination", not_benchmark),
    ("pii", without_pii),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = Kept(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = kept.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
