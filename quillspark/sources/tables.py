"""Readers. A table is a folder or file of Parquet, or another format named by its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A crawl's work list: JSON lines, or one JSON array over several lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_decisions(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Review decisions from CSV with a header; blank cells are null."""
    return spark.read.schema(schema).option("header", True).option("emptyValue", None).csv(path)


def read_xml_records(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """Records of finance filings; numbers stay text until they are parsed (see functions.money)."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, extension, content) of files below a folder, each a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.col("content").cast("string").alias("content"))


def parse_vectors(column: str) -> F.Column:
    """A vector written as '[1,2,3]'; null if it isn't one."""
    return F.from_json(F.col(column), "array<double>")


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Idempotent rebuild: the partitions that df holds are replaced as a whole, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
