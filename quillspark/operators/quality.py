"""Audits of a corpus: one row for each issue found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X


def checks(text: Column) -> dict[str, Column]:
    """What makes a text suspect."""
    return {
        "empty": text.isNull() | (F.trim(text) == ""),
        "control_characters": X.strip_controls(text) != text,
        "mojibake": text.rlike("Ã[\\x{80}-\\x{BF}©¨¤¶¼]|â€|\\x{FFFD}"),
        "exotic": X.exotic_ratio(text) > 0.05,
        "pii": F.size(X.pii_findings(text)) > 0,
        "contact": text.contains("@"),
        "advocacy": F.lower(text).rlike(r"\b(vote (yes|no) on|paid for by|support our campaign)\b"),
    }


def audit(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, issue), in one pass over the texts."""
    found = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks(F.col(text)).items()]
    return docs.select(F.col(doc_id), F.explode(F.array_compact(F.array(*found))).alias("issue"))


def report(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
