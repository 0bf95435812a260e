"""Names to subjects within their terms, and edges that cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(day: Column, start: Column, end: Column) -> Column:
    """A day inside a term; an open bound is no bound."""
    return (start.isNull() | (day >= start)) & (end.isNull() | (day <= end))


def resolve_names(mentions: DataFrame, roster: DataFrame, mention_id: str = "mention_id") -> DataFrame:
    """mentions (name_key, body, day) with n, subject_id and status: resolved, ambiguous, out_of_term, unknown.

    roster: (name_key, body, subject_id, start, end). Terms are applied before subjects are counted; never a tie-break after.
    """
    m, r = mentions.alias("m"), roster.alias("r")
    hits = m.join(r, (F.col("m.name_key") == F.col("r.name_key")) & (F.col("m.body") == F.col("r.body")), "left")
    seated = within(F.col("m.day"), F.col("r.start"), F.col("r.end")) & F.col("r.subject_id").isNotNull()
    found = hits.groupBy(F.col(f"m.{mention_id}").alias(mention_id)).agg(
        F.countDistinct(F.when(seated, F.col("r.subject_id"))).alias("n"),
        F.min(F.when(seated, F.col("r.subject_id"))).alias("subject_id"),
        F.count("r.subject_id").alias("known"),
    )
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").when(F.col("known") > 0, "out_of_term").otherwise("unknown")
    return found.select(mention_id, F.col("n").cast("long").alias("n"), F.when(F.col("n") == 1, F.col("subject_id")).alias("subject_id"), status.alias("status"))


def vote_edges(votes: DataFrame) -> DataFrame:
    """votes (vote_id, members array of (name, vote), moved_by, seconded_by) to rows (vote_id, name, edge).

    Of a name repeated in one roll call the first vote counts.
    """
    each = votes.select("vote_id", F.posexplode("members").alias("pos", "m"))
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("vote_id", "m.name").orderBy("pos"))).where("n = 1")
    roles = [votes.where(F.col(c).isNotNull()).select("vote_id", F.col(c).alias("name"), F.lit(edge).alias("edge")) for c, edge in (("moved_by", "moved"), ("seconded_by", "seconded"))]
    return first.select("vote_id", F.col("m.name").alias("name"), F.concat(F.lit("voted_"), F.lower("m.vote")).alias("edge")).unionByName(roles[0]).unionByName(roles[1])


def matter_refs(rows: DataFrame, row_id: str, text: str, pattern: str = r"(?i)\b((?:bill|ordinance|resolution)\s+(?:no\.?\s*)?[0-9]{2,5})\b") -> DataFrame:
    """(row_id, matter) once for each matter that a text names, in one spelling."""
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda m: F.regexp_replace(F.regexp_replace(F.lower(m), r"\bno\.?\s*", ""), r"\s+", " "))
    return rows.select(row_id, F.explode(F.array_distinct(found)).alias("matter"))


def roll_up_matters(voted: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(matter, actions, references, last_day) over two sources (matter, day)."""
    a = voted.groupBy("matter").agg(F.count("*").alias("actions"), F.max("day").alias("va"))
    b = mentioned.groupBy("matter").agg(F.count("*").alias("references"), F.max("day").alias("vb"))
    return a.join(b, "matter", "full_outer").select("matter", F.coalesce("actions", F.lit(0)).alias("actions"), F.coalesce("references", F.lit(0)).alias("references"), F.greatest("va", "vb").alias("last_day"))


def unique_names(index: DataFrame, phrase: str, subject: str) -> DataFrame:
    """Phrases that belong to one subject; shared ones are dropped. A single word is for review only."""
    out = index.groupBy(phrase).agg(F.countDistinct(subject).alias("n"), F.min(subject).alias(subject)).where("n = 1").drop("n")
    return out.withColumn("strength", F.when(F.size(F.split(F.col(phrase), " ")) > 1, "strong").otherwise("review"))


def restore_origin(rows: DataFrame, origins: DataFrame, key: str, origin: str) -> DataFrame:
    """rows with the origin of their key where there is just one."""
    one = origins.groupBy(key).agg(F.countDistinct(origin).alias("n"), F.min(origin).alias(origin)).where("n = 1").drop("n")
    return rows.join(one, key, "left")


def first_containing(needles: DataFrame, chunks: DataFrame, document: str, needle_id: str, needle: str, text: str, order: str) -> DataFrame:
    """(needle_id, chunk order, n): the first chunk of the document that holds the whole needle, and how many do."""
    hit = needles.join(chunks, document).where(F.contains(F.col(text), F.col(needle)) & (F.col(needle) != ""))
    return hit.groupBy(needle_id).agg(F.min(order).alias(order), F.count("*").alias("n"))


def broken_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each expectation."""
    counts = rows.agg(*[F.coalesce(F.sum((~F.coalesce(ok, F.lit(False))).cast("long")), F.lit(0)).alias(name) for name, ok in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("r")).select("r.*")
