"""Who speaks: proposals, precedence, guarded writes, publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Confidence tiers from the weakest (fixed values).
TIERS = ("inferred_low", "inferred_high", "confirmed")
PUBLIC = ("inferred_high", "confirmed")


def tier(confidence: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TIERS]), confidence), F.lit(0)).cast("int")


def publishable(rows: DataFrame, confidence: str = "confidence", name: str = "name") -> DataFrame:
    """The public view: confident enough, and with a name."""
    return rows.where(F.col(confidence).isin(*PUBLIC) & F.col(name).isNotNull() & (F.trim(F.col(name)) != ""))


def propose(anchors: DataFrame, key: list[str], subject: str, strength: str) -> DataFrame:
    """One proposal a cluster: its subject if all its anchors agree, else none; confidence is the best anchor's."""
    out = anchors.groupBy(*key).agg(F.countDistinct(subject).alias("n"), F.min(subject).alias("s"), F.max(strength).alias("best"))
    return out.select(*key, F.when(F.col("n") == 1, F.col("s")).alias(subject), F.when(F.col("n") == 1, F.col("best")).alias(strength), (F.col("n") > 1).alias("contested"))


def demote_contested(rows: DataFrame, within: list[str], subject: str, confidence: str = "confidence") -> DataFrame:
    """A subject claimed by several clusters of one meeting is only inferred_low in each, unless confirmed."""
    n = F.count("*").over(Window.partitionBy(*within, subject))
    low = F.col(subject).isNotNull() & (n > 1) & (F.col(confidence) != "confirmed")
    return rows.withColumn("contested", low).withColumn(confidence, F.when(low, "inferred_low").otherwise(F.col(confidence)))


def keep_best(rows: DataFrame, key: list[str], rank: list[Column]) -> DataFrame:
    """The row of highest rank of each key; ranks are compared in turn."""
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("b")).select(*key, "b.*")


def persist(stored: DataFrame, proposed: DataFrame, key: list[str], own: str) -> DataFrame:
    """stored and proposed (key, subject, confidence, basis) merged, with an action.

    Confirmed and rejected rows are locked. A row of basis `own` that isn't proposed any more is retracted. A row of another basis is
    overwritten only by a strictly higher tier.
    """
    a = stored.select(*key, F.struct("subject", "confidence", "basis").alias("o"))
    b = proposed.select(*key, F.struct("subject", "confidence", "basis").alias("n"))
    locked = F.col("o.confidence").isin("confirmed", "rejected")
    action = (
        F.when(F.col("o").isNull(), "insert")
        .when(locked, "locked")
        .when(F.col("n").isNull(), F.when(F.col("o.basis") == own, "retract").otherwise("keep"))
        .when((F.col("o.basis") == own) | (tier(F.col("n.confidence")) > tier(F.col("o.confidence"))), "update")
        .otherwise("keep")
    )
    out = a.join(b, key, "full_outer").withColumn("action", action)
    row = F.when(F.col("action").isin("insert", "update"), F.col("n")).when(F.col("action").isin("locked", "keep"), F.col("o"))
    return out.select(*key, "action", row.alias("r")).select(*key, "action", "r.*")


def absent(called: DataFrame, answered: DataFrame, key: list[str]) -> DataFrame:
    """Those called that no reader heard answer."""
    return called.select(*key).distinct().join(answered.select(*key).distinct(), key, "left_anti")


def verdict(frames: DataFrame, cluster: str, label: str, least: int) -> DataFrame:
    """(cluster, label): the label seen in at least so many frames, where no other is."""
    n = frames.groupBy(cluster, label).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.groupBy(cluster).agg(F.count("*").alias("k"), F.min(label).alias(label), F.max("n").alias("n")).where("k = 1").drop("k")
