"""Metrics of rankings and clusterings, from counts; never from pairs of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking(ranked: DataFrame, k: int) -> DataFrame:
    """ranked (query, rank, grade) to (query, ndcg, mrr, recall, covered). Graded 2^g - 1; relevant from grade 1 on.

    The ideal order takes all judged items of the ranking. Recall is null without a relevant item. Unjudged rows have a null grade.
    """
    gain = F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1
    rows = ranked.withColumn("gain", gain).withColumn("best", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(gain), "rank")))
    at = lambda place: F.log2(F.col(place) + 1.0)
    relevant = F.coalesce(F.col("grade") >= 1, F.lit(False))
    out = rows.groupBy("query").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("gain") / at("rank")).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("best") <= k, F.col("gain") / at("best")).otherwise(0.0)).alias("ideal"),
        F.min(F.when(relevant, F.col("rank"))).alias("first"),
        F.sum((relevant & (F.col("rank") <= k)).cast("int")).alias("found"),
        F.sum(relevant.cast("int")).alias("relevant"),
        F.bool_and((F.col("rank") > k) | F.col("grade").isNotNull()).alias("covered"),
    )
    return out.select("query", F.round(F.coalesce(F.col("dcg") / F.nullif("ideal", F.lit(0.0)), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("found") / F.nullif("relevant", F.lit(0)), 6).alias("recall"), "covered")


def clustering(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row: purity, coverage, pairwise and B-cubed precision, recall and F1, macro recall by label. Null labels don't take part.

    All come from the counts of (cluster, label).
    """
    cells = rows.where(F.col(label).isNotNull()).groupBy(F.col(cluster).alias("c"), F.col(label).alias("l")).agg(F.count("*").cast("double").alias("n"))
    by_c, by_l = cells.groupBy("c").agg(F.sum("n").alias("nc"), F.max("n").alias("mc")), cells.groupBy("l").agg(F.sum("n").alias("nl"), F.max("n").alias("ml"))
    pairs = lambda x: F.col(x) * (F.col(x) - 1) / 2
    all_cells = cells.join(by_c, "c").join(by_l, "l").agg(F.sum("n").alias("total"), F.sum(pairs("n")).alias("both"), F.sum(F.col("n") * F.col("n") / F.col("nc")).alias("bp"), F.sum(F.col("n") * F.col("n") / F.col("nl")).alias("br"))
    c_sums, l_sums = by_c.agg(F.sum("mc").alias("pure"), F.sum(pairs("nc")).alias("in_c")), by_l.agg(F.sum("ml").alias("cover"), F.sum(pairs("nl")).alias("in_l"))
    recalls = cells.groupBy("l").agg(F.sum(pairs("n")).alias("hit"), F.sum("n").alias("nl")).where("nl > 1").agg(F.avg(F.col("hit") / pairs("nl")).alias("macro"))
    one = all_cells.crossJoin(F.broadcast(c_sums)).crossJoin(F.broadcast(l_sums)).crossJoin(F.broadcast(recalls))  # single rows
    f1 = lambda p, r: F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    p, r = F.coalesce(F.col("both") / F.nullif("in_c", F.lit(0.0)), F.lit(1.0)), F.coalesce(F.col("both") / F.nullif("in_l", F.lit(0.0)), F.lit(1.0))
    bp, br = F.col("bp") / F.col("total"), F.col("br") / F.col("total")
    cols = {"purity": F.col("pure") / F.col("total"), "coverage": F.col("cover") / F.col("total"), "pair_precision": p, "pair_recall": r, "pair_f1": f1(p, r), "bcubed_precision": bp, "bcubed_recall": br, "bcubed_f1": f1(bp, br), "macro_recall": F.col("macro")}
    return one.select(*[F.round(v, 6).alias(k) for k, v in cols.items()])


def macro_precision(predictions: DataFrame, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """(predictions, correct, macro_precision, recall): mean over predicted people; 1.0 without predictions; null predictions abstain."""
    each = predictions.where(F.col(predicted).isNotNull()).groupBy(predicted).agg(F.count("*").alias("n"), F.sum((F.col(predicted) == F.col(truth)).cast("int")).alias("ok"))
    sums = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("predictions"), F.coalesce(F.sum("ok"), F.lit(0)).alias("correct"), F.coalesce(F.avg(F.col("ok") / F.col("n")), F.lit(1.0)).alias("p"))
    total = predictions.agg(F.count(truth).alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("predictions", "correct", F.round("p", 6).alias("macro_precision"), F.round(F.coalesce(F.col("correct") / F.nullif("total", F.lit(0)), F.lit(0.0)), 6).alias("recall"))


def pareto(points: DataFrame, precision: str = "precision", recall: str = "recall") -> DataFrame:
    """Points that no other beats in both; of equal ones the one of the highest threshold. One pass in order of recall."""
    w = Window.orderBy(F.desc(recall), F.desc(precision), F.desc("threshold"))  # a row for each operating point
    best = F.max(precision).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("__b", best).where(F.col("__b").isNull() | (F.col(precision) > F.col("__b"))).drop("__b")
