"""Quality of labelled voices: the coherent core of each person, operating points for people never seen, wrong merges."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import vectors as V
from quillspark.operators.pairs import EPS, usable, with_cohort


def sum_vectors(rows: DataFrame, keys: list[str], vector: str, name: str = "total") -> DataFrame:
    """(keys, name, n): sum and number of the vectors of each key, added up in each task before they move."""
    v = array_to_vector(F.col(f"`{vector}`").cast("array<double>"))
    out = rows.groupBy(*keys).agg(Summarizer.metrics("sum", "count").summary(v).alias("__s"))
    return out.select(*keys, vector_to_array("__s.sum").alias(name), F.col("__s.count").alias("n"))


def coherent_cores(rows: DataFrame, group: str, item: str, vector: str, floor: float, min_core: int, cohort: DataFrame | None = None, cohort_vector: str | None = None, z_floor: float | None = None, min_cohort: int = 3) -> DataFrame:
    """(group, item, mean_cosine, to_medoid, medoid, core): the members of each group that sound like its medoid.

    The medoid is the item of the highest mean cosine (9 places) with the others, ties by item; the mean is a dot product
    with the group's sum of unit vectors, so no pair of items meets, whatever a group's size. An item is in the core if its
    cosine with the medoid reaches the floor or, with a cohort of at least min_cohort vectors and a z_floor, if that cosine
    reaches z_floor deviations above the mean of the item's cosines with the cohort; an item whose cohort cosines don't
    spread is held to the floor. The medoid is in its core. Groups whose core would be smaller than min_core have none.
    Rows without a group, an item or a usable vector are left out. A zero vector has a cosine of 0 with all others.
    """
    ok = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull() & usable(F.col(vector)))
    unit = ok.select(F.col(group).alias("g"), F.col(item).alias("id"), V.unit(F.col(vector)).alias("u"))
    total = sum_vectors(unit, ["g"], "u")
    scored = unit.join(total, "g")
    mean = F.when(F.col("n") > 1, (V.dot(F.col("u"), F.col("total")) - 1) / (F.col("n") - 1)).otherwise(0.0)
    scored = scored.select("g", "id", "u", F.round(mean, 9).alias("mean_cosine"))
    best = scored.groupBy("g").agg(F.min_by(F.struct("id", "u"), F.struct((-F.col("mean_cosine")).alias("less"), "id")).alias("m"))
    near = scored.join(best, "g").select("g", "id", "u", "mean_cosine", F.round(V.dot(F.col("u"), F.col("m.u")), 9).alias("to_medoid"), (F.col("id") == F.col("m.id")).alias("medoid"))
    inside = F.col("to_medoid") >= floor
    if cohort is not None and z_floor is not None and (n := cohort.count()) >= min_cohort:
        near = with_cohort(near, "u", cohort, cohort_vector, n)
        spread = F.col("sd") - EPS
        inside = F.when(spread < 1e-6, inside).otherwise((F.col("to_medoid") - F.col("mu")) / spread >= z_floor)
    near = near.select("g", "id", "mean_cosine", "to_medoid", "medoid", (inside | F.col("medoid")).alias("inside"))
    size = near.groupBy("g").agg(F.count_if("inside").alias("size"))
    return near.join(size, "g").select(F.col("g").alias(group), F.col("id").alias(item), "mean_cosine", "to_medoid", "medoid", (F.col("inside") & (F.col("size") >= min_core)).alias("core"))


def left_out_points(rows: DataFrame, group: str, score: str, right: str, thresholds: list[float], precision: float) -> DataFrame:
    """For each group, the operating point that all others choose, and what it does to the group itself.

    rows are scored predictions: right says whether one is; a null score predicts nothing. The point is the threshold of the
    highest recall whose precision reaches the bar, ties by the higher threshold; points that predict nothing can't be it.
    Returns (group, threshold, rest_precision, rest_recall, predicted, correct, total), the last three of the group; groups
    whose others reach the bar nowhere are left out. A row is counted once, by group and by the highest threshold it
    reaches; running sums over thresholds give every sweep, and a left-out sweep is the whole one less the group's share.
    """
    steps = sorted(set(thresholds))
    passed = F.size(F.filter(F.array(*[F.lit(float(t)) for t in steps]), lambda t: F.col(score) >= t))
    each = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.coalesce(passed, F.lit(0)).alias("k"), F.coalesce(F.col(right), F.lit(False)).cast("long").alias("r"))
    counts = each.groupBy("g", "k").agg(F.count("*").alias("n"), F.sum("r").alias("r"))
    own = counts.groupBy("g").agg(F.sum("n").alias("total"))
    ladder = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(len(steps))).alias("k"), F.array(*[F.lit(float(t)) for t in steps]).alias("threshold")))
    dense = own.select("g", "total", ladder.alias("s")).select("g", "total", F.col("s.k").alias("k"), F.col("s.threshold").alias("threshold"))
    w = Window.partitionBy("g").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # one row a threshold
    sums = dense.join(counts, ["g", "k"], "left").select("g", "total", "k", "threshold", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"), F.coalesce(F.sum("r").over(w), F.lit(0)).alias("r"))
    whole = sums.groupBy("k").agg(F.sum("n").alias("wn"), F.sum("r").alias("wr"), F.sum("total").alias("wt"))
    rest = sums.join(F.broadcast(whole), "k")  # a row for each threshold
    n, r, t = F.col("wn") - F.col("n"), F.col("wr") - F.col("r"), F.col("wt") - F.col("total")
    rest = rest.select("g", "threshold", "n", "r", "total", (r / F.nullif(n, F.lit(0))).alias("p"), (r / F.nullif(t, F.lit(0))).alias("q"))
    best = rest.where(F.col("p") >= precision).groupBy("g").agg(F.max_by(F.struct("threshold", "p", "q", "n", "r", "total"), F.struct("q", "threshold")).alias("b"))
    return best.select(F.col("g").alias(group), "b.threshold", F.round("b.p", 6).alias("rest_precision"), F.round("b.q", 6).alias("rest_recall"), F.col("b.n").alias("predicted"), F.col("b.r").alias("correct"), "b.total")


def merge_harm(assignments: DataFrame, node: str, label: str, merges: DataFrame) -> DataFrame:
    """(a, b, harm, ambiguous) of merges (a, b) of two nodes: how many more labelled items would bear another's name.

    A node bears the name of most of its labelled items, so the others bear a wrong one. ambiguous: whether the merged node
    holds several labels, and so is refused by a guard. From counts by node and label; no item meets another. A node merged
    with itself does no harm; nodes without labelled items count nothing.
    """
    counts = assignments.where(F.col(label).isNotNull()).groupBy(F.col(node).alias("node"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    merges = merges.select("a", "b").distinct()
    ends = merges.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
    met = ends.join(counts, "node").groupBy("a", "b", "label").agg(F.sum("n").alias("n"), F.max(F.when(F.col("node") == F.col("a"), F.col("n"))).alias("na"), F.max(F.when((F.col("node") == F.col("b")) & (F.col("a") != F.col("b")), F.col("n"))).alias("nb"))
    of = lambda c: F.coalesce(F.sum(c) - F.max(c), F.lit(0))
    told = met.groupBy("a", "b").agg((of("n") - of("na") - of("nb")).alias("harm"), (F.count("*") > 1).alias("ambiguous"))
    return merges.join(told, ["a", "b"], "left").select("a", "b", F.coalesce("harm", F.lit(0)).alias("harm"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
