"""Spans in time: windows from starts, overlap, nearest, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def windows(rows: DataFrame, group: str, start: str, order: list[str], end: str = "end") -> DataFrame:
    """rows with the end of each: the next one's start; the last is open."""
    return rows.withColumn(end, F.coalesce(F.lead(start).over(Window.partitionBy(group).orderBy(*order)).cast("double"), F.lit(INF)))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def max_overlap(left: DataFrame, right: DataFrame, group: str, left_id: str, label: str, width: float = 3600.0) -> DataFrame:
    """(left_id, label, overlap): the label of the right span (start, end) that overlaps a left span (start, end) longest.

    No overlap: no label. Ties go by the right span's start, end and label. Both sides are cut into bins of `width`, and a
    pair is taken in the bin where its overlap begins, so spans meet only their neighbours in time, however long the group.
    """
    bins = lambda s, e: F.sequence(F.floor(s / width), F.greatest(F.floor(s / width), F.ceil(e / width) - 1))
    last = right.groupBy(group).agg(F.max("end").alias("__last"))
    l = left.join(last, group, "left")
    bounded = F.greatest(F.col("start"), F.least(F.col("end"), F.coalesce("__last", F.col("start"))))
    l = l.select(group, F.col(left_id).alias("lid"), F.col("start").alias("ls"), F.col("end").alias("le"), F.explode(bins(F.col("start"), bounded)).alias("bin"))
    r = right.select(group, F.col(label).alias("label"), F.col("start").alias("rs"), F.col("end").alias("re"), F.explode(bins(F.col("start"), F.col("end"))).alias("bin"))
    both = l.join(r, [group, "bin"]).withColumn("overlap", overlap(F.col("ls"), F.col("le"), F.col("rs"), F.col("re")))
    both = both.where((F.col("overlap") > 0) & (F.col("bin") == F.floor(F.greatest("ls", "rs") / width)))
    best = both.groupBy("lid").agg(F.min_by(F.struct("label", "overlap"), F.struct(-F.col("overlap"), "rs", "re", "label")).alias("b"))
    ids = left.select(F.col(left_id))
    return ids.join(best, ids[left_id] == best["lid"], "left").select(left_id, F.col("b.label").alias("label"), F.coalesce("b.overlap", F.lit(0.0)).alias("overlap"))


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(b0 - a1, a0 - b1, F.lit(0.0))


def nearest_span(points: DataFrame, spans: DataFrame, group: str, point_id: str, label: str) -> DataFrame:
    """(point_id, label): of the spans in the group the one of most overlap, else the nearest; ties by start, end, label.

    Only the last span to begin at or before a point's end and the first after it can be nearest among spans that don't overlap
    each other, so they are found by a running maximum over the merged time line instead of a join of all with all.
    """
    p = points.select(group, F.col(point_id).alias("pid"), F.col("start").alias("s"), F.col("end").alias("e"), F.lit(None).cast("struct<start:double,end:double,label:string>").alias("span"), F.col("end").alias("t"))
    one = F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col(label).cast("string").alias("label"))
    q = spans.select(group, F.lit(None).cast(points.schema[point_id].dataType).alias("pid"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("e"), one.alias("span"), F.col("start").alias("t"))
    w = Window.partitionBy(group).orderBy("t", F.col("pid").isNotNull())
    line = p.unionByName(q).select(group, "pid", "s", "e", F.last("span", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("before"), F.first("span", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"), F.last("span", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"))
    cands = F.filter(F.array("before", "after"), lambda x: x.isNotNull())
    scored = F.transform(cands, lambda x: F.struct((-overlap(F.col("s"), F.col("e"), x["start"], x["end"])).alias("o"), gap(F.col("s"), F.col("e"), x["start"], x["end"]).alias("g"), x["start"].alias("a"), x["end"].alias("b"), x["label"].alias("label")))
    return line.where(F.col("pid").isNotNull()).select(F.col("pid").alias(point_id), F.array_min(scored)["label"].alias("label"))


def nearest_of_any(points: DataFrame, spans: DataFrame, group: str, point_id: str, label: str, width: float = 3600.0) -> DataFrame:
    """nearest_span for spans that may overlap each other: (point_id, label) of most overlap, else of the least gap.

    Ties go by start, end and label; without spans in the group the label is null. Overlaps are found in bins of `width`; of the
    spans that end before a point the last to end, and of those that begin after it the first, are the nearest on either side,
    and are told by two running values over the merged time line. Nulls in a group, start or end are near nothing.
    """
    ok = lambda df: df.where(F.col(group).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    p = ok(points).select(F.col(group).alias("g"), F.col(point_id).alias("pid"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    q = ok(spans).select(F.col(group).alias("g"), F.col(label).alias("label"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    # a point without length lies in the spans that hold it, at no gap: for the bins it is the least bit longer
    bit = F.greatest(F.lit(1e-9), F.abs("start") * 4.5e-16)
    longer = p.withColumn("end", F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.col("start") + bit))
    whole = q.select("g", F.struct("start", "end", "label").alias("label"), "start", "end")
    inside = max_overlap(longer, whole, "g", "pid", "label", width).where("label is not null").join(p.select("pid", (F.col("end") > F.col("start")).alias("long")), "pid")
    inside = inside.select("pid", F.when(F.col("long"), -1.0).otherwise(0.0).alias("gap"), F.col("label.start").alias("a"), F.col("label.end").alias("b"), F.col("label.label").alias("label"))

    def side(at: str, edge: str, order: list[Column], forward: bool) -> DataFrame:
        """(pid, gap, a, b, label) of the nearest span on one side."""
        one = F.struct("start", "end", "label")
        left = p.select("g", F.col(at).alias("t"), "pid", F.col(at).alias("x"), F.lit(None).cast(q.select(one.alias("s")).schema["s"].dataType).alias("s"))
        right = q.select("g", F.col(edge).alias("t"), F.lit(None).cast(p.schema["pid"].dataType).alias("pid"), F.lit(None).cast("double").alias("x"), one.alias("s"))
        w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = left.unionByName(right).withColumn("s", F.last("s", True).over(w)).where("pid is not null and s is not null")
        return found.select("pid", (F.col("s.start") - F.col("x") if forward else F.col("x") - F.col("s.end")).alias("gap"), F.col("s.start").alias("a"), F.col("s.end").alias("b"), F.col("s.label").alias("label"))

    point_last = F.col("pid").isNotNull()
    before = side("start", "end", [F.asc("t"), point_last, F.desc("s.start"), F.desc("s.label")], False)
    after = side("end", "start", [F.desc("t"), point_last, F.desc("s.end"), F.desc("s.label")], True)
    best = inside.unionByName(before).unionByName(after).groupBy("pid").agg(F.min_by("label", F.struct("gap", "a", "b", "label")).alias("label"))
    ids = points.select(F.col(point_id)).distinct()
    return ids.join(best, ids[point_id] == best["pid"], "left").select(point_id, "label")


def runs(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """(group, run, label, n): neighbours of one label are one run."""
    w = Window.partitionBy(group).orderBy(*order)
    starts = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = rows.withColumn("__s", starts).withColumn("run", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "run").agg(F.first(label).alias(label), F.count("*").alias("n"))


def gap_groups(rows: DataFrame, group: str, order: Column, most: float) -> DataFrame:
    """rows with the number of their island: a step of more than `most` begins a new one."""
    w = Window.partitionBy(group).orderBy(order)
    far = F.coalesce((order - F.lag(order).over(w)) > most, F.lit(False)).cast("int")
    return rows.withColumn("__f", far).withColumn("island", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def responses(rows: DataFrame, group: str, order: str, label: str, text: str) -> DataFrame:
    """Each row with the label and text of the next one of its group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.select("*", F.lead(label).over(w).alias("next_label"), F.lead(text).over(w).alias("next_text"))
