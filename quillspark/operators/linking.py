"""Scores between vectors and people: galleries, normalised scores, margins, decisions, constrained clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import vectors as V
from quillspark.operators.components import connected_components, roots_of
from quillspark.operators.merging import merged
from quillspark.operators.names import close_pairs, common_letters, jaro_winkler  # noqa: F401
from quillspark.operators.pairs import BLOCK_ROWS, block_units, matrix, tiles, usable
from quillspark.operators.voices import sum_vectors
from quillspark.session import Kept

#: Rows of one group that are linked without a shared folder; larger groups are an error, not cut.
MAX_GROUP = 5_000
#: Rows of one group, or of a part of it, that a task links: it holds their vectors.
MAX_PART = 1 << 17
#: Tasks that groups are dealt to.
LINK_TASKS = 128
EPS = 1e-8
#: Vectors of a cohort that are broadcast; a larger one is left to the planner.
MAX_COHORT = 1 << 14
#: Centroids meet samples in so many lists.
CENTROID_BLOCKS = 64
#: Persons and samples that meet in one task.
PERSON_BLOCK, SAMPLE_BLOCK = 256, 4_096


def person_scores(samples: DataFrame, person: str, meeting: str, vector: str, sample_id: str) -> DataFrame:
    """(sample_id, person, score): mean cosine of each sample with every person's samples of other meetings.

    The mean of cosines is the dot product with the mean unit vector, so sums by person, and by person and meeting, stand for
    the pairs: a sample meets each person once.
    """
    u = samples.select(F.col(sample_id).alias("sid"), F.col(person).alias("person"), F.col(meeting).alias("meeting"), V.unit(F.col(vector)).alias("u"))
    flat = u.where(F.col("person").isNotNull()).select("person", "meeting", F.posexplode("u").alias("i", "x"))
    sums = flat.groupBy("person", "meeting", "i").agg(F.sum("x").alias("x"))
    arr = lambda df, keys, name: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(name))
    by_meeting = arr(sums, ["person", "meeting"], "vm").join(u.where(F.col("person").isNotNull()).groupBy("person", "meeting").agg(F.count("*").alias("nm")), ["person", "meeting"])
    by_person = arr(sums.groupBy("person", "i").agg(F.sum("x").alias("x")), ["person"], "vp").join(u.where(F.col("person").isNotNull()).groupBy("person").agg(F.count("*").alias("np")), "person")
    every = u.select("sid", "meeting", "u").join(by_person, F.lit(True))
    same = by_meeting.select(F.col("person").alias("p2"), F.col("meeting").alias("m2"), "vm", "nm")
    both = every.join(same, (F.col("person") == F.col("p2")) & (F.col("meeting") == F.col("m2")), "left")
    n = F.col("np") - F.coalesce("nm", F.lit(0))
    total = V.dot(F.col("u"), F.col("vp")) - F.when(F.col("vm").isNotNull(), V.dot(F.col("u"), F.col("vm"))).otherwise(0.0)
    return both.where(n > 0).select(F.col("sid").alias(sample_id), "person", F.round(total / n, 9).alias("score"))


def best_people(samples: DataFrame, person: str, meeting: str, vector: str, sample_id: str, kept: Kept, person_block: int = PERSON_BLOCK, sample_block: int = SAMPLE_BLOCK) -> DataFrame:
    """(sample_id, person, score, margin): best_with_margin of person_scores, by blocks of samples times blocks of persons.

    What moves are the samples once for each block of persons, the persons' sums once for each block of samples, and the
    two best of each block for a sample, not a row for each sample and person. Samples without an id or a usable vector, and
    those that no other sample can be compared with, have no row.
    """
    ok = samples.where(F.col(sample_id).isNotNull() & usable(F.col(vector)))
    u = kept.keep(ok.select(F.col(sample_id).alias("sid"), F.col(person).alias("person"), F.col(meeting).alias("meeting"), V.unit(F.col(vector)).alias("u")), "units")
    known = u.where("person is not null")
    part = kept.keep(sum_vectors(known, ["person", "meeting"], "u").withColumnRenamed("total", "v"), "sums")
    whole = sum_vectors(part.select("person", "v"), ["person"], "v").select("person", F.col("total").alias("v")).join(known.groupBy("person").agg(F.count("*").alias("n")), "person")
    none = F.lit(None).cast(part.schema["meeting"].dataType)
    rows = whole.select("person", none.alias("meeting"), "v", "n", F.lit(True).alias("whole")).unionByName(part.where("meeting is not null").select("person", "meeting", "v", "n", F.lit(False).alias("whole")))
    right = kept.keep(rows, "people")
    bs, bp = max(1, -(-u.count() // sample_block)), max(1, -(-right.where("whole").count() // person_block))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = u.select("sid", "meeting", "u", block("sid", bs).alias("bs"), F.explode(F.sequence(F.lit(0), F.lit(bp - 1))).alias("bp"))
    right = right.select("*", block("person", bp).alias("bp"), F.explode(F.sequence(F.lit(0), F.lit(bs - 1))).alias("bs"))
    schema = T.StructType([T.StructField("sid", u.schema["sid"].dataType), T.StructField("person", u.schema["person"].dataType), T.StructField("score", T.DoubleType())])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        full = b.filter(b.column("whole")).sort_by("person")
        if not a.num_rows or not full.num_rows:
            return pa.table({"sid": a.column("sid").slice(0, 0), "person": b.column("person").slice(0, 0), "score": pa.array([], pa.float64())})
        x, v = (as_rows(t.column(c)) for t, c in ((a, "u"), (full, "v")))
        s, n = x @ v.T, np.repeat(np.asarray(full.column("n"), float)[None, :], a.num_rows, 0)
        at = {p: j for j, p in enumerate(full.column("person").to_pylist())}
        own: dict = {}
        for r, m in enumerate(a.column("meeting").to_pylist()):
            own.setdefault(m, []).append(r)
        same = b.filter(pa.compute.invert(b.column("whole")))
        if same.num_rows:
            for p, m, w, k in zip(same.column("person").to_pylist(), same.column("meeting").to_pylist(), as_rows(same.column("v")), same.column("n").to_pylist(), strict=True):
                if m in own:
                    s[own[m], at[p]] -= x[own[m]] @ w
                    n[own[m], at[p]] -= k
        s = np.where(n > 0, np.round(s / np.maximum(n, 1), 9), -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")[:, :2]
        score = np.take_along_axis(s, order, 1)
        r, k = np.nonzero(score > -np.inf)
        return pa.table({"sid": a.column("sid").take(pa.array(r)), "person": full.column("person").take(pa.array(order[r, k])), "score": pa.array(score[r, k])})

    found = left.groupBy("bs", "bp").cogroup(right.groupBy("bs", "bp")).applyInArrow(compare, schema)
    top = found.groupBy("sid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "person"))), 1, 2).alias("b"))
    first, second = F.get("b", 0), F.get("b", 1)
    return top.select(F.col("sid").alias(sample_id), first["person"].alias("person"), (-first["less"]).alias("score"), F.round(-first["less"] - F.coalesce(-second["less"], F.lit(0.0)), 9).alias("margin"))


def as_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), float).reshape(len(column), -1)


def best_with_margin(scores: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """(key, label, score, margin) of the best label; a missing runner-up counts as 0. Ties go by label."""
    w = Window.partitionBy(key).orderBy(F.desc(score), label)
    placed = scores.withColumn("__n", F.row_number().over(w)).withColumn("__second", F.lead(score).over(w))
    return placed.where("__n = 1").select(key, label, score, F.round(F.col(score) - F.coalesce("__second", F.lit(0.0)), 9).alias("margin"))


def runners_up(scores: DataFrame, key: str, label: str, score: str, n: int = 3) -> DataFrame:
    """(key, label, alternatives): the labels placed after the best, n at most."""
    w = Window.partitionBy(key).orderBy(F.desc(score), label)
    placed = scores.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n + 1)
    return placed.groupBy(key).agg(F.min_by(label, "__n").alias(label), F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("__n", F.col(label).cast("string").alias("l")))), lambda s: s["__n"] > 1), lambda s: s["l"]), ",").alias("alternatives"))


def sweep(best: DataFrame, thresholds: list[float], margins: list[float], truth: str = "truth", label: str = "person", score: str = "score") -> DataFrame:
    """One row for each (threshold, margin): predictions, precision (1.0 without any) and recall.

    Each scored row is counted at the grid points it passes, in one aggregation over a fixed grid.
    """
    grid = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(m)).alias("margin_min")) for t in thresholds for m in margins])
    rows = best.select("*", F.explode(grid).alias("g"))
    passes = (F.col(score) >= F.col("g.threshold")) & (F.col("margin") >= F.col("g.margin_min"))
    right = passes & F.coalesce(F.col(label) == F.col(truth), F.lit(False))
    out = rows.groupBy("g.threshold", "g.margin_min").agg(F.sum(passes.cast("long")).alias("predictions"), F.sum(right.cast("long")).alias("correct"), F.count(truth).alias("total"))
    return out.select("threshold", "margin_min", "predictions", F.round(F.when(F.col("predictions") > 0, F.col("correct") / F.col("predictions")).otherwise(1.0), 6).alias("precision"), F.round(F.col("correct") / F.col("total"), 6).alias("recall"))


def operating_point(points: DataFrame, precision: float) -> DataFrame:
    """The point of most recall whose precision reaches the bar; ties go to the stricter. Points that predict nothing can't be it."""
    return points.where((F.col("precision") >= precision) & (F.col("predictions") > 0)).orderBy(F.desc("recall"), F.desc("threshold"), F.desc("margin_min")).limit(1)


def asnorm(pairs: DataFrame, vectors: DataFrame, cohort: DataFrame, item: str, vector: str, top: int) -> DataFrame:
    """pairs (a, b, score) with z: the mean of the score's z values against each side's `top` best cohort scores.

    The cohort is a bounded, frozen table; a vector of the cohort isn't scored with itself. Deviations are the population's, plus 1e-8.
    """
    c = cohort.select(F.col(item).alias("__c"), F.col(vector).alias("__cv"))
    c = F.broadcast(c) if cohort.count() <= MAX_COHORT else c
    scored = vectors.select(F.col(item).alias("__i"), F.col(vector).alias("__v")).join(c, F.col("__i") != F.col("__c")).select("__i", "__c", V.cosine(F.col("__v"), F.col("__cv")).alias("s"))
    w = Window.partitionBy("__i").orderBy(F.desc("s"), "__c")
    stats = scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).groupBy("__i").agg(F.avg("s").alias("mu"), (F.stddev_pop("s") + EPS).alias("sd"))
    of = lambda k: stats.select(F.col("__i").alias(k), F.col("mu").alias(f"mu_{k}"), F.col("sd").alias(f"sd_{k}"))
    z = ((F.col("score") - F.col("mu_a")) / F.col("sd_a") + (F.col("score") - F.col("mu_b")) / F.col("sd_b")) / 2
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "score", z.alias("z"))


def closest(samples: DataFrame, centroids: DataFrame, item: list[str], vector: str, digits: int = 9) -> DataFrame:
    """(item, label, score): each sample's closest centroid by cosine, ties by the smaller label.

    centroids: (label, centroid). They are put together as lists in blocks, so that a sample gives a row for each block, not
    for each label, and the best of a block is found inside the row.
    """
    lists = centroids.groupBy(F.pmod(F.xxhash64("label"), F.lit(CENTROID_BLOCKS)).alias("block")).agg(F.collect_list(F.struct("label", "centroid")).alias("cs"))
    best = F.array_max(F.transform("cs", lambda c: F.struct(F.round(V.cosine(F.col(vector), c["centroid"]), digits).alias("score"), (-c["label"]).alias("neg"))))
    top = samples.join(lists).select(*item, best.alias("b")).groupBy(*item).agg(F.max("b").alias("b"))
    return top.select(*item, (-F.col("b.neg")).alias("label"), F.col("b.score").alias("score"))


def evidence_score(rows: DataFrame, key: list[str], family: str, value: str, rest: float = 0.3) -> DataFrame:
    """Per family the best value and a share of the others, summed over families."""
    each = rows.groupBy(*key, family).agg((F.max(value) + rest * (F.sum(value) - F.max(value))).alias("v"))
    return each.groupBy(*key).agg(F.round(F.sum("v"), 6).alias("score"), F.count("*").alias("families"))


def gate(rows: DataFrame, rules: list[tuple[Column, str]], passed: str = "accepted") -> DataFrame:
    """rows with the reason of the first rule that holds, or `passed`."""
    out = F.lit(passed)
    for condition, reason in reversed(rules):
        out = F.when(condition, reason).otherwise(out)
    return rows.withColumn("decision", out)


def threshold_parts(rows: DataFrame, group: str, item: str, vector: str, threshold: float, kept: Kept, cannot: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(item, part): items (long) that a chain of pairs of one group at or above the threshold joins; single ones have no row.

    Pairs are compared block by block; a task joins its own and sends one row for an item, so no pair leaves it.
    """
    carry = {"grp": group} | ({"cannot": cannot} if cannot else {})
    units = block_units(rows.where(F.col(group).isNotNull()), item, vector, carry, kept, block_rows)

    def join(t: pa.Table) -> pa.Table:
        codes = lambda c: np.unique(np.array([str(x) for x in t.column(c).to_pylist()]), return_inverse=True)[1]
        g, c = (codes(x) if x and t.num_rows else None for x in ("grp", "cannot" if cannot else None))
        ids = np.asarray(t.column("id"), np.int64)
        at = root = np.zeros(0, np.int64)
        for p, q, _ in tiles(t, threshold - 1e-9):  # joined a tile at a time: pairs may be most of all
            keep = g[p] == g[q] if c is None else (g[p] == g[q]) & (c[p] != c[q])
            at, root = roots_of(np.concatenate([at, ids[p[keep]]]), np.concatenate([root, ids[q[keep]]]))
        return pa.table({"a": pa.array(at, pa.int64()), "b": pa.array(root, pa.int64())})

    edges = units.groupBy("i", "j").applyInArrow(join, "a long, b long")
    return connected_components(edges, kept).select(F.col("id").alias(item), F.col("component").alias("part"))


def linkage_sweep(rows: DataFrame, group: str, item: str, vector: str, thresholds: list[float], cannot: str | None = None, kept: Kept | None = None) -> DataFrame:
    """(group, item, threshold, node): complete_linkage at each of several thresholds, by one course of merges a group.

    A node of a threshold is what the merges at or above it have joined. A task holds the vectors of a group, not its pairs
    (merging.merged). With kept, groups of more than MAX_PART rows are split beforehand at the lowest threshold: items of two
    parts that no pair joins never share a node. Items lacking a group or a usable vector then are nodes of their own.
    """
    item_type = rows.schema[item].dataType.simpleString()
    group_type = rows.schema[group].dataType.simpleString()
    steps = sorted({float(t) for t in thresholds}, reverse=True)
    most = MAX_GROUP if kept is None else MAX_PART

    def link(t: pa.Table) -> pa.Table:
        if t.num_rows > most:
            raise ValueError(f"a group of {t.num_rows} rows; at most {most}")
        t = t.sort_by(item)
        if len(pa.compute.unique(pa.compute.list_value_length(t.column(vector)))) > 1:
            raise ValueError("vectors of several lengths")
        codes = np.asarray(t.column(cannot).combine_chunks().dictionary_encode(null_encoding="encode").indices) if cannot else None
        node = merged(matrix(t.column(vector)), codes, steps)
        ids, same = t.column(item).combine_chunks(), t.column(group).combine_chunks()
        out = [pa.table({group: same, item: ids, "threshold": pa.array(np.full(len(ids), s)), "node": ids.take(pa.array(node[:, k]))}) for k, s in enumerate(steps)]
        return pa.concat_tables(out).cast(pa.schema([(group, same.type), (item, ids.type), ("threshold", pa.float64()), ("node", ids.type)]))

    cols = list(dict.fromkeys([group, item, vector, *([cannot] if cannot else [])]))
    schema = f"{group} {group_type}, {item} {item_type}, threshold double, node {item_type}"
    if kept is None:
        return rows.select(*cols).groupBy(group).applyInArrow(link, schema)
    ok = F.col(group).isNotNull() & F.col(item).isNotNull() & usable(F.col(vector))
    marked = kept.keep(rows.select(*cols, F.when(ok, F.size(vector)).alias("__dim")), "rows")
    dim = marked.where("__dim is not null").groupBy("__dim").count().orderBy(F.desc("count"), "__dim").head()
    fits = F.coalesce(F.col("__dim") == (dim[0] if dim else 0), F.lit(False))
    sizes = marked.where(fits).groupBy(group).agg(F.count("*").alias("__n"))
    marked = marked.join(sizes, group, "left").withColumn("__large", fits & (F.col("__n") > MAX_PART))
    small, alone = marked.where(fits & ~F.col("__large")).select(*cols), marked.where(~fits).select(group, item)
    joined = small.repartition(LINK_TASKS, group).groupBy(group).applyInArrow(link, schema)  # by number: groups are small and take long
    if not sizes.where(F.col("__n") > MAX_PART).isEmpty():
        large = marked.where("__large").select(*cols)
        parts = threshold_parts(large, group, item, vector, steps[-1], kept, cannot).withColumnRenamed(item, "__item")
        split = kept.keep(large.join(parts, F.col(item).cast("long") == F.col("__item"), "left").drop("__item"), "parts")
        joined = joined.unionByName(split.where("part is not null").repartition(LINK_TASKS, group, "part").groupBy(group, "part").applyInArrow(link, schema))
        alone = alone.unionByName(split.where("part is null").select(group, item))
    return joined.unionByName(alone.select(group, item, F.explode(F.array(*[F.lit(t) for t in steps])).alias("threshold"), F.col(item).alias("node")))


def complete_linkage(rows: DataFrame, group: str, item: str, vector: str, threshold: float, cannot: str | None = None, kept: Kept | None = None) -> DataFrame:
    """(group, item, node): greedy complete linkage inside each group; items of one `cannot` value never share a node.

    The next merge is always that of the highest least similarity, ties by the smaller items. Without kept, groups are limited to
    MAX_GROUP rows. With kept (and items that are long and unique) a task takes MAX_PART rows; a larger group is first split
    where no pair reaches the threshold, which changes no node, and a part beyond it is refused.
    """
    return linkage_sweep(rows, group, item, vector, [threshold], cannot, kept).drop("threshold")


def sweep_metrics(nodes: DataFrame, node: str, label: str, condition: str) -> DataFrame:
    """(threshold, nodes, purity, precision, recall, f1, across_f1) of clusterings (threshold, node, label, condition).

    Pairs are counted from groups: same node, same label, both; across_f1 is of the pairs of different conditions. Items
    without a label take no part. Without pairs of a kind, precision and recall are 1.
    """
    known = nodes.where(F.col(label).isNotNull()).select("threshold", F.col(node).alias("node"), F.col(label).alias("label"), F.col(condition).alias("cond"))
    n = F.col("n")

    def pairs(keys: list[str], name: str) -> DataFrame:
        return known.groupBy("threshold", *keys).agg(F.count("*").alias("n")).groupBy("threshold").agg(F.sum(n * (n - 1) / 2).alias(name))

    out = known.groupBy("threshold", "node", "label").agg(F.count("*").alias("n")).groupBy("threshold", "node").agg(F.sum("n").alias("n"), F.max("n").alias("m")).groupBy("threshold").agg(F.count("*").alias("nodes"), (F.sum("m") / F.sum("n")).alias("purity"))
    for keys, name in ((["node"], "a"), (["label"], "b"), (["node", "label"], "c")):
        out = out.join(pairs(keys, name), "threshold").join(pairs([*keys, "cond"], f"{name}w"), "threshold")

    def rates(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
        p, r = F.coalesce(c / F.nullif(a, F.lit(0.0)), F.lit(1.0)), F.coalesce(c / F.nullif(b, F.lit(0.0)), F.lit(1.0))
        return p, r, F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))

    p, r, f = rates(F.col("a"), F.col("b"), F.col("c"))
    across = rates(F.col("a") - F.col("aw"), F.col("b") - F.col("bw"), F.col("c") - F.col("cw"))[2]
    return out.select("threshold", "nodes", *[F.round(v, 6).alias(k) for k, v in (("purity", F.col("purity")), ("precision", p), ("recall", r), ("f1", f), ("across_f1", across))])


def farthest_points(rows: DataFrame, group: str, item: str, vector: str, n: int, kept: Kept | None = None) -> DataFrame:
    """(group, item, place): n items of each group, each the farthest from those before; the first is the smallest item.

    Farthest is the one whose highest cosine (9 places) with those chosen is least; ties by item. Every step is one
    aggregate over all rows, whose state for a group is one item, so groups of any size do; the items chosen ride along.
    What each step chose is written, so that n points take n passes.
    """
    kept = kept or Kept(rows.sparkSession, "spread")
    unit = kept.keep(rows.select(F.col(group), F.col(item), V.unit(F.col(vector)).alias("__u")), "units")
    first = kept.keep(unit.groupBy(group).agg(F.min_by(F.struct(item, "__u"), item).alias("c")).select(group, F.array("c").alias("__chosen")), "chosen")
    for _ in range(n - 1):
        near = F.array_max(F.transform("__chosen", lambda c: F.round(V.dot(F.col("__u"), c["__u"]), 9)))
        new = ~F.exists("__chosen", lambda c: c[item] == F.col(item))
        scored = unit.join(first, group).where(new).select(group, near.alias("__near"), F.struct(item, "__u").alias("c"))
        step = scored.groupBy(group).agg(F.min_by("c", F.struct("__near", F.col(f"c.{item}"))).alias("c"))
        first = kept.keep(first.join(step, group, "left").select(group, F.when(F.col("c").isNull(), F.col("__chosen")).otherwise(F.concat("__chosen", F.array("c"))).alias("__chosen")), "chosen")
    return first.select(group, F.posexplode("__chosen").alias("place", "c")).select(group, F.col(f"c.{item}").alias(item), "place")


def align_calls(rows: DataFrame, group: str, kind: str, position: str, token: str) -> DataFrame:
    """(group, call, answer): each call of a roll with the answer that lies between it and the next call.

    An answer (kind 'answer') binds to the last call before it if no other answer came first; then as many calls as can be
    are bound, each to one answer. One window over the group's rows in order of position; equal positions put calls first.
    token is not looked at: it may be null.
    """
    w = Window.partitionBy(group).orderBy(position, F.col(kind) != "call")
    last = F.last(F.when(F.col(kind) == "call", F.col(position)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    bound = rows.withColumn("call", last).where((F.col(kind) == "answer") & F.col("call").isNotNull() & (F.col(position) > F.col("call")))
    return bound.groupBy(group, "call").agg(F.min(position).alias("answer"))


def fuzzy_names(phrases: DataFrame, vocabulary: DataFrame, phrase: str, name: str, floor: float = 0.85) -> DataFrame:
    """(phrase, name, score): the closest name for each phrase (names.close_pairs), ties to the greater name."""
    scored = close_pairs(phrases, vocabulary, phrase, name, floor)
    return scored.groupBy(F.col("p").alias(phrase)).agg(F.max_by(F.struct("v", F.round("score", 6).alias("score")), F.struct("score", "v")).alias("b")).select(phrase, F.col("b.v").alias(name), F.col("b.score").alias("score"))
