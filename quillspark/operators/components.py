"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import Kept

#: Edges that a task contracts at once.
CONTRACT = 1 << 20


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, the least vertex each can reach) over the edges a-b."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(ids))
    while True:
        lo = np.minimum(root[x], root[y])
        if (root[x] == lo).all() and (root[y] == lo).all():
            return ids, ids[root]
        for end in (x, y):
            np.minimum.at(root, root[end], lo)
            np.minimum.at(root, end, lo)
        while (root[root] != root).any():
            root = root[root]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (lo, hi) that join the same vertices: in runs of CONTRACT edges each vertex is joined with the least one it reaches."""

    def star(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        ids, root = roots_of(np.asarray(t.column("lo")), np.asarray(t.column("hi")))
        other = ids != root
        return pa.RecordBatch.from_arrays([pa.array(root[other]), pa.array(ids[other])], names=["lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CONTRACT:
                yield star(held)
                held, n = [], 0
        if n:
            yield star(held)

    return edges.mapInArrow(run, "lo long, hi long")


def connected_components(edges: DataFrame, kept: Kept, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): for each vertex (long) of an edge, the smallest vertex it can reach.

    Edges are contracted inside tasks, a bounded number at a time; then large-star and small-star rounds alternate (Kiveris
    et al., "Connected Components in MapReduce and Beyond"): each rewires edges towards smaller vertices, so that they end
    after O(log^2 n) rounds on any shape with no more edges than at the start. Neighbourhood minima are partial aggregates,
    so a hub is never gathered in one task. Self loops and repeated edges are allowed; null ends are dropped; no edges, no
    rows. Raises RuntimeError where max_rounds don't do.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).cast("long").alias("lo"), F.greatest(a, b).cast("long").alias("hi"))
    loops = kept.keep(e.where("lo = hi").select(F.col("lo").alias("id")).distinct(), "loops")
    e = kept.keep(contracted(e.where("lo < hi")), "contracted")
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: each vertex' greater neighbours are joined with its least one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: each vertex and its smaller neighbours are joined with the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.lo", "e.hi").where("lo <> hi").distinct()
        now = kept.keep(small, "star")
        # done where each vertex has one smaller neighbour and this has none
        shape = now.select(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("lo").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))).groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        settled = shape.where("up > 1 or (up = 1 and down > 0)").isEmpty()
        kept.drop(e)
        e = now
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    inner = e.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    ends = inner.unionByName(e.select(F.col("lo").alias("id"), F.col("lo").alias("component"))).unionByName(loops.select("id", F.col("id").alias("component")))
    out = kept.keep(ends.groupBy("id").agg(F.min("component").alias("component")), "components")
    kept.drop(e, loops)
    return out
