"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within them.

Equal vectors of a label are one class with a count, so copies are never compared with each other. Centroids are
fitted by spherical k-means on a bounded sample; every class is then assigned. Two unit vectors of cosine s are
sqrt(2 - 2 s) apart, so a vector farther than that from the plane that halves two centroids has no partner beyond
it: each vector is also sent to the cells of lower number that it is near enough to, and so no link is lost.
A cell is cut into blocks and each pair of blocks is one product, in a group of bounded size however large the cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.components import connected_components
from quillspark.session import Kept

THRESHOLD = 0.93
#: Vectors that the centroids are fitted on at most, those of the least hash; vectors for each cell; cells at most.
SAMPLE = 8192
CELL_ROWS = 2048
MAX_CELLS = 1024
BLOCK_ROWS = 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centroids of unit vectors; empty cells keep their centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def as_matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def least_labels(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id that each row of a symmetric boolean matrix reaches."""
    lab = ids.copy()
    while True:
        new = np.minimum(lab, np.where(near, lab[None, :], np.iinfo(np.int64).max).min(1))
        if (new == lab).all():
            return lab
        lab = new


def link(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """vectors with n_links, component_id and kept.

    Vectors are compared when their labels are equal and not null and they have as many components. Null or zero vectors
    and those with null or non-finite components link with nothing, nor do rows without an id; such a row is its own
    component and kept. Repeated rows, and rows that share an id, are vectors of their own; of those that share the smallest
    id of a component all are kept. A cosine that ties with the threshold links. Columns that bear a result's name are
    replaced, all others stay, whatever their names. No rows, no rows.
    """
    spark = vectors.sparkSession
    kept = Kept(spark, "vector-dedup")
    new = ["n_links", "component_id", "kept"]
    given = [c for c in vectors.columns if c not in new]
    names = dict(zip(given, [f"given{i}" for i in range(len(given))], strict=True))
    vectors = vectors.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    vec_id, embedding, label = names[vec_id], names[embedding], names[label]
    back = [F.col(n).alias(c) for c, n in names.items()]
    v = F.col(f"`{embedding}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    ok = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))
    marked = vectors.withColumn("__v", F.when(ok, v))
    # classes have numbers of their own, written once: ids may repeat
    distinct = marked.where(F.col("__v").isNotNull()).groupBy(F.col(label).alias("label"), F.col("__v").alias("v")).agg(F.min(vec_id).cast("long").alias("least"), F.count("*").alias("m"))
    numbered = kept.keep(distinct.withColumn("dim", F.size("v")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    classes = numbered.select("label", "v", "rep", "m", "dim")
    n = classes.count()
    if not n:
        return vectors.select(*back, F.lit(0).cast("long").alias("n_links"), F.col(vec_id).cast("long").alias("component_id"), F.lit(True).alias("kept"))

    dim = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").head()["dim"]
    order = F.xxhash64("least", F.lit("sample"))
    sample = numbered.where(F.col("dim") == dim).orderBy(order, "least", "rep").limit(SAMPLE).select("v").toPandas()["v"]
    x = unit(np.stack(sample.to_list()).astype(np.float64))
    k = max(1, min(MAX_CELLS, len(x) // 4, -(-n // cell_rows)))
    value = spark.sparkContext.broadcast(spherical_kmeans(x, k))
    tau = math.sqrt(2 - 2 * threshold) + 1e-9

    def assign(batches):
        c = value.value
        apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-18))
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                fit = np.asarray(b.column("dim")) == c.shape[1]
                homes, rows, cells, home = np.full(b.num_rows, -1), [np.arange(b.num_rows)], [], []
                if fit.any():
                    near = unit(as_matrix(b.column("v").filter(pa.array(fit)))) @ c.T
                    best = near.argmax(1)
                    homes[fit] = best
                    margin = (near[np.arange(len(near)), best][:, None] - near) / apart[best]
                    at, cell = np.nonzero((margin <= tau) & (np.arange(c.shape[0])[None, :] < best[:, None]))
                    rows.append(np.flatnonzero(fit)[at])
                    cells.append(cell)
                cells = np.concatenate([homes, *cells])
                home = np.arange(len(cells)) < b.num_rows
                out = b.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells, pa.int32()), pa.array(home)], names=[*out.schema.names, "cell", "home"])

    rows = classes.mapInArrow(assign, "label int, v array<double>, rep long, m long, dim int, cell int, home boolean".replace("label int", f"label {classes.schema['label'].dataType.simpleString()}"))
    key = ["label", "dim", "cell"]
    rows = kept.keep(rows, "cells")
    sizes = rows.groupBy(*key).agg(F.ceil(F.sum(F.col("home").cast("long")) / block_rows).cast("int").alias("nh"), F.ceil(F.sum((~F.col("home")).cast("long")) / block_rows).cast("int").alias("nr"))
    placed = rows.join(sizes.where("nh > 0"), key)
    block = F.pmod(F.xxhash64("rep", F.lit("block")), F.when(F.col("home"), F.col("nh")).otherwise(F.col("nr"))).cast("int")
    placed = placed.withColumn("block", block)
    all_h, all_r = F.sequence(F.lit(0), F.col("nh") - 1), F.when(F.col("nr") > 0, F.sequence(F.lit(0), F.col("nr") - 1)).otherwise(F.expr("array()").cast("array<int>"))
    # a pair of blocks: (i, j, false) of the cell's own rows, i <= j; (i, j, true) of own rows i and rows j from other cells
    own = F.concat(
        F.transform(all_h, lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), F.lit(False).alias("far"))),
        F.transform(all_r, lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("far"))),
    )
    other = F.transform(all_h, lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(True).alias("far")))
    units = placed.select(*key, "rep", "m", "v", "home", "block", F.explode(F.when(F.col("home"), own).otherwise(other)).alias("u")).select(*key, "u.i", "u.j", "u.far", "rep", "m", "v", "home", "block")

    def compare(t: pa.Table) -> pa.Table:
        x, ids, m = unit(as_matrix(t.column("v").combine_chunks())), np.asarray(t.column("rep")), np.asarray(t.column("m"))
        home, block = np.asarray(t.column("home")), np.asarray(t.column("block"))
        i, j, far = (t.column(c)[0].as_py() for c in ("i", "j", "far"))
        left = home & (block == i)
        right = ~home if far else home & (block == j)
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        near = x[a] @ x[b].T >= threshold
        if not far and i == j:
            np.fill_diagonal(near, False)
        ra, rb = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        near, a, b = near[np.ix_(ra, rb)], a[ra], b[rb]
        count = {int(q): int(c) for q, c in zip(ids[a], near @ m[b], strict=True)}
        if far or i != j:
            for q, c in zip(ids[b], near.T @ m[a], strict=True):
                count[int(q)] = count.get(int(q), 0) + int(c)
        if len(a) + len(b):
            rows = np.concatenate([a, b])
            full = np.zeros((len(rows), len(rows)), bool)
            full[: len(a), len(a) :] = near
            full |= full.T
            if not far and i == j:  # the same rows on both sides
                full |= ids[rows][:, None] == ids[rows][None, :]
            root = dict(zip(ids[rows].tolist(), least_labels(full, ids[rows].astype(np.int64)).tolist(), strict=True))
        else:
            root = {}
        return pa.table({"id": pa.array(list(count), pa.int64()), "links": pa.array(list(count.values()), pa.int64()), "root": pa.array([root[q] for q in count], pa.int64())})

    found = kept.keep(units.groupBy(*key, "i", "j", "far").applyInArrow(compare, "id long, links long, root long"), "links")
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), kept)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = numbered.select("rep", "least").join(parts.withColumnRenamed("id", "rep"), "rep").select("rep", "component", "least")
    parts = of.select("rep", "component").join(of.groupBy("component").agg(F.min("least").alias("smallest")), "component").select(F.col("rep").alias("pid"), "smallest")
    per = numbered.join(links, numbered["rep"] == links["id"], "left").drop("id").join(parts, F.col("rep") == F.col("pid"), "left")
    per = per.where("m > 1 or links > 0").select(F.col("label").alias("__l"), F.col("v").alias("__w"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("__n"), F.coalesce("smallest", "least").alias("__c"))
    out = marked.join(per, (F.col("__v") == F.col("__w")) & (F.col(label) == F.col("__l")), "left")
    part = F.coalesce("__c", F.col(vec_id).cast("long"))
    return out.select(*back, F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.coalesce(F.col(vec_id) == part, F.lit(True)).alias("kept"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


QUERIES = {"op10_vector_dedup": op10_vector_dedup}

ORACLES = {
    "op10_vector_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON comp.vec_id = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM pair GROUP BY a) p ON p.a = v.vec_id
""",
}
