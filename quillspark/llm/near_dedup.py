"""Near-duplicate documents by chosen-path set similarity join (Christiani, Pagh and Sivertsen, "Scalable and Robust
Set Similarity Join").

Documents with equal shingle sets are one class. A class has SIGNATURE minwise tokens. In each of TREES independent trees
a node chooses one or two of the tokens' places by a hash of its path, and a class goes on to one child for each place
chosen, with the classes that have the same token there. Trees branch JUMP times at once, then the classes of each node are
counted: nodes of one class end there, nodes of up to SMALL are compared exhaustively. Larger nodes are first dealt to blocks
of that size, which joins a large group of near copies without its pairs; those whose classes aren't all joined then branch
again, or, where few classes are left over, compare those with all.

A comparison never lists a group's pairs. In the first round it keeps a spanning forest of the most alike pairs (Boruvka's
rounds) of a block, which is confirmed on the full shingle sets; the confirmed links give labels. In the second only classes
that may be near one of another label, by their signatures, get their sets, and a block's pairs of different labels are
compared on these inside its task, so that again a forest leaves it and is confirmed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import words as W
from quillspark.llm.workers import own
from quillspark.operators.components import connected_components
from quillspark.session import Kept

SIGNATURE = 128
TREES = 10
#: Trees of the first round: they join most of what is near.
FIRST_TREES = 3
SMALL = 1024
#: A node branches so many times before its children are counted: texts that are alike but not near part soon.
JUMP = 4
#: Countings at most; what is large then is compared in blocks of bounded size.
MAX_LEVELS = 4
#: A large node of which at most so many classes aren't joined with the others is finished by comparing those with all.
FEW = 64
BLOCK_ROWS = 512
#: Pairs that a task compares at once, and bytes of sets that a block of the second round may have.
PAIRS = 1 << 18
BLOCK_BYTES = 32 << 20
#: The estimate of a link may lie so many standard deviations below its similarity.
SIGMAS = 3.5

_U = np.uint64
_RNG = np.random.default_rng(42)
_MULT = _RNG.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * _U(2) + _U(1)
_ROOTS = _RNG.integers(1, 1 << 63, TREES, dtype=np.uint64)


def signatures(sets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Minwise tokens (8 bits) of each row's set; rows without shingles get zeros."""
    out = np.zeros((len(begins) - 1, SIGNATURE), np.uint8)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        at = begins[full]
        for k in range(SIGNATURE):
            out[full, k] = W.mix(np.minimum.reduceat(sets * _MULT[k], at)) >> _U(56)
    return out


def branch(node: np.ndarray, sig: np.ndarray, at: np.ndarray, second: float, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of sig, node) after so many branchings of (at, node); the places are chosen by the node alone."""
    for _ in range(times):
        c1, c2 = ((W.mix(node ^ _U(k)) % _U(SIGNATURE)).astype(np.int64) for k in (0x51ED270B, 0xA0761D65))
        more = np.flatnonzero((W.mix(node ^ _U(0xE7037ED1)) < _U(int(second * (1 << 64)))) & (c1 != c2))
        rows, children = [], []
        for take, c in ((np.arange(len(node)), c1), (more, c2[more])):
            token = sig[at[take], c].astype(np.uint64)
            rows.append(at[take])
            children.append(W.mix(node[take] * _U(3) + W.mix(token + (c.astype(np.uint64) << _U(32)) + _U(1))))
        at, node = np.concatenate(rows), np.concatenate(children)
    return at, node


def sig_matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(len(column), SIGNATURE) if len(column) else np.zeros((0, SIGNATURE), np.uint8)


def sketch_batches(k: int, inside: np.ndarray, cells: bool) -> object:
    """Arrow function of (id, text, others): id, n, cls, the signature or the shingles themselves, others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("near_dedup")
        for batch in batches:
            for lo, hi, data, offs in W.pieces(batch.column(1)):
                sets, begins = W.shingles(*W.hashes(data, offs, inside), k)
                cls = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(begins[:-1], begins[1:], strict=True)]
                last = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(sets.view(np.int64))) if cells else pa.array([s.tobytes() for s in signatures(sets, begins)], pa.binary())
                others = [c.slice(lo, hi - lo) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(begins)), pa.array(cls, pa.binary()), last, *others], names=["id", "n", "cls", "shingles" if cells else "sig", *batch.schema.names[2:]])

    return run


_FIELDS = [T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType())]


class Rule:
    """Which pairs of (size, signature) may be similar enough."""

    def __init__(self, percent: int):
        s = percent / 100
        self.percent, self.least = percent, SIGNATURE * (s - SIGMAS * math.sqrt(s * (1 - s) / SIGNATURE))
        self.second = max(0.0, 1 / (s * 0.94) - 1)

    def near(self, n: np.ndarray, sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which pairs pass, number of equal places of those)."""
        at = np.flatnonzero(100 * np.minimum(n[a], n[b]) >= self.percent * np.maximum(n[a], n[b]))
        same = np.zeros(len(at), np.int32)
        for lo in range(0, len(at), 1 << 14):
            q = at[lo : lo + (1 << 14)]
            same[lo : lo + (1 << 14)] = (sig[a[q]] == sig[b[q]]).sum(1)
        ok = same >= self.least
        return at[ok], same[ok]


def spanning_forest(a: np.ndarray, b: np.ndarray, order: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Indexes of the edges a-b of a spanning forest over the parts of vertices; an edge of lesser order comes first.

    Boruvka's rounds: each part takes its first edge to another part, until none is left.
    """
    if not len(a):
        return np.zeros(0, np.int64)
    _, part = np.unique(part, return_inverse=True)
    rank = np.empty(len(a), np.int64)
    rank[order] = np.arange(len(a))
    chosen, live = [], np.arange(len(a))
    while True:
        live = live[part[a[live]] != part[b[live]]]
        if not len(live):
            break
        best = np.full(part.max() + 1, len(a), np.int64)
        for end in (a, b):
            np.minimum.at(best, part[end[live]], rank[live])
        take = order[np.unique(best[best < len(a)])]
        chosen.append(take)
        root = np.arange(len(best))
        x, y = part[a[take]], part[b[take]]
        while True:  # hook parts that the taken edges join, least first
            lo = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, root[x], lo)
            np.minimum.at(root, root[y], lo)
            np.minimum.at(root, x, lo)
            np.minimum.at(root, y, lo)
            root = root[root]
            if (root == before).all():
                break
        part = root[part]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def by_block(rows: DataFrame, work: object, schema: str) -> DataFrame:
    """work(table) over the rows of whole blocks; rows are sorted by block, and the run at the end of a batch waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("near_dedup")
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            block = np.asarray(batch.column("block"))
            last = int(np.searchsorted(block, block[-1]))
            if last == 0 and (len(held) == 1 or held[-2].column("block")[-1].as_py() == block[-1]):
                continue  # one run so far
            yield work(pa.Table.from_batches([p for p in held[:-1] + [batch.slice(0, last)] if p.num_rows]).combine_chunks())
            held = [batch.slice(last)]
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "block").sortWithinPartitions("block", "rep").mapInArrow(run, schema)


class Blocks:
    """The pairs of different labels inside blocks whose signatures may be similar enough."""

    def __init__(self, t: pa.Table, rule: Rule):
        block, label = np.asarray(t.column("block")), np.asarray(t.column("label"))
        self.rep, self.n, self.sig, self.rule = np.asarray(t.column("rep")), np.asarray(t.column("n")), sig_matrix(t.column("sig")), rule
        self.starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        self.sizes = np.diff(np.append(self.starts, len(block)))
        inside = np.repeat(np.arange(len(self.starts)), self.sizes)
        self.part = np.unique(np.stack([inside, label], 1), axis=0, return_inverse=True)[1].ravel()

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, equal places) of the pairs of whole blocks, a bounded number at a time unless one block has more."""
        for s in np.unique(self.sizes[self.sizes > 1]).tolist():
            i, j = np.triu_indices(s, 1)
            at = self.starts[self.sizes == s]
            step = max(1, PAIRS // len(i))
            for lo in range(0, len(at), step):
                a, b = (at[lo : lo + step, None] + i).ravel(), (at[lo : lo + step, None] + j).ravel()
                other = self.part[a] != self.part[b]
                a, b = a[other], b[other]
                ok, same = self.rule.near(self.n, self.sig, a, b)
                yield a[ok], b[ok], same

    def forest(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
        """(rep, rep) of a spanning forest of the pairs, the most alike first."""
        keep = spanning_forest(a, b, np.lexsort((self.rep[b], self.rep[a], -same)), self.part)
        return np.stack([self.rep[a[keep]], self.rep[b[keep]]], 1)


def edge_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    x = np.unique(np.sort(np.concatenate(found), 1), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def first_forest(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) of a spanning forest of each block of rows (block, rep, n, sig, label), by signatures."""

    def work(t: pa.Table) -> pa.RecordBatch:
        blocks = Blocks(t, rule)
        return edge_batch([blocks.forest(*p) for p in blocks])

    return by_block(rows.select("block", "rep", "n", "label", "sig"), work, "a long, b long").distinct()


def undecided(rows: DataFrame, rule: Rule) -> DataFrame:
    """Those of rows (block, rep, n, sig, label) that may be near one of another label in their block."""

    def work(t: pa.Table) -> pa.RecordBatch:
        blocks = Blocks(t, rule)
        keep = np.zeros(t.num_rows, bool)
        for a, b, _ in blocks:
            keep[a] = keep[b] = True
        return t.select(["block", "rep", "n", "label"]).filter(pa.array(keep)).combine_chunks().to_batches(max_chunksize=None)[0] if keep.any() else pa.RecordBatch.from_pylist([], schema=t.select(["block", "rep", "n", "label"]).schema)

    return by_block(rows.select("block", "rep", "n", "label", "sig"), work, "block long, rep long, n long, label long")


def common(a: np.ndarray, b: np.ndarray, cells: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets a and b; sets are sorted runs of cells."""
    out = np.zeros(len(a), np.int64)
    order = np.argsort(a, kind="stable")
    size = np.diff(begins)
    cut = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1])) if len(a) else []
    for lo, hi in zip(cut, np.append(cut[1:], len(a)), strict=True) if len(a) else ():
        one = cells[begins[a[order[lo]]] : begins[a[order[lo]] + 1]]
        for k in range(lo, hi, 256):
            at = order[k : min(hi, k + 256)]
            other = b[at]
            ends = np.cumsum(size[other])
            take = np.arange(ends[-1]) + np.repeat(begins[other] - (ends - size[other]), size[other])
            values = cells[take]
            hit = one[np.minimum(np.searchsorted(one, values), len(one) - 1)] == values
            out[at] = np.add.reduceat(hit, ends - size[other], dtype=np.int64)
    return out


def second_forest(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) of a spanning forest of each block of rows (block, rep, n, sig, label, cells), by sets."""

    def work(t: pa.Table) -> pa.RecordBatch:
        blocks, found = Blocks(t, rule), []
        column = t.column("cells").combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        begins, cells = np.asarray(column.offsets).astype(np.int64), np.asarray(column.values).view(np.uint32)
        for a, b, same in blocks:
            both = common(a, b, cells, begins)
            ok = 100 * both >= rule.percent * (blocks.n[a] + blocks.n[b] - both)
            found.append(blocks.forest(a[ok], b[ok], same[ok]))
        return edge_batch(found)

    return by_block(rows.select("block", "rep", "n", "label", "sig", "cells"), work, "a long, b long").distinct()


def cross_blocks(rows: DataFrame) -> DataFrame:
    """(block, rep, label) in blocks of bounded size such that each pair of different labels meets in one.

    rows: (node, rep, label, size, top, main); main is the label that most of a node's classes have. Its classes are dealt to
    blocks, and every other class is sent to all blocks; where the others are many, they are cut into blocks as well.
    """
    nb = F.ceil(F.col("top") / BLOCK_ROWS).cast("int")
    nu = F.ceil((F.col("size") - F.col("top")) / BLOCK_ROWS).cast("int")
    is_main = F.col("label") == F.col("main")
    block = F.pmod(F.xxhash64("rep"), F.when(is_main, nb).otherwise(nu)).cast("int")
    to = lambda n: F.sequence(F.lit(0), n - 1)
    with_main = F.when(is_main, F.transform(to(nu), lambda j: F.struct(F.lit(0).alias("kind"), block.alias("i"), j.alias("j")))).otherwise(F.transform(to(nb), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), block.alias("j"))))
    among = F.when(~is_main & (nu > 1), F.transform(to(nu), lambda j: F.struct(F.lit(1).alias("kind"), F.least(block, j).alias("i"), F.greatest(block, j).alias("j"))))
    units = F.concat(with_main, F.coalesce(among, F.expr("cast(array() as array<struct<kind:int,i:int,j:int>>)")))
    return rows.select("node", "rep", "label", F.explode(units).alias("u")).select(F.xxhash64("node", "u.kind", "u.i", "u.j").alias("block"), "rep", "label").distinct()


class Join:
    """One similarity join: its tables, and the links confirmed so far."""

    def __init__(self, docs: DataFrame, kept: Kept, k: int, percent: int, doc_id: str, text: str, inside: np.ndarray, carry: tuple[str, ...] = ()):
        self.rule, self.kept, self.k, self.percent, self.inside = Rule(percent), kept, k, percent, inside
        self.docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("x"))
        self.carry = [f"carry_{c}" for c in carry]
        docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("x"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, self.carry, strict=True)])
        schema = T.StructType([*_FIELDS, T.StructField("sig", T.BinaryType()), *docs.schema.fields[2:]])
        self.rows = kept.keep(docs.mapInArrow(sketch_batches(k, inside, False), schema), "sketch")
        found = self.rows.where("n > 0 and id is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        # numbers of classes are written once and only read afterwards; ids may repeat, they may not
        self.classes = kept.keep(found.withColumn("rep", F.monotonically_increasing_id()), "classes")
        self.narrow = self.classes.select("rep", "n", "sig")
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def roots(self) -> DataFrame:
        """(tree, node, rep): the nodes of each class after the first JUMP branchings."""
        second = self.rule.second

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own("near_dedup")
            for b in batches:
                sig, rep = sig_matrix(b.column("sig")), np.asarray(b.column("rep"))
                for t, root in enumerate(_ROOTS):
                    at, child = branch(np.full(len(rep), root), sig, np.arange(len(rep)), second, JUMP)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(child.view(np.int64)), pa.array(rep[at])], names=["tree", "node", "rep"])

        return self.narrow.select("rep", "sig").mapInArrow(run, "tree int, node long, rep long")

    def deeper(self, nodes: DataFrame) -> DataFrame:
        """(node, rep) after JUMP more branchings."""
        second = self.rule.second

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own("near_dedup")
            for b in batches:
                rep, sig = np.asarray(b.column("rep")), sig_matrix(b.column("sig"))
                at, child = branch(np.asarray(b.column("node")).view(np.uint64), sig, np.arange(len(rep)), second, JUMP)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(rep[at])], names=["node", "rep"])

        return nodes.select("node", "rep").join(self.narrow.select("rep", "sig"), "rep").mapInArrow(run, "node long, rep long")

    def labelled(self, nodes: DataFrame) -> DataFrame:
        """nodes with a label: classes of one label are known to be joined."""
        return nodes.join(self.labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))

    def fetch(self, reps: DataFrame) -> DataFrame:
        """(rep, shingles) of classes, from the whole texts of the documents that stand for them."""
        wanted = self.classes.join(reps, "rep", "left_semi").select("id", "rep", F.col("cls").alias("wanted"))
        schema = T.StructType([*_FIELDS, T.StructField("shingles", T.ArrayType(T.LongType(), False))])
        texts = self.docs.hint("merge").join(wanted.select("id").distinct(), "id", "left_semi").select("id", "x")
        sets = texts.mapInArrow(sketch_batches(self.k, self.inside, True), schema)
        return sets.join(wanted, "id").where(F.col("cls") == F.col("wanted")).select("rep", "shingles").dropDuplicates(["rep"])

    def confirm(self, pairs: DataFrame, name: str) -> None:
        """Add those of the pairs whose full sets are similar enough: 100 * both >= percent * either; then label anew."""
        pairs = self.kept.keep(pairs, f"pairs-{name}")
        of = lambda c: self.sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}"))
        both = pairs.join(of("b"), "b").join(of("a"), "a").withColumn("i", F.size(F.array_intersect("sa", "sb")))
        sure = self.kept.keep(both.where(100 * F.col("i") >= self.percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b"), f"links-{name}")
        self.links = sure if self.links is None else self.links.unionByName(sure)
        self.labels = connected_components(self.links, self.kept).withColumnsRenamed({"id": "rep", "component": "label"})
        self.kept.drop(pairs)

    def with_sets(self, rows: DataFrame) -> DataFrame:
        """rows (block, rep, n, label) with signatures and cells, in blocks of at most about BLOCK_BYTES such that pairs still meet.

        Cells are the upper halves of the shingles' hashes; what passes on them is confirmed on the whole ones.
        """
        pieces = rows.groupBy("block").agg(F.ceil(4 * F.sum("n") / BLOCK_BYTES).cast("int").alias("p"))
        mine = F.pmod(F.xxhash64("rep"), F.col("p")).cast("int")
        units = F.when(F.col("p") == 1, F.array(F.col("block"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda j: F.xxhash64("block", F.least(mine, j), F.greatest(mine, j))))
        dealt = rows.join(pieces, "block").select(F.explode(units).alias("block"), "rep", "n", "label")
        cells = self.sets.select("rep", F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("cells"))
        return dealt.join(self.narrow.select("rep", "sig"), "rep").join(cells, "rep")

    def counted(self, nodes: DataFrame) -> DataFrame:
        """nodes with their size, of those with at least two classes."""
        return nodes.join(nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "node")

    def mixed(self, nodes: DataFrame) -> DataFrame:
        """Labelled nodes (node, rep, label) with size, top and main, of those whose classes aren't all joined."""
        rows = self.labelled(nodes)
        most = rows.groupBy("node", "label").agg(F.count("*").alias("c")).groupBy("node").agg(F.sum("c").alias("size"), F.max("c").alias("top"), F.max_by("label", F.struct("c", "label")).alias("main")).where("top < size")
        return rows.drop("size").join(most, "node")

    def run(self) -> None:
        kept = self.kept
        nodes = kept.keep(self.roots(), "nodes")
        live = kept.keep(self.counted(nodes), "live")
        kept.drop(nodes)
        self.sets = kept.keep(self.fetch(live.select("rep").distinct()), "sets")
        # first: a forest over few trees; large nodes by blocks, so that a large group of near copies is joined
        pieces = F.ceil(2 * F.col("size") / SMALL)
        block = F.when(F.col("size") <= SMALL, F.col("node")).otherwise(F.xxhash64("node", F.pmod(F.xxhash64("rep", "tree"), pieces)))
        first = live.where(F.col("tree") < FIRST_TREES).select(block.alias("block"), "rep", F.col("rep").alias("label"))
        self.confirm(first_forest(first.join(self.narrow, "rep"), self.rule), "first")
        # then: all trees, what isn't joined yet; large nodes branch on
        nodes, pools, done = live.select("node", "rep"), [], [live]
        for level in range(1, MAX_LEVELS + 1):
            left = kept.keep(self.mixed(nodes), f"left{level}")
            kept.drop(*done)
            large, few = F.col("size") > SMALL, F.col("size") - F.col("top") <= FEW
            few = few if level < MAX_LEVELS else F.lit(True)
            pools.append(left.where(~large).select(F.col("node").alias("block"), "rep", "label"))
            pools.append(cross_blocks(left.where(large & few)))
            deep = left.where(large & ~few)
            if deep.isEmpty():
                break
            deep = kept.keep(self.deeper(deep).distinct(), f"nodes{level + 1}")
            nodes, done = self.counted(deep), [deep]
        pool = pools[0]
        for p in pools[1:]:
            pool = pool.unionByName(p)
        rows = kept.keep(undecided(pool.join(self.narrow, "rep"), self.rule), "undecided")
        self.confirm(second_forest(self.with_sets(rows), self.rule), "second")
        kept.drop(rows, self.sets)

    def components(self) -> DataFrame:
        """(id, n_shingles, component_id, label) of each row of the documents; label is the component's own number."""
        of = self.classes.select("cls", "rep", "id").join(self.labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        least = of.groupBy("label").agg(F.min("id").alias("component"))
        out = self.rows.select("id", "n", "cls", *self.carry).join(of.join(least, "label").select("cls", "component", "label"), "cls", "left")
        return out.select("id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"), "label", *self.carry)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", inside: np.ndarray = W.NONSPACE, carry: tuple[str, ...] = (), group: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) and the columns to carry for each row of docs.

    A document's set: its distinct k-word shingles, A-Z lowered; of fewer words, the whole sequence as one. Documents are
    linked when the share of shingles in both is at least percent of those in either. component_id is the smallest doc_id
    reachable; kept where it is the document's own. Null and empty texts have no shingles and link with nothing; a null
    doc_id links with nothing and is kept. Copies of a text, repeated rows and ties share a component; rows that share an id
    but not a text are compared by their texts. Texts of any length are read whole. No rows, no rows. Other columns of docs
    are not read unless carried, whatever their names. Where ids repeat, two components can have one component_id: with
    `group`, a column of that name numbers components apart (null for rows without shingles).
    """
    join = Join(docs, Kept(docs.sparkSession, "near-dedup"), k, percent, doc_id, text, inside, carry)
    join.run()
    out = join.components()
    names = [F.col(n).alias(c) for c, n in zip(carry, join.carry, strict=True)]
    if group is not None:
        names.append(F.col("label").alias(group))
    return out.select(F.col("id").alias(doc_id), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), *names)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


QUERIES = {"op7_near_dedup": op7_near_dedup}

ORACLES = {
    "op7_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 2], ' ')) AS s FROM w, unnest(range(1, greatest(2, len(w) - 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep FROM (SELECT doc_id, sha256(string_agg(CAST(s AS VARCHAR), ',' ORDER BY s)) AS k FROM s GROUP BY doc_id)),
r AS (SELECT s.doc_id, s.s FROM s JOIN cls ON cls.doc_id = s.doc_id AND cls.rep = cls.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM r a JOIN r b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
pair AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach(a, b) AS (SELECT rep, rep FROM cls UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.c, w.doc_id) AS component_id, coalesce(comp.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN cls ON cls.doc_id = w.doc_id LEFT JOIN comp ON comp.a = cls.rep
""",
}
