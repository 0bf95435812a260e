"""Deduplication and versions of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators.components import connected_components
from quillspark.session import Kept

MAX_HOPS = 16
#: Places whose counts put the tokens of a prefix in order (a power of two); they are broadcast.
COUNTS = 1 << 18
#: Cells of a set's sketch, a byte each (a power of two).
SKETCH = 128
#: Documents with equal sets that are one list.
COPIES = 1_024


def exact_duplicates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(content_hash, n, first_id) of texts that occur more than once, white space apart."""
    return docs.groupBy(X.content_hash(F.col(text)).alias("content_hash")).agg(F.count("*").alias("n"), F.min(doc_id).alias("first_id")).where("n > 1")


def _flat(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a column of arrays, the row of each, and each row's number of them."""
    flat, n = np.asarray(tokens.flatten(), np.int64), np.diff(np.asarray(tokens.offsets))
    return flat, np.repeat(np.arange(len(n)), n), n


def token_counts(classes: DataFrame) -> np.ndarray:
    """How many sets hold the tokens that fall into each of COUNTS places: tokens share one, so that it stays bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0] & COUNTS - 1, minlength=COUNTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    got = classes.select("tokens").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTS, np.int64)
    out[np.asarray(got.column("k"))] = np.asarray(got.column("n"))
    return out


def prefixes(classes: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(id, bucket, n, prefix, sketch): the rarest n - ceil(n * percent / 100) + 1 tokens of each set, rarest first, and how many
    of all its tokens fall into each of SKETCH cells, a byte each; empty where a cell holds more than a byte can tell."""
    value = classes.sparkSession.sparkContext.broadcast(counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                flat, row, n = _flat(batch.column(2))
                flat = flat[np.lexsort((flat, value.value[flat & COUNTS - 1], row))]
                at = np.concatenate([[0], np.cumsum(n)])
                keep = n + (-n * percent) // 100 + 1
                inside = np.arange(len(flat)) - at[row] < keep[row]
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32()), pa.array(flat[inside]))
                cells = np.bincount(row * SKETCH + (flat >> 40 & SKETCH - 1), minlength=len(n) * SKETCH).reshape(-1, SKETCH)
                sketch = pa.array([c.astype(np.uint8).tobytes() if c.max() < 256 else b"" for c in cells], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), prefix, sketch], names=["id", "bucket", "n", "prefix", "sketch"])

    rows = classes.select("id", "bucket", "tokens")
    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, bucket long, n int, prefix array<long>, sketch binary")


def may_agree(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, na, nb, sa, sb) that their sketches leave possible: two sets have at most the sum of the lesser
    cells in common, so that no pair that agrees by percent is lost."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (np.asarray(batch.column(k), np.int64) for k in ("na", "nb"))
            sa, sb = (batch.column(k).to_pylist() for k in ("sa", "sb"))
            told = np.array([bool(x and y) for x, y in zip(sa, sb, strict=True)], bool)
            most = np.minimum(na, nb)
            cells = lambda x: np.frombuffer(b"".join(v for v, t in zip(x, told, strict=True) if t), np.uint8).reshape(-1, SKETCH)
            most[told] = np.minimum(cells(sa), cells(sb)).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * most >= percent * (na + nb)))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(bound, f"a {kind}, b {kind}")


def near_duplicate_classes(docs: DataFrame, doc_id: str, text: str, bucket: list[str], percent: int, least: int, kept: Kept) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of one bucket with equal sets of tokens as classes: (id, h) of the documents, (h, k, id, n) of the classes with
    their least id and number of documents, and (ka, kb, jaccard) of the classes that agree by at least percent.

    Rows lacking a bucket field don't take part. A set join by prefixes: two such sets share one of the first
    n - ceil(n * percent / 100) + 1 tokens of both in any common order, so that only those are joined, not all pairs of a
    bucket. The order puts frequent tokens last, by counts of places that tokens share by their hash. At the first token that
    two sets share, enough must be left of both; then sketches of fixed size meet, and only the pairs that these leave fetch
    their whole sets, so that what is moved for a pair that doesn't agree is small. Texts are read once: what is kept are sets
    of 64-bit token hashes.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0)))
    rows = docs.dropna(subset=bucket).select(F.col(doc_id).alias("id"), F.xxhash64(*bucket).alias("bucket"), F.concat_ws("\x1f", *bucket).alias("names"), F.array_sort(tokens).alias("w")).where(F.size("w") >= least)
    rows = kept.keep(rows.select("id", "bucket", F.sha2(F.concat_ws(" ", "names", F.array_join("w", " ")), 256).alias("h"), "names", F.transform("w", lambda t: F.xxhash64(t)).alias("tokens")), "sets")
    first = [F.first(c).alias(c) for c in ("bucket", "names", "tokens")]
    classes = rows.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("n"), *first).withColumn("k", F.monotonically_increasing_id())  # written, so that numbers stay
    classes = kept.keep(classes, "classes")
    sets = classes.select(F.col("k").alias("id"), "bucket", "tokens")
    cut = kept.keep(prefixes(sets, token_counts(sets), percent), "prefixes")
    prefix = cut.select("id", "bucket", "n", F.posexplode("prefix").alias("p", "token"))
    a, b = prefix.alias("a"), prefix.alias("b")
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.id") < F.col("b.id"))
    left = F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p"))
    fits = (100 + percent) * left >= percent * (F.col("a.n") + F.col("b.n"))
    cand = a.hint("merge").join(b, on & fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    side = lambda c: cut.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    cand = kept.keep(may_agree(cand.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b"), percent), "candidates")
    of = lambda c: classes.select(F.col("k").alias(c), F.col("names").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))
    both = cand.join(of("a"), "a").join(of("b"), "b").where("na = nb").withColumn("i", F.size(F.array_intersect("ta", "tb"))).withColumn("u", F.size("ta") + F.size("tb") - F.col("i"))
    agree = both.where(100 * F.col("i") >= percent * F.col("u")).select(F.col("a").alias("ka"), F.col("b").alias("kb"), F.round(F.col("i") / F.col("u"), 6).alias("jaccard"))
    return rows.select("id", "h"), classes.select("h", "k", "id", "n"), agree


def near_duplicate_pairs(docs: DataFrame, doc_id: str, text: str, bucket: list[str], percent: int = 85, least: int = 30, copies: int = COPIES) -> DataFrame:
    """(a, b, jaccard), a < b, of all documents of one bucket whose distinct tokens agree by at least percent; each needs `least` tokens.

    Classes of equal sets are compared (near_duplicate_classes); their documents are then put together, those of one class
    with each other and with those of every class that agrees. Pairs of n copies are n squared; lists of about `copies` of
    them meet, two lists in a row, so that no task holds a class and the lists of a large one are spread over the tasks.
    """
    kept = Kept(docs.sparkSession, "near-pairs")
    rows, classes, agree = near_duplicate_classes(docs, doc_id, text, bucket, percent, least, kept)
    lists = F.ceil(F.col("n") / copies).cast("int")
    members = rows.join(classes.select("h", "k", lists.alias("m")), "h").groupBy("k", F.pmod(F.xxhash64("id"), "m").cast("int").alias("list")).agg(F.collect_list("id").alias("ids"))
    members = kept.keep(members, "members")
    m = lambda c: classes.select(F.col("k").alias(f"k{c}"), lists.alias(f"m{c}"))
    met = agree.join(m("a"), "ka").join(m("b"), "kb").unionByName(classes.where("n > 1").select(F.col("k").alias("ka"), F.col("k").alias("kb"), F.lit(1.0).alias("jaccard"), lists.alias("ma"), lists.alias("mb")))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    met = met.select("*", each("ma").alias("i")).select("*", each("mb").alias("j")).where("ka <> kb or i <= j")
    of = lambda k, at, ids: members.select(F.col("k").alias(k), F.col("list").alias(at), F.col("ids").alias(ids))
    met = met.join(of("ka", "i", "xs"), ["ka", "i"]).join(of("kb", "j", "ys"), ["kb", "j"])
    one = (F.col("ka") == F.col("kb")) & (F.col("i") == F.col("j"))
    pairs = met.select("jaccard", one.alias("one"), F.explode("xs").alias("x"), "ys").select("jaccard", "one", "x", F.explode("ys").alias("y")).where("x < y or (x > y and not one)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def near_duplicate_links(docs: DataFrame, doc_id: str, text: str, bucket: list[str], percent: int = 85, least: int = 30) -> DataFrame:
    """(a, b): links that join the same documents as near_duplicate_pairs does; copies hang on the least id of their class."""
    rows, classes, agree = near_duplicate_classes(docs, doc_id, text, bucket, percent, least, Kept(docs.sparkSession, "near-links"))
    of = lambda c: classes.select(F.col("k").alias(f"k{c}"), F.col("id").alias(c))
    copies = rows.select(F.col("id").alias("b"), "h").join(classes.where("n > 1").select("h", F.col("id").alias("a")), "h").where("a <> b")
    return agree.join(of("a"), "ka").join(of("b"), "kb").select("a", "b").unionByName(copies.select("a", "b"))


def duplicate_clusters(links: DataFrame, ids: DataFrame, kept: Kept, doc_id: str) -> DataFrame:
    """(doc_id, cluster): each document's cluster over the links (a, b); unlinked documents are their own."""
    parts = connected_components(links, kept).withColumnRenamed("id", "__id")
    return ids.join(parts, ids[doc_id] == F.col("__id"), "left").select(F.col(doc_id), F.coalesce("component", doc_id).alias("cluster"))


def canonical_pick(rows: DataFrame, cluster: str, order: list[Column]) -> DataFrame:
    """The first row of each cluster in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(cluster).orderBy(*order))).where("__n = 1").drop("__n")


def resolve_versions(docs: DataFrame, doc_id: str = "id", replaces: str = "replaces_id", hops: int = MAX_HOPS) -> DataFrame:
    """(id, canonical_id, superseded): follow the pointer that an old version holds to the new one.

    A cycle, a dangling pointer or more than `hops` steps give the row itself, not superseded. Pointers are doubled each
    round (after r rounds a row knows its place 2^r steps on), so there are log2(hops) joins, none of them over paths.
    """
    known = docs.select(F.col(doc_id).alias("id"), F.col(replaces).alias("to"))
    at = known.select("id", F.coalesce("to", "id").alias("at"), F.col("to").isNotNull().cast("int").alias("steps"), F.col("to").isNull().alias("done"))
    span = 1
    while span <= hops:  # one round beyond, which tells that the last row reached is an end
        step = at.select(F.col("id").alias("__at"), F.col("at").alias("__next"), F.col("steps").alias("__more"), F.col("done").alias("__done"))
        at = at.join(step, F.col("at") == F.col("__at"), "left").select(
            "id",
            F.when(F.col("done"), F.col("at")).otherwise(F.col("__next")).alias("at"),
            F.when(F.col("done"), F.col("steps")).otherwise(F.col("steps") + F.col("__more")).alias("steps"),
            (F.col("done") | F.coalesce("__done", F.lit(False))).alias("done"),
        )
        span *= 2
    fine = F.coalesce(F.col("done") & F.col("at").isNotNull() & (F.col("steps") <= hops), F.lit(False))
    return at.select("id", F.when(fine, F.col("at")).otherwise(F.col("id")).alias("canonical_id"), (fine & (F.col("at") != F.col("id"))).alias("superseded"))


def identity_ladder(incoming: DataFrame, stored: DataFrame, scope: str = "entity_id") -> DataFrame:
    """Match each incoming document with a stored one: by source_ref, else by content_hash unless refs contradict, else by file name.

    Adds match_id, match_by and action: new, skipped (same content), updated (a new version).
    """
    def one(key: str) -> DataFrame:
        return stored.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(scope, key).agg(F.max_by(F.struct("id", "content_hash", "source_ref"), "id").alias(f"by_{key}"))

    out = incoming
    for key in ("source_ref", "content_hash", "source_file"):
        out = out.join(one(key), [scope, key], "left")
    clash = F.coalesce((F.col("by_content_hash.source_ref") != F.col("source_ref")) & (F.col("source_ref") != "") & (F.col("by_content_hash.source_ref") != ""), F.lit(False))
    by_hash = F.when(~clash, F.col("by_content_hash"))
    match = F.coalesce("by_source_ref", by_hash, "by_source_file")
    how = F.when(F.col("by_source_ref").isNotNull(), "source_ref").when(by_hash.isNotNull(), "content_hash").when(F.col("by_source_file").isNotNull(), "source_file")
    action = F.when(match.isNull(), "new").when(match["content_hash"] == F.col("content_hash"), "skipped").otherwise("updated")
    return out.select(*incoming.columns, match["id"].alias("match_id"), how.alias("match_by"), action.alias("action"))


def three_way(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, action): insert, update, stale or same, by comparing two snapshots."""
    a = old.select(*key, F.struct(*values).alias("__old"))
    b = new.select(*key, F.struct(*values).alias("__new"))
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "stale").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("update")
    return a.join(b, key, "full_outer").select(*key, action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], locked: Column | None = None) -> DataFrame:
    """old with new's rows put in by key; rows of old for which locked holds keep their values."""
    cols = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*cols).alias("__old"), (F.lit(False) if locked is None else F.coalesce(locked, F.lit(False))).alias("__locked"))
    both = a.join(new.select(*key, F.struct(*cols).alias("__new")), key, "full_outer")
    row = F.when(F.coalesce("__locked", F.lit(False)) | F.col("__new").isNull(), F.col("__old")).otherwise(F.col("__new"))
    return both.select(*key, row.alias("__row")).select(*key, "__row.*")


def draft_final_pairs(docs: DataFrame, group: list[str], kind: Column, doc_id: str) -> DataFrame:
    """(group, draft_id, final_id) where there is just one draft and one final."""
    draft, final = kind == "draft", kind == "final"
    out = docs.groupBy(*group).agg(F.sum(draft.cast("int")).alias("d"), F.sum(final.cast("int")).alias("f"), F.min(F.when(draft, F.col(doc_id))).alias("draft_id"), F.min(F.when(final, F.col(doc_id))).alias("final_id"))
    return out.where("d = 1 and f = 1").drop("d", "f")


def chunk_ordinals(chunks: DataFrame, document: str, text: str, order: str) -> DataFrame:
    """chunks with the ordinal of each among its document's equal passages, by appearance."""
    w = Window.partitionBy(document, X.citation_form(F.col(text))).orderBy(order)
    return chunks.withColumn("ordinal", F.row_number().over(w) - 1)
