"""Routing, pooling, vetting and clean-up steps around search, voices and the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import display
from quillspark.functions import vectors as V
from quillspark.functions.text import fiscal_year, squeeze
from quillspark.operators import linking
from quillspark.operators.components import connected_components
from quillspark.operators.ordering import ranked
from quillspark.session import Kept


def thresholds(rows: DataFrame, score: str, kept: Kept, points: int = 80) -> DataFrame:
    """(threshold): distinct exact percentiles at evenly spaced points, the least and the largest score among them.

    Scores get their place in ranges; two places for each point, between which the percentile lies, reach the driver.
    """
    placed = ranked(rows.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("x")), [F.col("x")], kept)
    n = placed.agg(F.max("rank")).head()[0] or 0
    at = [i / (points - 1) * (n - 1) for i in range(points)] if n else []
    wanted = sorted({int(a) + k for a in at for k in (1, 2)})
    value = {r["rank"]: r["x"] for r in placed.where(F.col("rank").isin(wanted)).collect()} if at else {}  # 2 * points at most
    found = {round(value[int(a) + 1] + (value.get(int(a) + 2, value[int(a) + 1]) - value[int(a) + 1]) * (a - int(a)), 6) for a in at}
    return rows.sparkSession.createDataFrame([(x,) for x in sorted(found)], "threshold double")


def vet_positives(samples: DataFrame, label: str, item: str, vector: str, floor: float = 0.40) -> DataFrame:
    """(item, label, score, kept): cosine with the mean direction of the label's own samples; below the floor it isn't kept."""
    mine = samples.where(F.col(label).isNotNull())
    c = V.mean_vectors(mine.select(label, V.unit(F.col(vector)).alias(vector)), [label], vector)
    score = F.round(V.cosine(F.col(vector), F.col("centroid")), 6)
    return mine.join(c, label).select(item, label, score.alias("score")).withColumn("kept", F.col("score") >= floor)


def quarantine(negatives: DataFrame, centroids: DataFrame, item: str, vector: str, twin: float, near: float) -> DataFrame:
    """(item, label, score, state) of negatives by their closest person: quarantined as a twin, near, or clean.

    centroids: (label, centroid), one for each person.
    """
    best = linking.closest(negatives, centroids, [item], vector, 6)
    state = F.when(F.col("score") >= twin, "quarantined").when(F.col("score") >= near, "near").otherwise("clean")
    return best.withColumn("state", state)


def pool(ranked: DataFrame, judged: DataFrame, query: str, item: str, rank: str, depth: int = 20) -> DataFrame:
    """(query, item) of the first `depth` of every arm that aren't judged yet, each once."""
    return ranked.where(F.col(rank) <= depth).select(query, item).distinct().join(judged.select(query, item), [query, item], "left_anti")


INTENTS = [(r"(?i)\bbudget(?:ed)?\b.*\bactual\b|\bactual\b.*\bbudget", "budget_vs_actual"), (r"(?i)\brevenues?\b|\bincome\b", "revenue"), (r"(?i)\bspen[dt]\w*\b|\bexpenditures?\b|\bcosts?\b", "expenditure")]


def route(queries: DataFrame, query: str) -> DataFrame:
    """queries with intent (or 'text' for the text path) and the label of the fiscal year that they name."""
    return queries.withColumns({"intent": display.first_rule(F.col(query), INTENTS, "text"), "fiscal_year": fiscal_year(F.col(query))})


def render(figures: DataFrame, year: str, name: str, amount: str, citation: str) -> DataFrame:
    """figures with evidence: one line with the year, the name, the dollars and the citation."""
    return figures.withColumn("evidence", F.concat(F.col(year).cast("string"), F.lit(" "), F.col(name), F.lit(": "), display.usd(F.col(amount)), F.lit(" ["), F.col(citation), F.lit("]")))


def merged_variants(hits: DataFrame, query: str, item: str, variant: str, rank: str) -> DataFrame:
    """(query, item, place): hits of the variants of a query one list after another, repeats dropped."""
    first = hits.groupBy(query, item).agg(F.min(F.struct(variant, rank)).alias("f"))
    return first.select(query, item, F.row_number().over(Window.partitionBy(query).orderBy("f", item)).alias("place"))


def reranked(hits: DataFrame, query: str, item: str, score: str, rrf: str) -> DataFrame:
    """hits with place: by the reranker's score where all of a query's hits have one, else in the order of fusion."""
    w = Window.partitionBy(query)
    whole = F.count(score).over(w) == F.count("*").over(w)
    marked = hits.withColumn("by", F.when(whole, F.col(score)).otherwise(F.col(rrf)))
    return marked.withColumn("place", F.row_number().over(w.orderBy(F.desc("by"), item))).drop("by")


def enrollable(clusters: DataFrame, officials: DataFrame, person: str, confidence: str, basis: str, seconds: str, strong: list[str], bases: list[str], least: float) -> DataFrame:
    """Clusters that may be enrolled: strong confidence, a basis that isn't a voice, long enough, and an official's."""
    ok = F.col(confidence).isin(*strong) & F.col(basis).isin(*bases) & (F.col(seconds) >= least)
    return clusters.where(ok).join(officials.select(person), person, "left_semi")


def components_of_signals(rows: DataFrame, item: str, signals: list[list[Column]], kept: Kept) -> DataFrame:
    """(item, component): rows that agree in all columns of a signal are joined, over all signals; a null is no agreement.

    Each group of a signal is a star around its least item, so no pairs are listed.
    """
    edges = None
    for columns in signals:
        names = [f"k{i}" for i in range(len(columns))]
        keyed = rows.select(F.col(item).alias("b"), *[c.alias(n) for c, n in zip(columns, names, strict=True)]).dropna(subset=names)
        star = keyed.groupBy(*names).agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
        links = keyed.join(star, names).where("a <> b").select("a", "b")
        edges = links if edges is None else edges.unionByName(links)
    parts = connected_components(edges, kept).withColumnRenamed("id", "__id")
    return rows.join(parts, rows[item] == F.col("__id"), "left").select(item, F.coalesce("component", item).alias("component"))


def twins(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(html_id, pdf_id) of allowed pairs that hold: both current, extensions as expected, the PDF's text longer."""
    of = lambda p: docs.select(F.col("id").alias(f"{p}_id"), F.col("file").alias(f"{p}_file"), F.col("length").alias(f"{p}_length"), F.col("replaces_id").alias(f"{p}_replaced"))
    both = pairs.join(of("html"), "html_id").join(of("pdf"), "pdf_id")
    ok = F.col("html_replaced").isNull() & F.col("pdf_replaced").isNull() & F.col("html_file").rlike(r"(?i)\.html?$") & F.col("pdf_file").rlike(r"(?i)\.pdf$") & (F.col("pdf_length") > F.col("html_length"))
    return both.where(ok).select("html_id", "pdf_id")


def mention_edges(refs: DataFrame, cited: DataFrame) -> DataFrame:
    """(matter, chunk, citation_id) once for each matter that a chunk with a citation id names."""
    return refs.join(cited.where(F.col("citation_id").isNotNull()).select("chunk", "citation_id"), "chunk").select("matter", "chunk", "citation_id").distinct()


def name_only(turns: DataFrame, index: DataFrame, text: str, phrase: str) -> DataFrame:
    """Turns that say a known phrase and nothing else, with its subject."""
    bare = squeeze(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}# ]", " "))
    return turns.withColumn(phrase, bare).join(index, phrase)


def rosters(rows: DataFrame, slug: str, name: str, body: str) -> DataFrame:
    """(slug, name, bodies): one person for each slug, the first name in order, with the sorted list of its bodies (few)."""
    return rows.groupBy(slug).agg(F.min(name).alias(name), F.array_sort(F.collect_set(body)).alias("bodies"))


def stale(stored: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that a new load doesn't hold."""
    return stored.join(now.select(*keys), keys, "left_anti")


def spread(rows: DataFrame, subject: str, item: str, seed: str, kept: Kept) -> DataFrame:
    """rows with place: a fixed shuffle by a hash; a subject's rows lie a whole round apart, so that none follow each other
    while another subject is left. Both orders are told in ranges, so neither all rows nor a subject's are one task's."""
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.col(item).cast("string")))
    rounds = ranked(rows.select("*", mixed.alias("__mixed")), [F.col("__mixed"), F.col(item)], kept, out="__round", by=[subject])
    order = [F.col("__round"), F.md5(F.concat_ws(":", F.lit(seed), F.col(subject).cast("string"))), F.col(subject)]
    return ranked(rounds, order, kept, out="place").drop("__round", "__mixed")


def valid_chapters(rows: DataFrame, chapters: str, length: str) -> DataFrame:
    """rows with chapters: of a JSON array of {"t": seconds, "title": text} those with whole seconds within the length and a
    title, one for each second, in order; null for what isn't JSON."""
    parsed = F.from_json(F.col(chapters), "array<struct<t:int,title:string>>")
    good = F.filter(parsed, lambda c: c["t"].isNotNull() & (c["t"] >= 0) & (c["t"] < F.col(length)) & (F.trim(c["title"]) != ""))
    ordered = F.array_sort(good)
    once = F.filter(ordered, lambda c, i: (i == 0) | (c["t"] != F.get(ordered, i - 1)["t"]))
    return rows.withColumn(chapters, once)


def mintable(refs: DataFrame, known: DataFrame, number: str, margin: int) -> DataFrame:
    """refs whose number has as many digits as some known one and lies within the known range of that length, give or take."""
    n = known.select(F.length(F.col(number).cast("string")).alias("digits"), number).groupBy("digits").agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    r = refs.withColumn("digits", F.length(F.col(number).cast("string")))
    return r.join(F.broadcast(n), "digits").where(F.col(number).between(F.col("lo") - margin, F.col("hi") + margin)).select(*refs.columns)  # a row for each number of digits


def canonicalised(rows: DataFrame, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """rows with canonical (the text, each mangled name replaced) and audits (array of (start, raw, canonical), code points of
    the raw text). Longer rules come first, matches are whole words in any case over any white space and don't overlap."""
    order = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    escaped = lambda m: r"\s+".join(r"\Q" + w + r"\E" for w in m.split())
    pattern = r"(?i)\b(?:" + "|".join(escaped(m) for m, _ in order) + r")\b"
    target = F.create_map(*[F.lit(x) for m, c in reversed(order) for x in (" ".join(m.lower().split()), c)])
    found, pieces = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), F.split(F.col(text), pattern, -1)
    steps = F.zip_with(found, pieces, lambda m, p: F.struct(m.alias("raw"), p.alias("before")))
    start = F.expr("named_struct('at', 0, 'text', '', 'audits', cast(array() as array<struct<start:int,raw:string,canonical:string>>))")

    def add(acc: Column, s: Column) -> Column:
        new = F.element_at(target, squeeze(F.lower(s["raw"])))
        at = acc["at"] + F.char_length(s["before"])
        audit = F.struct(at.alias("start"), s["raw"].alias("raw"), new.alias("canonical"))
        step = F.struct((at + F.char_length(s["raw"])).alias("at"), F.concat(acc["text"], s["before"], new).alias("text"), F.concat(acc["audits"], F.array(audit)).alias("audits"))
        return F.when(s["raw"].isNull(), F.struct(acc["at"].alias("at"), F.concat(acc["text"], s["before"]).alias("text"), acc["audits"].alias("audits"))).otherwise(step)

    done = F.aggregate(steps, start, add)
    return rows.withColumn("__c", done).select("*", F.col("__c.text").alias("canonical"), F.col("__c.audits").alias("audits")).drop("__c")


def logit_scores(pairs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """pairs with logit and probability under a frozen calibrator; a missing feature makes both null."""
    z = F.lit(bias)
    for column, w in weights.items():
        z = z + F.lit(w) * F.col(column)
    return pairs.withColumn("logit", z).withColumn("probability", 1 / (1 + F.exp(-F.col("logit"))))


def pair_counts(rows: DataFrame, node: str, truth: str, condition: str) -> DataFrame:
    """One row of pairwise counts within and across conditions: same node, same truth, both. Counts of groups stand for the pairs."""

    def pairs(keys: list[str]) -> DataFrame:
        n = F.col("n")
        return rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n")).agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).cast("long").alias("p"))

    out = None
    for name, keys in (("node", [node]), ("truth", [truth]), ("both", [node, truth])):
        for where, more in (("all", []), ("within", [condition])):
            one = pairs([*keys, *more]).withColumnRenamed("p", f"{name}_{where}")
            out = one if out is None else out.join(one)
    return out.select(*[c for n in ("node", "truth", "both") for c in (F.col(f"{n}_within"), (F.col(f"{n}_all") - F.col(f"{n}_within")).alias(f"{n}_across"))])
