"""Reads of an archive: current documents, feeds, votes, rosters, dossiers and their lists. DataFrames in, a DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import squeeze
from quillspark.operators.graph import within


def current(docs: DataFrame) -> DataFrame:
    """Documents that none replaces: replaces_id stands on the old row and names the new one."""
    return docs.where(F.col("replaces_id").isNull())


def named_like(docs: DataFrame, name: str, pattern: str) -> DataFrame:
    return docs.where(F.col(name).ilike(pattern))


def scoped(docs: DataFrame, **wanted) -> DataFrame:
    """Rows that have each wanted value; None is no condition, a list is any of its values."""
    for column, value in wanted.items():
        if value is not None:
            docs = docs.where(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return docs


def newest(docs: DataFrame, n: int, day: str = "day", key: str = "id") -> DataFrame:
    """The n newest rows; rows without a day come last, equal days by key."""
    return docs.orderBy(F.desc_nulls_last(day), F.asc(key)).limit(n)


def recent(docs: DataFrame, kinds: list, since: Column | None, n: int) -> DataFrame:
    out = scoped(current(docs), kind=kinds)
    return newest(out if since is None else out.where(F.col("day") >= since), n)


def meeting_bundle(docs: DataFrame, body, day: Column, kinds: list) -> DataFrame:
    """Current documents of one body and day, of the given kinds."""
    return scoped(current(docs), body=body, kind=kinds).where(F.col("day") == day)


def guarded(figures: DataFrame, namespace: str, basis: str, rules: dict[str, str]) -> DataFrame:
    """Figures of a guarded namespace only with the basis that it needs; other namespaces are left out."""
    ok = F.lit(False)
    for name, needed in rules.items():
        ok = ok | ((F.col(namespace) == name) & (F.col(basis) == needed))
    return figures.where(ok)


def publishable(edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """Edges whose projection is complete and whose subject may be shown."""
    shown = subjects.where("publishable").select("subject_id")
    return edges.where("projection_complete").join(shown, "subject_id", "left_semi")


def verbatim(chunks: DataFrame, sources: DataFrame, key: str, chunk: str, text: str) -> DataFrame:
    """chunks with verbatim: whether the source holds the chunk once white space is single blanks; null without a source."""
    return chunks.join(sources.select(key, text), key, "left").withColumn("verbatim", F.contains(squeeze(F.col(text)), squeeze(F.col(chunk)))).drop(text)


def without_minors(clusters: DataFrame, turns: DataFrame, cue: str, cluster: str = "cluster", text: str = "text", evidence: str = "evidence") -> DataFrame:
    """Clusters where neither anything said nor the evidence matches the cue."""
    hit = turns.where(F.col(text).rlike(cue)).select(cluster).distinct()
    return clusters.where(~F.coalesce(F.col(evidence).rlike(cue), F.lit(False))).join(hit, cluster, "left_anti")


def longest_per(rows: DataFrame, by: list[str], size: str, key: str, n: int, least: float = 0.0) -> DataFrame:
    """The n largest rows of each group, at least that large; ties by key."""
    w = Window.partitionBy(*by).orderBy(F.desc(size), F.asc(key))
    return rows.where(F.col(size) >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def cited_timeline(edges: DataFrame, subjects: DataFrame, docs: DataFrame, votes: DataFrame) -> DataFrame:
    """(subject, document_id, vote_ref, edge, day, outcome) of edges whose document is current and whose vote exists."""
    out = edges.join(subjects.select("subject_id", "subject"), "subject_id").join(current(docs).select(F.col("id").alias("document_id"), "day"), "document_id")
    return out.join(votes.select("document_id", "vote_ref", "outcome"), ["document_id", "vote_ref"]).select("subject", "document_id", "vote_ref", "edge", "day", "outcome")


def seated_votes(votes: DataFrame, members: DataFrame) -> DataFrame:
    """Votes of members that sit on the body that owns the vote."""
    return votes.join(members.select("member", "body"), ["member", "body"], "left_semi")


def enriched(rows: DataFrame, docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the document's columns, '' where there is none."""
    out = rows.join(docs.select(key, *columns), key, "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def roster(memberships: DataFrame, subjects: DataFrame, people: DataFrame) -> DataFrame:
    """(body, subject_id, role, slug): the public slug of the person, else that of the subject."""
    out = memberships.join(subjects.select("subject_id", "person_id", F.col("slug").alias("own")), "subject_id")
    return out.join(people.select("person_id", "slug"), "person_id", "left").select("body", "subject_id", "role", F.coalesce("slug", "own").alias("slug"))


def votes_of_current(votes: DataFrame, docs: DataFrame, body, n: int) -> DataFrame:
    """The newest n votes of a body's current documents; votes of replaced documents go with them."""
    mine = scoped(current(docs), body=body).select(F.col("id").alias("document_id"), "day")
    return newest(votes.join(mine, "document_id"), n, "day", "vote_id")


def clusters_between(turns: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """(window_id, cluster, first): clusters that speak in the half-open window, by their first turn. Windows of a key are few."""
    hit = turns.join(windows, key).where((F.col("start") < F.col("until")) & (F.col("end") > F.col("since")))
    return hit.groupBy("window_id", "cluster").agg(F.min("start").alias("first"))


def unanimous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) where all rows of the key agree; conflicts are dropped."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.countDistinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def vote_maps(edges: DataFrame) -> DataFrame:
    """(vote_id, members, matters): sorted lists over edges (vote_id, kind, target). A vote has few of either."""
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("target"))))
    return edges.groupBy("vote_id").agg(pick("member").alias("members"), pick("matter").alias("matters"))


def member_summary(votes: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    return votes.groupBy(*by).agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def dossier(memberships: DataFrame) -> DataFrame:
    """(person, body, terms, since, until, open): a person's terms on each body; an open term leaves the end open."""
    out = memberships.groupBy("person", "body").agg(F.count("*").alias("terms"), F.min("start").alias("since"), F.max("end").alias("last"), F.max(F.col("end").isNull().cast("int")).alias("o"))
    return out.select("person", "body", "terms", "since", F.when(F.col("o") == 0, F.col("last")).alias("until"), (F.col("o") == 1).alias("open"))


def meeting_list(docs: DataFrame, flags: dict[str, str], preferred: list[str]) -> DataFrame:
    """(body, day, a flag for each kind, summary_id): the summary is the document of the kind preferred most, then of the least id."""
    rank = F.lit(len(preferred))
    for k in range(len(preferred) - 1, -1, -1):
        rank = F.when(F.col("kind") == preferred[k], k).otherwise(rank)
    best = F.min(F.when(F.col("kind").isin(*preferred), F.struct(rank.alias("rank"), F.col("id").alias("id"))))
    return docs.where(F.col("day").isNotNull()).groupBy("body", "day").agg(*[F.bool_or(F.col("kind") == k).alias(n) for n, k in flags.items()], best.alias("b")).select("body", "day", *flags, F.col("b.id").alias("summary_id"))


def tally(calls: DataFrame, by: list[str], vote: str, words: dict[str, str]) -> DataFrame:
    """How often each answer was given in a roll call."""
    return calls.groupBy(*by).agg(*[F.sum((F.col(vote) == w).cast("long")).alias(n) for n, w in words.items()])


def inferred_result(t: DataFrame, stated: str, ayes: str, noes: str) -> DataFrame:
    """t with result, ayes and noes: what is stated beats what is counted, a tie gives none, and where both disagree the
    counts are null."""
    counted = F.when(F.col(ayes) > F.col(noes), "passed").when(F.col(ayes) < F.col(noes), "failed")
    clash = F.col(stated).isNotNull() & counted.isNotNull() & (F.col(stated) != counted)
    agreed = lambda c: F.when(~F.coalesce(clash, F.lit(False)), F.col(c))
    return t.withColumns({"result": F.coalesce(F.col(stated), counted), ayes: agreed(ayes), noes: agreed(noes)})


def fixed_order(rows: DataFrame, key: str, order: list[str], then: list[str], place: str = "place") -> DataFrame:
    """rows whose key is in a fixed order, numbered by it and then by other columns; groups without rows leave no gap."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(key))
    return rows.where(F.col(key).isin(*order)).withColumn(place, F.row_number().over(Window.orderBy(at, *then)))


def even_sample(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """At most n rows of each group at even distances, the first and the last among them."""
    w = Window.partitionBy(*by)
    out = rows.withColumn("k", F.row_number().over(w.orderBy(order)) - 1).withColumn("m", F.count("*").over(w))
    # the j-th sample stands at round(j * (m - 1) / (n - 1))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.floor((2 * j * (F.col("m") - 1) + (n - 1)) / (2 * (n - 1))).cast("int"))
    return out.where((F.col("m") <= n) | F.array_contains(picks, F.col("k").cast("int"))).drop("k", "m")


def run_delta(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, now, change): gained, lost or changed between two runs; equal rows are left out."""
    both = before.select(key, F.col(value).alias("before")).join(now.select(key, F.col(value).alias("now")), key, "full_outer")
    change = F.when(F.col("before").isNull(), "gained").when(F.col("now").isNull(), "lost").otherwise("changed")
    return both.where(~F.col("before").eqNullSafe(F.col("now"))).withColumn("change", change)


def roll_union(heard: DataFrame, by: str, called: str, answered: str) -> DataFrame:
    """(by, present, silent): who answered to any reader, and who was called by one and answered to none."""
    out = heard.groupBy(by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(answered)))).alias("present"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(called)))).alias("c"))
    return out.select(by, "present", F.array_except("c", "present").alias("silent"))


def tier_recall(scored: DataFrame, tiers: list[str], tier: str = "tier", right: str = "right") -> DataFrame:
    """(tier, n, recall) of each fixed tier, those without rows too (recall null)."""
    spark = scored.sparkSession
    every = spark.createDataFrame([(t,) for t in tiers], f"{tier} string")
    found = scored.groupBy(tier).agg(F.count("*").alias("n"), F.sum(F.col(right).cast("long")).alias("ok"))
    return every.join(found, tier, "left").select(tier, F.coalesce("n", F.lit(0)).alias("n"), F.round(F.col("ok") / F.col("n"), 6).alias("recall"))


def cluster_verdict(frames: DataFrame, cluster: list[str], label: str, least: int) -> DataFrame:
    """(cluster, label, frames): the label that at least so many frames bear, if no other label is borne by as many."""
    n = frames.groupBy(*cluster, label).agg(F.count("*").alias("frames")).where(F.col("frames") >= least)
    return n.withColumn("rivals", F.count("*").over(Window.partitionBy(*cluster))).where("rivals = 1").drop("rivals")


def label_caps(verdicts: DataFrame, document: str, label: str, most: int) -> DataFrame:
    """(document, label, clusters) where a label wins more clusters of a document than one voice can have."""
    return verdicts.groupBy(document, label).agg(F.count("*").alias("clusters")).where(F.col("clusters") > most)


def benchmark_shape(rows: DataFrame, label: str, meeting: str, condition: str) -> DataFrame:
    """One row: labels, labels of several meetings, labels of several conditions, samples."""
    each = rows.groupBy(label).agg(F.countDistinct(meeting).alias("m"), F.countDistinct(condition).alias("c"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("labels"), F.sum((F.col("m") > 1).cast("long")).alias("recurring"), F.sum((F.col("c") > 1).cast("long")).alias("cross_condition"), F.sum("n").alias("samples"))


def token_profile(rows: DataFrame, by: str, tokens: str, top: int) -> DataFrame:
    """(by, token, rate, z): rates of the `top` most frequent tokens in each group and their distance from the mean over groups."""
    t = rows.select(by, F.explode(tokens).alias("token"))
    counts = t.groupBy(by, "token").agg(F.count("*").alias("c"))
    vocabulary = counts.groupBy("token").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "token").limit(top).select("token")
    groups = counts.groupBy(by).agg(F.sum("c").alias("all"))
    grid = groups.join(F.broadcast(vocabulary)).join(counts, [by, "token"], "left").select(by, "token", (F.coalesce("c", F.lit(0)) / F.col("all")).alias("rate"))
    over = grid.groupBy("token").agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("sd"))
    return grid.join(F.broadcast(over), "token").select(by, "token", "rate", F.when(F.col("sd") > 0, (F.col("rate") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("z"))


def cross_foot(cells: DataFrame, row: str, column: str, value: str, row_totals: DataFrame) -> DataFrame:
    """(row, total, stated, gap): sums over a row's columns against the stated total of the row."""
    sums = cells.groupBy(row).agg(F.sum(value).alias("total"), F.countDistinct(column).alias("columns"))
    return sums.join(row_totals, row, "full_outer").withColumn("gap", F.coalesce("total", F.lit(0)) - F.coalesce("stated", F.lit(0)))


def roll_forward(years: DataFrame, by: list[str], year: str, opening: str, change: str) -> DataFrame:
    """years with expected (the opening balance of the year before plus its change, if that year is there) and ok."""
    w = Window.partitionBy(*by).orderBy(year)
    before = F.lag(F.struct(F.col(year).alias("y"), (F.col(opening) + F.col(change)).alias("v"))).over(w)
    out = years.withColumn("b", before).withColumn("expected", F.when(F.col("b.y") == F.col(year) - 1, F.col("b.v"))).drop("b")
    return out.withColumn("ok", F.col("expected").isNull() | (F.col("expected") == F.col(opening)))


def arm_means(scores: DataFrame, arms: int, query: str = "query", arm: str = "arm", value: str = "value") -> DataFrame:
    """(arm, queries, mean) over the queries that every arm has scored; null scores leave the mean."""
    full = scores.groupBy(query).agg(F.countDistinct(arm).alias("n")).where(F.col("n") == arms).select(query)
    return scores.join(full, query, "left_semi").groupBy(arm).agg(F.count("*").alias("queries"), F.avg(value).alias("mean"))


def best_above(points: DataFrame, floors: list[float], guard: str, score: str, key: str) -> DataFrame:
    """(floor, key, score): for each floor the point of most score whose guard reaches it; ties by key; none where none does."""
    f = points.sparkSession.createDataFrame([(x,) for x in floors], "floor double")
    hit = points.join(F.broadcast(f), F.col(guard) >= F.col("floor"))
    return hit.groupBy("floor").agg(F.max_by(F.struct(key, score), F.struct(F.col(score), -F.col(key))).alias("b")).select("floor", "b.*")


def caps_per(rows: DataFrame, group: str, document: str, order: list[Column], per_document: int, per_group: int) -> DataFrame:
    """Evidence of a group: at most so many rows of a document, and of these at most so many in all."""
    some = rows.withColumn("d", F.row_number().over(Window.partitionBy(group, document).orderBy(*order))).where(F.col("d") <= per_document)
    return some.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= per_group).drop("d")


def verdict_actions(verdicts: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """verdicts (key, label) against stored (key, label, locked): insert, agree, conflict, or guarded where a person has decided."""
    old = stored.select(*key, F.col("label").alias("old"), "locked")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("old") == F.col("label"), "agree").when(F.col("locked"), "guarded").otherwise("conflict")
    return verdicts.join(old, key, "left").withColumn("action", action)


def supersession_plan(members: DataFrame, component: str, keys: list[Column]) -> DataFrame:
    """(id, replaces_id): every other member of a component is replaced by the one that the keys put first."""
    w = Window.partitionBy(component).orderBy(*keys)
    return members.withColumn("replaces_id", F.first("id").over(w)).where("id <> replaces_id").select("id", "replaces_id")


def trusted_dates(docs: DataFrame, trusted: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the calendar: distinct (body, day) of trusted provenance, documents whose day isn't trusted and not in the calendar)."""
    calendar = docs.where(F.col("provenance").isin(*trusted) & F.col("day").isNotNull()).select("body", "day").distinct()
    rest = docs.where(~F.coalesce(F.col("provenance").isin(*trusted), F.lit(False)) & F.col("day").isNotNull())
    return calendar, rest.join(calendar, ["body", "day"], "left_anti")


def redated(docs: DataFrame, inferred: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """docs with the day of the better provenance: an inferred one only where its rank is strictly higher."""
    rank = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), c), F.lit(0))
    both = docs.join(inferred.select("id", F.col("day").alias("new_day"), F.col("provenance").alias("new_provenance")), "id", "left")
    better = F.col("new_day").isNotNull() & (rank(F.coalesce("new_provenance", F.lit(""))) > rank(F.coalesce("provenance", F.lit(""))))
    pick = lambda c: F.when(better, F.col(f"new_{c}")).otherwise(F.col(c))
    return both.withColumns({"day": pick("day"), "provenance": pick("provenance"), "redated": better}).drop("new_day", "new_provenance")


def wholesale_failure(runs: DataFrame, by: str, outcome: str) -> DataFrame:
    """(by, failed) of runs where something failed and nothing else happened."""
    out = runs.groupBy(by).agg(F.sum((F.col(outcome) == "failed").cast("long")).alias("failed"), F.count("*").alias("n"))
    return out.where((F.col("failed") > 0) & (F.col("failed") == F.col("n"))).select(by, "failed")


def unresolved_queue(resolved: DataFrame) -> DataFrame:
    return resolved.where("status <> 'resolved'")


def canonical_chunks(old: DataFrame, new: DataFrame, text: str = "text") -> DataFrame:
    """old (doc, index, text) with new_index: the only new chunk of the document with the text; of several the one at the same
    index; else none."""
    norm = lambda c: squeeze(F.col(c))
    n = new.select(F.col("doc"), norm(text).alias("t"), F.col("index").alias("j"))
    hits = old.select("doc", "index", norm(text).alias("t")).join(n, ["doc", "t"]).groupBy("doc", "index").agg(F.count("*").alias("n"), F.min("j").alias("only"), F.max(F.when(F.col("j") == F.col("index"), F.col("j"))).alias("same"))
    return old.select("doc", "index").join(hits, ["doc", "index"], "left").select("doc", "index", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("same")).alias("new_index"))


def coverage_lag(events: DataFrame, by: str, day: str, posted: str) -> DataFrame:
    """(by, first_day, last_day, days, mean_lag): the window a source covers, and the days until its rows are posted."""
    return events.groupBy(by).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.countDistinct(day).alias("days"), F.avg(F.datediff(posted, day)).alias("mean_lag"))


def surfaces(ngrams: DataFrame, key: str, surface: str, count: str) -> DataFrame:
    """(key, surface, n, total, tokens): of spellings of one key the most frequent one wins, then the first in order."""
    out = ngrams.groupBy(key).agg(F.min_by(surface, F.struct(-F.col(count), F.col(surface))).alias(surface), F.max(count).alias("n"), F.sum(count).alias("total"))
    return out.withColumn("tokens", F.size(F.split(F.col(key), " ")))


def longest_only(found: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Spans of a text that lie in no longer span of it, in one pass over each text's spans in order.

    In the order of starts, the longest first, a span lies in another if and only if an earlier one ends no sooner.
    """
    w = Window.partitionBy(by).orderBy(F.asc(start), F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("reach", F.max(end).over(w)).where(F.col("reach").isNull() | (F.col("reach") < F.col(end))).drop("reach")


def transcript(turns: DataFrame, identities: DataFrame, shown: list[str]) -> DataFrame:
    """turns with the speaker's name where the identity may be published, else the cluster's own label."""
    names = identities.where(F.col("confidence").isin(*shown) & F.col("name").isNotNull()).select("cluster", "name")
    return turns.join(names, "cluster", "left").withColumn("speaker", F.coalesce("name", F.concat(F.lit("Speaker "), F.col("cluster").cast("string")))).drop("name")
