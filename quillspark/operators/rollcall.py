"""Roll calls in transcripts: regions where a clerk reads names, who answered which, and whether a region can be believed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.search import words_of
from quillspark.session import Kept

#: Words that a member answers with; a parameter of who transcribes.
ANSWERS = ("aye", "yes", "yea", "yay", "no", "nay", "here", "present", "abstain", "i", "yep", "yup")
#: Turns between two calls of one region at most; turns after the last call that may still answer; it can't be more.
MAX_GAP, TAIL = 8, 3
#: A clerk calls so many names at least; a region names so many members at least, and binds so many answers.
CLERK_CALLS, REGION_MEMBERS, BINDINGS = 2, 3, 3
#: Voices that answer may be so many more than members.
SLACK = 1
#: Similarities from which motions are looked for before lower ones; sizes of texts in a band differ by this factor at most.
FLOORS, BAND = (0.9, 0.8), 1.1
EPS = 1e-6


def regions(turns: DataFrame, meeting: str, index: str, cluster: str, subject: str, answer: str, max_gap: int = MAX_GAP, tail: int = TAIL, clerk_calls: int = CLERK_CALLS, members: int = REGION_MEMBERS) -> DataFrame:
    """(meeting, region, index, cluster, kind, subject): the calls and answers of each roll-call region.

    turns: one row a turn, numbered inside the meeting; subject is the member that a turn names (null: none), answer
    whether it is a short answer. Calls with at most max_gap turns between them are a group; the clerks of a group are the
    clusters with clerk_calls calls in it at least. A group whose clerks call fewer than `members` distinct members is no
    region. Its calls are the clerks', its answers the answers of all other clusters from the first call to `tail` turns
    after the last. region is the index of the first call. Turns without a cluster call and answer nothing. Everything is
    a window or a count by meeting, in order of turns; no turn meets another.
    """
    if tail > max_gap:
        raise ValueError("the tail of a region must not reach into the next")
    t = turns.select(F.col(meeting).alias("m"), F.col(index).alias("i"), F.col(cluster).alias("c"), F.col(subject).alias("s"), F.coalesce(F.col(answer), F.lit(False)).alias("a")).where("m is not null and i is not null and c is not null")
    order = Window.partitionBy("m").orderBy("i")
    call = F.col("s").isNotNull()
    before = F.last(F.when(call, F.col("i")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = call & (before.isNull() | (F.col("i") - before > max_gap))
    t = t.withColumn("g", F.sum(begins.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    calls = t.where("s is not null")
    clerks = calls.groupBy("m", "g", "c").agg(F.count("*").alias("n")).where(F.col("n") >= clerk_calls).drop("n")
    read = calls.join(clerks, ["m", "g", "c"], "left_semi")
    found = read.groupBy("m", "g").agg(F.countDistinct("s").alias("k"), F.min("i").alias("first"), F.max("i").alias("last")).where(F.col("k") >= members).drop("k")
    inside = t.join(found, ["m", "g"]).where(F.col("i").between(F.col("first"), F.col("last") + tail))
    inside = inside.join(clerks.withColumn("clerk", F.lit(True)), ["m", "g", "c"], "left")
    kind = F.when(F.col("clerk") & F.col("s").isNotNull(), "call").when(F.col("clerk").isNull() & F.col("a"), "answer")
    return inside.withColumn("kind", kind).where("kind is not null").select(F.col("m").alias(meeting), F.col("first").alias("region"), F.col("i").alias(index), F.col("c").alias(cluster), "kind", F.when(F.col("kind") == "call", F.col("s")).alias(subject))


def bindings(found: DataFrame, meeting: str, index: str, cluster: str, subject: str) -> DataFrame:
    """(meeting, region, call, subject, answer, cluster): each call with the first answer before the next call."""
    w = Window.partitionBy(meeting, "region").orderBy(index)
    last = F.last(F.when(F.col("kind") == "call", F.struct(F.col(index).alias("i"), F.col(subject).alias("s"))), ignorenulls=True).over(w)
    answers = found.withColumn("__c", last).where("kind = 'answer' and __c is not null")
    first = answers.groupBy(meeting, "region", F.col("__c.i").alias("call")).agg(F.min(F.struct(F.col(index).alias("i"), F.col("__c.s").alias("s"), F.col(cluster).alias("c"))).alias("b"))
    return first.select(meeting, "region", "call", F.col("b.s").alias(subject), F.col("b.i").alias("answer"), F.col("b.c").alias(cluster))


def accepted(found: DataFrame, meeting: str, index: str, cluster: str, subject: str, votes: DataFrame | None = None, least: int = BINDINGS, slack: int = SLACK) -> DataFrame:
    """(meeting, region, cluster, subject, bound): names for the clusters of the regions that can be believed.

    A region is believed if at least `least` answers are bound, no cluster answers to two members and no member is answered
    for by two clusters, and its distinct voices are at most its members and slack: those of the vote it is for, from
    votes (meeting, region, n_members), else the members called. bound counts the answers of the pair.
    """
    pairs = bindings(found, meeting, index, cluster, subject)
    per = pairs.groupBy(meeting, "region").agg(F.count("*").alias("bound"), F.countDistinct(cluster).alias("voices"), F.countDistinct(subject).alias("named"), F.countDistinct(cluster, subject).alias("links"))
    size = found.groupBy(meeting, "region").agg(F.countDistinct(F.when(F.col("kind") == "call", F.col(subject))).alias("called"), F.countDistinct(F.when(F.col("kind") == "answer", F.col(cluster))).alias("heard"))
    per = per.join(size, [meeting, "region"])
    limit = F.col("called")
    if votes is not None:
        per = per.join(votes.select(meeting, "region", "n_members"), [meeting, "region"], "left")
        limit = F.coalesce("n_members", "called")
    good = (F.col("bound") >= least) & (F.col("links") == F.col("voices")) & (F.col("links") == F.col("named")) & (F.col("heard") <= limit + slack)
    return pairs.join(per.where(good).select(meeting, "region"), [meeting, "region"]).groupBy(meeting, "region", cluster, subject).agg(F.count("*").alias("bound"))


def match_motions(spoken: DataFrame, votes: DataFrame, meeting: str, turn: str, text: str, vote: str, motion: str, floor: float = 0.7, kept: Kept | None = None) -> DataFrame:
    """(meeting, turn, vote, similarity): the vote whose motion is worded most like what was said, if one alone is.

    The similarity is twice the distinct words in both by the distinct words of each (Dice). A turn whose best vote ties with
    another, or stays below the floor, is matched with nothing. Repeated turns and votes (same id) count once; nulls match
    nothing.

    Two sets of a and b words at or above a floor have o = floor * (a + b) / 2 words in common, so they share one of the first
    a - o + 1 of the one and b - o + 1 of the other in any order common to both. The order puts words first by which fewest
    turns and votes of the meeting meet, those of one side alone before all others. Turns look for votes of each band of
    sizes apart, so that only as many words are tried as that size needs; and from high floors to low ones, each for the turns
    that found nothing above it, since a vote found at a floor is better than all below. A pair counts where the word it met by
    is the first that both have, so that it counts once and nothing is kept to tell repeats. Kept belongs to the caller.
    """
    kept = kept or Kept(spoken.sparkSession, "motions")
    words = lambda df, key, column: df.where(F.col(meeting).isNotNull() & F.col(key).isNotNull()).select(F.col(meeting).alias("m"), F.col(key).alias("k"), F.array_distinct(words_of(F.col(column))).alias("w")).where(F.size("w") > 0).dropDuplicates(["m", "k"])
    a, b = kept.keep(words(spoken, turn, text), "spoken"), kept.keep(words(votes, vote, motion), "motions")
    each = lambda df: df.select("m", "k", F.explode("w").alias("x"))
    often = each(a).select("m", "x", F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(each(b).select("m", "x", F.lit(0).alias("p"), F.lit(1).alias("q"))).groupBy("m", "x").agg((F.sum("p") * F.sum("q")).alias("c"))
    often = kept.keep(often, "often")

    def in_order(df: DataFrame, name: str) -> DataFrame:
        lists = each(df).join(often.hint("merge"), ["m", "x"]).groupBy("m", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("l"))
        return kept.keep(lists.select("m", "k", "l", F.size("l").alias("n"), F.floor(F.log(F.size("l")) / math.log(BAND) + EPS).cast("int").alias("band")), name)

    a, b = in_order(a, "spoken-order"), in_order(b, "motions-order")
    bands = b.groupBy("m", "band").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    found = None
    for least in [f for f in FLOORS if f > floor] + [floor]:
        left = a.drop("band") if found is None else a.drop("band").join(found.select("m", F.col("a").alias("k")).hint("merge"), ["m", "k"], "left_anti")
        both = lambda x, y, least=least: F.ceil((x + y) * least / 2 - EPS)
        head = lambda n, o: F.explode(F.slice("l", F.lit(1), (n - o + 1).cast("int"))).alias("x")
        sized = left.join(bands, "m").withColumn("o", both(F.col("n"), F.col("least"))).where((F.col("o") <= F.col("n")) & (F.col("o") <= F.col("most")))
        seek = sized.select("m", "band", F.col("k").alias("a"), F.col("l").alias("la"), head(F.col("n"), F.col("o")))
        own = F.ceil(F.col("n") * (least / (2 - least)) - EPS)  # the fewest words in common with a set of any size
        held = b.select("m", "band", F.col("k").alias("b"), F.col("l").alias("lb"), head(F.col("n"), own))
        met = seek.hint("merge").join(held, ["m", "band", "x"]).withColumn("i", F.array_intersect("la", "lb")).where(F.col("i")[0] == F.col("x"))
        alike = met.select("m", "a", "b", F.round(2 * F.size("i") / (F.size("la") + F.size("lb")), 9).alias("s")).where(F.col("s") >= least)
        top = alike.groupBy("m", "a", "s").agg(F.count("*").alias("n"), F.max("b").alias("b")).groupBy("m", "a").agg(F.max(F.struct("s", "n", "b")).alias("t"))
        now = kept.keep(top.select("m", "a", F.col("t.s").alias("s"), F.col("t.n").alias("n"), F.col("t.b").alias("b")), "best")
        found = now if found is None else found.unionByName(now)
    return found.where("n = 1").select(F.col("m").alias(meeting), F.col("a").alias(turn), F.col("b").alias(vote), F.col("s").alias("similarity"))


def attributed(matches: DataFrame, movers: DataFrame, meeting: str, vote: str, cluster: str, subject: str) -> DataFrame:
    """(meeting, cluster, subject, n): clusters that spoke the motions of one mover alone; n motions.

    matches: (meeting, vote, cluster) of spoken motions; movers: (meeting, vote, subject). A cluster whose motions were moved
    by several subjects, or a subject whose motions several clusters spoke, is attributed nothing.
    """
    both = matches.hint("merge").join(movers.where(F.col(subject).isNotNull()), [meeting, vote])
    pairs = both.groupBy(meeting, cluster, subject).agg(F.countDistinct(vote).alias("n"))
    one = lambda key, other: pairs.groupBy(meeting, key).agg(F.countDistinct(other).alias("__others")).where("__others = 1").select(meeting, key)
    return pairs.join(one(cluster, subject), [meeting, cluster]).join(one(subject, cluster), [meeting, subject]).select(meeting, cluster, subject, "n")
