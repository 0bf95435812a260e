"""Votes from minutes: blocks of lines, and two kinds of prose; the form is told for each document, and what was missed counted.

Line minutes are tables of (document, line): running windows in order of lines carry the state (which motion, which vote word),
so a document is never walked by itself and one of any length is sorted, not held. Prose is cut at the words that open a
motion. Results that are stated beat those that are counted; a tie decides nothing; where both give counts and they differ,
there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines above a mover that may be its motion, and below it that may hold its votes and result.
MOTION_LINES, RESULT_LINES = 14, 30
#: Words with which a motion begins, labels that are none, titles of members: parameters of who writes the minutes.
CUES = ("move", "motion", "approve", "adopt", "accept", "authorize", "ratify", "award", "adjourn", "convene", "recess", "direct", "appoint", "amend", "table", "that")
LABELS = ("contact", "description", "recommendation", "information", "action", "discussion")
TITLES = ("Mayor Pro Tempore", "Mayor Pro Tem", "Acting Mayor", "Councilmember", "Alderman", "Alderwoman", "Mayor")
#: Words of results and votes, and what they stand for.
RESULTS = {"carried": "passed", "carries": "passed", "passed": "passed", "passes": "passed", "approved": "passed", "adopted": "passed", "failed": "failed", "fails": "failed", "defeated": "failed", "did not pass": "failed", "tabled": "tabled", "withdrawn": "withdrawn"}
VOTES = {"aye": "aye", "ayes": "aye", "yes": "aye", "nay": "no", "nays": "no", "no": "no", "abstain": "abstain", "abstained": "abstain", "abstention": "abstain", "absent": "absent", "present": "present"}
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")

_VOTE = "|".join(sorted(VOTES, key=len, reverse=True))
_RESULT = "carried|carries|passed|passes|failed|fails|defeated|tabled|withdrawn"
_TALLY = r"([0-9]+)\s*-\s*([0-9]+)(?:\s*-\s*([0-9]+))?"
_WHO = "(?:" + "|".join(TITLES) + r")\s+[A-Z][A-Za-z.'-]*"


def _map(words: dict[str, str], value: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), F.regexp_replace(F.lower(value), r"\s+", " "))


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is none or it is empty."""
    return F.get(F.filter(F.array(F.trim(F.regexp_extract(text, pattern, group))), lambda v: v != ""), 0)  # nullif would match twice


def _once(rows: DataFrame, *columns: str | Column, **values: Column) -> DataFrame:
    """rows with these columns and values, each computed once a row: filters on them aren't moved below, nor expressions copied."""
    made = rows.select(*columns, *[v.alias(k) for k, v in values.items()])
    return made.select(F.explode(F.array(F.struct(*made.columns))).alias("o")).select("o.*")


def decide(stated: Column, given: list[Column], counted: list[Column], rolled: Column) -> dict[str, Column]:
    """result, basis, yes, no, abstain: stated by word, or counted; given counts are printed ones, counted those of the roll."""
    derived = F.when(rolled & (counted[0] > counted[1]), "passed").when(rolled & (counted[1] > counted[0]), "failed")
    differ = given[0].isNotNull() & rolled & ((given[0] != counted[0]) | (given[1] != counted[1]))
    count = [F.when(~F.coalesce(differ, F.lit(False)), F.coalesce(g, F.when(rolled, c), F.when(given[0].isNotNull(), F.lit(0)) if k == 2 else F.lit(None))) for k, (g, c) in enumerate(zip(given, counted, strict=True))]
    return {"result": F.coalesce(stated, derived), "basis": F.when(stated.isNotNull(), "stated").otherwise("derived"), **{n: c.cast("int") for n, c in zip(("yes", "no", "abstain"), count, strict=True)}}


def line_votes(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, motion_no, motion, moved_by, seconded_by, result, basis, yes, no, abstain) of minutes with 'Moved by:' lines.

    The motion is the run of lines right above the mover from the first that begins with a cue, or the whole run if none
    does; runs end at section numbers, labels and lines of other blocks. Votes stand below: 'Name-aye, Name-no' in one
    line, or a vote word and then names until the next. The first line that states a result ends the block. Blocks without a
    motion of three words or without a result are left out. Null texts have none; rows of one doc are one document.
    """
    line = F.regexp_replace(F.trim(F.regexp_replace(F.col("raw"), r"\s+", " ")), "[​﻿]", "")
    rows = docs.select(F.col(doc).alias("d"), F.posexplode(F.split(F.col(text), "\n")).alias("n", "raw"))
    rows = _once(rows, "d", "n", x=line).where(F.col("x") != "").where(~F.col("x").rlike(r"(?i)^page \d+ of \d+$")).repartition("d")
    x = F.col("x")
    kind = (
        F.when(x.rlike(r"(?i)^moved by: ?\S"), "mover")
        .when(x.rlike(r"(?i)^seconded by: ?\S"), "second")
        .when(x.rlike(rf"(?i)^(?:motion )?(?:{_RESULT})\b[ .]*(?:{_TALLY})?\.?$") | x.rlike(r"(?i)^(?:the votes were )?all ayes?\.?$"), "result")
        .when(x.rlike(rf"(?i)^(?:votes: ?)?[^,]+- ?(?:{_VOTE})(?: ?, ?[^,]+- ?(?:{_VOTE}))+\.?$"), "roll")
        .when(x.rlike(rf"(?i)^(?:{_VOTE})\b ?(?::|$)"), "header")
        .when(x.rlike(r"^[0-9]+(?:\.[0-9]+)*\.?$") | x.rlike(rf"(?i)^(?:{'|'.join(LABELS)}) ?:"), "stop")
        .otherwise("text")
    )
    at = lambda k: F.when(F.col("kind") == k, F.col("n"))
    so_far = Window.partitionBy("d").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("kind", kind).withColumn("block", F.count(at("mover")).over(so_far)).withColumn("mover", F.last(at("mover"), ignorenulls=True).over(so_far))
    # blocks follow each other in order of lines, so that all windows from here on share one order
    in_block = Window.partitionBy("d", "block").orderBy("n")
    order = Window.partitionBy("d").orderBy("block", "n")
    rows = rows.withColumn("ends", F.min(F.when(F.col("n") <= F.col("mover") + RESULT_LINES, at("result"))).over(in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    near = (F.col("block") > 0) & (F.col("n") > F.col("mover")) & (F.col("n") <= F.col("mover") + RESULT_LINES) & (F.col("ends").isNull() | (F.col("n") < F.col("ends")))
    rows = rows.withColumn("near", F.coalesce(near, F.lit(False)))
    rows = rows.withColumn("head", F.count(F.when(F.col("near"), at("header"))).over(in_block))
    names = F.col("near") & F.col("ends").isNotNull() & (F.col("head") > 0) & (F.col("kind") == "text")
    stop = F.col("kind").isin("mover", "second", "result", "stop") | (F.col("near") & F.col("kind").isin("header", "roll")) | names
    rows = rows.withColumn("names", names).withColumn("run", F.count(F.when(stop, 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next", F.first(at("mover"), ignorenulls=True).over(order.rowsBetween(0, MOTION_LINES)))
    # a line is text above the next mover, or stands in the block of the last one
    above = (F.col("kind") == "text") & ~F.col("names") & (F.col("next") - F.col("n") <= MOTION_LINES)
    listed = lambda when, *c: F.array_sort(F.collect_list(F.when(when, F.struct("n", *c))))
    rows = rows.withColumn("above", F.coalesce(above, F.lit(False))).withColumn("of", F.when(F.col("above"), F.col("next")).otherwise(F.col("mover")))
    said = F.col("near") & (F.col("head") > 0) & ((F.col("kind") == "header") | F.col("names"))
    rows = rows.where("of is not null").groupBy("d", "of").agg(
        F.max(F.when(F.col("kind") == "mover", F.col("block"))).alias("block"),
        F.min_by("x", at("mover")).alias("m"),
        F.min_by("run", at("mover")).alias("run"),
        F.min_by("x", F.when(F.col("near"), at("second"))).alias("s"),
        F.min_by("x", F.when(F.col("n") == F.col("ends"), F.col("n"))).alias("r"),
        listed(F.col("above"), "run", "x").alias("above"),
        listed(F.col("near") & (F.col("kind") == "roll"), "x").alias("rolls"),
        listed(said, "head", F.col("kind").alias("kind"), "x").alias("said"),
    )
    # the motion: text between the last stop and the mover
    lines = F.transform(F.filter("above", lambda s: s["run"] + 1 == F.col("run")), lambda s: s["x"])
    rows = rows.withColumn("l", lines).where(F.size("l") > 0)
    cue = F.array_position(F.transform("l", lambda s: s.rlike(rf"(?i)^(?:{'|'.join(CUES)})\b")), True)
    motion = F.array_join(F.when(cue > 0, F.slice("l", cue.cast("int"), F.size("l"))).otherwise(F.col("l")), " ")
    # votes: rolls in one line, and names under vote words
    pair = rf"(?i)^(?:votes: ?)?(.+)- ?({_VOTE})\.?$"
    rolled = F.flatten(F.transform("rolls", lambda s: F.transform(F.split(s["x"], " ?, ?"), lambda p: _map(VOTES, _part(p, pair, 2)))))
    under = lambda h: F.array_join(F.transform(F.filter("said", lambda s: s["head"] == h["head"]), lambda s: s["x"]), " ")
    whole = F.transform(F.filter("said", lambda s: s["kind"] == "header"), under)
    named = lambda w: F.filter(F.split(F.regexp_replace(w, rf"(?i)^(?:{_VOTE})\b ?:? ?", ""), r" ?, ?(?:and )?| and "), lambda x: x != "")
    spoken = F.flatten(F.transform(whole, lambda w: F.transform(named(w), lambda _: _map(VOTES, _part(w, rf"(?i)^({_VOTE})\b")))))
    out = _once(rows, "d", "block", "m", "s", "r", motion=motion, votes=F.concat(rolled, spoken))
    out = out.where(F.col("motion").rlike(r"^[A-Za-z]\S*(?: \S+){2,}") & ~F.col("motion").rlike(r"(?i)^the meeting (?:was )?adjourned\b"))
    out = _once(out, "d", "block", "motion", "m", "s", "r", **{f"c_{k}": _count("votes", k).cast("long") for k in ("aye", "no", "abstain")})
    mover = r"(?i)^moved by: ?(.+?)(?: ?; ?seconded by: ?(.+))?$"
    stated = F.when(F.col("r").rlike("(?i)all aye"), "passed").otherwise(_map(RESULTS, _part(F.col("r"), rf"(?i)({_RESULT})")))
    number = lambda k: _part(F.col("r"), _TALLY, k).cast("int")
    counted = [F.col(f"c_{k}") for k in ("aye", "no", "abstain")]
    told = decide(stated, [number(k) for k in (1, 2, 3)], counted, F.col("c_aye") + F.col("c_no") + F.col("c_abstain") > 0)
    out = _once(out, F.col("d").alias(doc), F.col("block").alias("motion_no"), "motion", _part(F.col("m"), mover).alias("moved_by"), F.coalesce(_part(F.col("m"), mover, 2), _part(F.col("s"), r"(?i)^seconded by: ?(.+)$")).alias("seconded_by"), **told)
    return out.where("result is not null")


_COUNCIL = rf"(?:(?:A motion was made|Motion (?:was )?made) by {_WHO} (?:to|that)\b|(?<!Acting )(?<! by )(?:{_WHO}|Mayor Pro Tempore) moved (?:to|that)\b|(?<!Acting ){_WHO} introduced Bill No\.? ?[0-9]+)"
_BOARD_WHO = r"[A-Z][A-Za-z.'-]*(?: [A-Z][A-Za-z.'-]*){0,3}"
_BOARD = rf"(?:(?<=\. )|(?<=^)){_BOARD_WHO} made a motion (?:to|that)\b"


def prose_votes(docs: DataFrame, doc: str, text: str, lead: str = _COUNCIL, who: str = _WHO) -> DataFrame:
    """line_votes' columns from prose: a motion begins where `lead` matches and ends before the next.

    It is seconded by who 'seconded' or by whom it 'was seconded by', and decided by the first sentence about the motion that
    says so, or by a roll of 'Name - Aye' with what follows it ('was adopted', 'became Ordinance', 'was defeated').
    Counts are printed ('7-0', '2 - Ayes to 5 - Nays', 'five votes in favor and one opposed') or counted from the roll.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    parts = F.filter(F.split(flat, f"(?={lead})"), lambda p: p.rlike(f"^{lead}"))
    rows = docs.select(F.col(doc).alias("d"), F.posexplode(parts).alias("k", "p"))
    p = F.col("p")
    second = rf"({who}) seconded\b|\bseconded by ({who})"
    body = F.coalesce(_part(p, rf"^(.*?)\.? (?:{who} seconded\b|The motion was seconded by)"), _part(p, r"^(.+?(?<! No))\.(?: [A-Z]|$)"), p)
    rest = F.expr("substring(p, length(motion) + 1)")
    rows = _once(rows, "d", "k", "p", motion=F.regexp_replace(body, r"\.$", "")).where(F.col("motion").rlike(r"^\S+(?: \S+){2,}")).withColumn("rest", rest)
    clause = _part(F.col("rest"), r"((?:[Tt]he )?[Mm]otion\b[^.]{0,80}?\b(?:passed|failed|carried|defeated|did not pass|approved)\b.*?(?:\.(?: [A-Z]|$)|$))")
    rolled = F.regexp_extract_all("rest", F.lit(rf"{who} ?[–—-] ?((?i:{_VOTE}))\b"), F.lit(1))
    rows = _once(rows, "d", "k", "p", "motion", "rest", clause=clause, votes=F.transform(rolled, lambda v: _map(VOTES, v)))
    spoken = _part(F.col("clause"), r"(?i)\b(passed|failed|carried|defeated|did not pass|approved)\b")
    after = F.when(F.col("rest").rlike(r"(?i)\b(?:was adopted|became Ordinance)\b"), "passed").when(F.col("rest").rlike(r"(?i)\b(?:was defeated|did not pass)\b"), "failed")
    stated = F.coalesce(_map(RESULTS, spoken), F.when(F.size("votes") > 0, after))
    words = F.create_map(*[F.lit(v) for k, w in enumerate(NUMBERS) for v in (w, k)])
    number = lambda k: F.coalesce(
        _part(F.col("clause"), _TALLY, k).cast("int"),
        _part(F.col("clause"), r"(?i)([0-9]+) ?-? ?ayes? to ([0-9]+) ?-? ?nays?()", k).cast("int"),
        F.try_element_at(words, F.lower(_part(F.col("clause"), r"(?i)\b([a-z]+) votes? in favor(?: and ([a-z]+) opposed)?()", k))),
    )
    given = [number(k) for k in (1, 2, 3)]
    given[1] = F.coalesce(given[1], F.when(given[0].isNotNull(), F.lit(0)))
    counted = [_count("votes", k) for k in ("aye", "no", "abstain")]
    told = decide(stated, given, counted, F.size("votes") > 0)
    out = _once(rows, F.col("d").alias(doc), (F.col("k") + 1).cast("long").alias("motion_no"), "motion", _part(F.col("p"), f"({who})").alias("moved_by"), F.coalesce(_part(F.col("rest"), second), _part(F.col("rest"), second, 2)).alias("seconded_by"), **told)
    return out.where("result is not null")


def _count(column: str, value: str) -> Column:
    return F.size(F.filter(column, lambda v: v == value))


def form_of(text: Column) -> Column:
    """lines, council, board or none: which way of recording votes a text keeps, by what opens its motions."""
    flat = F.regexp_replace(text, r"\s+", " ")
    council = F.contains(flat, F.lit(" made by ")) | F.contains(flat, F.lit(" moved t")) | F.contains(flat, F.lit(" introduced Bill No"))  # words that every match has
    board = F.contains(flat, F.lit(" made a motion t"))
    return F.when(text.rlike(r"(?im)^\s*moved by:"), "lines").when(council & flat.rlike(_COUNCIL), "council").when(board & flat.rlike(_BOARD), "board").otherwise("none")


def extract_votes(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """The votes of all documents, each read by its own form, with the form."""
    marked = _once(docs, F.col(doc), F.col(text), form=form_of(F.col(text)))
    lines = line_votes(marked.where("form = 'lines'"), doc, text).withColumn("form", F.lit("lines"))
    council = prose_votes(marked.where("form = 'council'"), doc, text).withColumn("form", F.lit("council"))
    board = prose_votes(marked.where("form = 'board'"), doc, text, _BOARD, _BOARD_WHO).withColumn("form", F.lit("board"))
    return lines.unionByName(council).unionByName(board)


def audit(docs: DataFrame, votes: DataFrame, doc: str, text: str) -> DataFrame:
    """(form, documents, openings, votes): how many motions the documents of each form open, and how many were read."""
    flat = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")
    form = form_of(F.col(text))
    opened = F.when(form == "lines", F.regexp_count(F.col(text), F.lit(r"(?im)^\s*moved by:"))).when(form == "council", F.regexp_count(flat, F.lit(_COUNCIL))).when(form == "board", F.regexp_count(flat, F.lit(_BOARD))).otherwise(0)
    per = docs.select(F.coalesce(form, F.lit("none")).alias("form"), opened.alias("o")).groupBy("form").agg(F.count("*").alias("documents"), F.sum("o").cast("long").alias("openings"))
    return per.join(votes.groupBy("form").agg(F.count("*").alias("votes")), "form", "left").select("form", "documents", "openings", F.coalesce("votes", F.lit(0)).alias("votes"))
