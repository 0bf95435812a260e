"""Repair of conversations whose turns were lost, emptied, repeated or mislabelled, by secondary-sorted streaming.

Rows are dealt out by conversation once. Inside a partition they are sorted by turn, latest first, and a pass over the
Arrow batches carries the cost of the cheapest repair of all later rows for each state of the wanted form; it leaves one
byte with each row, the best edit in each state. Then the partition is sorted the other way, and a second pass follows
these bytes. The bytes travel with the rows through Spark's sorter, which spills, so that a conversation of any length
needs the memory of one batch; only its audit, a letter for each edit, is held as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Costs of the edits: delete, insert, keep, change the role; what an undeleted truncated row adds.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
LETTERS = "DIKR"
#: Faults in the order in which the first counts.
FAULTS = ("blank", "duplicate", "truncated")

# The wanted roles are nothing, or an optional system turn and then pairs of user and assistant. States: before the first
# turn, after the system turn, after a user's, after an assistant's; in each, the role that may follow.
_FOLLOWS = ("u", "u", "a", "u")
_AFTER = {"u": 2, "a": 3}
_ROLE = {"u": "user", "a": "assistant"}
#: Cost of ending in each state: 0 and 3 are complete, the others need insertions.
_END = (0, 2 * INSERT, INSERT, 0)


def _next(state: int) -> int:
    return _AFTER[_FOLLOWS[state]]


def _kept(state: int, initial: str) -> int | None:
    """The state after keeping a row of this initial; None if it can't be kept."""
    if state == 0 and initial == "s":
        return 1
    return _next(state) if initial == _FOLLOWS[state] else None


class Steps:
    """One row's step of the dynamic programme, remembered: costs less their minimum take few values."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[tuple[int, ...], int]] = {}

    def __call__(self, later: tuple[int, ...], initial: str, fault: str) -> tuple[tuple[int, ...], int]:
        """Costs of each state before the row (less their minimum), and the best edit of each state, two bits a state.

        Of edits that cost the same the letter least in ASCII wins: it decides which audit is least, since edits of the
        same letter in the same state lead to the same state.
        """
        key = (later, initial, fault)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._step(*key)
        return found

    @staticmethod
    def _step(later: tuple[int, ...], initial: str, fault: str) -> tuple[tuple[int, ...], int]:
        more = TRUNCATED if fault == "truncated" else 0
        options: list[dict[str, int]] = []
        for s in range(4):
            own = {"D": DELETE + later[s]}
            if fault not in ("blank", "duplicate"):
                own["R"] = REROLE + more + later[_next(s)]
                to = _kept(s, initial)
                if to is not None:
                    own["K"] = KEEP + more + later[to]
            options.append(own)
        best = [min(o.values()) for o in options]
        for _ in range(3):  # insertions before the row lead from state to state
            best = [min(b, INSERT + best[_next(s)]) for s, b in enumerate(best)]
        packed = 0
        for s, own in enumerate(options):
            own["I"] = INSERT + best[_next(s)]
            letter = min(own, key=lambda x: (own[x], x))
            packed |= LETTERS.index(letter) << 2 * s
        low = min(best)
        return tuple(b - low for b in best), packed


def damage(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) damaged by a hash of conversation and turn, for tests of the repair.

    Nulls are one space in the hash and become one space as role or text. One row in twenty each is dropped, emptied, loses
    its full stops, exclamation and question marks, is repeated, or becomes the user's. A dropped row stays with `present`
    false, so that its conversation is not lost.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    out = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = out.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") != 0).alias("present"), "code")
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("copy", F.explode(copies)).drop("copy", "code")


def _fault(text: Column, again: Column) -> Column:
    return (
        F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(again, "duplicate")
        .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
        .otherwise("")
    )


_STEP = "key string, turn long, has_turn boolean, role string, text string, present boolean, fault string, nth int, best int"
_EDITED = "key string, turn long, has_turn boolean, before string, role string, text string, present boolean, fault string, edit string"


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows, latest first, with the best edit of each state."""
    steps, now, costs = Steps(), None, _END
    for batch in batches:
        best = []
        for key, role, fault, present in zip(batch["key"], batch["role"], batch["fault"], batch["present"], strict=True):
            if key != now:
                now, costs = key, _END
            packed = 0
            if present:
                costs, packed = steps(costs, role[:1], fault)
            best.append(packed)
        yield batch.assign(best=best)


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every row with its edit and the role after it, and the inserted rows where they belong."""
    names = [x.split()[0] for x in _EDITED.split(", ")]
    now, state, out = None, 0, []

    def insert(state: int) -> int:
        out.append((now, 0, False, None, _ROLE[_FOLLOWS[state]], "", True, "", "I"))
        return _next(state)

    def finish(state: int) -> None:
        while _END[state]:
            state = insert(state)

    for batch in batches:
        for key, turn, has_turn, role, text, present, fault, best in zip(*(batch[c] for c in ("key", "turn", "has_turn", "role", "text", "present", "fault", "best")), strict=True):
            if key != now:
                finish(state)
                now, state = key, 0
            if not present:
                out.append((key, turn, has_turn, role, role, text, False, "", ""))
                continue
            while (letter := LETTERS[best >> 2 * state & 3]) == "I":
                state = insert(state)
            after = role
            if letter == "R":
                after, state = _ROLE[_FOLLOWS[state]], _next(state)
            elif letter == "K":
                state = _kept(state, role[:1])
            out.append((key, turn, has_turn, role, after, text, True, fault, letter))
        yield pd.DataFrame(out, columns=names)
        out = []
    finish(state)
    if out:
        yield pd.DataFrame(out, columns=names)


_SUMMARY = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COST = {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE, "": 0}


class _Summary:
    """What is told of one conversation, row by row."""

    def __init__(self, key: str):
        self.key, self.audit, self.sha, self.first = key, bytearray(), hashlib.sha256(), True
        self.cost, self.illegal, self.before = 0, 0, None
        self.faults = dict.fromkeys(FAULTS, 0)
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, has_turn, before, role, text, fault, edit) -> None:
        self.audit += edit.encode()
        self.cost += _COST[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if fault:
            self.faults[fault] += 1
        if edit != "I":
            if self.before is not None and self.before + before[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = before[:1]
            if has_turn:
                turn = int(turn)
                self.low = turn if self.low is None else self.low
                self.turns += turn != self.high
                self.high = turn
        if edit != "D":
            self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.first = False

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)  # as long integers overflow
        return (self.key, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each conversation from its edited rows in order."""
    names = [x.split()[0] for x in _SUMMARY.split(", ")]
    now, done = None, []
    for batch in batches:
        for key, turn, has_turn, before, role, text, present, fault, edit in batch.itertuples(index=False):
            if now is None or key != now.key:
                if now is not None:
                    done.append(now.row())
                now = _Summary(key)
            if present:
                now.add(turn, has_turn, before, role, text, fault, edit)
        if done:
            yield pd.DataFrame(done, columns=names)
            done = []
    if now is not None:
        yield pd.DataFrame([now.row()], columns=names)


def _planned(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """Rows in order inside partitions, each with the best edit of every state."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    keyed = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{conv}`").cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.col(f"`{turn}`").cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.col(f"`{turn}`").isNotNull().alias("has_turn"),
        blank(role).alias("role"),
        blank(text).alias("text"),
        (F.coalesce(F.col(f"`{present}`"), F.lit(False)) if present else F.lit(True)).alias("present"),
    ).repartition("key")
    same = F.when(F.col("present"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    nth = F.row_number().over(Window.partitionBy("key", "same").orderBy("has_turn", "turn"))
    keyed = keyed.withColumn("same", same).withColumn("nth", nth).drop("same")
    keyed = keyed.withColumn("fault", F.when(F.col("present"), _fault(F.col("text"), F.col("nth") > 1)).otherwise(""))
    order = ("has_turn", "turn", "role", "text", "nth")
    late = keyed.sortWithinPartitions("key", *[F.desc(c) for c in order])
    names = [x.split()[0] for x in _STEP.split(", ")]
    found = late.select(*names[:-1]).mapInPandas(_backward, _STEP)
    return found.sortWithinPartitions("key", *order)


def _named(found: DataFrame, rows: DataFrame, conv: str) -> list[Column]:
    own = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(rows.schema[conv].dataType)
    return [own.alias(conv), *[F.col(c) for c in found.columns if c != "key"]]


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """The edited rows of each conversation: conv, turn (null for inserted rows), before (the role before; null for
    inserted rows), role, text, fault and edit (K kept, R role changed, D deleted, I inserted), in order inside partitions.

    A row's fault is the first that holds: blank (only blanks), duplicate (its role and text stood earlier in the
    conversation), truncated (its last character that isn't blank is no full stop, exclamation or question mark). Edits
    make the roles an optional system turn and then pairs of user and assistant, at the least cost, and among these with
    the least audit in ASCII. Rows go by turn, nulls first, then by role and text; repeated rows are duplicates. Null roles
    and texts are one space; null conversations are one conversation. Other columns are not read. Rows for which `present`
    isn't true are only names of conversations. A conversation is one task's, in the memory of a batch. No rows, no rows.
    """
    found = _planned(rows, conv, turn, role, text, present).mapInPandas(_forward, _EDITED).where("present")
    out = found.select("key", F.when(F.col("has_turn"), F.col("turn")).alias(turn), "before", "role", "text", "fault", "edit")
    return out.select(*_named(out, rows, conv))


def repair_summary(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """One row for each conversation: gaps (turns missing between the least and the greatest), counts of faults, illegal
    (neighbouring rows whose roles don't follow each other), cost and audit of the cheapest repair, and the sha256 of the
    repaired `role:text` lines. Rows and nulls as in repaired_turns; a conversation without present rows has zeros, an empty
    audit and the hash of the empty string.
    """
    found = _planned(rows, conv, turn, role, text, present).mapInPandas(lambda batches: _summaries(_forward(batches)), _SUMMARY)
    return found.select(*_named(found, rows, conv))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_summary(damage(rows), present="present")


QUERIES = {"op11_conversation_repair": op11_conversation_repair}

_BIT = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x"


def _step_sql() -> str:
    """New best (cost, audit, text) of each state after a row, before insertions."""
    free, add = "fault NOT IN ('blank', 'duplicate')", "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    drop = lambda s: f"struct_pack(c := v{s}.c + 2, a := v{s}.a || 'D', t := v{s}.t)"
    keep = lambda s, i: f"CASE WHEN {free} AND role[1] = '{i}' THEN struct_pack(c := v{s}.c + {add}, a := v{s}.a || 'K', t := v{s}.t || chr(10) || role || ':' || text) END"
    role = lambda s, r: f"CASE WHEN {free} THEN struct_pack(c := v{s}.c + 1 + {add}, a := v{s}.a || 'R', t := v{s}.t || chr(10) || '{r}:' || text) END"
    n2 = ", ".join([drop(2), *[keep(s, "u") for s in (0, 1, 3)], *[role(s, "user") for s in (0, 1, 3)]])
    return f"{drop(0)} AS n0, least({drop(1)}, {keep(0, 's')}) AS n1, least({n2}) AS n2, least({drop(3)}, {keep(2, 'a')}, {role(2, 'assistant')}) AS n3"


def _inserted(s: str, role: str) -> str:
    return f"struct_pack(c := {s}.c + 5, a := {s}.a || 'I', t := {s}.t || chr(10) || '{role}:')"


_NONE = "struct_pack(c := 1000000000, a := '', t := '')"

ORACLES = {
    "op11_conversation_repair": f"""
WITH RECURSIVE step AS (SELECT i, 0 AS k, i AS x FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, {_BIT} FROM step WHERE k < 8),
tab AS (SELECT list(x ORDER BY i) AS t FROM step WHERE k = 8),
own AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT k, (4294967295 - list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(k) + 1), lambda j: CAST(ascii(k[j]) AS BIGINT))), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]))) % 20 AS code
        FROM (SELECT DISTINCT k FROM own), tab),
rows AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
         FROM own JOIN crc USING (k), unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS u(copy) WHERE code <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM rows),
told AS (SELECT conv_id, i, turn, role, text, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
         lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM placed),
dp AS (SELECT conv_id, 0 AS i, v0, {_NONE} AS v1, {_inserted('v0', 'user')} AS v2, {_inserted(_inserted('v0', 'user'), 'assistant')} AS v3
       FROM (SELECT DISTINCT conv_id, struct_pack(c := 0, a := '', t := '') AS v0 FROM conversations)
  UNION ALL
  SELECT conv_id, i, n0, n1, r2, least(n3, {_inserted('r2', 'assistant')}) FROM
   (SELECT conv_id, i, n0, n1, n3, least(n2, {_inserted('n0', 'user')}, {_inserted('n1', 'user')}, {_inserted('n3', 'user')}) AS r2 FROM
    (SELECT dp.conv_id, told.i AS i, {_step_sql()} FROM dp JOIN told ON told.conv_id IS NOT DISTINCT FROM dp.conv_id AND told.i = dp.i + 1))),
last AS (SELECT conv_id, least(v0, v3) AS v FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
sums AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prior IS NOT NULL AND prior[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id)
SELECT last.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(v.c AS BIGINT) AS cost, v.a AS audit, sha256(v.t[2:]) AS repaired_sha256 FROM last LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM last.conv_id
""",
}
