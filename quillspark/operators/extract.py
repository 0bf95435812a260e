"""Passages and votes out of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET, FLUSH, LONG, CARRY = 200, 1.3, 1.5, 2
#: Characters of passages that a task gathers before it hands them on, and texts that it has in Python at once.
HELD, ROWS = 1 << 21, 256
_HEAD = re.compile(r"^(?:#{1,6}\s+(.+)|([0-9]{1,2}(?:\.[0-9]+)*\.?\s+[A-Z].{0,80})|([A-Z][A-Z &/-]{4,60}))$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def sections(text: str) -> list[tuple[str, str]]:
    """(title, body) by headings: marked, numbered or in capitals; the whole text if it has none."""
    out, title, body = [], "", []
    for line in text.split("\n"):
        m = _HEAD.match(line.strip())
        if m:
            if any(b.strip() for b in body):
                out.append((title, "\n".join(body)))
            title, body = next(g for g in m.groups() if g).strip(), []
        else:
            body.append(line)
    if any(b.strip() for b in body):
        out.append((title, "\n".join(body)))
    return out


def passages(body: str, target: int = TARGET) -> list[str]:
    """Passages of about `target` words: paragraphs are gathered until the next would go beyond 1.3 times that; a paragraph
    beyond 1.5 times is cut at sentences; each passage begins with the last two sentences of the one before."""
    units: list[str] = []
    for para in re.split(r"\n\s*\n|\n", body):
        para = " ".join(para.split())
        if not para:
            continue
        if len(para.split()) > LONG * target:
            units += [s for s in _SENTENCE.split(para) if s]
        else:
            units.append(para)
    out, now, n = [], [], 0
    for unit in units:
        k = len(unit.split())
        if now and n + k > FLUSH * target:
            out.append(" ".join(now))
            now = [" ".join(_SENTENCE.split(" ".join(now))[-CARRY:])] if n <= 4 * target else []
            n = sum(len(x.split()) for x in now)
        now.append(unit)
        n += k
    return [*out, " ".join(now)] if now else out


def passage_batches(batches: Iterator[pa.RecordBatch], target: int = TARGET) -> Iterator[pa.RecordBatch]:
    """Passages of rows (id, text), handed on about HELD characters at a time, however many texts come in at once."""
    for batch in batches:
        out, held = [], 0
        kind = pa.schema([pa.field("id", batch.schema.types[0]), ("chunk_index", pa.int32()), ("section", pa.string()), ("content", pa.string())])
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            for d, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                k = 0
                for title, body in sections(x or ""):
                    for p in passages(body, target):
                        out.append((d, k, title, p))
                        held, k = held + len(p), k + 1
                        if held >= HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)
                            out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)


def chunk(docs: DataFrame, doc_id: str, text: str, target: int = TARGET) -> DataFrame:
    """(doc_id, chunk_index, section, content) of whole texts; null texts have none. Row by row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return passage_batches(batches, target)

    kind = docs.schema[doc_id].dataType.simpleString()
    found = docs.select(F.col(doc_id).alias("id"), F.col(text)).mapInArrow(run, f"id {kind}, chunk_index int, section string, content string")
    return found.withColumnRenamed("id", doc_id)


def vote_result(stated: Column, yes: Column, no: Column) -> Column:
    """What is stated beats what is counted; a tie or a missing count decides nothing."""
    derived = F.when(yes > no, "passed").when(no > yes, "failed")
    return F.coalesce(F.when(F.lower(stated).rlike("pass|carri|approv|adopt"), "passed").when(F.lower(stated).rlike("fail|defeat|denied|reject"), "failed"), derived)


def parse_votes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, motion_no, motion, moved_by, seconded_by, yes, no, stated, result) from minutes.

    A motion begins with 'Moved by' or 'Motion by' and ends before the next. Counts come from 'Ayes: n' and 'Nays: n' (or No's);
    what isn't there stays null.
    """
    parts = F.filter(F.split(F.col(text), r"(?i)(?=\b(?:motion|moved)\s+by\s)"), lambda p: p.rlike(r"(?i)^(?:motion|moved)\s+by\s"))
    rows = docs.select(F.col(doc_id), F.posexplode(parts).alias("motion_no", "p"))
    one = lambda pattern: F.nullif(F.trim(F.regexp_extract("p", pattern, 1)), F.lit(""))
    yes, no = (F.regexp_extract("p", rf"(?i)\b(?:{w})\s*[:-]?\s*([0-9]{{1,3}})\b", 1) for w in ("ayes|yeas|yes", "nays|noes|no"))
    num = lambda c: F.when(c != "", c.cast("int"))
    name = r"([A-Z][\w.'-]*(?: [A-Z][\w.'-]*){0,3})"
    out = rows.select(doc_id, "motion_no", one(r"(?is)\bto\s+(.{3,300}?)(?:[.;]|\n|$)").alias("motion"), one(rf"(?i:motion|moved)\s+by\s+{name}").alias("moved_by"), one(rf"(?i:seconded|second)\s+by\s+{name}").alias("seconded_by"), num(yes).alias("yes"), num(no).alias("no"), one(r"(?i)\b(passed|carried|approved|adopted|failed|defeated|denied|rejected)\b").alias("stated"))
    return out.withColumn("result", vote_result(F.col("stated"), F.col("yes"), F.col("no")))


def ngrams(words: Column, longest: int = 4) -> Column:
    """All n-grams of an array of words, up to `longest`. The array is bound to a variable, so it is worked out once."""
    none = F.expr("cast(array() as array<string>)")

    def of(w: Column) -> Column:
        some = lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size(w) >= n, some(n)).otherwise(none)))

    return F.flatten(F.transform(F.array(words), of))


def proper_phrases(docs: DataFrame, text: str, longest: int = 4) -> DataFrame:
    """(phrase, n): counts of n-grams in runs of words that begin with a capital."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), F.lit(1))
    grams = docs.select(F.explode(found).alias("run")).select(F.explode(ngrams(F.split("run", " "), longest)).alias("phrase"))
    return grams.groupBy("phrase").agg(F.count("*").alias("n"))


def build_rules(rules: DataFrame, wrong: str = "mangled", right: str = "canonical") -> DataFrame:
    """Correction rules by lower-case form; those with several targets, and those that change nothing, are dropped."""
    out = rules.groupBy(F.lower(wrong).alias(wrong)).agg(F.countDistinct(right).alias("n"), F.min(right).alias(right)).where("n = 1").drop("n")
    return out.where(F.col(wrong) != F.lower(right))
