"""Scalar functions for showing records: money, years, clocks, titles, snippets, keys. All Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import squeeze


def usd(x: Column) -> Column:
    """Dollars with thousands separators, no cents; halves go to the even dollar."""
    return F.concat(F.when(F.bround(x, 0) < 0, "$-").otherwise("$"), F.format_number(F.abs(F.bround(x.cast("decimal(30,6)"), 0)), 0))


def usd_m(x: Column) -> Column:
    """Millions of dollars with two decimals."""
    return F.concat(F.lit("$"), F.format_number(F.bround(x.cast("decimal(30,6)") / F.lit(1_000_000).cast("decimal(10,0)"), 2), 2), F.lit("M"))


def short_year(x: Column) -> Column:
    """'2023-2024' as '23-24'; anything else as it is."""
    return F.when(x.rlike("^[0-9]+-[0-9]+$"), F.regexp_replace(x, "^[0-9]*?([0-9]{1,2})-[0-9]*?([0-9]{1,2})$", "$1-$2")).otherwise(x)


def nice_ceiling(x: Column) -> Column:
    """The least of 1, 2, 5 or 10 times a power of ten that x doesn't exceed; 1 for x of 0 and less."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(x, F.lit(1e-9)))))
    power = F.when(x < 1, F.lit(1.0)).otherwise(power)
    steps = F.array(*[power * k for k in (1, 2, 5, 10)])
    return F.when(x <= 0, 1.0).otherwise(F.array_min(F.filter(steps, lambda s: x <= s)))


def clock(seconds: Column) -> Column:
    """m:ss, past an hour h:mm:ss; '' for null and negative."""
    s = F.floor(seconds)
    h, m, sec = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    long = F.concat_ws(":", h.cast("string"), two(m), two(sec))
    return F.when(s.isNull() | (s < 0), "").when(h > 0, long).otherwise(F.concat_ws(":", m.cast("string"), two(sec)))


def first_sentence(x: Column, least: int = 20) -> Column:
    """The text up to the first end of a sentence at or after `least` characters, else all of it."""
    s = squeeze(F.coalesce(x, F.lit("")))
    head = F.regexp_extract(s, rf"^(.{{{least}}}.*?[.!?])(?:\s|$)", 1)
    return F.when(head != "", head).otherwise(s)


def display_id(ref: Column, numeric: Column | None = None) -> Column:
    """'#q' and the stable id; without one the row's number in four or more hex digits; else '#unknown'."""
    hexed = F.lit(None) if numeric is None else F.concat(F.lit("#q"), F.when(F.length(F.hex(numeric)) < 4, F.lpad(F.lower(F.hex(numeric)), 4, "0")).otherwise(F.lower(F.hex(numeric))))
    return F.coalesce(F.when(ref != "", F.concat(F.lit("#q"), ref)), hexed, F.lit("#unknown"))


def snippet(text: str, surface: str, width: int = 70) -> Column:
    """The text of a column around the first place of another column's value, one line, with … where it is cut."""
    at = F.expr(f"locate(`{surface}`, `{text}`)")
    t, n = F.col(text), F.char_length(F.col(surface))
    start = F.greatest(at - 1 - width, F.lit(0))
    end = F.least(F.char_length(t), at - 1 + n + width)
    cut = squeeze(F.substring(t, start + 1, end - start))
    return F.when((at == 0) | at.isNull(), "").otherwise(F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < F.char_length(t), "…").otherwise("")))


def windows(duration: Column, length: float, least: float) -> Column:
    """Array of (offset, length) that cover a duration; a last window below `least` is part of the one before."""
    n = F.greatest(F.ceil(duration / length), F.lit(1)).cast("int")
    rest = duration - (n - 1) * F.lit(length)
    k = F.when((n > 1) & (rest < least), n - 1).otherwise(n)
    each = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct((i * length).alias("offset"), F.when(i == k - 1, duration - i * length).otherwise(F.lit(float(length))).alias("length")))
    return F.when(duration <= 0, F.array(F.struct(F.lit(0.0).alias("offset"), F.lit(0.0).alias("length")))).otherwise(each)


def letters(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}]", "")


def trivial_variant(a: Column, b: Column) -> Column:
    """Whether names differ by spacing, hyphens or a plural s alone."""
    x, y = letters(a), letters(b)
    return (x == y) | (x == F.concat(y, F.lit("s"))) | (y == F.concat(x, F.lit("s")))


def confidence(a: Column, b: Column, score: Column, high: float, floor: float, single: float) -> Column:
    """high, review or null of a candidate name; single words are never high."""
    several = F.contains(a, F.lit(" ")) & F.contains(b, F.lit(" "))
    many = F.when((score >= high) | ((F.levenshtein(a, b) <= 2) & (score >= floor)), "high").when(score >= floor, "review")
    return F.when(several, many).otherwise(F.when(score >= single, "review"))


#: Words of a title that tell its state and not its subject.
STATE_WORDS = ("signed", "final", "draft", "approved")
#: Words of a title that a key keeps.
KEY_WORDS = 12
#: Words one of which a schedule bears in its name.
SCHEDULE_WORDS = ("calendar", "meetings", "schedule")


def name_words(x: Column) -> Column:
    """Runs of letters and digits of a name, in lower case; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def cluster_key(entity: Column, day: Column, kind: Column, title: Column) -> Column:
    """entity|day|kind|subject, for documents that may be twins; the parts of a stored key, in this order.

    The subject is the first KEY_WORDS words of the title, without its extension, words of state and numbered versions.
    """
    told = F.filter(name_words(title_of(title)), lambda w: ~w.isin(*STATE_WORDS) & ~w.rlike("^(?:v|rev)[0-9]+$"))
    parts = [F.coalesce(entity.cast("string"), F.lit("")), F.coalesce(F.left(day.cast("string"), F.lit(10)), F.lit("")), F.coalesce(F.trim(F.lower(kind)), F.lit(""))]
    return F.concat_ws("|", *parts, F.array_join(F.slice(told, 1, KEY_WORDS), " "))


def annual_schedule(x: Column) -> Column:
    """Whether a name is that of a schedule over a year and the next: both years side by side, and a word of schedules."""
    w = name_words(x)
    year = lambda v: F.when(v.rlike("^20[0-9]{2}$"), v.cast("int"))
    steps = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: year(b) - year(a) == 1)
    return F.exists(steps, lambda t: F.coalesce(t, F.lit(False))) & F.arrays_overlap(w, F.array(*[F.lit(v) for v in SCHEDULE_WORDS]))


def title_of(name: Column) -> Column:
    """A file's name without folder and extension, separators as blanks."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?i)\.[a-z0-9]{1,5}$", "")
    return squeeze(F.regexp_replace(base, "[_-]+", " "))


def first_rule(x: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that x matches: for kinds of documents, portals, families and themes."""
    out = F.lit(otherwise)
    for pattern, label in reversed(rules):
        out = F.when(x.rlike(pattern), label).otherwise(out)
    return out


#: Places of the two forms without signs among those of day_in_name.
_YMD, _MDY = 5, 9


def day_in_name(x: Column, years: tuple[int, int], today: Column | None = None) -> Column:
    """A date in a name: ISO, month day year, m.d.yyyy, m/d/yyyy, m_d_yyyy, yyyymmdd, m.d.yy, mm-dd-yy, mm dd yy, mmddyyyy,
    month year, the first of July of a span of years; the first form that gives a possible date within the years. A date
    without signs between its parts may be any number: with `today`, it counts only up to that day."""
    month = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
    forms = [
        (r"(?<![0-9])([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?![0-9])", 1, 2, 3), (rf"(?i)\b{month}\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})", 3, 1, 2),
        (r"(?<![0-9])([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})(?![0-9])", 3, 1, 2), (r"(?<![0-9])([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?![0-9])", 3, 1, 2),
        (r"(?<![0-9])([0-9]{1,2})_([0-9]{1,2})_([0-9]{4})(?![0-9])", 3, 1, 2),
        (r"(?<![0-9])([0-9]{4})([0-9]{2})([0-9]{2})(?![0-9])", 1, 2, 3), (r"(?<![0-9])([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{2})(?![0-9])", 3, 1, 2),
        (r"(?<![0-9])([0-9]{1,2})-([0-9]{1,2})-([0-9]{2})(?![0-9])", 3, 1, 2), (r"(?<![0-9])([0-9]{1,2}) ([0-9]{1,2}) ([0-9]{2})(?![0-9])", 3, 1, 2),
        (r"(?<![0-9])([0-9]{2})([0-9]{2})([0-9]{4})(?![0-9])", 3, 1, 2), (rf"(?i){month}[ _-]?([0-9]{{4}})(?![0-9])", 2, 1, 0),
        (r"(?<![0-9])([0-9]{4})-([0-9]{4})(?![0-9])", 1, 0, 0),
    ]
    names = F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()])
    parts = [F.struct(*[(F.regexp_extract(x, p, k) if k else F.lit(stand)).alias(n) for n, k, stand in (("y", y, ""), ("m", m, "7"), ("d", d, "1"))], F.lit(p in (forms[_YMD][0], forms[_MDY][0])).alias("run")) for p, y, m, d in forms]

    def day(part: Column) -> Column:
        year = F.try_to_number(part["y"], F.lit("9999")).cast("int")
        year = F.when(year < 100, year + 2000).otherwise(year)
        named = F.array_position(names, F.lower(F.substring(part["m"], 1, 3))).cast("int")
        month = F.when(named > 0, named).otherwise(F.try_to_number(part["m"], F.lit("99")).cast("int"))
        written = F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(part["d"], 2, "0"))
        found = F.when(year.between(*years) & month.between(1, 12), F.try_to_date(written, "yyyy-MM-dd"))
        return found if today is None else F.when(~part["run"] | (found <= today), found)

    return F.get(F.filter(F.transform(F.filter(F.array(*parts), lambda p: p["y"] != ""), day), lambda v: v.isNotNull()), 0)


def corrected_queries(query: Column, pairs: Column, most: int = 8) -> Column:
    """Other wordings of a query: each name of pairs (array of (mangled, canonical)) that stands in it, whole and in any case,
    replaced by its partner, both ways; distinct in lower case, in order, at most so many."""
    both = F.flatten(F.transform(pairs, lambda p: F.array(F.struct(p["mangled"].alias("a"), p["canonical"].alias("b")), F.struct(p["canonical"].alias("a"), p["mangled"].alias("b")))))
    pattern = lambda p: F.concat(F.lit("(?i)\\b\\Q"), p["a"], F.lit("\\E\\b"))
    made = F.transform(F.filter(both, lambda p: F.regexp_like(query, pattern(p))), lambda p: F.regexp_replace(query, pattern(p), F.replace(p["b"], F.lit("$"), F.lit("\\$"))))
    start = F.expr("cast(array() as array<string>)")
    fresh = F.aggregate(made, start, lambda acc, v: F.when((F.lower(v) == F.lower(query)) | F.exists(acc, lambda x: F.lower(x) == F.lower(v)), acc).otherwise(F.concat(acc, F.array(v))))
    return F.slice(fresh, 1, most)
