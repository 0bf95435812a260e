"""Scalar functions over text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(x: Column) -> Column:
    """White space (Unicode's) as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def content_hash(x: Column) -> Column:
    return F.sha2(squeeze(x), 256)


def citation_form(x: Column) -> Column:
    """squeeze with case folded: lower case, and ß as ss. Other multi-letter folds are not applied."""
    return F.replace(F.lower(squeeze(x)), F.lit("ß"), F.lit("ss"))


def first_nonblank(*xs: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in xs])


def citation_id(key: Column, text: Column, ordinal: Column) -> Column:
    """8 hex digits over the document's key and the passage; a repeated passage adds its ordinal."""
    body = F.concat(key, F.lit("\n"), citation_form(text), F.when(ordinal > 0, F.concat(F.lit("\n#"), ordinal.cast("string"))).otherwise(""))
    return F.substring(F.sha2(body, 256), 1, 8)


def vote_ref(citation: Column, ordinal: Column) -> Column:
    empty = citation.isNull() | (citation == "")
    return F.when(empty, F.raise_error(F.lit("a vote needs a citation"))).otherwise(F.sha2(F.concat_ws(":", citation, ordinal.cast("string")), 256))


def sentences(x: Column) -> Column:
    """Split after . ! or ? before white space; blank pieces are dropped."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")  # a bare F.trim would be handed the index as what to trim


def query_terms(x: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of three or more letters or digits, lower case, in order of appearance, without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9]{3,})"), F.lit(1)))
    return F.array_except(words, F.array(*[F.lit(s) for s in stop])) if stop else words


def best_sentence(parts: Column, terms: Column) -> Column:
    """0-based index of the sentence with most distinct terms, then most hits, then the first; -1 if none has any."""
    score = F.transform(parts, lambda s, i: F.struct(
        F.size(F.filter(terms, lambda t: F.contains(F.lower(s), t))).alias("distinct"),
        F.aggregate(terms, F.lit(0), lambda a, t: a + F.size(F.split(F.lower(s), F.concat(F.lit("\\Q"), t, F.lit("\\E")), -1)) - 1).alias("hits"),
        (-i).alias("order"),
    ))
    best = F.array_max(score)
    return F.when(F.coalesce(best["distinct"], F.lit(0)) > 0, -best["order"]).otherwise(-1)


def exotic_ratio(x: Column) -> Column:
    """Share of code points from U+0250 on, but for general punctuation (U+2000 to U+206F)."""
    n = F.char_length(x)
    return F.when(n > 0, (n - F.char_length(F.regexp_replace(x, "[\\x{250}-\\x{1FFF}\\x{2070}-\\x{10FFFF}]", ""))) / n).otherwise(0.0)


def strip_controls(x: Column) -> Column:
    return F.regexp_replace(x, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", " ")


def mask_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[0-9]", "X")


def source_ref(url: Column, id_params: dict[str, str] | None = None) -> Column:
    """A URL's canonical form: lower-case scheme and host, no query, fragment or slash at the end.

    id_params names, by host, the parameter in which some portals keep a page's id; that one stays.
    """
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    out = F.concat(scheme, F.lit("://"), host, path)
    for portal, param in (id_params or {}).items():
        value = F.regexp_extract(url, rf"[?&]{param}=([^&#]*)", 1)
        out = F.when((host == portal) & (value != ""), F.concat(out, F.lit(f"?{param}="), value)).otherwise(out)
    return F.when(host == "", F.trim(url)).otherwise(out)


def money(x: Column) -> Column:
    """'$1,234.50', '(12)' as -12, a lone dash and a blank cell as 0; an error for anything else but null."""
    bare = F.regexp_replace(F.trim(x), r"[$,\s]", "")
    sign = F.when(bare.rlike(r"^\(.*\)$"), -1).otherwise(1)
    digits = F.regexp_replace(bare, r"[()]", "")
    good = digits.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    value = F.when(good, digits.cast("decimal(18,2)") * sign)
    return F.when(x.isNull(), F.lit(None)).when(bare.rlike("^[-–—]?$"), F.lit(0).cast("decimal(18,2)")).when(good, value).otherwise(F.raise_error(F.concat(F.lit("no amount: "), x)).cast("decimal(18,2)"))


def money_or_null(x: Column) -> Column:
    """money, and null instead of an error."""
    bare = F.regexp_replace(F.trim(x), r"[$,\s]", "")
    return F.when(bare.rlike(r"^(-?[0-9]+(\.[0-9]+)?|\(-?[0-9]+(\.[0-9]+)?\)|[-–—]?)$"), money(x))


def rate(x: Column) -> Column:
    """'25.98%' as 0.2598."""
    return F.when(x.rlike(r"^\s*[0-9.]+\s*%\s*$"), F.regexp_extract(x, r"([0-9.]+)", 1).cast("double") / 100)


def fiscal_year(query: Column) -> Column:
    """The label 'Y-1 to Y' of the first year named; null where the query asks for a trend or names none."""
    y = F.regexp_extract(query, r"\b(20[0-9]{2})\b", 1)
    trend = F.lower(query).rlike(r"\b(trend|over time|history|since|each year|by year)\b")
    return F.when((y != "") & ~trend, F.concat((y.cast("int") - 1).cast("string"), F.lit("-"), y))


def name_key(x: Column, titles: tuple[str, ...] = ("mr", "mrs", "ms", "dr", "hon", "mayor", "alderman", "alderwoman", "councilmember", "director", "president", "chair")) -> Column:
    """A person's name to compare by: case folded, dashes alike and without blanks around, no dots or commas, leading
    titles off, however many."""
    plain = citation_form(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[‐-―−]", "-"), r"\s*-\s*", "-"), "[.,]", " "))
    return F.regexp_replace(plain, r"^(?:(?:" + "|".join(titles) + r")\s+)+", "")


def speech_form(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "['’]", ""), r"[^a-z0-9]+", " "))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


# Formats and their patterns, tried in order; the year must lie within the bounds.
_DATES = (
    (r"\b((?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})\b", "yyyy-MM-dd"),
    (r"\b([0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2})\b", "M/d/yyyy"),
    (r"\b([0-9]{1,2}-[0-9]{1,2}-(?:19|20)[0-9]{2})\b", "M-d-yyyy"),
    (r"\b([0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2})\b", "M.d.yyyy"),
    (r"(?i)\b((?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, (?:19|20)[0-9]{2})\b", "MMMM d, yyyy"),
    (r"\b((?:19|20)[0-9]{2}[01][0-9][0-3][0-9])\b", "yyyyMMdd"),
)


def parse_date(x: Column, low: int = 1990, high: int = 2035) -> Column:
    """The first date in a name or header, by the formats above in turn; null if none is a real day in bounds."""
    found = []
    for pattern, form in _DATES:
        d = F.try_to_date(F.initcap(F.regexp_extract(x, pattern, 1)), form) if "MMMM" in form else F.try_to_date(F.regexp_extract(x, pattern, 1), form)
        found.append(F.when(F.year(d).between(low, high), d))
    return F.coalesce(*found)


# Rules of the document-type classifier, first match wins.
DOCUMENT_TYPES = (
    ("transcript", r"transcript|captions?"),
    ("minutes", r"\bminutes?\b"),
    ("agenda", r"\bagendas?\b"),
    ("packet", r"\bpackets?\b|board book"),
    ("budget", r"\bbudgets?\b|\bbudget book\b"),
    ("audit", r"\baudit(?:ed)?\b|financial report"),
    ("resolution", r"\bresolutions?\b|\bordinances?\b"),
    ("report", r"\breports?\b"),
)


def document_type(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(name), "[_]+", " ")
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(DOCUMENT_TYPES):
        out = F.when(plain.rlike(pattern), kind).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def pii_findings(x: Column) -> Column:
    """Numbers shaped like a social security number, and labelled dates of birth, digits masked."""
    ssn = F.regexp_extract_all(x, F.lit(r"\b([0-9]{3}-[0-9]{2}-[0-9]{4})\b"), F.lit(1))
    born = F.regexp_extract_all(x, F.lit(r"(?i)\b((?:dob|date of birth|born)\W{1,3}[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})\b"), F.lit(1))
    return F.transform(F.concat(ssn, born), mask_digits)
