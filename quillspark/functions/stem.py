"""English stems: Porter's algorithm (M. F. Porter, "An algorithm for suffix stripping", 1980) as SQL expressions.

Every step is one expression over a column w, so a stem costs no Python and stays inside generated code. The texts are
written for any engine: `{m}(x, p)` stands for its test of a regular expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Runs of consonants and of vowels; y is a consonant at the beginning (written Y meanwhile) and after a vowel.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME = f"^({_C})?{_V}{_C}"  # measure above 0
_ONE = f"^({_C})?{_V}{_C}({_V})?$"  # measure 1
_MORE = f"^({_C})?{_V}{_C}{_V}{_C}"  # measure above 1
_VOWEL = f"^({_C})?[aeiouy]"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"

# Suffixes and what stands for them.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _is(n: int, pattern: str) -> str:
    return f"{{m}}({_cut(n)}, '{pattern}')"


def _swap(suffixes: dict[str, str], condition: str) -> str:
    """The longest suffix that fits is replaced where the rest meets the condition."""
    cases = " ".join(f"WHEN w LIKE '_%{s}' THEN CASE WHEN {_is(len(s), condition)} THEN {_cut(len(s))} || '{t}' ELSE w END" for s, t in sorted(suffixes.items(), key=lambda x: (-len(x[0]), x[0])))
    return f"CASE {cases} ELSE w END"


_DOUBLE = "(" + "|".join(c + c for c in "bcdfghjkmnpqrtvwx") + ")$"
_ION = f"WHEN w LIKE '_%sion' OR w LIKE '_%tion' THEN CASE WHEN {_is(3, _MORE)} THEN {_cut(3)} ELSE w END"

#: One after another over w. A bar marks a word that lost -ed or -ing until the next step has mended its end.
STEPS = [
    "CASE WHEN w LIKE 'y%' THEN 'Y' || substring(w, 2) ELSE w END",
    f"CASE WHEN w LIKE '_%sses' OR w LIKE '_%ies' THEN {_cut(2)} WHEN w LIKE '_%ss' THEN w WHEN w LIKE '_%s' AND length(w) > 2 THEN {_cut(1)} ELSE w END",
    f"CASE WHEN w LIKE '_%eed' THEN CASE WHEN {_is(3, _SOME)} THEN {_cut(1)} ELSE w END WHEN w LIKE '_%ed' THEN CASE WHEN {_is(2, _VOWEL)} THEN {_cut(2)} || '|' ELSE w END WHEN w LIKE '_%ing' THEN CASE WHEN {_is(3, _VOWEL)} THEN {_cut(3)} || '|' ELSE w END ELSE w END",
    f"CASE WHEN w NOT LIKE '%|' THEN w WHEN {_is(1, '(at|bl|iz)$')} THEN {_cut(1)} || 'e' WHEN {_is(1, _DOUBLE)} THEN {_cut(2)} WHEN {_is(1, _SHORT)} THEN {_cut(1)} || 'e' ELSE {_cut(1)} END",
    f"CASE WHEN w LIKE '_%y' AND {_is(1, _VOWEL)} THEN {_cut(1)} || 'i' ELSE w END",
    _swap(_STEP2, _SOME),
    _swap(_STEP3, _SOME),
    f"CASE {_ION} ELSE {_swap(dict.fromkeys(_STEP4, ''), _MORE)} END",
    f"CASE WHEN w LIKE '_%e' AND ({_is(1, _MORE)} OR ({_is(1, _ONE)} AND NOT {_is(1, _SHORT)})) THEN {_cut(1)} ELSE w END",
    f"CASE WHEN w LIKE '_%ll' AND {{m}}(w, '{_MORE}') THEN {_cut(1)} ELSE w END",
    "lower(w)",
]


def _plain(step: str) -> str:
    """A step with tests of suffixes in place of LIKE, which Spark compiles to regular expressions where it begins with '_'."""
    return re.sub(r"w LIKE '_%(\w+)'", lambda m: f"(endswith(w, '{m[1]}') AND length(w) > {len(m[1])})", step)


def with_stem(words: DataFrame, word: str, out: str = "stem") -> DataFrame:
    """words with the stem of a lower-case word; words of one or two letters, or with anything but a to z, are their own.

    Null stays null. Each step is a projection of its own, so that its input is worked out once.
    """
    names = [f"__s{k}" for k in range(len(words.columns))]  # whatever the columns are called, w is free
    rows = words.toDF(*names).withColumn("w", F.col(names[words.columns.index(word)])).withColumn("__word", F.col("w").rlike("^[a-z]{3,}$"))
    own = F.col(names[words.columns.index(word)])
    for step in STEPS:
        rows = rows.withColumn("w", F.expr(_plain(step).format(m="rlike")))
    keep = [(n, c) for n, c in zip(names, words.columns, strict=True) if c != out]
    return rows.select(*[F.col(n).alias(c) for n, c in keep], F.when(F.col("__word"), F.col("w")).otherwise(own).alias(out))


def stem_sql(word: str, source: str, match: str) -> str:
    """A query of (word, stem) of the distinct words of a source in SQL, for engines whose regex test is named match."""
    query = f"SELECT DISTINCT {word} AS word, {word} AS w FROM {source} WHERE {match}({word}, '^[a-z]{{3,}}$')"
    for step in STEPS:
        query = f"SELECT word, {step.format(m=match)} AS w FROM ({query})"
    return f"SELECT word, w AS stem FROM ({query}) UNION ALL SELECT DISTINCT {word}, {word} FROM {source} WHERE NOT {match}({word}, '^[a-z]{{3,}}$')"
