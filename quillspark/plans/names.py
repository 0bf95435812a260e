"""Queries over names that are spoken and written in conversations, and SQL for those without close names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import names
from quillspark.sources.tables import table


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as meetings: users' turns as what was written, assistants' as what was said; part names are the lexicon."""
    c = table(spark, d, "conversations").select("conv_id", "role", "text")
    lexicon = table(spark, d, "part").select(F.initcap("p_name").alias("name")).distinct()
    return lexicon, c.where("role = 'user'"), c.where("role = 'assistant'")


def spoken_surfaces(spark: SparkSession, d: str) -> DataFrame:
    return names.surfaces(_sides(spark, d)[2], "conv_id", "text")


def meeting_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    lexicon, written, _ = _sides(spark, d)
    return names.vocabulary(lexicon, written, "name", "conv_id", "text")


def misheard_names(spark: SparkSession, d: str) -> DataFrame:
    lexicon, written, spoken = _sides(spark, d)
    return names.misheard(spoken, names.vocabulary(lexicon, written, "name", "conv_id", "text"), "conv_id", "text")


def misheard_proposals(spark: SparkSession, d: str) -> DataFrame:
    return names.proposals(misheard_names(spark, d))


QUERIES = {f.__name__: f for f in (spoken_surfaces, meeting_vocabulary, misheard_names, misheard_proposals)}

_WORD = r"\p{Lu}[^\s.,;:!?()\[\]{}\"“”]*"


def _surfaces(role: str) -> str:
    return rf"""
r AS (SELECT conv_id AS meeting, regexp_split_to_array(unnest(regexp_extract_all(text, '(?:^|[\s(\[\"“])({_WORD}(?:[ \t]+{_WORD})*)', 1)), '[ \t]+') AS w FROM conversations WHERE role = '{role}'),
g AS (SELECT meeting, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM r, range(1, 5) AS s(n)),
c AS (SELECT meeting, array_to_string(w[i:i + n - 1], ' ') AS surface FROM g),
k AS (SELECT meeting, trim(regexp_replace(replace(lower(regexp_replace(surface, '[''’]', '', 'g')), 'ß', 'ss'), '^((mr|mrs|ms|dr|hon|mayor|alderman|alderwoman|councilmember|director|president|chair)\s+)+', '')) AS norm, surface, count(*) AS n FROM c GROUP BY ALL),
s AS (SELECT meeting, norm, arg_min(surface, (-n, surface)) AS surface, CAST(sum(n) AS BIGINT) AS n FROM k WHERE norm <> '' GROUP BY ALL)"""


_COMMON = ", ".join(f"'{w}'" for w in names.COMMON_WORDS)
_FIT = f"length(norm) >= 5 AND len(list_filter(string_split(norm, ' '), lambda x: x NOT IN ({_COMMON}))) > 0"

ORACLES = {
    "spoken_surfaces": f"WITH {_surfaces('assistant')} SELECT * FROM s",
    "meeting_vocabulary": f"""WITH {_surfaces("user")},
l AS (SELECT lower(p_name) AS norm, array_to_string(list_transform(string_split(min(p_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS canonical FROM part GROUP BY 1)
SELECT NULL AS meeting, norm, canonical, 'lexicon' AS source, {_FIT} AS target FROM l
UNION ALL SELECT meeting, norm, surface, 'written', {_FIT} AND norm NOT IN (SELECT norm FROM l) FROM s""",
}
