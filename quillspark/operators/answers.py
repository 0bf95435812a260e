"""Questions after figures: their intent by a vocabulary, the rows that answer it as cited evidence, or the text path."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import display
from quillspark.functions.text import fiscal_year
from quillspark.operators.finance import MONEY

#: Figures of one answer.
MAX_ITEMS = 12


@dataclass(frozen=True)
class Vocabulary:
    """Words that tell what a question is after, compared as whole words whatever their case.

    guards keep a question on the text path; categories and dimensions are tried in order. labels: dimension, label and its
    words. total: what a whole category is called, asked for by total_words where no label is named.
    """

    categories: dict[str, tuple[str, ...]]
    labels: dict[str, dict[str, tuple[str, ...]]]
    total: str = "total"
    total_words: tuple[str, ...] = ("total", "overall", "altogether")
    guards: tuple[str, ...] = field(default=("per pupil", "tax levy"))


def _names(query: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words, or phrases of letters, digits and blanks, stands in the query."""
    return F.lower(query).rlike(r"(?<![\p{L}\p{N}])(" + "|".join(words) + r")(?![\p{L}\p{N}])") if words else F.lit(False)


def intents(queries: DataFrame, query: str, vocabulary: Vocabulary) -> DataFrame:
    """queries with category, dimension, labels (in order of name) and fiscal_year; all but the year null where text must answer.

    A category and either a label or a word for the total are needed. Null queries go to the text path.
    """
    q, none = F.col(query), F.lit(None).cast("array<string>")
    category = F.coalesce(*[F.when(_names(q, words), c) for c, words in vocabulary.categories.items()])
    named = {d: F.array_compact(F.array(*[F.when(_names(q, words), label) for label, words in sorted(labels.items())])) for d, labels in vocabulary.labels.items()}
    total = _names(q, vocabulary.total_words)
    dimension = F.coalesce(*[F.when(F.size(a) > 0, d) for d, a in named.items()], F.when(total, vocabulary.total))
    labels = F.coalesce(*[F.when(F.size(a) > 0, a) for a in named.values()], F.when(total, F.array(F.lit(vocabulary.total))))
    asked = category.isNotNull() & dimension.isNotNull() & ~_names(q, vocabulary.guards)
    return queries.withColumns({"category": F.when(asked, category), "dimension": F.when(asked, dimension), "labels": F.when(asked, labels).otherwise(none), "fiscal_year": fiscal_year(q)})


def evidence(asked: DataFrame, figures: DataFrame, top: int = MAX_ITEMS) -> DataFrame:
    """(category, dimension, labels, fiscal_year, place, label, year, amount, funds, reference, evidence): the figures that answer each intent.

    figures: category, dimension, label, fund, year (a label as fiscal_year gives it), amount, position and reference. They are
    summed across funds a year and label before they meet the intents, each of which is answered once however often it is asked.
    The reference is the first that isn't null by position; figures without one can't be cited and are left out. Latest years
    first, then labels by name; the first `top`.
    """
    keys = ["category", "dimension", "label", "year"]
    cited = F.min_by("reference", F.when(F.col("reference").isNotNull(), F.struct("position", "reference")))
    rows = figures.groupBy(*keys).agg(F.sum(F.col("amount").cast(MONEY)).cast(MONEY).alias("amount"), F.array_join(F.array_sort(F.collect_set("fund")), "+").alias("funds"), cited.alias("reference")).where("reference IS NOT NULL")
    intent = ["category", "dimension", "labels", "fiscal_year"]
    each = asked.where("category IS NOT NULL").select(*intent).distinct().withColumn("label", F.explode("labels"))
    met = each.join(rows, ["category", "dimension", "label"]).where("fiscal_year IS NULL OR fiscal_year = year")
    w = Window.partitionBy(*intent).orderBy(F.desc("year"), "label")  # years and labels of one intent
    line = F.concat(F.lit("FY"), "year", F.lit(" - "), "label", F.lit(" ("), "funds", F.lit(", "), "category", F.lit("): "), display.usd(F.col("amount")), F.lit(" ["), F.col("reference").cast("string"), F.lit("]"))
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(*intent, "place", "label", "year", "amount", "funds", "reference", line.alias("evidence"))


def answers(queries: DataFrame, query: str, figures: DataFrame, vocabulary: Vocabulary, top: int = MAX_ITEMS) -> DataFrame:
    """queries with path ('figures' or 'text') and evidence, an array of lines in order, empty for the text path.

    A question whose intent has no figure falls back to text.
    """
    asked = intents(queries, query, vocabulary)
    lines = evidence(asked, figures, top).groupBy("category", "dimension", "labels", F.coalesce("fiscal_year", F.lit("")).alias("__y"))
    lines = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence"))), lambda s: s["evidence"]).alias("evidence"))
    out = asked.withColumn("__y", F.coalesce("fiscal_year", F.lit(""))).join(lines, ["category", "dimension", "labels", "__y"], "left").drop("__y")
    return out.withColumn("path", F.when(F.col("evidence").isNull(), "text").otherwise("figures")).withColumn("evidence", F.coalesce("evidence", F.expr("cast(array() as array<string>)")))
