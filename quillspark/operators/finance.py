"""Structured money: totals by year, shares, stacks, pivots, and the first citation of each figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(28,2)"


def yearly_totals(rows: DataFrame, year: Column, category: Column, amount: Column, kinds: dict[str, str]) -> DataFrame:
    """One row a year, one column for each kind; other categories are left out of all."""
    a = amount.cast(MONEY)
    return rows.groupBy(year.alias("year")).agg(*[F.coalesce(F.sum(F.when(category == value, a)), F.lit(0)).cast(MONEY).alias(name) for name, value in kinds.items()])


def shares(rows: DataFrame, key: Column, amount: Column, unnamed: str = "Unspecified") -> DataFrame:
    """(label, amount, percent): null and blank labels are one; nothing where the grand total isn't positive."""
    label = F.coalesce(F.nullif(F.trim(key), F.lit("")), F.lit(unnamed))
    sums = rows.groupBy(label.alias("label")).agg(F.sum(amount.cast(MONEY)).alias("amount"))
    total = sums.agg(F.sum("amount").alias("total"))
    return sums.join(F.broadcast(total)).where("total > 0").select("label", F.col("amount").cast(MONEY).alias("amount"), F.round(100 * F.col("amount").cast("double") / F.col("total").cast("double"), 6).alias("percent"))


def cited_shares(rows: DataFrame, key: Column, amount: Column, order: Column, reference: Column) -> DataFrame:
    """shares, each with the reference of its first row in order."""
    label = F.coalesce(F.nullif(F.trim(key), F.lit("")), F.lit("Unspecified"))
    first = rows.groupBy(label.alias("label")).agg(F.min_by(reference, order).alias("reference"))
    return shares(rows, key, amount).join(first, "label")


def component_trend(rows: DataFrame, year: Column, amount: Column, order: Column, reference: Column) -> DataFrame:
    """Sum a year, with the first reference that isn't null."""
    return rows.groupBy(year.alias("year")).agg(F.sum(amount.cast(MONEY)).cast(MONEY).alias("amount"), F.min_by(reference, F.when(reference.isNotNull(), order)).alias("reference"))


def stack(rows: DataFrame, series: Column, year: Column, amount: Column) -> DataFrame:
    """(series, year, amount, series_total, place): series by total, the largest first, ties by name."""
    cells = rows.groupBy(series.alias("series"), year.alias("year")).agg(F.sum(amount.cast(MONEY)).cast(MONEY).alias("amount"))
    totals = cells.groupBy("series").agg(F.sum("amount").cast(MONEY).alias("series_total"))
    totals = totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("series_total"), "series")))  # a row for each series
    return cells.join(totals, "series")


def budget_vs_actual(rows: DataFrame, keys: list[str], basis: Column, amount: Column, bases: tuple[str, str, str]) -> DataFrame:
    """Original, final and actual side by side, all three needed, and the variance of actual from final."""
    a = amount.cast("decimal(32,6)")  # sums are rounded, not their terms
    wide = rows.groupBy(*keys).agg(*[F.sum(F.when(basis == b, a)).cast(MONEY).alias(n) for n, b in zip(("original", "final", "actual"), bases, strict=True)])
    return wide.dropna(subset=["original", "final", "actual"]).withColumn("variance", (F.col("actual") - F.col("final")).cast(MONEY))


def roll_up(rows: DataFrame, keys: list[str], amount: Column, fund: Column, order: Column, reference: Column, top: int | None = None) -> DataFrame:
    """Figures summed across funds: the funds by name, the first reference that isn't null; rows without one are dropped, newest first."""
    out = rows.groupBy(*keys).agg(F.sum(amount.cast(MONEY)).cast(MONEY).alias("amount"), F.array_join(F.array_sort(F.collect_set(fund)), "+").alias("funds"), F.min_by(reference, F.when(reference.isNotNull(), order)).alias("reference"))
    out = out.where(F.col("reference").isNotNull())
    return out.orderBy(*[F.desc(k) for k in keys]).limit(top) if top else out


def reconcile(parts: DataFrame, totals: DataFrame, keys: list[str], part: str, total: str, tolerance: float = 0.005) -> DataFrame:
    """For each key the sum of its parts, the stated total, and whether they agree; keys on one side alone don't."""
    sums = parts.groupBy(*keys).agg(F.sum(F.col(part).cast(MONEY)).cast(MONEY).alias("parts"))
    both = sums.join(totals.select(*keys, F.col(total).cast(MONEY).alias("stated")), keys, "full_outer")
    return both.select(*keys, "parts", "stated", F.coalesce(F.abs(F.col("parts") - F.col("stated")) <= tolerance, F.lit(False)).alias("agrees"))


def planned_and_actual(actual: DataFrame, planned: DataFrame, year: str = "year", amount: str = "amount") -> DataFrame:
    each = [df.groupBy(year).agg(F.sum(F.col(amount).cast(MONEY)).cast(MONEY).alias("amount")).select(year, F.lit(kind).alias("kind"), "amount") for kind, df in (("actual", actual), ("planned", planned))]
    return each[0].unionByName(each[1])
