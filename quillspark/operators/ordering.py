"""Positions of rows in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.session import Kept

#: monotonically_increasing_id holds the partition above these bits, and the row inside it below.
ROW_BITS = 33


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    name = f"__{stem}"
    while name in df.columns:
        name += "_"
    return name


def ranked(df: DataFrame, order: list[Column], kept: Kept, out: str = "rank", by: list[str] | None = None) -> DataFrame:
    """df with each row's 1-based position (long) in the given order.

    Rows are dealt out in ranges of the order, sorted inside, and written; a row's position is that in its range and the
    number of rows in the ranges before, of which there is one count each. A number of its own breaks each row's ties for
    dealing, so equal rows, however many, spread over several ranges; which of them comes first is left open.
    With `by`, positions begin anew for each value of these columns, which lead the order.
    No rows give no rows; nulls stand where the order puts them.
    """
    tie, at, part, base = (fresh(df, x) for x in ("tie", "at", "part", "base"))
    by = by or []
    keys = [*[F.col(f"`{c}`").asc_nulls_first() for c in by], *order]
    dealt = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys, F.col(tie)).sortWithinPartitions(*keys, F.col(tie)).drop(tie)
    rows = kept.keep(dealt.withColumn(at, F.monotonically_increasing_id()), "ranked").withColumn(part, F.shiftright(at, ROW_BITS))
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))  # one row for each range
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    placed = rows.join(F.broadcast(bases), part).withColumn(out, F.col(base) + F.col(at).bitwiseAND((1 << ROW_BITS) - 1) + 1)
    if by:
        first = placed.groupBy(*[F.col(f"`{c}`").alias(f"{base}{k}") for k, c in enumerate(by)]).agg(F.min(out).alias(tie))
        same = [F.col(f"`{c}`").eqNullSafe(F.col(f"{base}{k}")) for k, c in enumerate(by)]
        cond = same[0]
        for x in same[1:]:
            cond &= x
        placed = placed.join(first, cond).withColumn(out, F.col(out) - F.col(tie) + 1).drop(tie, *[f"{base}{k}" for k in range(len(by))])
    return placed.drop(at, part, base)
