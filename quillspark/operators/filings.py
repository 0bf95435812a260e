"""Figures of XML filings: nested tables read by a layout, every stated total held against its parts, failures as rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as X

TOTAL = "total"
_CORRUPT = "__corrupt"


@dataclass(frozen=True)
class Block:
    """A table of a filing: the elements from below the root down to its rows, and the attributes of a row.

    key names a row; an element without that attribute is none of this block. columns are labels with their attributes; total
    is the attribute of the row's stated total.
    """

    name: str
    path: tuple[str, ...]
    key: str
    columns: dict[str, str]
    total: str | None = None

    def attributes(self) -> dict[str, str]:
        return self.columns | ({TOTAL: self.total} if self.total else {})


@dataclass(frozen=True)
class CrossFoot:
    """In each row of a block the columns sum up to the stated total; `rows` must be there."""

    name: str
    block: Block
    rows: tuple[str, ...] = ()
    tolerance: float = 0.0


@dataclass(frozen=True)
class Balance:
    """For each column the signed cells of rows, (block, row) with their signs, sum up to nothing; all are needed but the optional ones.

    A balance carried forward, two statements of one total, and a total of totals are of this kind.
    """

    name: str
    terms: dict[tuple[str, str], int]
    columns: tuple[str, ...]
    optional: frozenset[tuple[str, str]] = frozenset()
    tolerance: float = 0.0


@dataclass(frozen=True)
class PartOf:
    """For each parent row and column the direct parts sum up to the parent's cell; parts are row: parent.

    As every parent is held against its direct parts, a tree of any depth is held against its leaves.
    """

    name: str
    block: str
    parents: dict[str, str]
    columns: tuple[str, ...]
    tolerance: float = 0.0


@dataclass(frozen=True)
class AllRows:
    """For each column all rows of a block sum up to one row of another."""

    name: str
    block: str
    into: tuple[str, str]
    columns: tuple[str, ...]
    tolerance: float = 0.0


@dataclass(frozen=True)
class Quotient:
    """A stated rate is factor * top / bottom; the three are (block, row, column)."""

    name: str
    top: tuple[str, str, str]
    bottom: tuple[str, str, str]
    rate: tuple[str, str, str]
    factor: float = 1.0
    tolerance: float = 0.0001


Check = CrossFoot | Balance | PartOf | AllRows | Quotient


@dataclass
class _Node:
    attributes: set[str] = field(default_factory=set)
    children: dict[str, _Node] = field(default_factory=dict)

    def type(self) -> T.StructType:
        fields = [T.StructField(f"_{a}", T.StringType()) for a in sorted(self.attributes)]
        return T.StructType(fields + [T.StructField(e, T.ArrayType(n.type())) for e, n in sorted(self.children.items())])


def schema(blocks: list[Block]) -> T.StructType:
    """The nested type that holds the rows of all blocks; elements may repeat at every level."""
    root = _Node()
    for b in blocks:
        node = root
        for element in b.path:
            node = node.children.setdefault(element, _Node())
        node.attributes |= {b.key, *b.attributes().values()}
    return T.StructType([*root.type().fields, T.StructField(_CORRUPT, T.StringType())])


def figures(filings: DataFrame, doc: str, xml: str, blocks: list[Block]) -> DataFrame:
    """(doc, block, row, column, raw, amount): a row for each cell that a filing states.

    Elements are told by their local names, in any order and number. A percent is read as a rate, other cells as money; amount is
    null where the text is neither. Null, empty and broken XML states nothing. Doc must name a filing; the rest is one map.
    """
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = filings.where(F.length(xml) > 0).select(F.col(doc), F.from_xml(F.col(xml), schema(blocks).simpleString(), options).alias("x")).where(F.col(f"x.{_CORRUPT}").isNull())

    def cells(b: Block) -> Column:
        def rows(at: Column, path: tuple[str, ...]) -> Column:
            inner = F.coalesce(at[path[0]], F.array())
            return inner if len(path) == 1 else F.flatten(F.transform(inner, lambda e: rows(e, path[1:])))

        def of(r: Column) -> Column:
            return F.array(*[F.struct(F.lit(b.name).alias("block"), r[f"_{b.key}"].alias("row"), F.lit(c).alias("column"), r[f"_{a}"].alias("raw")) for c, a in b.attributes().items()])

        stated = F.filter(F.flatten(F.transform(rows(F.col("x"), b.path), of)), lambda c: c["row"].isNotNull() & c["raw"].isNotNull())
        return stated

    out = parsed.select(doc, F.explode(F.concat(*[cells(b) for b in blocks])).alias("c")).select(doc, "c.block", "c.row", "c.column", "c.raw")
    rate = X.rate(F.col("raw")).cast("decimal(18,6)")
    return out.withColumn("amount", F.coalesce(rate, X.money_or_null(F.col("raw")).cast("decimal(18,6)")))


def _parts(check: Check) -> tuple[list[Column], list[tuple[str, int]]]:
    """What a figure adds to a check, as (check, at, part, amount, needed), and the places with the number of needed cells."""
    block, row, column, amount = (F.col(c) for c in ("block", "row", "column", "amount"))

    def add(when: Column, at: Column, sign: Column, needed: Column, part: str = "sum") -> Column:
        return F.when(when, F.struct(F.lit(check.name).alias("check"), at.alias("at"), F.lit(part).alias("part"), (sign * amount).cast("decimal(28,6)").alias("amount"), needed.cast("int").alias("needed")))

    one, places = F.lit(1), lambda first, cs: F.concat(first, F.lit("/"), cs)
    match check:
        case CrossFoot():
            sign = F.when(column == TOTAL, -1).otherwise(1)
            return [add((block == check.block.name), row, sign, one)], [(r, len(check.block.attributes())) for r in check.rows]
        case Balance():
            of = F.concat_ws("\x01", block, row)
            named = lambda keys: of.isin([f"{b}\x01{r}" for b, r in keys]) if keys else F.lit(False)
            plus, minus = ({k for k, s in check.terms.items() if (s > 0) == up} for up in (True, False))
            sign = F.when(named(plus), 1).otherwise(-1)
            wanted = set(check.terms) - check.optional
            return [add((named(plus) | named(minus)) & column.isin(*check.columns), column, sign, named(wanted))], [(c, len(wanted)) for c in check.columns]
        case PartOf():
            inside = (block == check.block) & column.isin(*check.columns)
            parent = reduce(lambda c, kv: c.when(row == kv[0], kv[1]), check.parents.items(), F.when(F.lit(False), F.lit("")))
            tops = sorted(set(check.parents.values()))
            n = {p: sum(v == p for v in check.parents.values()) + 1 for p in tops}
            return [add(inside & parent.isNotNull(), places(parent, column), one, one), add(inside & row.isin(tops), places(row, column), F.lit(-1), one)], [(f"{p}/{c}", n[p]) for p in tops for c in check.columns]
        case AllRows():
            into = (block == check.into[0]) & (row == check.into[1])
            part = (block == check.block) & ~into
            return [add((part | into) & column.isin(*check.columns), column, F.when(into, -1).otherwise(1), into)], [(c, 1) for c in check.columns]
        case Quotient():
            cell = lambda k: (block == k[0]) & (row == k[1]) & (column == k[2])
            return [add(cell(k), F.lit(""), one, one, p) for p, k in (("top", check.top), ("bottom", check.bottom), ("rate", check.rate))], [("", 3)]


def reconcile(filings: DataFrame, cells: DataFrame, doc: str, checks: list[Check]) -> DataFrame:
    """(doc, check, at, difference, holds): each check of each filing, at a row or column.

    It holds where all needed cells are stated, once each and readable, and the difference is within its tolerance. A check
    without cells doesn't hold; rows of a cross-foot that aren't asked for are checked where they stand. difference is null where
    nothing is to be summed up or the bottom of a rate is 0. One grouping by filing, check and place.
    """
    added, expected = zip(*[_parts(c) for c in checks], strict=True)
    found = cells.select(doc, F.explode(F.array_compact(F.array(*[a for each in added for a in each]))).alias("c")).select(doc, "c.check", "c.at", "c.part", "c.amount", "c.needed", F.lit(0).alias("asked"))
    asked = [F.struct(F.lit(c.name).alias("check"), F.lit(at).alias("at"), F.lit(n).alias("asked")) for c, places in zip(checks, expected, strict=True) for at, n in places]
    if asked:
        nothing = F.lit(None).cast("decimal(28,6)").alias("amount")
        found = found.unionByName(filings.select(doc).distinct().select(doc, F.explode(F.array(*asked)).alias("c")).select(doc, "c.check", "c.at", F.lit(None).cast("string").alias("part"), nothing, F.lit(0).alias("needed"), "c.asked"))
    of = lambda p: F.sum(F.when(F.col("part") == p, F.col("amount")))
    sums = found.groupBy(doc, "check", "at").agg(
        of("sum").alias("sum"), of("top").alias("top"), of("bottom").alias("bottom"), of("rate").alias("rate"),
        F.sum("needed").alias("n"), F.max("asked").alias("asked"), F.count_if(F.col("part").isNotNull() & F.col("amount").isNull()).alias("unread"),
    )
    by = lambda value: reduce(lambda c, x: c.when(F.col("check") == x.name, value(x)), checks, F.when(F.lit(False), F.lit(0.0)))
    rate = by(lambda x: float(x.factor) if isinstance(x, Quotient) else 0.0) * F.col("top").cast("double") / F.nullif(F.col("bottom").cast("double"), F.lit(0.0)) - F.col("rate").cast("double")
    sums = sums.withColumn("difference", F.round(F.when(F.col("check").isin([c.name for c in checks if isinstance(c, Quotient)] or [""]), rate).otherwise(F.col("sum").cast("double")), 6))
    whole = (F.when(F.col("asked") > 0, F.col("asked")).otherwise(F.col("n")) == F.col("n")) & (F.col("unread") == 0)
    holds = whole & F.coalesce(F.abs("difference") <= by(lambda x: float(x.tolerance)) + 1e-9, F.lit(False))
    return sums.select(doc, "check", "at", "difference", holds.alias("holds"))


def accepted(cells: DataFrame, checked: DataFrame, doc: str) -> DataFrame:
    """The figures of filings whose checks all hold; a filing that was not checked is not accepted."""
    good = checked.groupBy(doc).agg(F.bool_and("holds").alias("good")).where("good").select(doc)
    return cells.join(good, doc, "left_semi")


def line_items(cells: DataFrame, doc: str, blocks: list[str]) -> DataFrame:
    """(doc, block, row, column, amount, quote): a cited figure for each cell that isn't a total or zero; quote is the text to cite."""
    rows = cells.where(F.col("block").isin(*blocks) & (F.col("column") != TOTAL) & (F.col("amount") != 0))
    amount = F.col("amount").cast("decimal(18,2)")
    shown = F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(amount), 2))
    return rows.select(doc, "block", "row", "column", amount.alias("amount"), F.concat("row", F.lit(", "), "column", F.lit(": "), shown).alias("quote"))
