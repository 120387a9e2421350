"""Lookup and reference functions as relations.

Cells are rows (sheet_id, row, col, ...). Exact lookups are equi-joins; approximate ones
take the last key not above the probe, by one sort of both sides together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.formula import render
from tabulon.functions.numbering import a1_name, a1_position
from tabulon.operators.ranges import halved
from tabulon.operators.steps import kept


def vlookup(df: DataFrame, probe: str, lookup: DataFrame, key: str, values: list[str], approximate: bool = False) -> DataFrame:
    """df with values of the row whose key equals the probe (of several, the least values); approximate: whose key is the largest not above it."""
    if approximate:
        return asof(df, probe, lookup, key, values)
    # One row per key, so df's rows never multiply.
    first = lookup.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*values)).alias("__v"))
    return df.join(first, F.col(probe) == F.col("__key"), "left").select(*df.columns, *(F.col(f"__v.{v}").alias(v) for v in values))


def asof(df: DataFrame, probe: str, lookup: DataFrame, key: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """df with values of the last lookup row whose key is not above the probe (of equal keys, the least values).

    Both sides are sorted together within each group and the last lookup row is carried on. Without by, keys
    are dealt to BINS quantile bins, each of which begins with the last key before it, and a bin's probes to
    SALTS shares, so one frequent probe does not land in one task."""
    known = lookup.filter(F.col(key).isNotNull())
    if by:
        return _carried(df, F.col(probe), known, F.col(key), values, by)
    quantiles = known.select(F.explode(F.percentile_approx(key, [k / BINS for k in range(1, BINS)], 10 * BINS)).alias("e"))
    edges = sorted({r["e"] for r in quantiles.collect() if r["e"] is not None})  # at most BINS
    right = known.withColumn("__bin", halved(F.col(key), edges)).groupBy("__bin", F.col(key).alias("__key")).agg(F.min(F.struct(*values)).alias("__v")).select("__bin", "__key", *(F.col(f"__v.{v}").alias(v) for v in values))
    last = {r["__bin"]: r["h"] for r in right.groupBy("__bin").agg(F.max_by(F.struct("__key", *values), "__key").alias("h")).collect()}
    carried, head = [], None
    for k in range(len(edges) + 1):
        if head is not None:
            carried.append((k, *head))
        head = last.get(k, head)
    right = right.unionByName(lookup.sparkSession.createDataFrame(carried, right.schema))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = df.withColumns({"__bin": halved(F.col(probe), edges), "__salt": F.floor(F.rand(1) * SALTS).cast("int")})
    return _carried(left, F.col(probe), right, F.col("__key"), values, ["__bin", "__salt"]).drop("__bin", "__salt")


BINS, SALTS = 64, 8


def _carried(left: DataFrame, at: Column, right: DataFrame, key: Column, values: list[str], by: list[str]) -> DataFrame:
    kind = lambda d, c: d.select(F.struct(*c).alias("s")).schema["s"].dataType
    a = left.select(*by, at.alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(kind(right, values)).alias("__v"))
    b = right.groupBy(*by, key.alias("__at")).agg(F.min(F.struct(*values)).alias("__v")).select(*by, "__at", F.lit(0).alias("__side"), F.lit(None).cast(kind(left, left.columns)).alias("__row"), "__v")
    window = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__v", F.last("__v", True).over(window)).filter("__side = 1")
    return both.select("__row.*", *(F.col(f"__v.{v}").alias(v) for v in values))


def lookup(df: DataFrame, probe: str, table: DataFrame, key: str, value: str) -> DataFrame:
    return asof(df, probe, table, key, [value])


def hlookup(df: DataFrame, probe: str, cells: DataFrame, row: int, approximate: bool = False) -> DataFrame:
    """The value `row` rows below the header cell that the probe finds: header and value rows by column, then as vlookup."""
    head = cells.filter("row = 0").select("col", F.col("text").alias("__head"))
    body = cells.filter(F.col("row") == row).select("col", F.col("text").alias("found"))
    return vlookup(df, probe, head.join(body, "col"), "__head", ["found"], approximate)


def match(df: DataFrame, probe: str, table: DataFrame, key: str, position: str, approximate: bool = False) -> DataFrame:
    """The position of the probe: of equal keys the first; approximate: of the largest key not above it."""
    first = table.groupBy(key).agg(F.min(position).alias("position"))
    return vlookup(df, probe, first, key, ["position"], approximate)


def index(cells: DataFrame, row: int, col: int) -> DataFrame:
    """The cell at a place of a range, counted from 1."""
    ends = cells.agg(F.min("row").alias("__r"), F.min("col").alias("__c"))
    return cells.join(F.broadcast(ends), (F.col("row") == F.col("__r") + row - 1) & (F.col("col") == F.col("__c") + col - 1)).drop("__r", "__c")  # one row


def offset(cells: DataFrame, c0: int, r0: int, rows: int, cols: int, height: int = 1, width: int = 1) -> DataFrame:
    return cells.filter(F.col("row").between(r0 + rows, r0 + rows + height - 1) & F.col("col").between(c0 + cols, c0 + cols + width - 1))


def indirect(df: DataFrame, name: str, cells: DataFrame, value: str = "text") -> DataFrame:
    """df with the value of the cell that a text names (A1)."""
    given = df.withColumn("__at", a1_position(F.col(name)))
    own = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias("found"))
    return given.join(own, (F.col("__at.row") == F.col("__r")) & (F.col("__at.col") == F.col("__c")), "left").select(*df.columns, "found")


def address(row: Column, col: Column, absolute: bool = True) -> Column:
    """The name of a place counted from 1."""
    return a1_name(col - 1, row - 1, absolute, absolute)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cells that two ranges share."""
    return a.join(b.select("sheet_id", "row", "col").distinct(), ["sheet_id", "row", "col"], "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both ranges' cells; those in both count twice."""
    return a.unionByName(b)


def areas(references: Column) -> Column:
    return F.size(references)


def columns(cells: DataFrame) -> DataFrame:
    return cells.agg((F.max("col") - F.min("col") + 1).alias("columns"))


def rows(cells: DataFrame) -> DataFrame:
    return cells.agg((F.max("row") - F.min("row") + 1).alias("rows"))


def sheets(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count_distinct("sheet_id").alias("sheets"))


def row_of(row: Column) -> Column:
    return row + 1


def column_of(col: Column) -> Column:
    return col + 1


def sheet_of(sheet_id: Column) -> Column:
    return sheet_id + 1


# Errors: cells have error_code, null without one.
NOT_AVAILABLE = 32767


def is_na(code: Column) -> Column:
    return F.coalesce(code == NOT_AVAILABLE, F.lit(False))


def is_err(code: Column) -> Column:
    return code.isNotNull() & (code != NOT_AVAILABLE)


def is_error(code: Column) -> Column:
    return code.isNotNull()


def error_type(code: Column) -> Column:
    return code


def is_formula(formula: Column) -> Column:
    return formula.isNotNull() & (F.size(formula) > 0)


def is_reference(token: dict) -> bool:
    return token["type"] in ("cell", "cells", "column")


def formula_text(tokens: list[dict]) -> str:
    return "=" + render(tokens)


def cell_info(kind: str, row: Column, col: Column, value: Column, content_type: Column) -> Column:
    """CELL: ROW, COL, ADDRESS, CONTENTS or TYPE (b, l or v)."""
    own = {"ROW": row + 1, "COL": col + 1, "ADDRESS": a1_name(col, row, True, True), "CONTENTS": value, "TYPE": F.when(content_type == "NONE", "b").when(content_type == "TEXT", "l").otherwise("v")}
    return own[kind.upper()]


def multiple_operations(parameters: DataFrame, formula: Callable[..., Column], names: list[str], name: str = "result") -> DataFrame:
    """A what-if table: a formula of parameter columns, once for each row of parameters."""
    return parameters.withColumn(name, formula(*(F.col(n) for n in names)))


def goal_seek(value: Callable[[float], float], target: float, guess: float = 1.0) -> float | None:
    """The argument for which a formula's value is the target; None if steps don't settle."""
    from tabulon.functions.special import newton

    found = newton(lambda x: value(x) - target, guess)
    return None if found != found else found


def traced(references: DataFrame, start: DataFrame, forwards: bool = False, depth: int | None = None) -> DataFrame:
    """Detective: cells that start's cells depend on (or that depend on them), through others too. references: cell, refers.

    Walked until nothing new is found, or `depth` steps if given; each step is kept, so plans stay short."""
    here, there = ("refers", "cell") if forwards else ("cell", "refers")
    step = references.select(F.col(here).alias("cell"), F.col(there).alias("__next"))
    found = near = kept(start.select("cell").distinct())
    k = 0
    while depth is None or k < depth:
        k += 1
        near = kept(near.join(step, "cell").select(F.col("__next").alias("cell")).distinct().join(found, "cell", "left_anti"))
        if near.isEmpty():
            break
        found = found.unionByName(near)
        if k % 16 == 0:
            found = kept(found.coalesce(8))
    return found
