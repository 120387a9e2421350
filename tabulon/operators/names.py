"""Names and places: named ranges, label ranges, sheet names in references, cached links."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.formula import compile_tokens, tokens
from tabulon.functions.numbering import a1_name
from tabulon.operators.ranges import table_of
from tabulon.plans.specs import Range


class Workbook:
    """Named ranges over a cell table. Names are not case-sensitive."""

    def __init__(self, cells: DataFrame, ranges: list[Range] = (), formulas: dict[str, str] | None = None):
        self.cells = cells
        self.ranges = {r.name.lower(): r for r in ranges}
        self.formulas = {k.lower(): v for k, v in (formulas or {}).items()}

    def table(self, name: str) -> DataFrame:
        """A named range as a table."""
        found = self.ranges.get(name.lower())
        if found is None:
            raise KeyError(f"no range is named {name}")
        return table_of(self.cells, found)

    def views(self, prefix: str = "") -> list[str]:
        """Each range as a temporary view; the views' names."""
        out = []
        for name, spec in self.ranges.items():
            table_of(self.cells, spec).createOrReplaceTempView(prefix + name)
            out.append(prefix + name)
        return out

    def formula(self, name: str) -> Column:
        """A named formula as a column; names in it are resolved too. A name that stands for itself is an error."""
        return self._resolved(name.lower(), ())

    def _resolved(self, name: str, seen: tuple) -> Column:
        if name in seen:
            raise ValueError(f"{name} stands for itself")
        if name not in self.formulas:
            return F.col(name)
        return compile_tokens(tokens(self.formulas[name]), lambda t: self._resolved(t["name"].lower(), (*seen, name)))


def labelled(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Columns under the labels of column-label ranges."""
    return df.withColumnsRenamed(labels)


def with_sheet_names(references: DataFrame, sheets: DataFrame, sheet: str = "sheet_id", current: str = "own_sheet_id") -> DataFrame:
    """References with the name of their sheet where it is not the current one. sheets: doc_id, sheet_id, name, a few rows a document."""
    names = sheets.select("doc_id", F.col("sheet_id").alias(sheet), F.col("name").alias("__name"))
    out = references.join(names, ["doc_id", sheet], "left")
    return out.withColumn("sheet_name", F.when(F.col(sheet) != F.col(current), F.col("__name"))).drop("__name")


def reference_text(col: Column, row: Column, sheet_name: Column, absolute_col: bool = False, absolute_row: bool = False) -> Column:
    """[.A1], or [Sheet.A1] with a sheet's name."""
    return F.concat(F.lit("["), F.coalesce(sheet_name, F.lit("")), F.lit("."), a1_name(col, row, absolute_col, absolute_row), F.lit("]"))


def token_properties(given: list[dict]) -> str:
    """A formula's tokens as the property list that sheet calls carry (JSON). Shared formulas have none."""
    kinds = {"operator": "operator", "function": "function", "number": "number", "long": "number", "text": "text", "cell": "cell", "cells": "cells", "column": "cell"}
    if any(t["type"] == "index" for t in given):
        return "[]"
    return json.dumps([{"type": kinds[t["type"]]} | {k: v for k, v in t.items() if k != "type"} for t in given])


def linked(df: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of area and live links with the values that were stored for them; nothing is fetched."""
    return df.join(links, keys, "left")


def sheet_attributes(sheets: DataFrame, visible_only: bool = True, scenario: bool | None = None) -> DataFrame:
    """Sheets by their flags: visible, scenario, active."""
    out = sheets.filter("visible") if visible_only else sheets
    return out if scenario is None else out.filter(F.col("scenario") == scenario)
