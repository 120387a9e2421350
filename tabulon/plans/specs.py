"""Declarative specifications of sheet operations, as sheets store them.

Stored files give codes without a meaning; the names used here are this library's own.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Entry:
    """A filter condition. connect joins it to those before it, left to right."""

    field: str
    op: str  # = <> < <= > >= empty nonempty contains begins ends regex top bottom top% bottom%
    value: object = None
    by_string: bool | None = None  # None: by the value's type
    connect: str = "and"


@dataclass(frozen=True)
class Query:
    entries: tuple[Entry, ...] = ()
    case_sensitive: bool = True
    regex: bool = False
    duplicates: bool = True
    whole_cell: bool = True

    MOST = 8  # entries a stored query holds; more are fine here


@dataclass(frozen=True)
class Key:
    field: str
    ascending: bool = True
    user_list: tuple[str, ...] = ()


@dataclass(frozen=True)
class Sort:
    keys: tuple[Key, ...] = ()
    case_sensitive: bool = True
    limit: int | None = None


@dataclass(frozen=True)
class Group:
    field: str
    functions: tuple[tuple[str, str], ...]  # (column, function)


@dataclass(frozen=True)
class Subtotal:
    groups: tuple[Group, ...]
    ascending: bool = True
    remove: bool = False


@dataclass(frozen=True)
class Dimension:
    """orientation: row, column, data or page. hidden: members that are left out."""

    field: str
    orientation: str = "row"
    function: str = "sum"
    hidden: tuple[str, ...] = ()
    page: object = None
    subtotal: bool = False


@dataclass(frozen=True)
class Pilot:
    dimensions: tuple[Dimension, ...]
    query: Query = Query()
    total_rows: bool = False
    total_columns: bool = False
    ignore_empty: bool = False
    values: tuple = ()  # the column dimension's members; none: read from the data


@dataclass(frozen=True)
class Rule:
    """Validation. mode: any, whole, decimal, date, time, length, list, custom."""

    column: str
    mode: str
    op: str = "between"
    low: object = None
    high: object = None
    members: tuple = ()
    allow_empty: bool = True
    message: str = ""


@dataclass(frozen=True)
class Range:
    """A named rectangle of a sheet; positions from 0, ends included."""

    name: str
    sheet: int
    c0: int
    r0: int
    c1: int
    r1: int
    header: bool = True
    by_row: bool = True
    query: Query = Query()
    sort: Sort = Sort()
    subtotal: Subtotal | None = None
    consolidate: tuple = field(default=())
