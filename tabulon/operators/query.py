"""Filters, sorts, subtotals, pivots, consolidation, validation: stored specifications, executed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.formula import FUNCTIONS, compile_text
from tabulon.operators.ranges import row_numbers
from tabulon.plans.specs import Dimension, Entry, Pilot, Query, Rule, Sort, Subtotal


def condition(entry: Entry, query: Query, kind: str) -> Column:
    """One filter entry as a condition; kind: the column's type."""
    by_string = entry.by_string if entry.by_string is not None else isinstance(entry.value, str)
    x, value = F.col(entry.field), entry.value
    if entry.op in ("empty", "nonempty"):
        empty = x.isNull() | (x.cast("string") == "")
        return empty if entry.op == "empty" else ~empty
    if by_string:
        x, value = x.cast("string"), str(value)
        if entry.op == "regex" or query.regex and entry.op in ("=", "<>"):
            pattern = value if not query.whole_cell or entry.op == "regex" else f"^(?:{value})$"
            found = x.rlike(pattern if query.case_sensitive else f"(?i){pattern}")
            return ~found if entry.op == "<>" else found
        if not query.case_sensitive:
            x, value = F.lower(x), value.lower()
        text = {"contains": x.contains, "begins": x.startswith, "ends": x.endswith}
        if entry.op in text:
            return text[entry.op](value)
        if not query.whole_cell and entry.op in ("=", "<>"):
            return x.contains(value) if entry.op == "=" else ~x.contains(value)
    elif kind == "string":
        x = x.try_cast("double")
    tests = {"=": x == value, "<>": x != value, "<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}
    if entry.op not in tests:
        raise ValueError(f"no filter operator {entry.op}")
    return tests[entry.op]


RANKED = ("top", "bottom", "top%", "bottom%")


def filtered(df: DataFrame, query: Query) -> DataFrame:
    """Conditions from left to right: ((a and b) or c). Ranked entries (top and bottom so many, ties kept) are joined by and."""
    kinds, out = dict(df.dtypes), None
    for entry in query.entries:
        if entry.op in RANKED:
            continue
        own = condition(entry, query, kinds[entry.field])
        out = own if out is None else (out & own if entry.connect == "and" else out | own)
    found = df if out is None else df.filter(out)
    for entry in query.entries:
        if entry.op in RANKED:
            found = _ranked(found, entry)
    return found if query.duplicates else found.dropDuplicates()


def _ranked(df: DataFrame, entry: Entry) -> DataFrame:
    """By the value at the limit's place, found by a top-k that is combined map-side, not by a ranking of all rows."""
    top, n = entry.op.startswith("top"), int(entry.value)
    if entry.op.endswith("%"):
        share = 1 - n / 100 if top else n / 100
        edge = df.agg(F.percentile(entry.field, F.lit(share)).alias("edge"))
    else:
        order = F.desc_nulls_last(entry.field) if top else F.asc_nulls_last(entry.field)
        edge = df.filter(F.col(entry.field).isNotNull()).select(entry.field).orderBy(order).limit(n).agg((F.min if top else F.max)(entry.field).alias("edge"))
    joined = df.join(F.broadcast(edge), (F.col(entry.field) >= F.col("edge")) if top else (F.col(entry.field) <= F.col("edge")))  # one row
    return joined.drop("edge")


def distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(columns)


#: Criteria rows of one condition: a sheet range.
CRITERIA = 8192


def advanced_filter(df: DataFrame, criteria: DataFrame, distinct_rows: bool = False) -> DataFrame:
    """Rows that some criteria row matches in all its columns that aren't empty. A criterion is a value or an operator and a value (`>10`).

    Up to CRITERIA rows are read to the driver and made one condition; more are a semi-join, in which each row is held against each criteria row."""
    rows = criteria.limit(CRITERIA + 1).collect()
    kinds = dict(df.dtypes)
    if len(rows) > CRITERIA:
        out = _criteria_join(df, criteria, kinds)
        return out.dropDuplicates() if distinct_rows else out
    tests = []
    for row in rows:
        own = [_criterion(F.col(c), kinds[c], row[c]) for c in criteria.columns if row[c] is not None and row[c] != ""]
        if own:
            tests.append(reduce(Column.__and__, own))
    out = df.filter(reduce(Column.__or__, tests)) if tests else df
    return out.dropDuplicates() if distinct_rows else out


def _criterion(x: Column, kind: str, given: object) -> Column:
    text = str(given)
    for op in ("<=", ">=", "<>", "<", ">", "="):
        if text.startswith(op):
            value = text[len(op) :]
            x, value = (x.cast("double"), float(value)) if kind != "string" else (x, value)
            return {"<=": x <= value, ">=": x >= value, "<>": x != value, "<": x < value, ">": x > value, "=": x == value}[op]
    return x == (float(text) if kind != "string" else text)


def _criteria_join(df: DataFrame, criteria: DataFrame, kinds: dict[str, str]) -> DataFrame:
    names = criteria.columns
    given = criteria.select(*(F.col(c).cast("string").alias(f"__c{k}") for k, c in enumerate(names)))
    given = given.filter(reduce(Column.__or__, [F.coalesce(F.col(c) != "", F.lit(False)) for c in given.columns])).distinct()
    if given.isEmpty():
        return df
    parts = []
    for k, name in enumerate(names):
        op = F.regexp_extract(f"__c{k}", "^(<=|>=|<>|<|>|=)?", 1)
        value = F.substring(F.col(f"__c{k}"), F.length(op) + 1, F.length(f"__c{k}"))
        parts += [op.alias(f"__o{k}"), F.when(F.col(f"__c{k}") != "", value if kinds[name] == "string" else value.cast("double")).alias(f"__v{k}")]
    tests = []
    for k, name in enumerate(names):
        op, v, x = F.col(f"__o{k}"), F.col(f"__v{k}"), F.col(name) if kinds[name] == "string" else F.col(name).cast("double")
        held = F.when(op == "<=", x <= v).when(op == ">=", x >= v).when(op == "<>", x != v).when(op == "<", x < v).when(op == ">", x > v).otherwise(x == v)
        tests.append(v.isNull() | held)
    return df.join(given.select(*parts), reduce(Column.__and__, tests), "left_semi")


def semi_filter(df: DataFrame, keys: DataFrame, on: list[str], anti: bool = False) -> DataFrame:
    """Rows whose keys are (not) in another table, of any size."""
    return df.join(keys.select(*on).distinct(), on, "left_anti" if anti else "left_semi")


def orders(spec: Sort, df: DataFrame) -> list[Column]:
    kinds, out = dict(df.dtypes), []
    for key in spec.keys:
        x = F.col(key.field)
        if key.user_list:  # listed values first, in the list's order
            place = F.array_position(F.array(*map(F.lit, key.user_list)), x)
            x = F.when(place > 0, place).otherwise(F.lit(len(key.user_list) + 1))
        elif kinds[key.field] == "string" and not spec.case_sensitive:
            x = F.lower(x)
        out.append(x.asc_nulls_last() if key.ascending else x.desc_nulls_last())
    return out


def sorted_rows(df: DataFrame, spec: Sort) -> DataFrame:
    """Empty cells last, in either direction. With a limit it is a top-k, without a full sort."""
    out = df.orderBy(*orders(spec, df))
    return out if spec.limit is None else out.limit(spec.limit)


def aggregate(function: str, column: str) -> Column:
    x = F.col(column)
    return {"count": F.count(x), "countnums": FUNCTIONS["count"].build(x)}.get(function.lower()) if function.lower() in ("count", "countnums") else FUNCTIONS[function.lower()].build(x)


def subtotals(df: DataFrame, spec: Subtotal) -> DataFrame:
    """A row per group of each level and the grand total: level is the number of fields it totals over. One pass by rollup."""
    fields = [g.field for g in spec.groups]
    wanted = dict.fromkeys(f for g in spec.groups for f in g.functions)
    made = df.rollup(*fields).agg(F.grouping_id().alias("__id"), *(aggregate(f, c).alias(f"{f}_{c}") for c, f in wanted))
    level = F.bit_count("__id").cast("int").alias("level")
    return made.select(*fields, level, *(f"{f}_{c}" for c, f in wanted))


def with_subtotals(df: DataFrame, spec: Subtotal) -> DataFrame:
    """Detail rows and subtotal rows together, in sheet order: details of a group, then its total. level 0 is a detail."""
    if spec.remove:
        return df
    totals = subtotals(df, spec).withColumn("level", F.col("level") + 1)
    fields = [g.field for g in spec.groups]
    both = df.withColumn("level", F.lit(0)).unionByName(totals, allowMissingColumns=True)
    order = [F.col(f).asc_nulls_last() if spec.ascending else F.col(f).desc_nulls_last() for f in fields]
    return both.orderBy(*order, "level")


def pilot(df: DataFrame, spec: Pilot) -> DataFrame:
    """A data pilot: page filters and hidden members, rows by columns, totals by grouping sets.

    Columns are named member_function_field; without a column dimension, function_field."""
    df = filtered(df, spec.query)
    rows, across, data = ([d for d in spec.dimensions if d.orientation == o] for o in ("row", "column", "data"))
    for d in spec.dimensions:
        if d.hidden:
            df = df.filter(~F.col(d.field).isin(*d.hidden) | F.col(d.field).isNull())
        if d.orientation == "page" and d.page is not None:
            df = df.filter(F.col(d.field) == d.page)
        if spec.ignore_empty and d.orientation in ("row", "column"):
            df = df.filter(F.col(d.field).isNotNull())
    names = [d.field for d in rows]
    measures = _measures(df, across, data, spec)
    if not names:
        return df.agg(*measures)
    sets = [names] + [names[: k + 1] for k in range(len(names) - 1) if rows[k].subtotal] + ([[]] if spec.total_rows else [])
    if len(sets) == 1:
        return df.groupBy(*names).agg(*measures)
    made = df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in names)).agg(F.grouping_id().alias("__id"), *measures)
    return made.withColumn("level", F.bit_count("__id").cast("int")).drop("__id")


def _measures(df: DataFrame, across: list[Dimension], data: list[Dimension], spec: Pilot) -> list[Column]:
    plain = [aggregate(d.function, d.field).alias(f"{d.function}_{d.field}") for d in data]
    if not across:
        return plain
    if len(across) > 1:
        raise ValueError("one column dimension; combine columns first for more")
    field = across[0].field
    members = list(spec.values) or [r[0] for r in df.select(field).distinct().orderBy(field).collect()]
    out = [_when(d, field, m).alias(f"{m}_{d.function}_{d.field}") for m in members for d in data]
    return out + (plain if spec.total_columns else [])


def _when(d: Dimension, field: str, member: object) -> Column:
    own = F.when(F.col(field) == member, F.col(d.field))
    return F.count(own) if d.function == "count" else FUNCTIONS[d.function.lower()].build(own)


def consolidate(areas: list[DataFrame], function: str, label: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Areas combined by the label column, or by position (a row number in the given order)."""
    columns = [c for c in areas[0].columns if c != label and c not in (order or [])]
    if label:
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), areas)
        columns = [c for c in stacked.columns if c != label]
        return stacked.groupBy(label).agg(*(aggregate(function, c).alias(c) for c in columns))
    numbered = [row_numbers(a, order, "position").select("position", *columns) for a in areas]
    return reduce(DataFrame.unionByName, numbered).groupBy("position").agg(*(aggregate(function, c).alias(c) for c in columns))


def holds(rule: Rule, kind: str) -> Column:
    """Is a cell valid?"""
    x = F.col(rule.column)
    number = x if kind != "string" else x.try_cast("double")
    subject = {"length": F.char_length(x.cast("string")), "whole": number, "decimal": number, "date": F.try_to_date(x.cast("string")), "time": number}.get(rule.mode, x)
    if rule.mode == "any":
        return F.lit(True)
    if rule.mode == "list":
        out = x.isin(*rule.members)
    elif rule.mode == "custom":
        out = compile_text(str(rule.low)).cast("boolean")
    else:
        tests = {"between": lambda: subject.between(rule.low, rule.high), "outside": lambda: ~subject.between(rule.low, rule.high), "=": lambda: subject == rule.low, "<>": lambda: subject != rule.low, "<": lambda: subject < rule.low, "<=": lambda: subject <= rule.low, ">": lambda: subject > rule.low, ">=": lambda: subject >= rule.low}
        out = tests[rule.op]()
        if rule.mode == "whole":
            out = out & (number == F.floor(number))
    return F.when(x.isNull(), F.lit(rule.allow_empty)).otherwise(F.coalesce(out, F.lit(False)))


def validated(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with valid and the messages of rules that don't hold."""
    kinds = dict(df.dtypes)
    tests = [holds(r, kinds[r.column]) for r in rules]
    messages = F.filter(F.array(*(F.when(~t, F.lit(r.message or r.column)) for t, r in zip(tests, rules, strict=True))), lambda m: m.isNotNull())
    return df.withColumns({"valid": reduce(Column.__and__, tests), "messages": messages})


def styled(df: DataFrame, entries: list[tuple[Column, str]], name: str = "style") -> DataFrame:
    """Conditional formats: the style of the first condition that holds."""
    out = F.lit(None).cast("string")
    for test, style in reversed(entries):
        out = F.when(test, F.lit(style)).otherwise(out)
    return df.withColumn(name, out)


def imported(spark, statement: str, trusted: bool = False) -> DataFrame:
    """A stored external query. Statements from a file are not run unless the caller trusts them."""
    if not trusted:
        raise PermissionError("a statement from a document is not run unless trusted")
    return spark.sql(statement)


# Mail merge and change tracking.


def merge_rows(df: DataFrame, order: list[str], selections: list[tuple[int, int]] | None = None, when: Column | None = None) -> DataFrame:
    """Records by number in an order (from 1): those in the selections that meet the condition, with record_number."""
    numbered = row_numbers(df, order, "record_number")
    tests = [F.col("record_number").between(a, b) for a, b in selections or []]
    out = numbered.filter(reduce(Column.__or__, tests)) if tests else numbered
    return out if when is None else out.filter(when)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n records, numbered: a top-k before the numbering."""
    return merge_rows(df.orderBy(*order).limit(n), order)


def replayed(log: DataFrame, keys: list[str], order: list[str], rejected: Column | None = None) -> DataFrame:
    """The last change of each cell that isn't rejected: an aggregate, so a cell of very many changes is combined map-side."""
    kept = log if rejected is None else log.filter(~rejected)
    rest = [c for c in log.columns if c not in keys]
    last = kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return last.select(*keys, *(F.col(f"__last.{c}").alias(c) for c in rest))


def change_view(log: DataFrame, start=None, end=None, author: str | None = None, but_author: bool = False, states: list[str] | None = None) -> DataFrame:
    """The changes a view shows: by date range, author (or all but them) and state."""
    out = log
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end))
    if author is not None:
        out = out.filter((F.col("author") != author) if but_author else (F.col("author") == author))
    return out if states is None else out.filter(F.col("state").isin(*states))
