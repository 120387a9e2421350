"""Cells and ranges: long cell tables, wide tables, rectangles, runs, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.steps import kept
from tabulon.plans.specs import Range

#: Columns and last row of a sheet, unless the document says otherwise.
MOST_COLUMNS, LAST_ROW = 256, 8191


#: Values that the edges of row numbers' bins are drawn from, on average, and the bins.
DRAWN, BINS = 8192, 64


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the number of each row, from 1, in an order whose first column has no null; ties by the other columns.

    No task numbers all rows: rows are dealt to bins by edges of the first column, drawn from its values by
    their hash (a bounded number), numbered within each bin, and moved on by the rows of the bins before."""
    first = F.col(order[0])
    n = df.count()
    drawn = df.filter(F.pmod(F.xxhash64(first), F.lit(max(1, n // DRAWN))) == 0).select(first.alias("v")).filter("v is not null").distinct().orderBy("v").collect()
    edges = [drawn[k * len(drawn) // BINS]["v"] for k in range(1, BINS)] if len(drawn) >= BINS else []
    binned = df.withColumn("__bin", halved(first, edges))
    sizes = {r["__bin"]: r["n"] for r in binned.groupBy("__bin").agg(F.count(F.lit(1)).alias("n")).collect()} if edges else {}
    before, total = [], 0
    for k in range(len(edges) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    own = F.row_number().over(Window.partitionBy("__bin").orderBy(*order))
    return binned.withColumn(name, own + F.element_at(F.array(*map(F.lit, before)), F.col("__bin") + 1)).drop("__bin")


def halved(x: Column, edges: list) -> Column:
    """How many ascending edges are at or below x; 0 for null."""

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x >= F.lit(edges[mid]), part(mid + 1, high)).otherwise(part(low, mid))

    return part(0, len(edges))


def to_cells(df: DataFrame, order: list[str], sheet: int = 0, columns: list[str] | None = None) -> DataFrame:
    """A wide table as cells: sheet_id, row, col, content_type, value, text. order: columns whose order rows are numbered by."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    numbered = row_numbers(df, order, "__row").withColumn("__row", F.col("__row") - 1)
    cells = [F.struct(F.lit(k).alias("col"), F.col(c).try_cast("double").alias("value") if kinds[c] != "string" else F.lit(None).cast("double").alias("value"), F.col(c).cast("string").alias("text"), F.lit("TEXT" if kinds[c] == "string" else "NUMBER").alias("kind")) for k, c in enumerate(columns)]
    long = numbered.select(F.col("__row").alias("row"), F.explode(F.array(*cells)).alias("c"))
    kind = F.when(F.col("c.text").isNull(), "NONE").otherwise(F.col("c.kind"))
    return long.select(F.lit(sheet).alias("sheet_id"), "row", "c.col", kind.alias("content_type"), "c.value", "c.text")


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row per id and column, values as text."""
    return df.select(*ids, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(ids, columns, name, value)


def cells_in(cells: DataFrame, c0: int, r0: int, c1: int, r1: int, sheet: int | None = None) -> DataFrame:
    """The rectangle's cells: a filter that reaches the scan."""
    out = cells.filter(F.col("col").between(c0, c1) & F.col("row").between(r0, r1))
    return out if sheet is None else out.filter(F.col("sheet_id") == sheet)


def in_bounds(cells: DataFrame, last_row: int = LAST_ROW) -> DataFrame:
    return cells.filter(F.col("col").between(0, MOST_COLUMNS - 1) & F.col("row").between(0, last_row))


def to_wide(cells: DataFrame, columns: dict[int, str], by: list[str] | None = None, first_row: int = 0) -> DataFrame:
    """Cells as a wide table: a row per sheet row, columns by position. One aggregate, no pivot pass."""
    by = by or ["sheet_id", "row"]
    pick = [F.max(F.when(F.col("col") == k, F.col("text"))).alias(name) for k, name in columns.items()]
    return cells.filter((F.col("row") >= first_row) & F.col("col").isin(*columns)).groupBy(*by).agg(*pick)


def header_of(cells: DataFrame, spec: Range) -> dict[int, str]:
    """Names of a range's columns, from its header row (at most 256 cells)."""
    if not spec.header:
        return {c: f"Col{c - spec.c0 + 1}" for c in range(spec.c0, spec.c1 + 1)}
    rows = cells_in(cells, spec.c0, spec.r0, min(spec.c1, MOST_COLUMNS - 1), spec.r0, spec.sheet).select("col", "text").collect()
    found = {r["col"]: r["text"] for r in rows if r["text"]}
    return {c: found.get(c, f"Col{c - spec.c0 + 1}") for c in range(spec.c0, spec.c1 + 1)}


def table_of(cells: DataFrame, spec: Range) -> DataFrame:
    """A named range as a table."""
    body = cells_in(cells, spec.c0, spec.r0, spec.c1, spec.r1, spec.sheet)
    return to_wide(body, header_of(cells, spec), first_row=spec.r0 + spec.header)


def typed(df: DataFrame) -> DataFrame:
    """Text columns that hold nothing but numbers as numbers (one aggregate over all columns)."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    tests = df.agg(*(F.bool_and(F.col(c).isNull() | F.col(c).try_cast("double").isNotNull()).alias(c) for c in texts)).first()
    return df.withColumns({c: F.col(c).try_cast("double") for c in texts if tests[c]})


def matrix_cells(df: DataFrame, values: str, columns: int, ids: list[str]) -> DataFrame:
    """A stored matrix (an array, row by row) as cells."""
    out = df.select(*ids, F.posexplode(values).alias("at", "value"))
    return out.select(*ids, F.floor(F.col("at") / columns).cast("int").alias("row"), F.pmod("at", F.lit(columns)).alias("col"), "value")


def runs_to_rows(df: DataFrame, runs: str, ids: list[str]) -> DataFrame:
    """Run lengths (array of struct(times, value)) as one row per position."""
    stops = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,times:int,value:int>>").alias("out")), lambda a, r: F.struct((a["at"] + r["times"]).cast("int").alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].cast("int").alias("start"), r["times"].cast("int").alias("times"), r["value"].cast("int").alias("value")))).alias("out")), lambda a: a["out"])
    each = df.select(*ids, F.explode(stops).alias("r")).filter("r.times > 0")
    return each.select(*ids, F.explode(F.sequence(F.col("r.start"), F.col("r.start") + F.col("r.times") - 1)).alias("at"), "r.value")


def runs(df: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """Neighbouring rows of equal value as one: by, first and last order, value, n. Gaps and islands."""
    window = Window.partitionBy(*by).orderBy(*order)
    changed = df.withColumn("__v", value).withColumn("__new", (~F.col("__v").eqNullSafe(F.lag("__v").over(window)) | F.lag(F.lit(1)).over(window).isNull()).cast("int"))
    numbered = changed.withColumn("run", F.sum("__new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.first("__v").alias("value"), F.count(F.lit(1)).alias("n"))


def row_blocks(bounds: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """Intervals cut where any begins or ends: by, row_lo, row_hi of the pieces, for rows that repeat."""
    edges = bounds.select(*by, F.col(low).alias("at")).union(bounds.select(*by, (F.col(high) + 1).alias("at"))).distinct()
    window = Window.partitionBy(*by).orderBy("at")
    return edges.withColumn("next", F.lead("at").over(window)).filter("next is not null").select(*by, F.col("at").alias("row_lo"), (F.col("next") - 1).alias("row_hi"))


def interval_join(points: DataFrame, at: Column, intervals: DataFrame, low: str, high: str, how: str = "left_anti", width: int = 1024) -> DataFrame:
    """Points joined to intervals that hold them (ends included). Both are dealt to bins of a width, so it is an equi-join."""
    binned = intervals.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    inside = (F.col("__at") >= F.col(low)) & (F.col("__at") <= F.col(high))
    given = points.withColumns({"__at": at, "__own": F.floor(at / width)})
    return given.join(binned, (F.col("__own") == F.col("__bin")) & inside, how).drop("__at", "__own", "__bin")


def outline_rows(df: DataFrame, row: Column, outline: DataFrame) -> DataFrame:
    """Rows that no hidden outline entry (start, size, hidden) covers."""
    hidden = outline.filter("hidden").select(F.col("start").alias("__lo"), (F.col("start") + F.col("size") - 1).alias("__hi"))
    return interval_join(df, row, hidden, "__lo", "__hi")


def merged_runs(styles: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells with the style run (c0, c1) that holds them, and runs without a cell: a full interval join per row."""
    spread = styles.withColumn("col", F.explode(F.sequence("c0", "c1")))
    return cells.join(spread, [*by, "col"], "full_outer")


def fused_columns(boxes: DataFrame, by: list[str], x: str, width: str) -> DataFrame:
    """Text-table boxes with a column number: positions closer than half the least width are one."""
    least = boxes.groupBy(*by).agg((F.min(width) / 2).alias("__half"))
    placed = boxes.join(least, by).withColumn("__x", F.round(F.col(x) / F.greatest("__half", F.lit(1e-9))))
    return placed.withColumn("column", F.dense_rank().over(Window.partitionBy(*by).orderBy("__x")) - 1).drop("__half", "__x")


def inherited(styles: DataFrame, items: DataFrame) -> DataFrame:
    """Style items with those of parents that the style lacks. styles: name, parent; items: name, item, value.

    Nearest ancestor wins; a missing parent ends the chain, a cycle too. Each round doubles the levels that are known, until no style gets a further ancestor."""
    up = styles.filter("parent is not null and parent <> name").select("name", F.col("parent").alias("ancestor"), F.lit(1).alias("level"))
    chain = kept(styles.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("level")).unionByName(up).groupBy("name", "ancestor").agg(F.min("level").alias("level")))
    known, last = chain.count(), -1
    while known > last:
        further = chain.select(F.col("name").alias("ancestor"), F.col("ancestor").alias("next"), F.col("level").alias("more"))
        chain = kept(chain.join(further, "ancestor").groupBy("name", F.col("next").alias("ancestor")).agg(F.min(F.col("level") + F.col("more")).alias("level")))
        known, last = chain.count(), known
    chain = chain.join(styles.select(F.col("name").alias("ancestor")).distinct(), "ancestor")
    own = chain.join(items.select(F.col("name").alias("ancestor"), "item", "value"), "ancestor")
    return own.groupBy("name", "item").agg(F.min_by("value", "level").alias("value"), F.min("level").alias("level"))
