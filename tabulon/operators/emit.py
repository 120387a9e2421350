"""Sinks: CSV lines, plain text, HTML, SVG, and call traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_text(x: Column) -> Column:
    """The shortest form of a number: no point for whole ones."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame, order: list[str], columns: list[str] | None = None, separator: str = ",", keep: list[str] | None = None) -> DataFrame:
    """keep, line: every cell quoted, empty cells as \"\", numbers in the shortest form."""
    kinds = dict(df.dtypes)
    columns = columns or df.columns
    cells = [quoted(number_text(F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")) for c in columns]
    out = df.select(*(keep or []), *(o for o in order if o not in (keep or [])), F.concat_ws(separator, *cells).alias("line"))
    return out.select(*(keep or order), "line")


def csv_header(n: int, separator: str = ",") -> str:
    return separator.join(f"Col{k}" for k in range(1, n + 1))


def sheet_csv(cells: DataFrame, columns: int) -> DataFrame:
    """Cells (row, col, text) of a sheet as lines of a file: row -1 is the header. Rows without a cell are not made up."""
    pick = [quoted(F.max(F.when(F.col("col") == k, F.col("text")))) for k in range(columns)]
    body = cells.groupBy("row").agg(F.concat_ws(",", *pick).alias("line"))
    head = cells.sparkSession.createDataFrame([(-1, csv_header(columns))], "row int, line string")
    return head.unionByName(body.select(F.col("row").cast("int"), "line"))


def plain_text(paragraphs: DataFrame, by: list[str], order: str, text: str = "text") -> DataFrame:
    """A document's paragraphs joined by line ends: a document is one row, so its paragraphs are gathered."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda s: s["t"]), "\n")
    return paragraphs.groupBy(*by).agg(joined.alias("text"))


def escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html(paragraphs: DataFrame, by: list[str], order: str, text: str = "text", level: str | None = None) -> DataFrame:
    """A document as HTML: headings by level (0 is h1), paragraphs else."""
    tag = F.when(F.col(level).between(0, 5), F.concat(F.lit("h"), (F.col(level) + 1).cast("string"))).otherwise("p") if level else F.lit("p")
    line = F.concat(F.lit("<"), tag, F.lit(">"), escaped(F.coalesce(F.col(text), F.lit(""))), F.lit("</"), tag, F.lit(">"))
    body = plain_text(paragraphs.withColumn("__line", line), by, order, "__line")
    return body.select(*by, F.concat(F.lit("<html><body>\n"), "text", F.lit("\n</body></html>")).alias("html"))


def svg_shape(kind: Column, points: Column, style: Column, text: Column) -> Column:
    """One shape as an SVG element. points: array of struct(x, y): two corners for boxes, else the path."""
    at = lambda k, f: F.get(points, F.lit(k))[f].cast("string")
    size = lambda f: F.abs(F.get(points, F.lit(1))[f] - F.get(points, F.lit(0))[f]).cast("string")
    listed = F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")
    shape = (
        F.when(kind == "rectangle", F.concat(F.lit('<rect x="'), at(0, "x"), F.lit('" y="'), at(0, "y"), F.lit('" width="'), size("x"), F.lit('" height="'), size("y")))
        .when(kind == "ellipse", F.concat(F.lit('<ellipse cx="'), at(0, "x"), F.lit('" cy="'), at(0, "y"), F.lit('" rx="'), at(1, "x"), F.lit('" ry="'), at(1, "y")))
        .when(kind == "polygon", F.concat(F.lit('<polygon points="'), listed))
        .when(kind == "text", F.concat(F.lit('<text x="'), at(0, "x"), F.lit('" y="'), at(0, "y")))
        .otherwise(F.concat(F.lit('<polyline points="'), listed))
    )
    return F.concat(shape, F.lit('" style="'), F.coalesce(style, F.lit("")), F.when(kind == "text", F.concat(F.lit('">'), escaped(F.coalesce(text, F.lit(""))), F.lit("</text>"))).otherwise(F.lit('"/>')))


def svg_pages(shapes: DataFrame, by: list[str], order: str) -> DataFrame:
    """A page's shapes as one SVG text."""
    made = shapes.withColumn("__line", svg_shape(F.col("kind"), F.col("points"), F.col("style"), F.col("text")))
    return plain_text(made, by, order, "__line").select(*by, F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">\n'), "text", F.lit("\n</svg>")).alias("svg"))


def numbering_names(cells: DataFrame, properties: str) -> DataFrame:
    """Cells with a name for each distinct property set (Numbering0, ...): ranked over the distinct sets, not over the cells."""
    names = cells.select(properties).filter(F.col(properties).isNotNull()).distinct().withColumn("numbering_name", F.concat(F.lit("Numbering"), (F.row_number().over(Window.orderBy(properties)) - 1).cast("string")))
    return cells.join(names, properties, "left")


# Call traces: doc, seq, depth, op, props.


def trace_lines(events: DataFrame) -> DataFrame:
    """doc, seq, line: each call indented by its depth, properties in order of their names."""
    props = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    return events.select("doc", "seq", F.concat(F.repeat(F.lit("  "), F.col("depth")), "op", F.lit("("), F.coalesce(props, F.lit("")), F.lit(")")).alias("line"))


def balanced(events: DataFrame) -> DataFrame:
    """doc, depth_left, lowest: calls that open and close must come to 0 and never below. The sum is per document, in order of seq."""
    step = F.when(F.col("op").rlike("^(open|start)"), 1).when(F.col("op").rlike("^(close|end)"), -1).otherwise(0)
    window = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("__depth", F.sum(step).over(window)).groupBy("doc").agg(F.max_by("__depth", "seq").alias("depth_left"), F.min("__depth").alias("lowest"))


def sheet_trace(cells: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Cells as calls: sheets, rows and cells open and close around them. Each call's place is computed from its own keys, and numbered per document."""
    at = lambda level, sheet, row, col, op, depth, props: F.struct(sheet.alias("s"), row.alias("r"), col.alias("c"), F.lit(level).alias("k"), F.lit(depth).alias("depth"), F.lit(op).alias("op"), props.alias("props"))
    none, first, last = F.create_map().cast("map<string,string>"), F.lit(-1), F.lit(1 << 30)
    c = F.col
    cell_props = F.create_map(F.lit("librevenge:column"), c("col").cast("string"), F.lit("librevenge:row"), c("row").cast("string"))
    one = cells.select(c(doc).alias("doc"), F.explode(F.array(at(2, c("sheet_id"), c("row"), c("col"), "openSheetCell", 3, cell_props), at(3, c("sheet_id"), c("row"), c("col"), "insertText", 4, F.create_map(F.lit("text"), F.coalesce(c("text"), F.lit("")))), at(4, c("sheet_id"), c("row"), c("col"), "closeSheetCell", 3, none))).alias("e"))
    rows = cells.select(doc, "sheet_id", "row").distinct().select(c(doc).alias("doc"), F.explode(F.array(at(1, c("sheet_id"), c("row"), first, "openSheetRow", 2, none), at(9, c("sheet_id"), c("row"), last, "closeSheetRow", 2, none))).alias("e"))
    sheets = cells.select(doc, "sheet_id").distinct().select(c(doc).alias("doc"), F.explode(F.array(at(0, c("sheet_id"), first, first, "openSheet", 1, none), at(9, c("sheet_id"), last, last, "closeSheet", 1, none))).alias("e"))
    docs = cells.select(doc).distinct().select(c(doc).alias("doc"), F.explode(F.array(at(0, first, first, first, "startDocument", 0, none), at(9, last, last, last, "endDocument", 0, none))).alias("e"))
    every = one.unionByName(rows).unionByName(sheets).unionByName(docs)
    window = Window.partitionBy("doc").orderBy("e.s", "e.r", "e.c", "e.k")
    return every.select("doc", F.row_number().over(window).alias("seq"), "e.depth", "e.op", "e.props")
