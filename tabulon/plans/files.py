"""Queries over legacy files, and over formulas, fields and charts that come out of them.

No document is at hand, so each row of a test table is first written as a file of its own
(`sources.build`); the readers' tables are then what SQL says of that row.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tabulon.functions import formats, formula
from tabulon.operators import charts, emit, lookup, names, query, ranges, text
from tabulon.plans.registry import read, register
from tabulon.sources import build, languages, office, properties, trace

c = F.col


def made(f: Callable, *columns: Column, kind=BinaryType) -> Column:
    """f over the values of each row: the content of a file, or a text."""

    @F.pandas_udf(kind())
    def run(*given: pd.Series) -> pd.Series:
        return pd.Series([f(*v) for v in zip(*given, strict=True)], dtype=object)

    return run(*columns)


def filed(df: DataFrame, key: str, f: Callable, *columns: str) -> DataFrame:
    """A file per row: path (the key) and content."""
    return df.select(c(key).cast("string").alias("path"), made(f, *map(c, columns)).alias("content"))


# Containers.


def _sheet(key: int, name: str, balance: float) -> bytes:
    row, plus = key % 8000, [build.cell_token(0, key % 8000), build.operator_token(21), build.number_token(1.0)]
    cells = [(row, 0, balance), (row, 1, name), (row, 2, (balance + 1.0, plus))]
    return build.sheet_stream([("First", [], []), ("Second", cells, [(row, 1, name, "20150929", "me")])], "geheim", key % 100)


def _text(key: int, name: str, password: str = "") -> bytes:
    return build.text_stream([(1, None, name, False)], ["Heading", "Body"], password, key % 2 == 1)


def _drawing(key: int, size: int) -> bytes:
    shapes = [(2 + key % 8, (size, 1, size + 10, key % 1000), 3), (1, (0, 0, 9, 9), 3, [(4, (5, 5, 8, 8), 3)])]
    return build.drawing_stream([(True, (2100, 2970), [(16, (1, 2, 3, 4), 0)]), (False, (2100, 2970), shapes)])


def _gallery(size: int) -> bytes:
    width = size % 7 + 1
    plain = b"".join(b"".join(bytes([size, x, y]) for x in range(width)).ljust(-(-width * 3 // 4) * 4, b"\0") for y in (1, 0))
    runs = bytes([width, 1, 0, 0]) * 2 + b"\0\1"
    return build.gallery_file(
        [
            build.bitmap_file(24, plain, width, 2),
            build.bitmap_file(8, runs, width, 2, 1, bytes([0, 0, 0, 0, size, 7, 9, 0])),
            build.bitmap_file(1, b"\xaa\0\0\0" * 2, width, 2, palette=b"\0\0\0\0\xff\0\0\0", deflated=True),
            b"xx",
        ]
    )


def _any(key: int, name: str) -> bytes:
    """A file of one of nine kinds."""
    book = build.compound_file({"StarCalcDocument": build.sheet_stream([("One", [(0, 0, float(key)), (1, 0, name)], [])])})
    kinds = {
        0: lambda: book, 1: lambda: build.compound_file({"StarWriterDocument": _text(key, name)}), 2: lambda: build.compound_file({"StarWriterDocument": _text(0, name, "geheim")}), 3: lambda: build.compound_file({"StarDrawDocument": _drawing(key, 1)}),
        4: lambda: build.compound_file({"StarDrawDocument3": _drawing(key, 1), "\x01CompObj": build.class_stream("StarImpress 5.0")}), 5: lambda: _gallery(key % 50), 6: lambda: build.compound_file({"Object 1/StarChartDocument": name.encode()}), 7: name.encode, 8: lambda: book[:700],
    }
    return kinds[key % 9]()


@register("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, ['spreadsheet', 'text', 'text', 'draw', 'presentation', 'gallery', 'chart', 'unknown', 'unknown'][k] AS kind, CASE k WHEN 3 THEN 'supported encryption' WHEN 7 THEN 'none' WHEN 8 THEN 'none' WHEN 9 THEN 'none' ELSE 'excellent' END AS confidence,
CASE WHEN k > 7 THEN 'unknown' ELSE 'ok' END AS result FROM (SELECT c_custkey, c_custkey % 9 + 1 AS k FROM customer)""")
def documents_kind(spark, d):
    return office.read_documents(filed(read(spark, d, "customer"), "c_custkey", _any, "c_custkey", "c_name"))


@register("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, dir, name, strlen(bytes) AS n, md5(bytes) AS digest FROM (SELECT s_suppkey, '' AS dir, 'Large' AS name, repeat(s_name, 700) AS bytes FROM supplier
UNION ALL SELECT s_suppkey, 'Object 1', 'Small', s_name FROM supplier UNION ALL SELECT s_suppkey, 'Object 1/Inner', 'Odd', repeat(s_name, CAST(s_suppkey % 5 AS INTEGER)) FROM supplier)""")
def streams_read(spark, d):
    make = lambda key, name: build.compound_file({"Large": (name * 700).encode(), "Object 1/Small": name.encode(), "Object 1/Inner/Odd": (name * (key % 5)).encode()})
    found = office.read_streams(filed(read(spark, d, "supplier"), "s_suppkey", make, "s_suppkey", "s_name"))
    return found.select("doc_id", "dir", "name", F.octet_length("bytes").alias("n"), F.md5("bytes").alias("digest"))


@register("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, s_name AS title, 'me' AS creator, '2015-09-29T17:23:18.00' AS created, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier""")
def documents_meta(spark, d):
    make = lambda name, nation: build.compound_file({"SfxDocumentInfo": build.information({"dc:title": name, "meta:initial-creator": "me", "user:Nation": str(nation)})})
    found = office.read_meta(filed(read(spark, d, "supplier"), "s_suppkey", make, "s_name", "s_nationkey"))
    meta = lambda k: F.element_at("meta", F.lit(k))
    return found.select("doc_id", meta("dc:title").alias("title"), meta("meta:initial-creator").alias("creator"), meta("meta:creation-date").alias("created"), meta("user:Nation").alias("nation"))


# Sheets, texts, drawings.


@register("""SELECT doc_id, 1 AS sheet_id, 'Second' AS sheet, k AS "row", CAST(j AS INTEGER) AS col, ['NUMBER', 'TEXT', 'FORMULA'][j + 1] AS content_type, CASE j WHEN 0 THEN c_acctbal WHEN 2 THEN c_acctbal + 1 END AS value, CASE j WHEN 1 THEN c_name END AS text,
CASE j WHEN 2 THEN '[{"type": "cell", "c0": 0, "r0": ' || k || ', "s0": 0, "rel0": [false, false, false]}, {"type": "operator", "name": "+"}, {"type": "number", "value": 1.0}]' END AS formula
FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS doc_id, CAST(c_custkey % 8000 AS INTEGER) AS k, unnest([0, 1, 2]) AS j FROM customer)""")
def cells_read(spark, d):
    found = office.read_cells(filed(read(spark, d, "customer"), "c_custkey", _sheet, "c_custkey", "c_name", "c_acctbal"), "geheim")
    return found.withColumn("text", F.when(c("content_type") == "TEXT", c("text")))


@register("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 0 AS sheet_id, CAST(c_custkey % 8000 AS INTEGER) AS "row", 3 AS col, c_name AS text, '20150929' AS date, c_mktsegment AS author FROM customer""")
def notes_read(spark, d):
    make = lambda key, name, author: build.compound_file({"StarCalcDocument": build.sheet_stream([("One", [], [(key % 8000, 3, name, "20150929", author)])])})
    return office.read_notes(filed(read(spark, d, "customer"), "c_custkey", make, "c_custkey", "c_name", "c_mktsegment"))


def _document(key: int, body: str | None) -> bytes:
    """A text document of paragraphs of 500 characters: the first a heading, each third in a section."""
    parts = [(body or "")[k : k + 500] for k in range(0, len(body or "") or 1, 500)]
    paragraphs = [(min(k, 1), None if k else 2, p, k % 3 == 2) for k, p in enumerate(parts)]
    return build.text_stream(paragraphs, ["Heading", "Body"], "geheim" if key % 16 == 0 else "", key % 3 == 0)


@register("""SELECT doc_id, ord, CASE WHEN ord = 0 THEN 'Heading' ELSE 'Body' END AS style, CASE WHEN ord = 0 THEN 2 END AS level, t AS text, CASE WHEN t <> '' THEN strlen(substr(t, 1, length(t) - 1)) END AS last_at, CASE WHEN ord % 3 = 2 THEN 'section' ELSE '' END AS inside
FROM (SELECT doc_id, CAST(k AS INTEGER) AS ord, substr(body, k * 500 + 1, 500) AS t FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, COALESCE(text, '') AS body, unnest(range(greatest(1, (length(COALESCE(text, '')) + 499) // 500))) AS k FROM documents))""")
def paragraphs_read(spark, d):
    found = office.read_paragraphs(filed(read(spark, d, "documents"), "doc_id", _document, "doc_id", "text"))
    return found.select("doc_id", "ord", "style", "level", "text", F.get("src_pos", F.size("src_pos") - 1).alias("last_at"), "inside")


_SHAPES = """SELECT CAST(p_partkey AS VARCHAR) AS doc_id, unnest([
{'page': 0, 'master': TRUE, 'ord': -1, 'parent': NULL, 'kind': 'sheet', 'x0': 0, 'y0': 0, 'x1': 2100, 'y1': 2970, 'layer': NULL},
{'page': 0, 'master': TRUE, 'ord': 0, 'parent': NULL, 'kind': 'text', 'x0': 1, 'y0': 2, 'x1': 3, 'y1': 4, 'layer': 0},
{'page': 1, 'master': FALSE, 'ord': -1, 'parent': NULL, 'kind': 'sheet', 'x0': 0, 'y0': 0, 'x1': 2100, 'y1': 2970, 'layer': NULL},
{'page': 1, 'master': FALSE, 'ord': 0, 'parent': NULL, 'kind': ['line', 'rectangle', 'ellipse', 'sector', 'arc', 'cut', 'polygon', 'polyline'][p_partkey % 8 + 1], 'x0': p_size, 'y0': 1, 'x1': p_size + 10, 'y1': CAST(p_partkey % 1000 AS INTEGER), 'layer': 3},
{'page': 1, 'master': FALSE, 'ord': 1, 'parent': NULL, 'kind': 'group', 'x0': 0, 'y0': 0, 'x1': 9, 'y1': 9, 'layer': 3},
{'page': 1, 'master': FALSE, 'ord': 2, 'parent': 1, 'kind': 'ellipse', 'x0': 5, 'y0': 5, 'x1': 8, 'y1': 8, 'layer': 3}]) AS s FROM part"""


def _shapes(spark, d) -> DataFrame:
    make = lambda key, size: build.compound_file({"StarDrawDocument3": _drawing(key, size)})
    return office.read_shapes(filed(read(spark, d, "part"), "p_partkey", make, "p_partkey", "p_size"))


@register(f"SELECT doc_id, s.page AS page, s.master AS master, s.ord AS ord, s.parent AS parent, s.kind AS kind, s.x0 AS x0, s.y0 AS y0, s.x1 AS x1, s.y1 AS y1, s.layer AS layer FROM ({_SHAPES})")
def shapes_read(spark, d):
    return _shapes(spark, d)


@register(f"SELECT doc_id, 1 AS page, s.ord AS ord, s.kind AS kind, s.x0 AS x0 FROM ({_SHAPES})")
def master_shapes(spark, d):
    pages = read(spark, d, "part").select(c("p_partkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("master_page"))
    return office.on_masters(_shapes(spark, d), pages).select("doc_id", "page", "ord", "kind", "x0")


@register("""SELECT doc_id, CAST(page AS INTEGER) AS page, CASE WHEN page < 3 THEN w END AS width, CASE WHEN page < 3 THEN 2 END AS height,
CASE page WHEN 0 THEN array_to_string(list_transform(range(2 * w), lambda i: printf('%02X%02X%02X', i // w, i % w, p_size)), '') WHEN 1 THEN repeat(printf('0907%02X', p_size), 2 * w) WHEN 2 THEN array_to_string(list_transform(range(2 * w), lambda i: CASE WHEN i % w % 2 = 0 THEN '0000FF' ELSE '000000' END), '') END AS pixels,
CASE page WHEN 3 THEN 'no bitmap' END AS error FROM (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_size, p_size % 7 + 1 AS w, unnest([0, 1, 2, 3]) AS page FROM part)""")
def gallery_read(spark, d):
    found = office.read_gallery(filed(read(spark, d, "part"), "p_partkey", _gallery, "p_size"))
    return found.withColumn("pixels", F.hex("pixels"))


# Languages, properties, traces.


@register("SELECT c_custkey, k AS language_id, language, country FROM (SELECT c_custkey, [1033, 1031, 1036, 1043, 9999][c_custkey % 5 + 1] AS k FROM customer) LEFT JOIN (VALUES (1033, 'en', 'US'), (1031, 'de', 'DE'), (1036, 'fr', 'FR'), (1043, 'nl', 'NL')) AS t (n, language, country) ON k = n")
def language_names(spark, d):
    numbers = F.array(*map(F.lit, (1033, 1031, 1036, 1043, 9999)))
    return languages.with_language(read(spark, d, "customer").select("c_custkey", F.get(numbers, (c("c_custkey") % 5).cast("int")).alias("language_id")))


def _calls(name: str, segment: str) -> bytes:
    return properties.encode([("openCell", {"name": name, "list": [{"x": segment}, {}]}), ("#text", {"text": name}), ("closeCell", None)])


def _shown(data: bytes) -> str:
    return " ".join(f"{name}={props}" for name, props in properties.decode(bytes(data)))


def _own(x: str) -> str:
    """SQL of a text in the calls' binary form, as hexadecimal digits."""
    return f"printf('%02X000000', length({x}) + 1) || hex({x}) || '00'"


@register(f"""SELECT c_custkey, '53' || {_own("'openCell'")} || '0200000070' || {_own("'name'")} || {_own("c_name")} || '76' || {_own("'list'")} || '02000000' || '0100000070' || {_own("'x'")} || {_own("c_mktsegment")} || '00000000' || '54' || {_own("c_name")} || '45' || {_own("'closeCell'")} AS bytes,
'openCell={{''name'': ''' || c_name || ''', ''list'': [{{''x'': ''' || c_mktsegment || '''}}, {{}}]}} #text={{''text'': ''' || c_name || '''}} closeCell=None' AS calls FROM customer""")
def property_roundtrip(spark, d):
    data = read(spark, d, "customer").select("c_custkey", made(_calls, c("c_name"), c("c_mktsegment")).alias("data"))
    return data.select("c_custkey", F.hex("data").alias("bytes"), made(_shown, c("data"), kind=StringType).alias("calls"))


@register("SELECT c_custkey AS doc, 0 AS seq, CAST(c_custkey % 3 AS INTEGER) AS depth, 'insertText' AS op, c_name AS text, '1' AS at FROM customer")
def trace_lines_read(spark, d):
    line = F.concat(F.repeat(F.lit("  "), (c("c_custkey") % 3).cast("int")), F.lit("insertText(text: "), "c_name", F.lit(", at: 1)"))
    found = trace.parsed(read(spark, d, "customer").select(c("c_custkey").alias("doc"), F.lit(0).alias("seq"), line.alias("line")))
    return found.select("doc", "seq", "depth", "op", F.element_at("props", F.lit("text")).alias("text"), F.element_at("props", F.lit("at")).alias("at"))


# Formulas, formats, references.


def _stack(key: int, size: int) -> list[dict]:
    return [{"type": "column", "name": f"c{key}"}, {"type": "long", "value": size}, {"type": "operator", "name": "+"}, {"type": "function", "name": "Sqrt", "arity": 1}]


def _infix(key: int, size: int) -> str:
    return formula.render([t | {"type": "number"} if t["type"] == "long" else t for t in formula.infix(_stack(key, size))])


def _properties(key: int, size: int) -> str:
    return names.token_properties(_stack(key, size)[:3])


@register("SELECT p_partkey, 'Sqrt(([c' || p_partkey || ']+' || p_size || '))' AS formula FROM part")
def formula_infix(spark, d):
    return read(spark, d, "part").select("p_partkey", made(_infix, c("p_partkey"), c("p_size"), kind=StringType).alias("formula"))


@register("""SELECT p_partkey, '[{"type": "cell", "name": "c' || p_partkey || '"}, {"type": "number", "value": ' || p_size || '}, {"type": "operator", "name": "+"}]' AS tokens FROM part""")
def formula_tokens(spark, d):
    return read(spark, d, "part").select("p_partkey", made(_properties, c("p_partkey"), c("p_size"), kind=StringType).alias("tokens"))


@register("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y at %H:%M') AS by_letters, strftime(o_orderdate, '%Y-%m/%d') AS by_tokens FROM orders")
def date_patterns(spark, d):
    tokens = [(21, ""), (-12, "-"), (7, ""), (-12, "/"), (17, "")]
    made_by = {"by_letters": formats.strftime_pattern("%d.%m.%Y at %H:%M"), "by_tokens": formats.token_pattern(tokens)}
    return read(spark, d, "orders").select("o_orderkey", *(F.date_format("o_orderdate", p).alias(k) for k, p in made_by.items()))


@register("""WITH RECURSIVE t AS (SELECT max(p_partkey) AS cell FROM part UNION SELECT cell // 2 FROM t WHERE cell > 0) SELECT cell FROM t""")
def traced_cells(spark, d):
    """Cell n refers to cell n/2: the last one with all it depends on."""
    cells = read(spark, d, "part").select(c("p_partkey").alias("cell"))
    references = cells.filter("cell > 0").select("cell", F.floor(c("cell") / 2).alias("refers"))
    return lookup.traced(references, cells.agg(F.max("cell").alias("cell")))


@register("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def imported_query(spark, d):
    return query.imported(spark, f"SELECT n_regionkey, count(*) AS n FROM parquet.`{d}/nation.parquet` GROUP BY n_regionkey", trusted=True)


@register('SELECT s_suppkey, CAST(k // 3 AS INTEGER) AS "row", CAST(k % 3 AS INTEGER) AS col, s_suppkey * 10 + k AS value FROM (SELECT s_suppkey, unnest(range(6)) AS k FROM supplier)')
def matrix_values(spark, d):
    given = read(spark, d, "supplier").select("s_suppkey", F.array(*(c("s_suppkey") * 10 + k for k in range(6))).alias("values"))
    return ranges.matrix_cells(given, "values", 3, ["s_suppkey"])


@register("SELECT s_suppkey, x, CAST(CASE WHEN x < 100 THEN 0 ELSE 1 END AS INTEGER) AS \"column\" FROM (SELECT s_suppkey, unnest([0, 20, 110 + s_suppkey % 10]) AS x FROM supplier)")
def fused_boxes(spark, d):
    boxes = read(spark, d, "supplier").select("s_suppkey", F.explode(F.array(F.lit(0).cast("long"), F.lit(20).cast("long"), 110 + c("s_suppkey") % 10)).alias("x"), F.lit(100).alias("width"))
    return ranges.fused_columns(boxes, ["s_suppkey"], "x", "width").select("s_suppkey", "x", "column")


# Contents, indexes, fields, pictures, charts.


@register("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def contents_table(spark, d):
    rows = read(spark, d, "conversations").withColumn("level", F.when(c("role") == "user", 0).otherwise(11))
    return text.outline(rows, "level", ["conv_id", "turn"]).select("conv_id", "turn", "text")


@register("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS pages FROM part GROUP BY p_brand")
def index_pages(spark, d):
    made_of = text.index_entries(read(spark, d, "part"), "p_brand", "p_size")
    return made_of.select("p_brand", F.array_join(c("pages").cast("array<string>"), ",").alias("pages"))


_FIELDS = "db user filename dbName pageNumber author chapter docStat getExp hiddenText postIt hiddenPara docInfo extUser reg dropDown".split()


@register(f"""SELECT c_custkey, kind, CASE kind WHEN 'db' THEN c_mktsegment WHEN 'extUser' THEN c_mktsegment WHEN 'filename' THEN c_name WHEN 'pageNumber' THEN CAST(c_nationkey + 2 AS VARCHAR) WHEN 'author' THEN 'me' WHEN 'chapter' THEN 'One' WHEN 'docStat' THEN '7' WHEN 'docInfo' THEN 'own'
WHEN 'hiddenText' THEN CASE WHEN c_acctbal > 0 THEN v ELSE '' END WHEN 'hiddenPara' THEN '' WHEN 'reg' THEN NULL WHEN 'dropDown' THEN NULL ELSE v END AS text FROM (SELECT *, '/x/' || c_name AS v, unnest({_FIELDS}) AS kind FROM customer)""")
def fields_expanded(spark, d):
    value = F.concat(F.lit("/x/"), "c_name")
    given = read(spark, d, "customer").select(
        "c_custkey", F.explode(F.array(*map(F.lit, _FIELDS))).alias("kind"), value.alias("value"), (c("c_acctbal") > 0).alias("condition"), c("c_nationkey").alias("page"), F.lit(2).alias("offset"), F.lit("One").alias("chapter"),
        F.create_map(value, c("c_mktsegment")).alias("record"), F.create_map(F.lit("meta:initial-creator"), F.lit("me"), F.lit("statistic"), F.lit("7"), value, F.lit("own")).alias("meta"),
    )
    return text.expanded(given).select("c_custkey", "kind", "text")


@register("""SELECT p_partkey, '<svg xmlns="http://www.w3.org/2000/svg">' || chr(10) || '<rect x="1" y="2" width="' || p_size || '" height="3" style="fill:none"/>' || chr(10) || '<text x="1" y="2" style="">' || p_name || ' &amp; more</text>' || chr(10) || '</svg>' AS svg FROM part""")
def svg_texts(spark, d):
    point = lambda x, y: F.struct(x.cast("long").alias("x"), F.lit(y).cast("long").alias("y"))
    shape = lambda k, kind, style, words: F.struct(F.lit(k).alias("ord"), F.lit(kind).alias("kind"), F.array(point(F.lit(1), 2), point(c("p_size") + 1, 5)).alias("points"), F.lit(style).cast("string").alias("style"), words.alias("text"))
    shapes = read(spark, d, "part").select("p_partkey", F.explode(F.array(shape(0, "rectangle", "fill:none", F.lit("")), shape(1, "text", None, F.concat("p_name", F.lit(" & more"))))).alias("s"))
    return emit.svg_pages(shapes.select("p_partkey", "s.*"), ["p_partkey"], "ord")


@register("""SELECT s_suppkey, 'T' || j || s_name AS series, 'T' || 3 * i || s_name AS category, CAST(i - 1 AS INTEGER) AS ord, s_acctbal * (3 * i + j) AS value, CAST(i AS DOUBLE) AS position
FROM (SELECT *, unnest([1, 2]) AS j FROM (SELECT *, unnest([1, 2]) AS i FROM supplier))""")
def chart_matrix(spark, d):
    """A chart's range of three rows and columns, the first of each titles."""
    k = c("k")
    rows = read(spark, d, "supplier").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumns({"row": F.floor(k / 3).cast("int"), "col": k % 3})
    cells = rows.select("s_suppkey", "row", "col", F.when((c("row") > 0) & (c("col") > 0), c("s_acctbal") * k).alias("value"), F.concat(F.lit("T"), k.cast("string"), "s_name").alias("text"))
    data = charts.chart_data(cells, ["s_suppkey"])
    return charts.on_axis(data, "sequence", ["s_suppkey", "series"]).select("s_suppkey", "series", "category", "ord", "value", "position")
