import pytest
from pyspark.sql import functions as F

from tabulon.operators import emit, lookup, matrix, query, ranges, text
from tabulon.plans.specs import Dimension, Entry, Key, Pilot, Query, Range, Rule, Sort


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("Ann", 3.0, "x"), ("bob", 1.0, None), ("Cid", None, "y"), ("ann", 3.0, "x")], "name string, n double, k string").cache()


def test_filters(people):
    names = lambda q: sorted(r.name for r in query.filtered(people, q).collect())
    assert names(Query((Entry("name", "=", "ANN"),), case_sensitive=False)) == ["Ann", "ann"]
    assert names(Query((Entry("k", "empty"),))) == ["bob"] and names(Query((Entry("k", "nonempty"),))) == ["Ann", "Cid", "ann"]
    assert names(Query((Entry("n", "top", 1),))) == ["Ann", "ann"] and names(Query((Entry("n", "bottom", 1),))) == ["bob"]
    assert names(Query((Entry("name", "=", "[AC].*"),), regex=True)) == ["Ann", "Cid"]
    assert query.filtered(people.select("n", "k"), Query(duplicates=False)).count() == 3


def test_sort_and_validation(people):
    spec = Sort((Key("n", False), Key("name")), case_sensitive=False)
    assert [r.name for r in query.sorted_rows(people, spec).collect()][2:] == ["bob", "Cid"]
    rows = query.validated(people, [Rule("n", "decimal", ">=", 2, message="small"), Rule("name", "length", "=", 3)]).collect()
    assert {r.name: r.valid for r in rows} == {"Ann": True, "bob": False, "Cid": True, "ann": True}
    assert next(r.messages for r in rows if r.name == "bob") == ["small"]


def test_untrusted_statements_are_not_run(spark):
    with pytest.raises(PermissionError):
        query.imported(spark, "DROP TABLE x")


def test_ranges(spark, people):
    cells = ranges.to_cells(people.filter("name <> 'ann'"), ["name"])
    assert cells.count() == 9 and cells.filter("content_type = 'NONE'").count() == 2
    back = ranges.typed(ranges.table_of(cells, Range("r", 0, 0, 0, 1, 2, header=False))).collect()
    assert sorted((r.Col1, r.Col2) for r in back) == [("Ann", 3.0), ("Cid", None), ("bob", 1.0)]
    head = spark.createDataFrame([(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "1"), (0, 1, 1, "x")], "sheet_id int, row int, col int, text string")
    assert ranges.table_of(head, Range("r", 0, 0, 0, 1, 1)).select("a", "b").first() == ("1", "x")


def test_runs_and_matrices(spark):
    df = spark.createDataFrame([(1, [(2, 7), (0, 9), (1, 8)])], "id int, runs array<struct<times:int,value:int>>")
    assert [(r["at"], r["value"]) for r in ranges.runs_to_rows(df, "runs", ["id"]).orderBy("at").collect()] == [(0, 7), (1, 7), (2, 8)]
    m = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    assert [(r.row, r["col"]) for r in ranges.matrix_cells(m, "v", 2, []).collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    rows = spark.createDataFrame([(0, [2.0, 1.0]), (1, [1.0, 1.0])], "i int, values array<double>")
    own = rows.agg(matrix.square(F.struct("i", "values")).alias("m")).select(matrix.determinant("m").alias("d"), matrix.inverse("m").alias("v")).first()
    assert own.d == pytest.approx(1) and own.v[0] == pytest.approx([1, -1])


def test_style_inheritance_with_cycle_and_missing_parent(spark):
    styles = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "nowhere"), ("e", None)], "name string, parent string")
    items = spark.createDataFrame([("c", "bold", "1"), ("b", "bold", "0"), ("d", "size", "9")], "name string, item string, value string")
    found = {(r.name, r["item"]): r["value"] for r in ranges.inherited(styles, items).collect()}
    assert found == {("a", "bold"): "0", ("b", "bold"): "0", ("c", "bold"): "1", ("d", "size"): "9"}


def test_interval_join_edges(spark):
    points = spark.createDataFrame([(0,), (9,), (10,), (2047,), (2048,), (5000,)], "p int")
    spans = spark.createDataFrame([(10, 2047), (5000, 5000)], "lo int, hi int")
    assert sorted(r.p for r in ranges.interval_join(points, F.col("p"), spans, "lo", "hi").collect()) == [0, 9, 2048]


def test_lookups(spark):
    table = spark.createDataFrame([(float(k), f"v{k}") for k in range(0, 1000, 10)] + [(None, "none"), (50.0, "a first")], "k double, v string")
    probes = spark.createDataFrame([(-1.0,), (0.0,), (9.9,), (55.0,), (990.0,), (5e9,), (None,)], "p double")
    found = {r.p: r.v for r in lookup.vlookup(probes, "p", table, "k", ["v"], approximate=True).collect()}
    assert found == {-1.0: None, 0.0: "v0", 9.9: "v0", 55.0: "a first", 990.0: "v990", 5e9: "v990", None: None}
    exact = {r.p: r.v for r in lookup.vlookup(probes, "p", table, "k", ["v"]).collect()}
    assert exact[0.0] == "v0" and exact[9.9] is None and exact[None] is None
    cells = spark.createDataFrame([(0, 0, 0, "x"), (0, 0, 1, "y"), (0, 1, 0, "1"), (0, 1, 1, "2")], "sheet_id int, row int, col int, text string")
    given = spark.createDataFrame([("y",), ("q",)], "p string")
    assert {r.p: r.found for r in lookup.hlookup(given, "p", cells, 1).collect()} == {"y": "2", "q": None}
    named = spark.createDataFrame([("$B$2",), ("Z9",), ("no",)], "n string")
    assert {r.n: r.found for r in lookup.indirect(named, "n", cells).collect()} == {"$B$2": "2", "Z9": None, "no": None}
    assert lookup.index(cells, 2, 1).first().text == "1"
    assert lookup.goal_seek(lambda x: x * x, 2.0) == pytest.approx(2**0.5)
    refs = spark.createDataFrame([("C1", "B1"), ("B1", "A1"), ("D1", "A1")], "cell string, refers string")
    assert sorted(r.cell for r in lookup.traced(refs, spark.createDataFrame([("C1",)], "cell string")).collect()) == ["A1", "B1", "C1"]


def test_list_numbers(spark):
    rows = spark.createDataFrame([(1, k, lv, re) for k, (lv, re) in enumerate([(0, False), (1, False), (1, False), (0, False), (1, False), (0, True), (1, False)])], "d int, o int, level int, again boolean")
    out = text.numbered(rows, ["d"], "o", "level", restart=F.col("again"), levels=2).orderBy("o").select(text.label(F.col("label_numbers"), ["1", "a"]).alias("l")).collect()
    assert [r["l"] for r in out] == ["1", "1.a", "1.b", "2", "2.a", "1", "1.a"]


def test_fields(spark):
    rows = spark.createDataFrame([(k, "v|w", True, 3, 1, "Intro", {"v|w": "cell"}, {"meta:initial-creator": "me"}) for k in text.FIELD_KINDS], "kind string, value string, condition boolean, page int, offset int, chapter string, record map<string,string>, meta map<string,string>")
    found = {r.kind: r.text for r in text.expanded(rows).collect()}
    assert len(found) == 40 and found["hiddenText"] == "v" and found["pageNumber"] == "4" and found["author"] == "me" and found["db"] == "cell"
    assert all(found[k] is None for k in text.SILENT)


def test_csv_and_svg(spark):
    cells = spark.createDataFrame([(0, 0, "A1"), (0, 2, 'q"'), (1, 1, "2")], "row int, col int, text string")
    assert [r.line for r in emit.sheet_csv(cells, 3).orderBy("row").collect()] == ["Col1,Col2,Col3", '"A1","","q"""', '"","2",""']
    shapes = spark.createDataFrame([(1, 0, "rectangle", [(1.0, 2.0), (4.0, 6.0)], None, None), (1, 1, "text", [(0.0, 0.0)], None, "a<b")], "page int, o int, kind string, points array<struct<x:double,y:double>>, style string, text string")
    out = emit.svg_pages(shapes, ["page"], "o").first().svg
    assert '<rect x="1.0" y="2.0" width="3.0" height="4.0"' in out and ">a&lt;b</text>" in out


def test_charts(spark):
    from pyspark.sql import Window

    from tabulon.operators import charts

    grid = [["", "s1", "s2"], ["a", 1.0, 10.0], ["b", 3.0, None], ["c", 5.0, 30.0]]
    cells = spark.createDataFrame([("d", r, c, v if isinstance(v, float) else None, v if isinstance(v, str) else None) for r, row in enumerate(grid) for c, v in enumerate(row)], "doc string, row int, col int, value double, text string")
    data = charts.chart_data(cells, ["doc"]).cache()
    assert sorted((r.series, r.category, r.ord, r.value) for r in data.filter("series = 's1'").collect()) == [("s1", "a", 0, 1.0), ("s1", "b", 1, 3.0), ("s1", "c", 2, 5.0)]
    s = {r.series: r for r in charts.statistics(data, ["doc"], "percent", 10).collect()}
    assert (s["s1"].n, s["s1"].mean, s["s1"].slope, s["s1"].low) == (3, 3.0, 2.0, pytest.approx(2.7)) and s["s2"].n == 2
    assert {(r.series, r.category): r.position for r in charts.on_axis(data, "sequence-skip-empty", ["doc", "series"]).collect()}["s2", "c"] == 2
    top = {(r.series, r.ord): (r.low, r.high) for r in charts.stacked(data.filter("ord <> 1"), ["doc"], percent=True).collect()}
    assert top["s2", 0] == (pytest.approx(100 / 11), pytest.approx(100))
    fit = data.filter("series = 's1'").withColumn("f", charts.fitted("linear", F.col("value"), F.col("ord") + 1.0, Window.partitionBy("doc"))).collect()
    assert all(r.f == pytest.approx(r.value) for r in fit)
    with pytest.raises(ValueError, match="axis"):
        charts.on_axis(data, "round", [])


def test_names(spark):
    from tabulon.operators import names

    cells = spark.createDataFrame([(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "1"), (0, 1, 1, "2")], "sheet_id int, row int, col int, text string")
    book = names.Workbook(cells, [Range("Sales", 0, 0, 0, 1, 1)], {"twice": "[a] * 2", "more": "[twice] + [b]", "loop": "[loop] + 1"})
    assert book.table("SALES").select(book.formula("More")).first()[0] == 4
    assert book.views("v_") == ["v_sales"] and spark.table("v_sales").count() == 1
    with pytest.raises(ValueError, match="itself"):
        book.formula("loop")
    with pytest.raises(KeyError):
        book.table("none")
    refs = spark.createDataFrame([("d", 1, 0, 2, 3), ("d", 0, 0, 0, 0)], "doc_id string, sheet_id int, own_sheet_id int, col int, row int")
    sheets = spark.createDataFrame([("d", 0, "One"), ("d", 1, "Two")], "doc_id string, sheet_id int, name string")
    found = names.with_sheet_names(refs, sheets).select(names.reference_text(F.col("col"), F.col("row"), F.col("sheet_name")).alias("t")).collect()
    assert sorted(r.t for r in found) == ["[.A1]", "[Two.C4]"]
    assert names.token_properties([{"type": "index", "value": 1}]) == "[]"


@pytest.mark.parametrize("bins", [64, 4])
def test_row_numbers(spark, monkeypatch, bins):
    monkeypatch.setattr(ranges, "BINS", bins)
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") % 97).alias("k"), F.col("id").alias("i")).repartition(5)
    rows = ranges.row_numbers(df, ["k", "i"], "n").collect()
    assert [r.n for r in sorted(rows, key=lambda r: (r.k, r.i))] == list(range(1, 1001))
    assert ranges.row_numbers(df.limit(0), ["k"], "n").count() == 0


def test_traced_walks_long_chains_and_cycles(spark):
    refs = spark.createDataFrame([(k, k - 1) for k in range(1, 80)] + [(5, 70)], "cell int, refers int").coalesce(1)
    start = spark.createDataFrame([(79,)], "cell int")
    assert sorted(r.cell for r in lookup.traced(refs, start).collect()) == list(range(80))


def test_advanced_filter_takes_all_criteria(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (2.0, "b"), (3.0, None), (None, "c"), (20_000.0, "d")], "x double, s string")
    filler = spark.range(9000).select((-F.col("id") - 1).cast("string").alias("x"), F.lit(None).cast("string").alias("s"))
    own = spark.createDataFrame([("2", "b"), ("", "<>a"), (">=20000", None), ("", "")], "x string, s string")
    small = query.advanced_filter(df, own).collect()
    assert sorted(query.advanced_filter(df, filler.unionByName(own)).collect(), key=str) == sorted(small, key=str) and len(small) == 4


def test_pilot_keeps_all_members(spark):
    df = spark.range(300).select(F.lit("r").alias("row"), F.format_string("m%03d", "id").alias("col"), F.col("id").alias("v"))
    found = query.pilot(df, Pilot((Dimension("row"), Dimension("col", "column"), Dimension("v", "data", "sum")))).first().asDict()
    assert {k: v for k, v in found.items() if k != "row"} == {f"m{k:03d}_sum_v": k for k in range(300)}


def test_styles_of_any_depth(spark):
    styles = spark.createDataFrame([(k, k - 1 if k else None) for k in range(45)], "name long, parent long")
    found = ranges.inherited(styles, spark.createDataFrame([(0, "colour", "red")], "name long, item string, value string")).collect()
    assert sorted((r.name, r.level) for r in found) == [(k, k) for k in range(45)]
