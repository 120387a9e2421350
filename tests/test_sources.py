"""Decoders on files built here: no document is shipped."""

import math
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.functions.markup import mathml
from tabulon.sources import bitmap, charset, cipher, compound, office, sheet
from tabulon.sources.bytes import BadBytes, Bytes, drawing_record, framework_record, record_ends, writer_record


def string(text: str) -> bytes:
    raw = text.encode("cp1252")
    return struct.pack("<H", len(raw)) + raw


def record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HI", kind, len(body)) + body


def many(kind: int, body: bytes, sizes: list[int]) -> bytes:
    return record(kind, body) + struct.pack("<HI", 0x4200, 4 * len(sizes)) + b"".join(struct.pack("<I", s) for s in sizes)


def token(code: int, kind: int = 0, body: bytes = b"\0") -> bytes:
    return struct.pack("<HB", code, kind) + body


def workbook(version: int = 8) -> bytes:
    """Two sheets: a number, a text, a formula (1 + A1 and its value) and a note."""
    flags = struct.pack("<H", version) + string("Default") + b"\0" + string("") + struct.pack("<HBHHH", 1033, 1, 0, version, 100)
    extra = b"\0" if version >= 7 else b""
    tokens = token(0, 1, struct.pack("<d", 1.0)) + token(21) + token(0, 3, struct.pack("<hhhB", 0, 0, 0, 0))
    body = b"\0" + b"\x08" + struct.pack("<h", 0) + struct.pack("<d", 2.5) + b"\x40" + b"\0" + struct.pack("<H", 3) + tokens
    first = struct.pack("<H", 2) + struct.pack("<HB", 0, 1) + extra + struct.pack("<d", 1.5) + struct.pack("<HB", 2, 2) + extra + string("né")
    second = struct.pack("<H", 1) + struct.pack("<HB", 1, 3) + body
    notes = struct.pack("<HH", 1, 2) + string("hi") + string("2001") + string("me")
    column0 = many(0x4250, first, []) + record(0x4251, notes)
    column1 = many(0x4250, second, [len(body)])
    columns = many(0x4240, b"\0" + column0 + b"\1" + column1, [len(column0), len(column1)])
    sizes = struct.pack("<HH", 256, 1285) + struct.pack("<HB", 256, 0) + struct.pack("<HH", 101, 256) + struct.pack("<HB", 101, 0)
    tab = b"\0" + string("") + b"\0\0\0\0\0" + string("One")
    one = record(0x4242, tab) + record(0x4241, sizes) + columns
    two = record(0x4242, b"\0" + string("") + b"\0\0\0\0\0" + string("Two"))
    return record(0x4220, record(0x4221, flags) + record(0x4999, b"skipped") + record(0x4222, one) + record(0x4222, two))


def compound_file(streams: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors; streams of any size, none of them small (cut-off 0)."""
    names = list(streams)
    sectors, table, starts = [], [], {}

    def put(data: bytes) -> int:
        n, first = max(1, -(-len(data) // 512)), len(sectors)
        for k in range(n):
            sectors.append(data[k * 512 : (k + 1) * 512].ljust(512, b"\0"))
            table.append(first + k + 1 if k + 1 < n else compound.END)
        return first

    for n in names:
        starts[n] = put(streams[n])

    def entry(name: str, kind: int, left: int, right: int, child: int, start: int, size: int) -> bytes:
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", left, right, child) + bytes(16) + bytes(4) + bytes(16) + struct.pack("<II", start, size) + bytes(4)

    free = compound.FREE
    entries = [entry("Root Entry", compound.ROOT, free, free, 1 if names else free, compound.END, 0)]
    for k, n in enumerate(names):
        entries.append(entry(n, compound.STREAM, free, k + 2 if k + 1 < len(names) else free, free, starts[n], len(streams[n])))
    directory = put(b"".join(entries).ljust(-(-len(entries) // 4) * 512, b"\0"))
    fat = len(sectors)
    table.append(0xFFFFFFFD)
    head = compound.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, directory, 0, 0, compound.END, 0, compound.END, 0)
    head += struct.pack("<109I", fat, *[free] * 108)
    assert len(head) == 512 and len(table) <= 128
    return head + b"".join(sectors) + struct.pack("<128I", *table, *[free] * (128 - len(table)))


def test_sheet_records():
    book = sheet.read_sheet(workbook())
    assert book.error is None and [s.name for s in book.sheets] == ["One", "Two"]
    cells = {(c["row"], c["col"]): c for c in book.sheets[0].cells}
    assert cells[0, 0]["value"] == 1.5 and cells[2, 0]["text"] == "né"
    assert cells[1, 1]["value"] == 2.5 and cells[1, 1]["content_type"] == "FORMULA"
    assert [t.get("name", t["type"]) for t in cells[1, 1]["formula"]] == ["number", "+", "cell"]
    assert book.sheets[0].notes == [{"row": 2, "col": 0, "text": "hi", "date": "2001", "author": "me"}]
    assert book.sheets[0].widths == [(256, 1285)] and book.last_row == 100


def test_masked_sheet():
    assert [s.name for s in sheet.read_sheet(cipher.masked(workbook(), 0x5A)).sheets] == ["One", "Two"]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_broken_sheets_never_raise(data):
    raw = bytearray(workbook())
    for _ in range(data.draw(st.integers(1, 6))):
        raw[data.draw(st.integers(0, len(raw) - 1))] = data.draw(st.integers(0, 255))
    sheet.read_sheet(bytes(raw[: data.draw(st.integers(0, len(raw)))]))


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_broken_files_are_only_unknown(data):
    raw = bytearray(compound_file({"StarCalcDocument": workbook()}))
    for _ in range(data.draw(st.integers(1, 8))):
        raw[data.draw(st.integers(0, 1200))] = data.draw(st.integers(0, 255))
    assert compound.detect(bytes(raw))["kind"] in ("spreadsheet", "unknown", "text", "draw", "chart")


def test_compound_streams():
    long = bytes(range(256)) * 9
    file = compound_file({"StarCalcDocument": workbook(), "\x01CompObj": bytes(28) + b"x", "Long": long})
    streams = compound.Compound(file).streams()
    assert streams["Long"] == long and streams["StarCalcDocument"] == workbook()
    assert compound.detect(file) == {"kind": "spreadsheet", "confidence": "excellent"}
    assert compound.detect(b"SGA3....")["kind"] == "gallery"
    clip = bytes(28) + struct.pack("<i", 1) + b"\0" + struct.pack("<i", 16) + b"StarImpress 5.0\0"
    assert compound.detect(compound_file({"StarDrawDocument3": b"", "\x01CompObj": clip}))["kind"] == "presentation"


def test_files_as_tables(spark, tmp_path):
    good = compound_file({"StarCalcDocument": workbook(), "SfxDocumentInfo": information()})
    for name, data in (("a.sdc", good), ("b.sdc", good[:700]), ("c.sdc", b"junk")):
        (tmp_path / name).write_bytes(data)
    files = office.files(spark, str(tmp_path))
    assert sorted((r.kind, r.result) for r in office.read_documents(files).collect()) == [("spreadsheet", "ok"), ("unknown", "unknown"), ("unknown", "unknown")]
    cells = office.read_cells(files).collect()
    assert len(cells) == 3 and {c.sheet for c in cells} == {"One"}
    assert office.read_streams(files).count() == 2
    assert office.read_notes(files).first().author == "me"
    meta = [r.meta for r in office.read_meta(files).collect() if r.meta]
    assert meta[0]["dc:title"] == "T" and meta[0]["meta:creation-date"] == "2015-09-29T17:23:18.00" and meta[0]["user:Key"] == "Value"
    office.register(spark)
    assert spark.read.format("officecells").option("paths", f"{tmp_path}/a.sdc,{tmp_path}/b.sdc").load().filter("value > 2").count() == 1


def information() -> bytes:
    out = string("SfxDocumentInfo") + struct.pack("<HBHBB", 1, 0, 1, 0, 0)
    for k, (slot, size) in enumerate(office.SLOTS):
        text = {"dc:title": "T", "meta:initial-creator": "me"}.get(slot, "Key" if k == 7 else "Value" if k == 8 else "")
        out += string(text).ljust(size, b"\0")
        if k < 3:
            out += struct.pack("<II", 20150929, 17231800)
    return out


def test_streamed_files(spark, tmp_path):
    from tabulon.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sdc").write_bytes(workbook())
    query = ingest.arriving_cells(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("arrived").count() == 3


def test_running_totals(spark, tmp_path):
    from tabulon.streaming import ingest

    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k, 2.0D AS v UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 3.0D").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    query = ingest.running_totals(events, "ts", ["k"], "v").writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.n, r.total) for r in spark.table("totals").collect()] == [(2, 5.0)]


def test_cipher():
    key = cipher.key_of("secret")
    assert cipher.apply(cipher.apply(b"some text of any length at all", key), key) == b"some text of any length at all"
    assert cipher.apply(key, cipher.PASSWORD_KEY) == b"secret".ljust(16)
    check = cipher.apply(cipher.stamp(20150929, 17231800), key)
    assert cipher.fits(key, 20150929, 17231800, check) and not cipher.fits(cipher.key_of("other"), 20150929, 17231800, check)
    assert cipher.guessed(20150929, 17231800, check) == key
    assert cipher.unmasked(cipher.masked(bytes(range(256)), 7), 7) == bytes(range(256))


def test_charsets():
    assert len(charset.BY_NUMBER) == 79
    assert charset.decode(b"\xe9\x80", 1) == "é€" and charset.decode(b"\xe9", 13) == "é" and charset.decode(b"\xc0", 74) == "ю"
    assert charset.decode("日本".encode("cp932"), 60) == "日本" and charset.decode(b"\xb1", 81) == "ｱ"
    assert charset.positions("a日b".encode("cp932"), 60) == ("a日b", [0, 1, 3])
    for number in charset.BY_NUMBER:
        assert isinstance(charset.decode(bytes(range(32, 127)), number), str)
        assert isinstance(charset.decode(bytes(range(128, 256)), number), str)


def test_framings():
    b = Bytes(struct.pack("<I", ord("T") | 10 << 8) + b"abcdef" + b"rest")
    kind, body = writer_record(b)
    assert kind == "T" and body.take(6) == b"abcdef" and b.take(4) == b"rest"
    big = Bytes(struct.pack("<I", ord("N") | 0xFFFFFF << 8) + b"xyz!")
    assert writer_record(big, {0: 8})[1].left == 4
    assert framework_record(Bytes(struct.pack("<I", 3 | 2 << 8) + b"ok"))[1].left == 2
    magic, version, body = drawing_record(Bytes(b"DrPg" + struct.pack("<HI", 5, 12) + b"ab"))
    assert (magic, version, body.left) == ("DrPg", 5, 2)
    assert record_ends(Bytes(b"\x04" + struct.pack("<I", 1) + struct.pack("<II", 40, 9))) == {40: 49}
    assert [Bytes(x).compressed() for x in (b"\x85", b"\x41\x02", b"\x08\x00\x00\x01\x00")] == [5, 0x102, 256]
    with pytest.raises(BadBytes):
        writer_record(Bytes(struct.pack("<I", ord("T") | 99 << 8)))
    assert math.isnan(Bytes(struct.pack("<d", math.inf)).f64())


def bmp(bits: int, rows: bytes, width: int, height: int, compression: int = 0, palette: bytes = b"") -> bytes:
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 0) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, compression, 0, 0, 0, len(palette) // 4, 0) + palette + rows


def test_bitmaps():
    plain = bitmap.read_bitmap(Bytes(bmp(24, b"\1\2\3\4\5\6\0\0" + b"\7\x08\x09\x0a\x0b\x0c\0\0", 2, 2)))
    assert plain["pixels"].tolist() == [[[9, 8, 7], [12, 11, 10]], [[3, 2, 1], [6, 5, 4]]]
    palette = b"\0\0\0\0" + b"\xff\0\0\0"
    runs = bitmap.read_bitmap(Bytes(bmp(8, b"\x02\x01\0\0" + b"\0\x03\0\1\0\0" + b"\0\1", 3, 2, 1, palette)))
    assert runs["pixels"][:, :, 2].tolist() == [[0, 255, 0], [255, 255, 0]]
    packed = zlib.compress(palette + b"\x80\0\0\0")
    deflated = b"BM" + struct.pack("<IHHI", 0, 0, 0, 0) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 1, bitmap.DEFLATED, 0, 0, 0, 2, 0) + struct.pack("<III", len(packed), 12, 0) + packed
    assert bitmap.read_bitmap(Bytes(deflated))["pixels"][:, :, 2].tolist() == [[255, 0]]
    found = list(bitmap.gallery(b"junk" + b"SGA3" + struct.pack("<HHH", 4, 5, 1) + b"\1" + bmp(24, b"\1\2\3\0", 1, 1) + b"xxSGA3" + b"\0" * 3))
    assert found[0]["width"] == 1 and found[0]["error"] is None and found[1]["error"]
    with pytest.raises(BadBytes):
        bitmap.read_bitmap(Bytes(bmp(24, b"", 60_000, 1)))


def test_math_markup():
    assert mathml("a over b") .endswith("<mfrac><mi>a</mi><mi>b</mi></mfrac></math>")
    assert "<msubsup><mi>x</mi><mn>1</mn><mn>2</mn></msubsup>" in mathml("x_1^2")
    assert "<munderover><mo>∑</mo><mrow>" in mathml("sum from {i=1} to n i^2")
    assert "<mtable><mtr><mtd><mi>a</mi></mtd><mtd><mi>b</mi></mtd></mtr><mtr>" in mathml("matrix{a # b ## c # d}")
    assert "<msqrt><mn>2</mn></msqrt>" in mathml("sqrt 2") and "α" in mathml("%alpha")
    assert mathml("{a").endswith("<mtext>{a</mtext></math>") and mathml("") .endswith("</math>")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab12{}()^_+ overqtmax#\"%<&", max_size=40))
def test_math_markup_never_raises(text):
    mathml(text)


def test_traces(spark):
    from tabulon.sources import trace

    lines = ["startDocument()", "  openSheetCell(librevenge:column: 0, librevenge:row: 12)", "    insertText(text: a, b)", "  closeSheetCell()", "  setStyle (x:y: ((a: 1, b: 2)), z: c)", "  endMasterPage", "endDocument()"]
    df = spark.createDataFrame([("d", k, t) for k, t in enumerate(lines)], "doc string, seq int, line string")
    rows = {r.seq: r for r in trace.parsed(df).collect()}
    assert rows[1].props == {"librevenge:column": "0", "librevenge:row": "12"} and rows[1].depth == 1
    assert rows[2].props == {"text": "a, b"} and rows[4].props["x:y"] == "((a: 1, b: 2))" and rows[5].op == "endMasterPage"
    from tabulon.operators import emit

    left = emit.balanced(trace.parsed(df.filter("seq not in (4, 5)"))).first()
    assert (left.depth_left, left.lowest) == (0, 0)


def writer_stream(version: int = 0x101, password: str = "", order: str = "<") -> bytes:
    """A pool of two styles, two paragraphs (one a heading) and one inside a section; statistics."""
    key = cipher.key_of(password) if password else b""
    rec = lambda kind, body: struct.pack(order + "I", ord(kind) | (len(body) + 4) << 8) + body
    pack = lambda form, *v: struct.pack(order + form, *v)

    def text_of(t: str) -> bytes:
        raw = cipher.apply(t.encode("cp1252"), key) if key else t.encode("cp1252")
        return pack("H", len(raw)) + raw

    pool = rec("!", b"\x01" + pack("H", 2) + b"".join(pack("HH", k, len(s)) + s.encode() for k, s in enumerate(("Heading", "Body"))))
    node = lambda style, t, more=b"": rec("T", b"\x02" + pack("H", style) + text_of(t) + more)
    content = lambda *nodes: rec("N", b"\x04" + pack("HH", 0, len(nodes)) + b"".join(nodes))
    section = rec("I", b"junk" + content(node(1, "inner")))
    stats = rec("d", b"\x0c" + pack("HHHHI", 0, 0, 0, 1, 3))
    body = pool + content(node(0, "Title", rec("3", b"\x01\x02")), node(1, "née"), section) + stats
    date, time = 20150929, 17231800
    check = cipher.apply(cipher.stamp(date, time), key) if key else bytes(16)
    head = (b"SW" if order == "<" else b"WS") + b"5HDR\0\x2e" + pack("HHII", version, 8 if key else 0, 0, 0) + bytes(8) + check + b"\x01\0" + pack("II", date, time)
    return head.ljust(8 + 0x2E, b"\0") + body


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("password", ["", "geheim"])
def test_text_documents(order, password):
    from tabulon.sources import writer

    doc = writer.read_text(writer_stream(password=password, order=order), password)
    assert doc.error is None and doc.password_fits and doc.encrypted == bool(password)
    assert [(p.style, p.level, p.text, p.inside) for p in doc.paragraphs] == [("Heading", 2, "Title", ""), ("Body", None, "née", ""), ("Body", None, "inner", "section")]
    assert doc.paragraphs[1].src_pos == [0, 1, 2] and doc.statistics["paragraphs"] == 3 and doc.records == ["pool", "content", "statistics"]
    if password:
        assert writer.read_text(writer_stream(password=password), "").paragraphs[0].text == "Title"  # the key is guessed
        assert not writer.read_text(writer_stream(password=password), "wrong").password_fits


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_broken_texts_never_raise(data):
    from tabulon.sources import writer

    raw = bytearray(writer_stream())
    for _ in range(data.draw(st.integers(1, 6))):
        raw[data.draw(st.integers(0, len(raw) - 1))] = data.draw(st.integers(0, 255))
    writer.read_text(bytes(raw[: data.draw(st.integers(0, len(raw)))]))


def test_paragraph_table(spark, tmp_path):
    (tmp_path / "a.sdw").write_bytes(compound_file({"StarWriterDocument": writer_stream()}))
    files = office.files(spark, str(tmp_path))
    assert [r.text for r in office.read_paragraphs(files).orderBy("ord").collect()] == ["Title", "née", "inner"]
    assert tuple(office.read_documents(files).first())[1:] == ("text", "excellent", "ok")


def test_nested_calls_come_back():
    from tabulon.sources import properties

    calls = [("startDocument", {}), ("openCell", {"a": "1", "list": [{"x": "é"}, {}]}), ("#text", {"text": "T"}), ("closeCell", None)]
    assert list(properties.decode(properties.encode(calls))) == calls
    assert properties.encode([("#text", {"text": ""})]) == b""
    with pytest.raises(BadBytes):
        list(properties.decode(b"Q"))


def test_languages(spark):
    from tabulon.sources import languages

    df = spark.createDataFrame([(1033,), (1031,), (1,)], "language_id int")
    assert {r.language_id: (r.language, r.country) for r in languages.with_language(df).collect()} == {1033: ("en", "US"), 1031: ("de", "DE"), 1: (None, None)}
    assert office.picture_type(b"BM....") == "bmp" and office.picture_type(b"?") == "unknown"


def drawing_stream() -> bytes:
    """A master page, and a page of a rectangle and a group that holds a circle."""
    rec = lambda magic, version, body: magic + struct.pack("<HI", version, len(body) + 10) + body
    obj = lambda number, box, more=b"": rec(b"DrOb", 5, b"SVDr" + struct.pack("<H", number) + struct.pack("<I", 22) + struct.pack("<iiiiH", *box, 3) + more)
    size = lambda w, h: struct.pack("<I", 60) + b"JoeM" + struct.pack("<I", 38) + struct.pack("<iiiiiiH", w, h, 0, 0, 0, 0, 0)
    page = size(2100, 2970) + obj(3, (1, 2, 30, 40)) + obj(1, (0, 0, 9, 9), obj(4, (5, 5, 8, 8))) + b"DrXX"
    return rec(b"DrMd", 11, b"pool" + rec(b"DrMP", 11, size(2100, 2970) + bytes(8)) + rec(b"DrPg", 11, page))


def test_drawings(spark, tmp_path):
    from tabulon.sources import drawing

    rows = list(drawing.read_drawing(drawing_stream()))
    assert [(r["page"], r["master"], r["kind"], r["parent"]) for r in rows] == [(0, True, "sheet", None), (1, False, "sheet", None), (1, False, "rectangle", None), (1, False, "group", None), (1, False, "ellipse", 1)]
    assert (rows[1]["x1"], rows[1]["y1"]) == (2100, 2970) and (rows[2]["x0"], rows[2]["y1"], rows[2]["layer"]) == (1, 40, 3)
    (tmp_path / "a.sda").write_bytes(compound_file({"StarDrawDocument3": drawing_stream()}))
    assert office.read_shapes(office.files(spark, str(tmp_path))).filter("kind = 'ellipse'").count() == 1


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_broken_drawings_never_raise(data):
    from tabulon.sources import drawing

    raw = bytearray(drawing_stream())
    for _ in range(data.draw(st.integers(1, 6))):
        raw[data.draw(st.integers(0, len(raw) - 1))] = data.draw(st.integers(0, 255))
    list(drawing.read_drawing(bytes(raw[: data.draw(st.integers(0, len(raw)))])))
