"""Spreadsheet streams: records to sheets, cells, notes, formulas and stored specifications.

Records that are not understood are skipped by their length. A fault inside a sheet ends
that sheet with what was read; nothing is raised beyond `read_sheet`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from tabulon.functions.formula import OPCODES
from tabulon.sources import charset, cipher
from tabulon.sources.bytes import BadBytes, Bytes, sheet_record

# Record ids.
DOCUMENT, OLD_DOCUMENT, FLAGS, SHEET, NAMES, DATABASE, CHARSET = 0x4220, 0x422D, 0x4221, 0x4222, 0x4224, 0x4225, 0x422C
COLUMNS, SIZES, TAB, LINK = 0x4240, 0x4241, 0x4242, 0x4243
DATA, NOTES, ATTRIBUTES, ENTRIES = 0x4250, 0x4251, 0x4252, 0x4200

LAST_COLUMN = 255


@dataclass
class Sheet:
    number: int
    name: str = ""
    page_style: str = ""
    widths: list[tuple[int, int]] = field(default_factory=list)  # (times, width)
    heights: list[tuple[int, int]] = field(default_factory=list)
    cells: list[dict] = field(default_factory=list)
    notes: list[dict] = field(default_factory=list)
    outline: list[dict] = field(default_factory=list)


@dataclass
class Workbook:
    version: int = 0
    page_style: str = ""
    last_row: int = 8191
    charset: int = 0
    sheets: list[Sheet] = field(default_factory=list)
    names: list[dict] = field(default_factory=list)
    ranges: list[dict] = field(default_factory=list)
    error: str | None = None


class Reader:
    def __init__(self, password: bytes = b""):
        self.book, self.key = Workbook(), password

    def text(self, b: Bytes) -> str:
        raw = b.take(b.u16())
        return charset.decode(cipher.apply(raw, self.key) if self.key else raw, self.book.charset)

    def entries(self, b: Bytes) -> tuple[Bytes, list[int]]:
        """A record of several entries: its body and their sizes, which a table behind it holds."""
        body = sheet_record(b)
        if b.u16() != ENTRIES:
            raise BadBytes("no table of entries")
        sizes = b.within(b.u32())
        return body, [sizes.u32() for _ in range(sizes.left // 4)]

    def document(self, data: bytes) -> Workbook:
        b = Bytes(data)
        if len(data) > 1 and data[1] != 0x42:
            b = Bytes(cipher.unmasked(data, cipher.mask_for(data[1], 0x42)))
        if b.u16() not in (DOCUMENT, OLD_DOCUMENT):
            raise BadBytes("no spreadsheet")
        body = sheet_record(b)
        while body.left >= 6:
            kind = body.u16()
            if kind in (NAMES, DATABASE):
                inner, sizes = self.entries(body)
                self.listed(kind, inner, sizes)
                continue
            inner = sheet_record(body)
            try:
                if kind == FLAGS:
                    self.flags(inner)
                elif kind == CHARSET:
                    inner.u8()
                    self.book.charset = inner.u8()
                elif kind == SHEET:
                    self.sheet(inner)
            except BadBytes as e:
                self.book.error = self.book.error or str(e)
        return self.book

    def flags(self, b: Bytes) -> None:
        self.book.version = b.u16()
        self.book.page_style = self.text(b)
        b.u8()
        self.text(b)
        for size in (2, 1, 2):  # language, calculates by itself, visible sheet
            if b.left:
                b.take(size)
        if b.left:
            self.book.version = b.u16()
        if b.left:
            self.book.last_row = b.u16()

    def listed(self, kind: int, b: Bytes, sizes: list[int]) -> None:
        n = b.u16() if kind == DATABASE or b.left > 1 else 0
        if kind == NAMES:
            b.take(2)
        for size in sizes[: n or None]:
            inner = b.within(size)
            try:
                if kind == DATABASE:
                    self.book.ranges.append(self.database(inner))
                else:
                    self.book.names.append({"name": self.text(inner)})
            except BadBytes as e:
                self.book.error = self.book.error or str(e)

    def database(self, b: Bytes) -> dict:
        out = {"name": self.text(b)}
        out["sheet"], out["c0"], out["r0"], out["c1"], out["r1"] = b.unpack("HHHHH")
        out["by_row"], out["header"] = bool(b.u8()), bool(b.u8())
        return out

    def sheet(self, b: Bytes) -> None:
        sheet = Sheet(len(self.book.sheets))
        self.book.sheets.append(sheet)
        while b.left >= 6:
            kind = b.u16()
            if kind == COLUMNS:
                body, sizes = self.entries(b)
                for k, size in enumerate(sizes):
                    if not body.left:
                        break
                    column = body.u8() if self.book.version >= 6 else k
                    self.column(body.within(size), sheet, column)
                continue
            inner = sheet_record(b)
            if kind == SIZES:
                self.sizes(inner, sheet)
            elif kind == TAB:
                self.tab(inner, sheet)

    def sizes(self, b: Bytes, sheet: Sheet) -> None:
        """Run lengths of widths, column flags, heights and row flags."""
        for runs, last, form in ((sheet.widths, LAST_COLUMN, "HH"), (None, LAST_COLUMN, "HB"), (sheet.heights, self.book.last_row, "HH"), (None, self.book.last_row, "HB")):
            at = 0
            while at <= last and b.left >= 3:
                times, value = b.unpack(form)
                if not times:
                    continue
                if runs is not None:
                    runs.append((times, value))
                at += times

    def tab(self, b: Bytes, sheet: Sheet) -> None:
        b.take(1)  # scenario
        self.text(b)  # its comment
        b.take(4 + 1)  # colour, flags
        sheet.name = self.text(b)

    def column(self, b: Bytes, sheet: Sheet, column: int) -> None:
        while b.left >= 6:
            kind = b.u16()
            if kind == DATA:
                body, sizes = self.entries(b)
                self.data(body, sizes, sheet, column)
                continue
            inner = sheet_record(b)
            if kind == NOTES:
                for _ in range(inner.u16()):
                    row = inner.u16()
                    sheet.notes.append({"row": row, "col": column, "text": self.text(inner), "date": self.text(inner), "author": self.text(inner)})

    def extra(self, b: Bytes) -> None:
        """Bytes that later versions put before a cell's value."""
        if self.book.version >= 7:
            b.take(b.u8() & 15)

    def data(self, b: Bytes, sizes: list[int], sheet: Sheet, column: int) -> None:
        formulas = iter(sizes)
        for _ in range(b.u16()):
            row, kind = b.u16(), b.u8()
            cell = {"row": row, "col": column, "content_type": "NONE", "value": None, "text": None, "formula": None}
            if kind == 1:
                self.extra(b)
                cell |= {"content_type": "NUMBER", "value": b.f64()}
            elif kind in (2, 6):
                self.extra(b)
                cell |= {"content_type": "TEXT", "text": self.text(b)}
            elif kind == 3:
                size = next(formulas, None)
                if size is None:
                    raise BadBytes("a formula without an entry")
                self.formula(b.within(size), cell)
            elif kind == 4:
                self.extra(b)
            else:
                raise BadBytes(f"cell kind {kind} is not known")
            if 0 <= column <= LAST_COLUMN and row <= self.book.last_row:
                sheet.cells.append(cell)

    def formula(self, b: Bytes, cell: dict) -> None:
        version = self.book.version
        cell["content_type"] = "FORMULA"
        if version < 8:
            return  # the result of older formulas is not stored beside them
        head = b.u8()
        b.take(head & 15)
        flags = b.u8()
        b.i16()
        if flags & 8:
            cell["value"] = b.f64()
        if flags & 16:
            cell["text"] = self.text(b) or None
        try:
            cell["formula"] = self.tokens(b)
        except BadBytes:
            cell["formula"] = None

    def tokens(self, b: Bytes) -> list[dict] | None:
        """The token list in infix order; None if it points to shared formulas."""
        flags = b.u8()
        b.take(flags & 15)
        b.u8()
        if flags & 0x10:
            b.take(2)
        if flags & 0x20:
            b.take(2)
        out = [self.token(b) for _ in range(b.u16())] if flags & 0x40 else []
        if any(t and t["type"] == "index" for t in out):
            return None
        return [t for t in out if t]

    def token(self, b: Bytes) -> dict | None:
        code, kind = b.u16(), b.u8()
        own: dict = {}
        if kind == 0:
            own = {"type": "long", "value": b.unpack("b")[0]}
        elif kind == 1:
            own = {"type": "number", "value": b.f64()}
        elif kind in (3, 4):
            own = {"type": "cell" if kind == 3 else "cells"} | self.place(b, "0")
            if kind == 4:
                own |= self.place(b, "1")
        elif kind == 6:
            own = {"type": "index", "value": b.u16()}
        elif kind == 7:
            b.take(2 * b.u8())
        elif kind not in (0x70, 0x71):
            if kind == 8:
                b.u8()
            own = {"type": "text", "value": charset.decode(b.take(b.u8()), self.book.charset)}
        # Opcodes without a name in the vocabulary.
        marks = {7: "(", 8: ")", 9: ";", 17: "%"}
        if code in (0, 3, 4):
            return own or None
        if code in (2, 12):
            return None
        if code == 5:
            return {"type": "function", "name": "If"}
        if code in marks:
            return {"type": "operator", "name": marks[code]}
        name = OPCODES.get(code)
        if name is None:
            raise BadBytes(f"opcode {code} is not known")
        return {"type": "operator" if code < 41 or code in (42, 43) else "function", "name": name}

    def place(self, b: Bytes, end: str) -> dict:
        col, row, sheet, flags = *b.unpack("hhh"), b.u8()
        new = self.book.version >= 0x10
        relative = [bool(flags >> s & (1 if new else 3)) for s in (0, 2, 4)]
        return {f"c{end}": col, f"r{end}": row, f"s{end}": sheet, f"rel{end}": relative}


def read_sheet(data: bytes, password: bytes = b"") -> Workbook:
    reader = Reader(password)
    try:
        return reader.document(data)
    except (BadBytes, IndexError) as e:
        reader.book.error = str(e) or "bad bytes"
        return reader.book


def rows(book: Workbook) -> Iterator[dict]:
    """Cells as rows of the cell table."""
    import json

    for sheet in book.sheets:
        for c in sheet.cells:
            value = c["value"]
            shown = c["text"] if c["text"] is not None else None if value is None else (f"{value:.15g}")
            yield {"sheet_id": sheet.number, "sheet": sheet.name, "row": c["row"], "col": c["col"], "content_type": c["content_type"], "value": value, "text": shown, "formula": json.dumps(c["formula"]) if c["formula"] is not None else None}
