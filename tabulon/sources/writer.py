"""Text document streams: header, string pool, content nodes, statistics.

Gives paragraphs (also those inside tables and sections, with the kind of node they lie in).
Records that aren't understood are skipped by their length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from tabulon.sources import charset, cipher
from tabulon.sources.bytes import BadBytes, Bytes, record_ends, writer_record

#: Names by record type, for nodes and top-level records.
NODES = {"E": "table", "G": "graphic", "I": "section", "O": "object", "T": "text", "l": "format", "o": "format", "v": "redline", "i": "repeated text"}
TOP = {
    "!": "pool", "0": "outline", "R": "outline", "1": "footnotes", "4": "endnotes", "8": "print", "D": "database", "F": "frames", "J": "job", "M": "macros", "N": "content", "U": "layout", "V": "redlines", "Y": "field type", "a": "bookmarks",
    "d": "statistics", "j": "dictionary", "q": "number formats", "u": "index", "y": "index", "%": "record sizes",
}
STATISTICS = ("tables", "graphics", "objects", "pages", "paragraphs", "words", "chars")


@dataclass
class Paragraph:
    ord: int
    style: str
    level: int | None
    text: str
    src_pos: list[int]
    inside: str = ""
    marks: int = 0


@dataclass
class Document:
    version: int = 0
    charset: int = 0
    encrypted: bool = False
    password_fits: bool = True
    pool: list[str] = field(default_factory=list)
    paragraphs: list[Paragraph] = field(default_factory=list)
    nodes: list[str] = field(default_factory=list)
    statistics: dict[str, int] = field(default_factory=dict)
    records: list[str] = field(default_factory=list)
    error: str | None = None


class Reader:
    def __init__(self, password: str = ""):
        self.doc, self.key, self.ends, self.password = Document(), b"", {}, password

    def document(self, data: bytes) -> Document:
        b = self.header(data)
        while b.left >= 4:
            kind, body = writer_record(b, self.ends)
            if kind == "Z":  # the end
                break
            self.doc.records.append(TOP.get(kind, kind))
            try:
                if kind == "!":
                    self.pool(body)
                elif kind == "N":
                    self.content(body, "")
                elif kind == "d":
                    self.statistics(body)
            except BadBytes as e:
                self.doc.error = self.doc.error or str(e)
        return self.doc

    def header(self, data: bytes) -> Bytes:
        if len(data) < 0x36 or data[:2] not in (b"SW", b"WS") or data[3:7] != b"HDR\0":
            raise BadBytes("no text document")
        b = Bytes(data, big=data[:2] == b"WS")
        b.at = 7
        size = b.u8()
        if size < 0x2E:
            raise BadBytes("a short header")
        self.doc.version, flags = b.u16(), b.u16()
        if flags & 0x8000:
            raise BadBytes("the document is marked as bad")
        b.u32()
        places = b.u32()
        b.take(8)
        check = b.take(16)
        self.doc.charset = b.u8()
        b.u8()
        date, time = b.u32(), b.u32()
        if flags & 8:
            self.doc.encrypted = True
            self.key = cipher.key_of(self.password) if self.password else cipher.guessed(date, time, check) or b""
            self.doc.password_fits = bool(self.key) and cipher.fits(self.key, date, time, check)
        b.at = 8 + size
        if places and self.doc.version >= ord("%"):
            side = Bytes(data, b.order == ">")
            side.at = places
            kind, body = writer_record(side)
            if kind == "%":
                self.ends = record_ends(body)
        return b

    def text(self, b: Bytes, enciphered: bool = False) -> tuple[str, list[int]]:
        raw = b.take(b.u16())
        return charset.positions(cipher.apply(raw, self.key) if enciphered and self.key else raw, self.doc.charset)

    def flags(self, b: Bytes) -> tuple[int, Bytes]:
        """A byte of flags whose low half tells how many bytes belong to it."""
        own = b.u8()
        return own, b.within(own & 15)

    def pool(self, b: Bytes) -> None:
        old = self.doc.version < 3
        number = self.doc.charset if old else b.u8()
        n = b.u16()
        if old and n >= 256:
            b.at -= 1
            number, n = b.data[b.at - 1], b.u16()
        for _ in range(n):
            if not old:
                b.u16()
            self.doc.pool.append(charset.decode(b.take(b.u16()), number))

    def content(self, b: Bytes, inside: str) -> None:
        version = self.doc.version
        zone = self.flags(b)[1] if version >= 5 else b
        if version >= 0x201:
            n = zone.u32()
        else:
            if version >= 5:
                zone.u16()
            n = zone.u16()
        for _ in range(n):
            if b.left < 4:
                break
            kind, body = writer_record(b, self.ends)
            self.node(kind, body, inside)

    def node(self, kind: str, b: Bytes, inside: str) -> None:
        name = NODES.get(kind, kind)
        self.doc.nodes.append(name)
        if kind == "T":
            self.paragraph(b, inside)
        elif kind in "EI":  # whatever lies between, the contents in them are records of their own
            for own in self.found(b):
                self.content(own, name)

    def found(self, b: Bytes) -> Iterator[Bytes]:
        """The content records inside a table's or a section's record, at any depth of lines and boxes."""
        at = b.at
        while at + 4 <= b.stop:
            head = struct.unpack_from(b.order + "I", b.data, at)[0]
            kind, size = head & 0xFF, head >> 8
            if chr(kind) in "NLtEI" and 4 < size <= b.stop - at:
                inner = Bytes(b.data, b.order == ">")
                inner.at, inner.stop = at + 4, at + size
                if chr(kind) == "N":
                    yield inner
                else:
                    yield from self.found(inner)
                at += size
            else:
                at += 1

    def paragraph(self, b: Bytes, inside: str) -> None:
        flags, zone = self.flags(b)
        style = zone.u16() if zone.left >= 2 else 0xFFFF
        level = None
        if flags & 0x10 and self.doc.version < 0x201 and zone.left:
            value = zone.u8()
            if value == 200 and zone.left:
                value = zone.u8()
            level = None if value == 200 else value & 0x1F
        text, places = self.text(b, True)
        marks = 0
        while b.left >= 4:
            kind, body = writer_record(b, self.ends)
            if kind == "3":
                value = self.flags(body)[1].u8()
                level = None if value == 201 else min(value & 0x1F, 9)
            elif kind in "AKS":
                marks += 1
        name = self.doc.pool[style] if style < len(self.doc.pool) else ""
        self.doc.paragraphs.append(Paragraph(len(self.doc.paragraphs), name, level, text, places, inside, marks))

    def statistics(self, b: Bytes) -> None:
        zone = self.flags(b)[1]
        wide = self.doc.version >= 0x201
        for k, name in enumerate(STATISTICS):
            size = 4 if wide or k > 3 else 2
            if zone.left < size:
                break
            self.doc.statistics[name] = zone.u32() if size == 4 else zone.u16()


def read_text(data: bytes, password: str = "") -> Document:
    reader = Reader(password)
    try:
        return reader.document(data)
    except (BadBytes, IndexError, struct.error) as e:
        reader.doc.error = str(e) or "bad bytes"
        return reader.doc
