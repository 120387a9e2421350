"""The binary form of nested documents' calls, both ways.

Tags: E a name; S a name and its properties; T a text. A property list is a count, then `p`
with a name and a value, or `v` with a name and a list of property lists. Counts and text
lengths (with their closing zero) are 32 bits, little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from tabulon.sources.bytes import BadBytes, Bytes

DEEPEST = 64


def _text(text: str) -> bytes:
    raw = text.encode() + b"\0"
    return struct.pack("<i", len(raw)) + raw


def _list(props: dict) -> bytes:
    out = struct.pack("<i", len(props))
    for name, value in props.items():
        if isinstance(value, list):
            out += b"v" + _text(name) + struct.pack("<i", len(value)) + b"".join(map(_list, value))
        else:
            out += b"p" + _text(name) + _text(str(value))
    return out


def encode(calls: list[tuple[str, dict | None]]) -> bytes:
    """calls: (name, properties); (\"#text\", {\"text\": ...}) is a text. Empty texts leave nothing."""
    out = b""
    for name, props in calls:
        if name == "#text":
            out += b"T" + _text(props["text"]) if props["text"] else b""
        elif props is None:
            out += b"E" + _text(name)
        else:
            out += b"S" + _text(name) + _list(props)
    return out


def _read_text(b: Bytes) -> str:
    n = b.unpack("i")[0]
    if n < 1:
        raise BadBytes("a text without its closing zero")
    return b.take(n)[:-1].decode("utf-8", "replace")


def _read_list(b: Bytes, depth: int = 0) -> dict:
    if depth > DEEPEST:
        raise BadBytes("property lists too deep")
    out: dict = {}
    for _ in range(b.unpack("i")[0]):
        kind = b.take(1)
        name = _read_text(b)
        if kind == b"p":
            out[name] = _read_text(b)
        elif kind == b"v":
            out[name] = [_read_list(b, depth + 1) for _ in range(b.unpack("i")[0])]
        else:
            raise BadBytes("no property")
    return out


def decode(data: bytes) -> Iterator[tuple[str, dict | None]]:
    """The calls, up to a fault (which raises BadBytes)."""
    b = Bytes(data)
    while b.left:
        tag = b.take(1)
        if tag == b"E":
            yield _read_text(b), None
        elif tag == b"S":
            yield _read_text(b), _read_list(b)
        elif tag == b"T":
            yield "#text", {"text": _read_text(b)}
        else:
            raise BadBytes(f"tag {tag!r} is not known")
