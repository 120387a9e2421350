"""Bitmaps of legacy documents and galleries: headers, masks, run lengths, deflated data."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

from tabulon.sources.bytes import BadBytes, Bytes

# The compression number of deflated bitmaps, and limits.
DEFLATED, MOST_INFLATED, MOST_SIDE = 0x1004453, 10_000_000, 50_000


def read_bitmap(b: Bytes, file_header: bool = True) -> dict:
    """width, height and pixels (height, width, 3) of the bitmap at the reader's place."""
    if file_header:
        magic = b.take(2)
        if magic == b"BA":
            b.take(12)
            magic = b.take(2)
        if magic != b"BM":
            raise BadBytes("no bitmap")
        b.take(12)
    size = b.u32()
    if size == 12:
        width, height, planes, bits = b.unpack("HHHH")
        compression = colours = 0
    elif size >= 36:
        width, height, planes, bits, compression, _, _, _, colours = b.unpack("iiHHIIIII" if size < 40 else "iiHHIIIII")
        b.take(max(0, size - 36))
    else:
        raise BadBytes("a bitmap header of unknown size")
    upside = height < 0
    height = abs(height)
    if not 0 < width <= MOST_SIDE or not 0 < height <= MOST_SIDE or width * height > MOST_INFLATED * 8:
        raise BadBytes("the bitmap's sides are out of range")
    if bits not in (1, 4, 8, 16, 24, 32):
        raise BadBytes(f"{bits} bits a pixel are not known")
    if compression == DEFLATED:
        packed, full, compression = b.u32(), b.u32(), b.u32()
        if not 0 < full <= MOST_INFLATED:
            raise BadBytes("deflated data of too many bytes")
        try:
            data = zlib.decompressobj().decompress(b.take(packed), full)
        except zlib.error as e:
            raise BadBytes(str(e)) from e
        b = Bytes(data)
    masks = (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
    if compression == 3 and bits in (16, 32):
        masks = b.unpack("III")
    palette = None
    if bits <= 8:
        n = colours or 1 << bits
        step = 3 if size == 12 else 4
        table = np.frombuffer(b.take(n * step), np.uint8).reshape(n, step)
        palette = table[:, 2::-1]
    if compression == 1 and bits == 8 or compression == 2 and bits == 4:
        index = run_lengths(b, width, height, bits == 4)
        return {"width": width, "height": height, "pixels": _coloured(index[::-1] if not upside else index, palette)}
    line = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(b.take(line * height), np.uint8).reshape(height, line)
    if bits <= 8:
        index = np.unpackbits(rows, axis=1)[:, : width * bits].reshape(height, width, bits) if bits < 8 else rows[:, :width]
        if bits < 8:
            index = (index * (1 << np.arange(bits)[::-1])).sum(axis=2)
        pixels = _coloured(index, palette)
    elif bits == 24:
        pixels = rows[:, : width * 3].reshape(height, width, 3)[:, :, ::-1]
    else:
        own = np.ascontiguousarray(rows[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.int64)
        pixels = np.stack([_part(own, m) for m in masks], axis=2)
    return {"width": width, "height": height, "pixels": np.ascontiguousarray(pixels if upside else pixels[::-1]).astype(np.uint8)}


def _part(values: np.ndarray, mask: int) -> np.ndarray:
    """A colour's bits as 0..255."""
    if not mask:
        return np.zeros_like(values)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return ((values & mask) >> low) * 255 // most


def _coloured(index: np.ndarray, palette: np.ndarray) -> np.ndarray:
    return palette[np.minimum(index, len(palette) - 1)]


def run_lengths(b: Bytes, width: int, height: int, half: bool) -> np.ndarray:
    """Palette numbers, bottom row first. half: two pixels a byte."""
    out = np.zeros((height, width), np.uint8)
    x = y = 0

    def put(values: list[int]) -> None:
        nonlocal x
        for v in values:
            if x < width and y < height:
                out[y, x] = v
            x += 1

    while y < height:
        n = b.u8()
        if n:
            v = b.u8()
            put([v >> 4 if k % 2 == 0 else v & 15 for k in range(n)] if half else [v] * n)
            continue
        n = b.u8()
        if n == 0:
            x, y = 0, y + 1
        elif n == 1:
            break
        elif n == 2:
            x, y = x + b.u8(), y + b.u8()
        else:
            raw = b.take((n + 1) // 2 if half else n)
            put([v for c in raw for v in (c >> 4, c & 15)][:n] if half else list(raw))
            if len(raw) % 2:
                b.take(1)
    return out


def gallery(data: bytes) -> Iterator[dict]:
    """The bitmaps of a gallery file: its entries are found by their magic, wherever they begin."""
    at = 0
    while (at := data.find(b"SGA3", at)) >= 0:
        b = Bytes(data)
        b.at = at + 4
        at += 4
        try:
            b.take(6)
            if b.u8() in (1, 2):
                found = read_bitmap(b)
                yield found | {"error": None}
        except BadBytes as e:
            yield {"width": None, "height": None, "pixels": None, "error": str(e)}
