"""Media columns: TIFF files in a binary column, a row per page.

The reader walks the chain of image directories in either byte order, decodes strips or
tiles that are stored plain or by PackBits, LZW or deflate, undoes the horizontal and the
floating-point predictor, and joins them to the page's samples, row by row.

The writer stores bytes losslessly as 8-bit grey pages, in strips.

Defined results: a null or empty file gives no page; a file that can't be read gives the
pages before the fault and then one row with `error` and no data; a chain of directories
that turns back on itself ends there with an error; pages over MAX_BYTES are errors;
repeated rows give their pages each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.runtime import table

# Fixed values of the format: tags, field types (struct letter) and compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

MAX_BYTES = 1 << 28


class BadFile(ValueError):
    pass


def unpack_bits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    out, at, plain = bytearray(), 0, bytearray()

    def put() -> None:
        for k in range(0, len(plain), 128):
            part = plain[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        plain.clear()

    while at < len(data):
        n = 1
        while n < 128 and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        if n > 2:
            put()
            out.append(257 - n)
            out.append(data[at])
        else:
            plain.extend(data[at : at + n])
        at += n
    put()
    return bytes(out)


CLEAR, END = 256, 257


def lzw_decode(data: bytes) -> bytes:
    out: list[bytes] = []
    words: list[bytes] = []
    size, bits, held, last = 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < size:
            continue
        bits -= size
        code, held = held >> bits, held & (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            words = [bytes([k]) for k in range(256)] + [b"", b""]
            size, last = 9, b""
            continue
        if not words:
            raise BadFile("LZW data without a clear code")
        if code < len(words):
            word = words[code]
        elif code == len(words) and last:
            word = last + last[:1]
        else:
            raise BadFile("LZW code out of range")
        out.append(word)
        if last:
            words.append(last + word[:1])
        last = word
        if len(words) + 1 >= 1 << size and size < 12:  # codes grow one early
            size += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    codes: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        known = 258 + max(0, len(codes) - 257)  # the reader's table is one entry behind
        size = min(12, max(9, (known + 1).bit_length()))
        held, bits = held << size | code, bits + size
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    def clear() -> None:
        put(CLEAR)
        codes.clear()
        codes.update((bytes([k]), k) for k in range(256))

    clear()
    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = len(codes) + 2
        word = data[k : k + 1]
        if len(codes) + 2 >= 4094:
            put(codes[word])
            word = b""
            clear()
    if word:
        put(codes[word])
        codes[word + b"\0\0"] = -1  # the reader has one more entry by then
    put(END)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def decoded(data: bytes, compression: int, most: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return lzw_decode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    raise BadFile(f"compression {compression} is not known")


def encoded(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1)}[compression](data)


def predicted(rows: np.ndarray) -> np.ndarray:
    """Differences along each row (rows, columns, samples)."""
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def unpredicted(rows: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """rows: (rows, columns, samples), of the page's own type."""
    if predictor == 1:
        return rows
    if predictor == 2:
        return np.cumsum(rows, axis=1, dtype=rows.dtype)
    if predictor == 3:  # bytes of a row's values in planes, highest first, each the difference to the byte before
        n, columns, samples = rows.shape
        flat = np.cumsum(rows.view(np.uint8).reshape(n, -1, samples), axis=1, dtype=np.uint8).reshape(n, rows.dtype.itemsize, columns * samples)
        flat = flat if order == ">" else flat[:, ::-1]
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(rows.dtype).reshape(rows.shape)
    raise BadFile(f"predictor {predictor} is not known")


class Directory(dict):
    def one(self, tag: int, default: int | None = None) -> int:
        found = self.get(tag)
        if found:
            return found[0]
        if default is None:
            raise BadFile(f"tag {tag} is missing")
        return default


def directories(data: bytes) -> Iterator[tuple[str, Directory]]:
    """(byte order, tags) of each image directory, in the chain's order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise BadFile("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise BadFile("the chain of directories turns back")
        seen.add(at)
        if at + 2 > len(data):
            raise BadFile("a directory lies outside the file")
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * n > len(data):
            raise BadFile("a directory lies outside the file")
        tags = Directory()
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            letter = TYPES.get(kind)
            if not letter:
                continue
            form = order + letter * count
            place = at + 10 + 12 * k
            if count > len(data):
                raise BadFile("a tag has more values than the file has bytes")
            if struct.calcsize(form) > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            if place + struct.calcsize(form) > len(data):
                raise BadFile("a tag's values lie outside the file")
            tags[tag] = struct.unpack_from(form, data, place)
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def page_samples(data: bytes, order: str, tags: Directory) -> np.ndarray:
    """(rows, columns, samples)"""
    width, height, samples = tags.one(WIDTH), tags.one(HEIGHT), tags.one(SAMPLES, 1)
    bits, form = tags.get(BITS, (1,)), tags.one(SAMPLE_FORMAT, 1)
    if len(set(bits)) > 1 or bits[0] not in (8, 16, 32, 64):
        raise BadFile(f"{bits} bits a sample are not known")
    kind = np.dtype(f"{order}{'f' if form == 3 else 'u'}{bits[0] // 8}") if bits[0] > 8 else np.dtype(np.uint8)
    if not width or not height or width * height * samples * kind.itemsize > MAX_BYTES:
        raise BadFile("the page has no sample, or too many")
    tiled = TILE_WIDTH in tags
    own_width, own_height = (tags.one(TILE_WIDTH), tags.one(TILE_HEIGHT)) if tiled else (width, min(height, tags.one(STRIP_ROWS, height)))
    if not own_width or not own_height or own_width * own_height * samples * kind.itemsize > MAX_BYTES:
        raise BadFile("a strip or tile has no sample, or too many")
    places, sizes = tags.get(TILE_AT if tiled else STRIP_AT), tags.get(TILE_BYTES if tiled else STRIP_BYTES)
    if not places or not sizes or len(places) != len(sizes):
        raise BadFile("no list of strips or tiles")
    planes, own_samples = (samples, 1) if tags.one(PLANAR, 1) == 2 else (1, samples)
    across, down = -(-width // own_width), -(-height // own_height)
    if len(places) < across * down * planes:
        raise BadFile("strips or tiles are missing")
    page = np.zeros((height, width, samples), kind)
    for k in range(across * down * planes):
        plane, (row, column) = k // (across * down), divmod(k % (across * down), across)
        top, left = row * own_height, column * own_width
        rows = own_height if tiled else min(own_height, height - top)
        need = rows * own_width * own_samples * kind.itemsize
        raw = decoded(data[places[k] : places[k] + sizes[k]], tags.one(COMPRESSION, NONE), need)
        if len(raw) < need:
            raise BadFile("a strip or tile is short")
        block = unpredicted(np.frombuffer(raw[:need], kind).reshape(rows, own_width, own_samples), tags.one(PREDICTOR, 1), order)
        part = block[: height - top, : width - left]
        page[top : top + part.shape[0], left : left + part.shape[1], plane : plane + own_samples] = part
    return page


def pages(data: bytes | None) -> Iterator[dict]:
    """A row per page; a fault ends the walk with a row that has `error`."""
    if not data:
        return
    k = 0
    try:
        for order, tags in directories(data):
            samples = page_samples(data, order, tags)
            yield {
                "page": k, "width": samples.shape[1], "height": samples.shape[0], "samples": samples.shape[2], "bits": samples.dtype.itemsize * 8,
                "compression": tags.one(COMPRESSION, NONE), "predictor": tags.one(PREDICTOR, 1), "data": samples.tobytes(), "error": None,
            }
            k += 1
    except (BadFile, zlib.error, struct.error, IndexError) as e:
        yield dict.fromkeys(("width", "height", "samples", "bits", "compression", "predictor", "data")) | {"page": k, "error": str(e)}


def grey_tiff(payload: bytes, width: int, page_rows: int = 64, strip_rows: int = 16, compression: int = DEFLATE, predictor: int = 2) -> bytes:
    """payload (a multiple of width, not empty) as grey pages of at most page_rows rows each."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must fill whole rows")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width, 1)
    body, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(rows), page_rows):
        page = rows[top : top + page_rows]
        places, sizes = [], []
        for k in range(0, len(page), strip_rows):
            strip = page[k : k + strip_rows]
            own = encoded((predicted(strip) if predictor == 2 else strip).tobytes(), compression)
            places.append(len(body))
            sizes.append(len(own))
            body += own
        body += b"\0" * (len(body) & 1)
        lists = len(body)
        if len(places) > 1:
            body += struct.pack(f"<{2 * len(places)}I", *places, *sizes)
        at_places, at_sizes = (lists, lists + 4 * len(places)) if len(places) > 1 else (places[0], sizes[0])
        tags = [
            (WIDTH, 4, 1, width), (HEIGHT, 4, 1, len(page)), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (STRIP_AT, 4, len(places), at_places),
            (SAMPLES, 3, 1, 1), (STRIP_ROWS, 4, 1, strip_rows), (STRIP_BYTES, 4, len(places), at_sizes), (PREDICTOR, 3, 1, predictor),
        ]
        body[link : link + 4] = struct.pack("<I", len(body))
        body += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(body)
        body += b"\0\0\0\0"
    return bytes(body)


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, data binary, error string"


def tiff_pages(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """A row per page of each file: id, page, width, height, samples, bits, compression, predictor, data (row by row), error."""

    kinds = [pa.int64(), *[pa.int32()] * 7, pa.binary(), pa.string()]
    names = [id_col, *(f.split(" ")[0] for f in PAGE_SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [(batch.column(0)[k].as_py(), *(p[n] for n in names[1:])) for p in pages(batch.column(1)[k].as_py())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return df.select(id_col, media_col).mapInArrow(run, f"{id_col} long, {PAGE_SCHEMA}")


UNIT = 576


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (UNIT - len(raw) if not raw else -len(raw) % UNIT)


def feature(found: list[dict]) -> str:
    """Pages, mean grey in hundredths, and which of 64 equal stretches are lighter than the whole."""
    data = np.concatenate([np.frombuffer(p["data"], np.uint8) for p in found])
    sums = data.reshape(64, -1).sum(axis=1, dtype=np.int64)
    lighter = sums * 64 > sums.sum()
    return f"{len(found)}:{int(sums.sum()) * 100 // len(data)}:{np.packbits(lighter).tobytes().hex()}"


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long"
    kinds = [{"long": pa.int64(), "string": pa.string()}[f.split(" ")[1]] for f in fields.split(", ")]
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def row(doc_id, text: str | None) -> tuple:
        n, payload = padded(text)
        media = grey_tiff(payload, UNIT)
        found = list(pages(media))
        if found[-1]["error"]:
            raise BadFile(found[-1]["error"])
        back = b"".join(p["data"] for p in found)
        return doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [row(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, fields)


QUERIES = {"op5_tiff": op5_tiff}
