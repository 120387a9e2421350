import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import tiff


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.sampled_from([b"a", b"b", b"xyz"]), max_size=2000).map(b"".join))
def test_codecs_come_back(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_long_lzw():
    data = os.urandom(30_000) + b"ab" * 20_000
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_pages_come_back(compression, predictor):
    data = os.urandom(576 * 130)
    found = list(tiff.pages(tiff.grey_tiff(data, 576, compression=compression, predictor=predictor)))
    assert [p["height"] for p in found] == [64, 64, 2] and b"".join(p["data"] for p in found) == data


def tiled(order: str, samples: np.ndarray, size: int, planar: int = 1, predictor: int = 1, compression: int = tiff.NONE) -> bytes:
    """A file of one page in square tiles."""
    height, width, n = samples.shape
    tiles = []
    for plane in range(n if planar == 2 else 1):
        part = samples[:, :, plane : plane + 1] if planar == 2 else samples
        for top in range(0, height, size):
            for left in range(0, width, size):
                tile = np.zeros((size, size, part.shape[2]), samples.dtype)
                own = part[top : top + size, left : left + size]
                tile[: own.shape[0], : own.shape[1]] = own
                tiles.append(tiff.encoded((tiff.predicted(tile) if predictor == 2 else tile).tobytes(), compression))
    body, places = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), []
    for t in tiles:
        places.append(len(body))
        body += t
    lists = len(body)
    body += struct.pack(f"{order}{2 * len(tiles)}I", *places, *map(len, tiles))
    bits = len(body)
    body += struct.pack(f"{order}{n}H", *[samples.dtype.itemsize * 8] * n)
    one = len(tiles) == 1
    short = lambda v: struct.pack(order + "HH", v, 0)
    long = lambda v: struct.pack(order + "I", v)
    tags = [(256, 4, 1, long(width)), (257, 4, 1, long(height)), (258, 3, n, long(bits) if n > 2 else struct.pack(f"{order}2H", *[samples.dtype.itemsize * 8] * n, *[0] * (2 - n))), (259, 3, 1, short(compression)), (277, 3, 1, short(n)), (284, 3, 1, short(planar)), (317, 3, 1, short(predictor)), (322, 4, 1, long(size)), (323, 4, 1, long(size)), (324, 4, len(tiles), long(places[0] if one else lists)), (325, 4, len(tiles), long(len(tiles[0]) if one else lists + 4 * len(tiles)))]
    body[4:8] = struct.pack(order + "I", len(body))
    return bytes(body + struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHI", *t[:3]) + t[3] for t in tags) + bytes(4))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("planar", "predictor", "compression", "bits"), [(1, 1, tiff.NONE, 8), (2, 1, tiff.PACKBITS, 8), (1, 2, tiff.LZW, 8), (1, 2, tiff.DEFLATE, 16), (2, 2, tiff.DEFLATE, 16)])
def test_tiles_in_both_orders(order, planar, predictor, compression, bits):
    samples = np.random.default_rng(1).integers(0, 1 << bits, (37, 50, 3)).astype(f"{order}u{bits // 8}" if bits > 8 else np.uint8)
    (page,) = tiff.pages(tiled(order, samples, 16, planar, predictor, compression))
    assert page["error"] is None and (page["width"], page["height"], page["samples"]) == (50, 37, 3)
    assert page["data"] == samples.tobytes()


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_broken_files_give_an_error_row(data):
    raw = bytearray(tiff.grey_tiff(os.urandom(576 * 70), 576))
    for _ in range(data.draw(st.integers(1, 5))):
        raw[data.draw(st.integers(0, len(raw) - 1))] = data.draw(st.integers(0, 255))
    list(tiff.pages(bytes(raw[: data.draw(st.integers(0, len(raw)))])))


def test_chain_that_turns_back():
    raw = bytearray(tiff.grey_tiff(b"x" * 576, 576))
    start = struct.unpack_from("<I", raw, 4)[0]
    raw[-4:] = struct.pack("<I", start)
    found = list(tiff.pages(bytes(raw)))
    assert found[0]["error"] is None and "turns back" in found[1]["error"] and found[1]["page"] == 1


def test_tables(spark):
    good = tiff.grey_tiff(b"z" * 576 * 65, 576)
    df = spark.createDataFrame([(1, good, "p"), (1, good, "p"), (2, None, "q"), (3, b"", "q"), (4, b"nonsense", "q")], "doc_id long, media binary, page string")
    rows = tiff.tiff_pages(df).collect()
    assert sorted((r.doc_id, r.page, r.error is None) for r in rows) == [(1, 0, True), (1, 0, True), (1, 1, True), (1, 1, True), (4, 0, False)]
    assert tiff.tiff_pages(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    import hashlib
    import zlib

    texts = ["", None, "a" * 576, "é" * 300, "long " * 40_000, "a" * 576]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in tiff.op5_tiff(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert rows[2][1:] == rows[5][1:] and rows[0].feature == rows[1].feature
