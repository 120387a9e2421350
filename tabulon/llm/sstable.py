"""Token-ID output: sorted-string-table shards of token ids, keyed by document.

Layout of a shard (integers little-endian; varints are LEB128):

    blocks   each: zlib of entries; entry: varint bytes of the key shared with the one
             before, varint of the rest, the rest, varint value bytes, the value.
             Every block starts with a whole key, so it can be read alone.
    index    zlib of, per block: varint key length, last key of the block, u64 offset, u32 size
    bloom    bit array over the keys, 10 bits a key, 7 probes
    footer   u64 index offset, u32 index size, u64 bloom offset, u32 bloom size,
             u64 entries, u64 tokens, 8 bytes magic

A key is the document's identifier as 8 big-endian bytes with the sign bit flipped, then
a 4-byte repeat number, so byte order is identifier order and repeated rows stay apart.
A null identifier has the empty prefix and comes first. A value is ids of 16 bits, or of
32 after a marker byte.

Rows are range-partitioned by identifier and by the text's hash within one, so neither a
large table nor rows of one identifier make a large shard: there are as many ranges as give
SHARD_BYTES of text each, and a shard holds one. Shards in order are the whole table. Each task writes under a name of its own and renames, so a task that
runs again leaves one good shard. Only a row per shard goes through a single task (the
prefix sums of token counts).

Defined results: null text counts as empty and an empty text is the end id alone;
repeated identifiers keep all rows, in order of their texts' hashes; an empty table writes
no shard; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.runtime import fresh_path, table
from tabulon.llm.tokens import LITTLE, WordBpe, encoder

#: Of text, about, in a shard: its keys and index are held in memory.
SHARD_BYTES = 256 << 20
MAGIC = b"TABSST01"
FOOTER = struct.Struct("<QIQIQQ8s")
BITS, PROBES, BLOCK = 10, 7, 256 * 1024


def store(path: str):
    """(file system, path in it). Local paths need no further library."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_of(name: int | None, repeat: int = 0) -> bytes:
    return (b"" if name is None else struct.pack(">Q", (name + (1 << 63)) & ((1 << 64) - 1))) + struct.pack(">I", repeat)


def name_of(key: bytes) -> tuple[int | None, int]:
    return (None if len(key) == 4 else struct.unpack(">Q", key[:8])[0] - (1 << 63)), struct.unpack(">I", key[-4:])[0]


def value_of(ids: np.ndarray) -> bytes:
    return b"\0" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\1" + ids.astype(LITTLE).tobytes()


def ids_of(value: bytes) -> np.ndarray:
    return np.frombuffer(value, LITTLE if value[0] else np.dtype("<u2"), offset=1).astype(LITTLE)


def probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + k * b) % bits for k in range(PROBES)]


class Writer:
    """Writes entries in key order to an open binary file."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.block, self.last, self.first = bytearray(), b"", True
        self.index = bytearray()
        self.keys: list[bytes] = []
        self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        same = 0 if self.first else len(os.path.commonprefix([key, self.last]))
        if not self.first and key <= self.last:
            raise ValueError("keys must ascend")
        put_varint(self.block, same)
        put_varint(self.block, len(key) - same)
        self.block += key[same:]
        value = value_of(ids)
        put_varint(self.block, len(value))
        self.block += value
        self.last, self.first = key, False
        self.keys.append(key)
        self.tokens += len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _emit(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.block:
            at, n = self._emit(zlib.compress(bytes(self.block), 1))
            put_varint(self.index, len(self.last))
            self.index += self.last + struct.pack("<QI", at, n)
            self.block, self.first = bytearray(), True

    def finish(self) -> None:
        self._flush()
        index = self._emit(zlib.compress(bytes(self.index), 1))
        bits = max(64, BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in probes(key[:-4], bits):
                bloom[p >> 3] |= 1 << (p & 7)
        at, n = self._emit(struct.pack("<Q", bits) + bytes(bloom))
        self._emit(FOOTER.pack(*index, at, n, len(self.keys), self.tokens, MAGIC))


class Reader:
    """Reads a shard: whole, or one document by Bloom filter and binary search."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2) or file.tell()
        *spans, self.entries, self.tokens, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index = zlib.decompress(self._read(*spans[:2]))
        bloom = self._read(*spans[2:])
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self.lasts, self.spans, at = [], [], 0
        while at < len(index):
            n, at = get_varint(index, at)
            self.lasts.append(index[at : at + n])
            self.spans.append(struct.unpack_from("<QI", index, at + n))
            at += n + 12

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = zlib.decompress(self._read(*self.spans[k])), 0, b""
        while at < len(data):
            same, at = get_varint(data, at)
            n, at = get_varint(data, at)
            key = key[:same] + data[at : at + n]
            at += n
            n, at = get_varint(data, at)
            yield key, ids_of(data[at : at + n])
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.spans)):
            yield from self._block(k)

    def get(self, name: int | None) -> list[np.ndarray]:
        """All entries of an identifier; none if there is none."""
        prefix = key_of(name)[:-4]
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(prefix, self.bits)):
            return []
        found = []
        for k in range(bisect.bisect_left(self.lasts, key_of(name)), len(self.spans)):
            for key, ids in self._block(k):
                if key[:-4] == prefix:
                    found.append(ids)
                elif name_of(key)[0] is not None and (name is None or key[:-4] > prefix):
                    return found
        return found


def write_shard(folder: str, part: int, rows: Iterable[tuple[int | None, np.ndarray]]) -> dict | None:
    """rows: in order of identifier. Writes under another name, then renames."""
    fs, base = store(folder)
    fs.create_dir(base, recursive=True)
    name = f"shard-{part:06d}.sst"
    temp = f"{base}/.{name}.{uuid.uuid4().hex}"
    writer = last = None
    repeat = 0
    with fs.open_output_stream(temp, compression=None) as out:
        for doc, ids in rows:
            writer = writer or Writer(out)
            repeat = repeat + 1 if writer.keys and doc == last else 0
            last = doc
            writer.add(key_of(doc, repeat), ids)
        if writer:
            writer.finish()
    if not writer:
        fs.delete_file(temp)
        return None
    fs.move(temp, f"{base}/{name}")
    return {"shard": part, "path": f"{folder}/{name}", "n_docs": len(writer.keys), "n_tokens": writer.tokens}


def write_tables(df: DataFrame, folder: str, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Writes df's texts to shards in folder; a row per shard: shard, path, n_docs, n_tokens, lazily."""
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    given = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not shards:
        size = given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    order = [F.col("id").asc_nulls_first(), F.col("hash")]
    ranged = given.withColumn("hash", F.xxhash64("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, end = encoder(WordBpe, path), np.array([end_id], LITTLE)

        def encoded():
            for batch in batches:
                names, texts = batch.column(0), batch.column(1)
                for k in range(batch.num_rows):
                    yield names[k].as_py(), np.concatenate([own.encode(texts[k].as_py()), end])

        made = write_shard(folder, TaskContext.get().partitionId(), encoded())
        if made:
            yield pa.RecordBatch.from_pylist([made])

    return ranged.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long")


def read_tables(shards: DataFrame, batch_rows: int = 512) -> DataFrame:
    """A row per document of the shards: shard, ordinal in it, doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = store(row["path"])
                rows: list[tuple] = []
                with fs.open_input_file(path) as file:
                    for k, (key, ids) in enumerate(Reader(file)):
                        rows.append((row["shard"], k, name_of(key)[0], ids.astype(np.int32)))
                        if len(rows) == batch_rows:
                            yield as_batch(rows)
                            rows = []
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["shard", "ordinal", "doc_id", "ids"])

    return shards.mapInArrow(run, "shard long, ordinal long, doc_id long, ids array<int>")


def digests(shards: DataFrame) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32. shards: with `before`, the tokens of all shards before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = store(row["path"])
                at, rows = row["before"], []
                with fs.open_input_file(path) as file:
                    for key, ids in Reader(file):
                        rows.append((name_of(key)[0], at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, names: list[int | None]) -> DataFrame:
    """The given documents, by binary search in every shard: doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = store(row["path"])
                with fs.open_input_file(path) as file:
                    reader = Reader(file)
                    if rows := [(n, ids.astype(np.int32)) for n in names for ids in reader.get(n)]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.int32())), strict=True)], ["doc_id", "ids"])

    return shards.mapInArrow(run, "doc_id long, ids array<int>")


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "sst")
    written = write_tables(table(spark, sf_dir, "documents"), folder)
    # A row per shard: the files are written once, and the list of them is read from here on.
    shards = spark.createDataFrame(written.collect(), written.schema)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = shards.withColumn("before", before)
    return digests(listed.repartition(max(1, min(shards.count(), 4096))))


QUERIES = {"op9_sstable": op9_sstable}
