"""Packing: vector bin packing of examples into fixed-length training sequences.

An example is a run of tokens with a mask of loss-bearing ones. A sequence holds at most
`tokens` tokens, `segments` pieces and `loss` loss-bearing tokens at once. The bin-centric
dot-product heuristic keeps one sequence open and always adds the waiting example whose
demand vector has the largest dot product with what is left of the sequence, both in
units of capacity. Where no waiting example fits whole, the best one is cut to fill it.

Each task packs what its scan partition holds, through a window of bounded length, so
there is no shuffle, no global order and no task that grows with the data. Sequence ids
are the partition's number in the upper bits and a counter in the lower 32.

Defined results: null text counts as empty; an empty text is its end id alone; repeated
rows are packed again each; an empty table gives an empty one; other columns are ignored
unless named. A null id stays null, and ids keep their type. An example that is tokenised
already and has no id of a token gives no piece. Limits under 1 and masks that are not as
long as their ids are errors.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tabulon.llm.runtime import table
from tabulon.llm.tokens import LITTLE, ByteBpe, encoder


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048
    window: int = 512  # waiting examples
    min_cut: int = 8  # less room than this is left as padding
    waste: int = 32  # more padding than this is cut into sequences of powers of two

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss, self.window) < 1:
            raise ValueError("each limit must be 1 at least")


@dataclass
class Example:
    """Tokens start..stop of a document; loss: loss-bearing tokens before each of its tokens, and in all (None: each token)."""

    doc: object
    start: int
    stop: int
    loss: np.ndarray | None = None

    def __len__(self) -> int:
        return self.stop - self.start

    def losses(self, upto: int | None = None) -> int:
        stop = self.stop if upto is None else self.start + upto
        return stop - self.start if self.loss is None else int(self.loss[stop] - self.loss[self.start])

    def fit(self, tokens: int, losses: int) -> int:
        """The longest prefix within both limits."""
        n = min(tokens, len(self))
        if self.loss is None:
            return min(n, losses)
        return min(n, int(np.searchsorted(self.loss, self.loss[self.start] + losses, "right")) - 1 - self.start)

    def cut(self, n: int) -> Example:
        """Takes the first n tokens off."""
        head = Example(self.doc, self.start, self.start + n, self.loss)
        self.start += n
        return head


def powers(pieces: list[Example]) -> Iterator[list[Example]]:
    """The same tokens in sequences whose lengths are descending powers of two."""
    left = sum(map(len, pieces))
    pieces = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        own = []
        while room:
            take = min(room, len(pieces[-1]))
            own.append(pieces[-1].cut(take))
            room -= take
            if not len(pieces[-1]):
                pieces.pop()
        yield own


class Packer:
    """Feeds examples in, yields full sequences (lists of pieces)."""

    def __init__(self, limits: Limits = Limits()):
        self.limits = limits
        self.waiting: list[Example] = []
        self.demand = np.zeros((3, 2 * limits.window))
        self.open: list[Example] = []
        self.room = self._capacity()

    def _capacity(self) -> list[int]:
        return [self.limits.tokens, self.limits.segments, self.limits.loss]

    def add(self, example: Example) -> Iterator[list[Example]]:
        most = self.limits
        while len(example) >= most.tokens and (n := example.fit(most.tokens, most.loss)) == most.tokens:
            yield [example.cut(n)]  # a sequence of its own
        if len(example):
            self._wait(example)
        while len(self.waiting) >= most.window:
            yield from self._step()

    def finish(self) -> Iterator[list[Example]]:
        while self.waiting:
            yield from self._step()
        yield from self._close()

    def _wait(self, example: Example) -> None:
        k = len(self.waiting)
        if k == self.demand.shape[1]:
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)], axis=1)
        self.waiting.append(example)
        self._measure(k)

    def _measure(self, k: int) -> None:
        e = self.waiting[k]
        self.demand[:, k] = len(e), 1, e.losses()

    def _step(self) -> Iterator[list[Example]]:
        n = len(self.waiting)
        demand = self.demand[:, :n]
        room = np.array(self.room, float)
        capacity = np.array(self._capacity(), float)
        score = (room / capacity**2) @ demand
        fits = (demand <= room[:, None]).all(axis=0)
        if fits.any():
            k = int(np.where(fits, score, -1).argmax())
            self._place(self._take(k))
        elif self.room[1] and self.room[0] >= (self.limits.min_cut if self.open else 1) and (own := self._cut(score)):
            self._place(own)
        else:
            yield from self._close()
            return
        if not self.room[0] or not self.room[1]:
            yield from self._close()

    def _cut(self, score: np.ndarray) -> Example | None:
        k = int(score.argmax())
        n = self.waiting[k].fit(self.room[0], self.room[2])
        if n < 1:  # of an open sequence only: a fresh one holds a token of any kind
            return None
        own = self.waiting[k].cut(n)
        self._measure(k)
        return own

    def _take(self, k: int) -> Example:
        own, last = self.waiting[k], self.waiting.pop()
        if k < len(self.waiting):
            self.waiting[k] = last
            self.demand[:, k] = self.demand[:, len(self.waiting)]
        return own

    def _place(self, own: Example) -> None:
        self.open.append(own)
        for k, used in enumerate((len(own), 1, own.losses())):
            self.room[k] -= used

    def _close(self) -> Iterator[list[Example]]:
        own, pad = self.open, self.room[0]
        self.open, self.room = [], self._capacity()
        if own:
            yield from powers(own) if pad > self.limits.waste else [own]


#: A document as the packer takes it: its ids, and its mask of loss-bearing tokens (None: all).
Ids = tuple[np.ndarray, np.ndarray | None]


def packed(documents: Iterable[tuple[object, Ids]], limits: Limits) -> Iterator[tuple[int, int, Example, np.ndarray, bool]]:
    """(sequence, offset, piece, its ids, is it the document's last use) for every piece."""
    packer, ids, left = Packer(limits), {}, {}
    number = 0

    def out(sequence: list[Example]) -> Iterator[tuple]:
        nonlocal number
        at = 0
        for piece in sequence:
            whole = ids[piece.doc]
            left[piece.doc] -= len(piece)
            yield number, at, piece, whole, not left[piece.doc]
            at += len(piece)
            if not left[piece.doc]:
                del ids[piece.doc], left[piece.doc]
        number += 1

    for key, (own, mask) in documents:
        ids[key], left[key] = own, len(own)
        loss = None if mask is None else np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        for sequence in packer.add(Example(key, 0, len(own), loss)):
            yield from out(sequence)
    for sequence in packer.finish():
        yield from out(sequence)


FIELDS = "start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, encode: Callable[[dict], Iterator[Ids]], inputs: list[str], id_col: str = "doc_id", limits: Limits = Limits(), with_ids: bool = True) -> DataFrame:
    """One row per piece. encode: gets an Arrow batch's columns as lists, gives each row's ids."""
    given = df.select(F.col(id_col).alias("doc_id"), *inputs)
    return given.mapInArrow(_packing(lambda rows: zip(rows["doc_id"], encode(rows), strict=True), df.schema[id_col].dataType, limits, with_ids), f"doc_id {df.schema[id_col].dataType.simpleString()}, {FIELDS}")


def _packing(examples: Callable[[dict], Iterator[tuple[object, Ids]]], id_type, limits: Limits, with_ids: bool, rest: Callable[[], Iterator[tuple[object, Ids]]] = lambda: iter(())):
    """A task's work. examples: gets rows as lists, gives (id, ids and mask); rest: those left at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        names: dict[int, object] = {}

        def documents():
            parts = (batch.slice(at, 256).to_pydict() for batch in batches for at in range(0, batch.num_rows, 256))
            found = chain(chain.from_iterable(map(examples, parts)), chain.from_iterable(f() for f in (rest,)))
            for n, (name, own) in enumerate(x for x in found if len(x[1][0])):
                names[n] = (name, len(own[0]))
                yield n, own

        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        kinds = [to_arrow_type(id_type), pa.int64(), pa.int64(), pa.list_(pa.int32()), *[pa.int64()] * 5]
        fields = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)
            rows.clear()
            return made

        for sequence, at, piece, whole, last in packed(documents(), limits):
            own = whole[piece.start : piece.stop]
            name, n = names[piece.doc]
            rows.append((name, piece.start, len(piece), own.astype(np.int32) if with_ids else None, zlib.crc32(own.astype(LITTLE).tobytes()), n, piece.losses(), base + sequence, at))
            if last:
                del names[piece.doc]
            if len(rows) >= 4096:
                yield batch()
        if rows:
            yield batch()

    return run


def text_ids(path: str, pattern: str, end_id: int, text_col: str) -> Callable[[dict], Iterator[Ids]]:
    """Plain text: every token bears loss, and the end id follows."""

    def encode(rows: dict) -> Iterator[Ids]:
        own = encoder(ByteBpe, path, pattern)
        end = np.array([end_id], LITTLE)
        for text in rows[text_col]:
            yield np.concatenate([own.encode(text or ""), end]), None

    return encode


def masked_ids(ids_col: str, mask_col: str) -> Callable[[dict], Iterator[Ids]]:
    """Examples that are tokenised already, with a mask of loss-bearing tokens (a null mask: all)."""

    def encode(rows: dict) -> Iterator[Ids]:
        for ids, mask in zip(rows[ids_col], rows[mask_col], strict=True):
            if mask is not None and len(mask) != len(ids or []):
                raise ValueError("a mask must be as long as its ids")
            yield np.array(ids or [], LITTLE), None if mask is None else np.array(mask, bool)

    return encode


def pack_texts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, end_id: int = 1, limits: Limits = Limits(), with_ids: bool = True) -> DataFrame:
    """Packs whole texts; tokenizer: path of a byte-level BPE file."""
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    return pack(df, text_ids(path, public_tokenizers.PATTERN, end_id, text_col), [text_col], id_col, limits, with_ids)


def pack_conversations(df: DataFrame, tokenizer: str | None = None, end_id: int = 1, limits: Limits = Limits(), answer_role: str = "assistant", stretch: int = 1 << 16) -> DataFrame:
    """Instruction data (conv_id, turn, role, text): each conversation's turns in order, an end id after each turn; only the answers bear loss.

    Turns are range-partitioned by conversation and turn and read as a stream, so no
    conversation is gathered: an example is a conversation's turns of one partition, cut
    after the turn that reaches `stretch` tokens, and `start` counts within it. `turn`
    is the example's first turn. A turn without a conv_id is an example of its own; null
    roles bear no loss; null texts are empty."""
    import public_tokenizers

    path, pattern = tokenizer or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = df.select("conv_id", "turn", "role", "text").repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    numbered = StructType([StructField("conv_id", df.schema["conv_id"].dataType), StructField("turn", df.schema["turn"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ByteBpe, path, pattern)
        held: list[tuple[np.ndarray, bool]] = []
        key: tuple = ()
        size = 0

        def example() -> tuple[dict, Ids]:
            ids = np.concatenate([x for x, _ in held])
            mask = np.concatenate([np.full(len(x), m) for x, m in held])
            held.clear()
            return {"conv_id": key[0], "turn": key[1]}, (ids, mask)

        def examples(rows: dict) -> Iterator[tuple[dict, Ids]]:
            nonlocal key, size
            for conv, turn, role, text in zip(*(rows[c] for c in ("conv_id", "turn", "role", "text")), strict=True):
                if held and (conv is None or conv != key[0] or size >= stretch):
                    yield example()
                if not held:
                    key, size = (conv, turn), 0
                held.append((np.concatenate([own.encode(text or ""), [end_id]]).astype(LITTLE), role == answer_role))
                size += len(held[-1][0])

        def rest() -> Iterator[tuple[dict, Ids]]:
            if held:
                yield example()

        yield from _packing(examples, numbered, limits, True, rest)(batches)

    found = turns.mapInArrow(run, f"example {numbered.simpleString()}, {FIELDS}")
    return found.select("example.conv_id", "example.turn", *(f.split(" ")[0] for f in FIELDS.split(", ")))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


QUERIES = {"op1_packing": op1_packing}
