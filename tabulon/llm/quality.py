"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A token is a run of letters, digits and characters outside ASCII, or a run of other
printable characters; case counts. Tokens are hashed to BUCKETS rows. Each row's index
vector is sparse, with NONZERO entries of +1 or -1, and its word vector is the sum of the
index vectors of the tokens beside it, over all whole texts of the corpus. Each task adds
up a table of its own (BUCKETS x DIMENSIONS whole numbers, a fixed size), and the tables are summed slice by
slice, first in salted groups; sums are exact, so the order of tasks changes nothing. Word vectors are then centred and scaled to unit
length.

A document is pooled as the mean and the standard deviation of its tokens' vectors, the
shares of token shapes (lower, title, upper, digits, other characters, long, repeated) and
its length. A network of one hidden layer, in numpy, gives a logit, which a temperature
divides so that probabilities on validation rows are calibrated.

The network is fitted on a sample of labelled rows of at most about `sample` rows (a share
by hash); word vectors and scores cover all rows and whole texts.

Defined results: null text counts as empty, and an empty text is scored by the network on
zero features; labels that repeat are averaged and null labels ignored; without labels
every score is 0.5; repeated rows are scored each; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.runtime import table
from tabulon.llm.shingles import BACK, BASE, mixed, portions

BUCKETS, DIMENSIONS, NONZERO = 1 << 14, 32, 4
SLICES, SALTS = 16, 32
BATCH = 512
SHAPES = 7
FEATURES = 2 * DIMENSIONS + SHAPES + 1

#: 0 white space and control, 1 word, 2 other
KIND = np.array([0 if b <= 32 or b == 127 else 1 if chr(b).isalnum() or b > 127 else 2 for b in range(256)], np.int8)
BYTES = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000
    hidden: int = 32
    steps: int = 400
    rate: float = 0.01
    decay: float = 1e-3
    seed: int = 5


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, shape number, text number) of each token."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kind = KIND[data]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([[0], change])
    stops = np.concatenate([change, [len(data)]])
    real = kind[starts] > 0
    starts, stops = starts[real], stops[real]
    powers = np.full(len(data) + 1, BASE)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers[:-1], out=sums[1:])
    powers[1:] = BACK
    np.cumprod(powers, out=powers)
    buckets = (mixed((sums[stops] - sums[starts]) * powers[starts]) >> np.uint64(64 - 14)).astype(np.int64)
    size = stops - starts
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    uppers, first = upper[stops] - upper[starts], (data[starts] >= 65) & (data[starts] <= 90)
    digit = (data[starts] >= 48) & (data[starts] <= 57)
    shape = np.where(kind[starts] == 2, 4, np.where(digit, 3, np.where((uppers > 1) & (uppers * 2 > size), 2, np.where(first, 1, 0))))
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, "right")
    return buckets, shape | (size > 16).astype(np.int64) << 3, owner


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), each BUCKETS x NONZERO"""
    draw = np.random.default_rng(31)
    return draw.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), draw.integers(0, 2, (BUCKETS, NONZERO)) * 2.0 - 1


def neighbours(texts: list[str], places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The sum, by token, of the index vectors of the tokens beside it, flat."""
    token, _, owner = tokens(texts)
    out = np.zeros(BUCKETS * DIMENSIONS)
    same = owner[1:] == owner[:-1]
    left, right = token[:-1][same], token[1:][same]
    for a, b in ((left, right), (right, left)):
        for k in range(NONZERO):
            out += np.bincount(a * DIMENSIONS + places[b, k], signs[b, k], len(out))
    return out


def word_vectors(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIMENSIONS, over all rows of df."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                for texts in portions([t or "" for t in batch.column(0).slice(at, BATCH).to_pylist()]):
                    total += neighbours(texts, places, signs)
        salt = TaskContext.get().partitionId() % SALTS
        parts = [x.astype(np.int64).tobytes() for x in np.split(total, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([salt] * SLICES, pa.int32()), pa.array(parts, pa.binary())], ["slice", "salt", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for k, salt, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, np.int64)
                sums[k, salt] = sums[k, salt] + own if (k, salt) in sums else own
        for (k, salt), own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["slice", "salt", "sums"])

    schema = "slice int, salt int, sums binary"
    salted = df.select(text_col).mapInArrow(count, schema).repartition("slice", "salt").mapInArrow(add, schema)
    sliced = salted.withColumn("salt", F.lit(0)).repartition("slice").mapInArrow(add, schema)
    sums = np.zeros((SLICES, BUCKETS * DIMENSIONS // SLICES), np.int64)
    for r in sliced.collect():  # a row per slice
        sums[r["slice"]] = np.frombuffer(r["sums"], np.int64)
    return scaled(sums.reshape(BUCKETS, DIMENSIONS).astype(float))


def scaled(sums: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.where(size > 0, sums / np.maximum(size, 1e-9), 0)
    seen = size[:, 0] > 0
    unit[seen] -= unit[seen].mean(axis=0) if seen.any() else 0
    return (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """len(texts) x FEATURES"""
    return np.concatenate([_pooled(own, vectors) for own in portions(texts)]) if texts else np.zeros((0, FEATURES))


def _pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    token, shape, owner = tokens(texts)
    out = np.zeros((len(texts), FEATURES))
    n = np.bincount(owner, minlength=len(texts))
    some = np.flatnonzero(n)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        for own in np.array_split(some, -(-len(token) // 100_000)):
            if not len(own):
                continue
            a, b = starts[own[0]], starts[own[-1]] + n[own[-1]]
            at = starts[own] - a
            each = vectors[token[a:b]]
            mean = np.add.reduceat(each, at, axis=0, dtype=np.float64) / n[own, None]
            square = np.add.reduceat(each * each, at, axis=0, dtype=np.float64) / n[own, None]
            out[own, :DIMENSIONS] = mean
            out[own, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
        share = lambda which: np.bincount(owner, which, len(texts)) / np.maximum(n, 1)
        for k in range(5):
            out[:, 2 * DIMENSIONS + k] = share((shape & 7) == k)
        out[:, 2 * DIMENSIONS + 5] = share(shape >> 3)
        again = np.zeros(len(token), bool)
        if len(token) > 2:  # the token before the last, or the last, once more
            again[1:] |= (token[1:] == token[:-1]) & (owner[1:] == owner[:-1])
            again[2:] |= (token[2:] == token[:-2]) & (owner[2:] == owner[:-2])
        out[:, 2 * DIMENSIONS + 6] = share(again)
    out[:, -1] = np.log1p(n)
    return out


class Network:
    def __init__(self, settings: Settings = Settings()):
        self.settings = settings
        self.mean, self.std = np.zeros(FEATURES), np.ones(FEATURES)
        self.weights: list[np.ndarray] | None = None
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on whole batches; every fifth row calibrates the temperature."""
        if len(y) < 10:
            return self
        s, draw = self.settings, np.random.default_rng(self.settings.seed)
        held = np.arange(len(y)) % 5 == 4
        self.mean, self.std = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6
        own, target = self._scaled(x[~held]), y[~held]
        w = [draw.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, s.hidden)), np.zeros(s.hidden), draw.normal(0, s.hidden**-0.5, s.hidden), np.zeros(1)]
        first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        for step in range(1, s.steps + 1):
            hidden = np.maximum(own @ w[0] + w[1], 0)
            error = (1 / (1 + np.exp(-(hidden @ w[2] + w[3]))) - target) / len(target)
            back = np.outer(error, w[2]) * (hidden > 0)
            slopes = [own.T @ back + s.decay * w[0] / FEATURES, back.sum(axis=0), hidden.T @ error + s.decay * w[2] / s.hidden, error.sum(keepdims=True)]
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= s.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        logit = self.logits(x[held])
        loss = lambda t: np.mean(np.logaddexp(0, logit / t) - y[held] * logit / t)
        self.temperature = float(min(np.geomspace(0.5, 20, 200), key=loss))
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        w = self.weights
        return np.maximum(self._scaled(x) @ w[0] + w[1], 0) @ w[2] + w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(documents: DataFrame, labels: DataFrame, vectors: np.ndarray, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", settings: Settings = Settings()) -> Network:
    """labels: id_col and label_col (0 or 1)."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    n = known.count()
    share = min(1.0, settings.sample / max(n, 1))
    drawn = known.filter(F.xxhash64("id", F.lit("sample")).cast("double") < (2 * share - 1) * float(1 << 63))
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = pooled([t or "" for t in part.column(2).to_pylist()], shared.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    # The sample is of a bounded size, so it may be sent to all tasks.
    rows = documents.select(F.col(id_col).alias("id"), text_col).join(F.broadcast(drawn), "id").select("id", "y", text_col).mapInArrow(run, "id long, y double, x binary").collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], float).reshape(-1, FEATURES)
    order = np.random.default_rng(settings.seed).permutation(len(rows))
    return Network(settings).fit(x[order], np.array([r["y"] for r in rows])[order])


def score(df: DataFrame, vectors: np.ndarray, network: Network, text_col: str = "text") -> DataFrame:
    """df with __qc_score; a column of that name is replaced."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    df = df.drop("__qc_score")
    shared = df.sparkSession.sparkContext.broadcast((vectors, network))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_vectors, own = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                made = own.scores(pooled([t or "" for t in part.column(at).to_pylist()], own_vectors))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.float64())], [*part.schema.names, "__qc_score"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("__qc_score", DoubleType())]))


HELD_OUT = (4, 2)
KEEP_FROM = 0.7


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT[0])) == HELD_OUT[1]
    vectors = word_vectors(documents)
    network = fit(documents, labels.filter(~held), vectors)
    found = score(documents.select("doc_id", "text"), vectors, network)
    return found.select("doc_id", held.alias("held_out"), F.col("__qc_score").alias("score"), (F.col("__qc_score") >= KEEP_FROM).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
