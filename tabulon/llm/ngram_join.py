"""N-gram Jaccard join by MinHash banding.

Documents are joined whose sets of word n-grams (five words) have a Jaccard similarity of
at least 0.8.

1. Each text gives its set's 128-bit digest, a MinHash signature, and the hashes of its
   bands. `bands_and_rows` chooses the counts: of those that give a pair at the threshold
   the target recall with at most HASHES values, the ones by which unlike pairs share the
   fewest bands.
2. Equal sets are one class of copies from here on, with one row that stands for them.
3. The classes' band hashes are shuffled. Only classes that share a band get their
   signatures (a byte a value). Within a band, the signatures of all pairs are compared,
   and pairs that are plausible (their estimate is within SLACK standard deviations of the
   threshold) are connected; what leaves a task is a spanning forest of these links, never
   the pairs. So texts that merely share some band don't chain together. A row that is
   connected to the band's first row is compared with the others' rows only by them, so a
   band of alike texts costs one comparison a row.
4. Within a component of plausible links, all pairs are verified on full n-gram sets, taken
   anew from the texts.
5. Components of the verified links are the classes of near-duplicates.

In steps 3 and 4 a large band or component is dealt to blocks, by number and by bytes, and
each pair of blocks is a task's unit of its own: memory is bounded by two blocks, no task
gets a whole group, and no pair is left out or emitted. What leaves a unit of step 4 are
sums of links per class and a spanning forest.

Recall: a pair at similarity s shares a band with probability 1 - (1 - s^rows)^bands at
least, 0.99999 at the threshold by default, and then is plausible with the probability that
its estimate is at most SLACK = 4 deviations low, 0.99997; both are more above it, and a
pair that shares a component through others is verified all the same.

A clash of digests (odds of n^2 / 2^129) makes one class of two sets.

Defined results: null text counts as empty; texts without a word have no n-gram and no
link, not even to each other; a text of fewer words than n is one n-gram; repeated rows
are copies of each other; a class id is the least identifier in it (null only if all are);
an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.components import components
from tabulon.llm.runtime import table, written
from tabulon.llm.shingles import ngram_sets

N = 5
#: Similarity from which a pair is a link, as a fraction.
THRESHOLD = (4, 5)
RECALL = 0.99999
#: MinHash values of a text at most.
HASHES = 256
SLACK = 4.0
#: Classes (and bytes of their sets) in a block of step 4, signatures in a block of step 3.
BLOCK, BLOCK_BYTES, SIGNATURES = 128, 32 << 20, 4096
BATCH = 256
DIGEST = 16


def bands_for(similarity: float, recall: float, rows: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def shares_band(similarity: float, bands: int, rows: int) -> float:
    return 1 - (1 - similarity**rows) ** bands


def bands_and_rows(similarity: float, recall: float, most: int = HASHES) -> tuple[int, int]:
    """(bands, rows): pairs at five eighths of the similarity share a band as seldom as `most` values allow."""
    options = [(bands_for(similarity, recall, r), r) for r in range(1, 33)]
    return min((o for o in options if o[0] * o[1] <= most), key=lambda o: shares_band(similarity * 5 / 8, *o), default=options[0])


def least_matches(similarity: float, values: int, slack: float = SLACK) -> int:
    """Of `values` signature bytes, how many agree at least where a pair is plausible; unequal values agree once in 256."""
    low = max(0.0, similarity - slack * math.sqrt(similarity * (1 - similarity) / values))
    return math.floor(values * (low + (1 - low) / 256))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.times = (draw.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.plus = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]

    def signature(self, grams: np.ndarray) -> np.ndarray:
        own = (grams >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(own), 2048):
            np.minimum(out, (own[None, k : k + 2048] * self.times + self.plus).min(axis=1), out=out)
        return out

    def band_hashes(self, signature: np.ndarray) -> np.ndarray:
        values = signature.reshape(self.bands, self.rows).astype(np.uint64)
        out = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(self.rows):
            out = (out ^ values[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return out.view(np.int64)


def class_digest(grams: np.ndarray, size: int = DIGEST) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=size).digest()


def _signed(df: DataFrame, text_col: str, id_col: str, n: int, counts: tuple[int, int], digest: int) -> DataFrame:
    """id, node (null: no n-gram), size, bands, signature."""
    kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MinHash(*counts)

        def row(grams: np.ndarray) -> tuple:
            if not len(grams):
                return None, 0, None, None
            values = own.signature(grams)
            return class_digest(grams, digest), len(grams), own.band_hashes(values), values.astype(np.uint8).tobytes()

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows = [row(g) for g in ngram_sets([t or "" for t in part.column(1).to_pylist()], n)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["id", "node", "size", "bands", "signature"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, node binary, size long, bands array<long>, signature binary")


def _gram_rows(df: DataFrame, n: int, digest: int) -> DataFrame:
    """df: id, text and wanted nodes' columns. Rows whose text is of the wanted node, with its set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = ngram_sets([t or "" for t in part.column("text").to_pylist()], n)
                mine = [k for k, (g, node) in enumerate(zip(sets, part.column("node").to_pylist(), strict=True)) if len(g) and class_digest(g, digest) == node]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(mine, pa.int64())) for c in ("node", "copies", "label", "blocks")), pa.array([sets[k].tobytes() for k in mine], pa.binary())], ["node", "copies", "label", "blocks", "grams"])

    return df.select("text", "node", "copies", "label", "blocks").mapInArrow(run, "node binary, copies long, label binary, blocks int, grams binary")


def _by_unit(df: DataFrame, keys: int, compare: Callable[[list[tuple]], list[tuple]], out: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """df: a unit's rows together, told apart by the first columns. compare: gets a unit's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, made = None, [], []

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*made, strict=True), out, strict=True)], [name for name, _ in out])
            made.clear()
            return done

        for given in batches:
            for at in range(0, given.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in given.slice(at, 64).columns), strict=True):
                    if row[:keys] != unit:
                        if held:
                            made += compare(held)
                        unit, held = row[:keys], []
                        if len(made) > 4096:
                            yield batch()
                    held.append(row)
        if held:
            made += compare(held)
        if made:
            yield batch()

    return df.mapInArrow(run, schema)


def plausible_forest(signatures: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links (a, b) that connect the rows which pairs of at least `least` equal values connect.

    A row that is connected to the first one when its turn comes needs no comparison of its
    own: a row that stays unconnected to it is compared with all."""
    group = np.arange(len(signatures))
    out = []
    for k, own in enumerate(signatures):
        if k and group[k] == group[0]:
            continue
        alike = np.flatnonzero((signatures == own).sum(axis=1) >= least)
        for label in np.unique(group[alike]):
            if label != group[k]:
                out.append((k, int(alike[group[alike] == label][0])))
        merged = np.isin(group, group[alike])
        group[merged] = group[merged].min()
    return out


def _plausible(banded: DataFrame, classes: DataFrame, least: int, block: int) -> DataFrame:
    """banded: node, band. Links a, b: a forest per unit of a band."""

    def compare(rows: list[tuple]) -> list[tuple]:
        nodes = [r[3] for r in rows]
        signatures = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        return [(nodes[a], nodes[b]) for a, b in plausible_forest(signatures, least)]

    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("band").alias("label"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = banded.withColumnRenamed("band", "label").join(buckets, "label").join(classes.select("node", "signature"), "node")
    units = _blocks(members, "signature").select("label", "i", "j", "node", "signature").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    return _by_unit(units, 3, compare, [("a", pa.binary()), ("b", pa.binary())], "a binary, b binary")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each of left shares with each of right."""
    sets = left + right
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    number = np.concatenate([[0], np.cumsum(grams[1:] != grams[:-1])]) if len(grams) else np.zeros(0, int)
    is_left = owner < len(left)
    both = np.zeros(number[-1] + 1 if len(number) else 0, np.uint8)
    both[number[is_left]] |= 1
    both[number[~is_left]] |= 2
    keep = both[number] == 3
    number, owner, is_left = number[keep], owner[keep], is_left[keep]
    number = np.concatenate([[0], np.cumsum(number[1:] != number[:-1])]) if len(number) else number
    out = np.zeros((len(left), len(right)), np.float32)
    total = number[-1] + 1 if len(number) else 0
    for low in range(0, total, 4096):
        a, b = np.searchsorted(number, [low, low + 4096])
        here, who, side = number[a:b] - low, owner[a:b], is_left[a:b]
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        x[who[side], here[side]] = 1
        y[who[~side] - len(left), here[~side]] = 1
        out += x @ y.T
    return out


def links(left: list[np.ndarray], right: list[np.ndarray], threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Which pairs reach the threshold: shared / (all) >= p / q, in whole numbers."""
    p, q = threshold
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return (p + q) * shared_counts(left, right).astype(np.int64) >= p * sizes


def forest(pairs: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Pairs (a, b) that connect what all pairs connect."""
    parent = list(range(size))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


VERIFIED = "node binary, links long, class_links long, other binary"


def _verify(units: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """units: label, i, j, block, node, copies, grams, a unit's rows together. Rows of sums (other is null) and of forest links (other is a node)."""

    def compare(rows: list[tuple]) -> list[tuple]:
        i, j = rows[0][1], rows[0][2]
        rows = list({r[4]: r for r in rows}.values())  # repeated rows of a text
        left = [r for r in rows if r[3] == i]
        right = left if i == j else [r for r in rows if r[3] == j]
        if not left or not right:
            return []
        sets = lambda side: [np.frombuffer(r[6], np.uint64) for r in side]
        own = sets(left)
        found = links(own, own if i == j else sets(right), threshold)
        if i == j:
            np.fill_diagonal(found, False)
        out = []
        for side, hit, others in ((left, found, right), *([] if i == j else [(right, found.T, left)])):
            copies = np.array([r[5] for r in others], np.int64)
            for r, n, k in zip(side, hit @ copies, hit.sum(axis=1), strict=True):
                if k:
                    out.append((r[4], int(n), int(k), None))
        pairs = np.argwhere(np.triu(found) if i == j else found)
        nodes = [r[4] for r in left] + ([] if i == j else [r[4] for r in right])
        if i != j:
            pairs = pairs + np.array([0, len(left)])
        return out + [(nodes[a], 0, 0, nodes[b]) for a, b in forest(pairs, len(nodes))]

    return _by_unit(units, 3, compare, [("node", pa.binary()), ("links", pa.int64()), ("class_links", pa.int64()), ("other", pa.binary())], VERIFIED)


def _blocks(rows: DataFrame, *more: str) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("label", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", *more)


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, block: int = BLOCK, signatures: int = SIGNATURES, digest: int = DIGEST) -> DataFrame:
    """A row per row of df: id, class_id (least id of all it is linked to, through others too), rep_id (least id with an equal set), copies, links, class_links.

    links counts the other documents it is linked to, class_links the other sets."""
    counts = bands_and_rows(threshold[0] / threshold[1], recall)
    rows = written(_signed(df, text_col, id_col, n, counts, digest), "signed")
    classes = written(rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "classes")
    least = least_matches(threshold[0] / threshold[1], counts[0] * counts[1])
    near = components(_plausible(classes.select("node", F.explode("bands").alias("band")), classes, least, signatures))

    of = classes.select("node", "rep_id", "copies", "size")
    placed = near.join(of, "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") * 8 / BLOCK_BYTES)).cast("int")
    sizes = placed.groupBy("label").agg(blocks.alias("blocks"))
    wanted = written(placed.join(sizes, "label").select("rep_id", "node", "copies", "label", "blocks"), "wanted")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Merged at every size: which texts are wanted grows with them.
    units = _blocks(_gram_rows(texts.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("rep_id"))), n, digest), "copies", "grams")
    verified = written(_verify(units.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j"), threshold), "verified")

    sums = verified.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    groups = components(verified.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    least = groups.join(of.select("node", "rep_id"), "node").groupBy("label").agg(F.min("rep_id").alias("class_id"))
    of_class = of.drop("size").join(sums, "node", "left").join(groups.join(least, "label").drop("label"), "node", "left")
    # Written, so the join is between two plain exchanges and a class of very many copies is split.
    found = rows.select("id", "node").join(written(of_class, "of-class"), "node", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return found.select(
        "id",
        F.coalesce("class_id", "rep_id", "id").alias("class_id"),
        F.coalesce("rep_id", "id").alias("rep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
        (zero("links") + F.coalesce("copies", F.lit(1)) - 1).alias("links"),
        zero("class_links").alias("class_links"),
    )


def drop_near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of df that stay: of each class the row of the least identifier (of repeated ones, one). All columns are kept."""
    found = written(near_duplicates(df, text_col, id_col).select("id", "class_id"), "classes-of")
    lost = found.filter(~F.col("id").eqNullSafe(F.col("class_id"))).select(F.col("id").alias("__nj_id")).distinct()
    again = found.filter(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("__nj_id"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__nj_id"))
    # Merged at every size: what is lost grows with the rows.
    out = df.join(lost.hint("merge"), same, "left_anti")
    if not again.isEmpty():
        out = out.join(again, same, "left_anti").unionByName(df.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
    return out


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_ngram_join": op10_ngram_join}
