"""Language ID: interpolated Kneser-Ney character models, one per language.

A model reads a word (letters, and marks that combine with them) in lower case between two
word ends and gives each character a probability from the `order` - 1 before it. Counts
above order one are continuation counts, discounted by Kneser-Ney's absolute discounts,
interpolated down to the uniform distribution over the characters known to any language.
N-grams are kept as 64-bit hashes in one sorted array per order, looked up by binary
search; beside each are the languages that have it, with their finished log-probabilities,
and likewise contexts with back-off weights. What a language lacks takes no room.

A text's language is the one of the lowest cross-entropy per character (a word end counts
as one). `score` is the posterior of that language when each language's total
log-probability is tempered to `characters` ** 0.5 characters, so long texts don't all
score 1. A text is rejected when its lowest cross-entropy lies above the language's limit,
plus `short` / sqrt(characters), as short texts scatter more. Limits are calibrated on
training documents that no model was counted on: half way from the language's own, by
robust quantiles (the `keep` quantile, at most `spread` deviations over the median, so a
few mislabelled documents don't set it), to the lowest cross-entropies of the other
languages' documents (their `beyond` quantile), or `slack` nats above the own where there
is no other language. Texts without a letter are `und` and rejected.

Models are fitted on a sample of labelled documents: for each language every document
whose hash falls under a share that gives `sample` documents on average. All words of
these documents count, as n-gram counts per language; each language's model is built by
one task. Everything else covers all rows and whole texts.

Word scores are cached in each worker (bounded): a text's sum is over its words' rows.

Defined results: null and letterless texts are `und`, score 0 (numbers such as one half or
Roman numeral signs are no letters, nor is a mark without a letter before it); repeated
rows are scored each; an empty table gives an empty one; without any labelled row every
text is `und`; `identify` keeps all columns and adds names beginning with `__lid_`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.runtime import table, written

UND = "und"
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Word ends, as the models see them.
EDGE = "\x02"
LONGEST = 4096  # characters scored at once; a longer word is counted and scored in stretches of that length
CACHED = 300_000


@dataclass(frozen=True)
class Settings:
    order: int = 4
    sample: int = 1000
    keep: float = 0.999
    spread: float = 12.0
    beyond: float = 0.01
    slack: float = 1.0
    short: float = 9.0


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all windows of n codes (uint64 arithmetic wraps)."""
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ codes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out ^ np.uint64(n)


def grams_of(words: dict[str, int], order: int) -> Counter:
    """Counts of what ends at each character of the words: `order` characters, or all from the word's begin if those are fewer."""
    grams: Counter = Counter()
    for word, count in words.items():
        text = EDGE + word + EDGE
        for stop in range(2, len(text) + 1):
            grams[text[max(0, stop - order) : stop]] += count
    return grams


class Model:
    """One language's discounted counts: for each order, n-gram -> (share left after the discount) and context -> weight of the lower orders."""

    def __init__(self, words: dict[str, int], order: int):
        self._discount(grams_of(words, order), order)

    @classmethod
    def of_grams(cls, counted: dict[str, int], order: int) -> Model:
        made = cls.__new__(cls)
        made._discount(counted, order)
        return made

    def _discount(self, counted: dict[str, int], order: int) -> None:
        grams: list[dict[str, float]] = [Counter() for _ in range(order + 1)]
        for g, c in counted.items():
            grams[len(g)][g] = c
        # Below the highest order an n-gram counts once for each character seen before it;
        # those that begin a word have none before, and keep their counts.
        for n in range(order - 1, 0, -1):
            for g, c in Counter(g[1:] for g in grams[n + 1]).items():
                if not g.startswith(EDGE) or n == 1:
                    grams[n][g] = c
        self.shares, self.weights = [], []
        for counts in grams[1:]:
            once, twice = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
            discount = min(0.95, max(0.1, once / (once + 2 * twice) if once + twice else 0.5))
            total, kinds = Counter(), Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.shares.append({g: (c - discount) / total[g[:-1]] for g, c in counts.items()})
            self.weights.append({h: discount * kinds[h] / total[h] for h in total})


def _keyed(names: list[str], values: list[float], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending; logarithms of the values)"""
    codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.uint64)
    key = hashes(codes, n)[::n] if n and len(codes) else np.zeros(len(names), np.uint64)
    order = np.argsort(key)
    return key[order], np.log(np.array(values, float))[order].astype(np.float32)


#: For each order: n-grams' hashes and log-probabilities, contexts' hashes and log-weights.
Part = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def finished(model: Model, order: int, symbols: int) -> Part:
    """One language's arrays: interpolated with the lower orders."""
    lower, out = {"": 1 / symbols}, []
    for n in range(order):
        weights = model.weights[n]
        own = {g: v + weights[g[:-1]] * lower[g[1:]] for g, v in model.shares[n].items()}
        out.append((*_keyed(list(own), list(own.values()), n + 1), *_keyed(list(weights), list(weights.values()), n)))
        lower = own
    return out


class Sparse:
    """Sorted hashes, and for each the languages that have it with their values."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        self.langs = np.repeat(np.arange(len(parts), dtype=np.int16), [len(k) for k, _ in parts])[order]
        self.values = np.concatenate([v for _, v in parts])[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.bounds = np.append(first, len(keys))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the key, language, value) of each entry of the keys that are known."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.float32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == key)
        at = at[known]
        sizes = self.bounds[at + 1] - self.bounds[at]
        place = np.arange(sizes.sum()) + np.repeat(self.bounds[at] - np.cumsum(sizes) + sizes, sizes)
        return np.repeat(known, sizes), self.langs[place], self.values[place]


class Tables:
    """All languages' models. What a language lacks backs off to its lower orders."""

    def __init__(self, parts: list[Part], symbols: int):
        self.order = len(parts[0]) if parts else 0
        self.grams = [Sparse([p[n][:2] for p in parts]) for n in range(self.order)]
        self.contexts = [Sparse([p[n][2:] for p in parts]) for n in range(self.order)]
        self.unknown = np.array([(float(p[0][3][0]) if len(p[0][3]) else 0.0) - math.log(symbols) for p in parts])

    def score(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log-probabilities of each code, given those before it in its word; place: how many those are."""
        hashed = [None, *(hashes(codes, n) if len(codes) >= n else np.zeros(0, np.uint64) for n in range(1, self.order + 1))]
        window = np.minimum(place + 1, self.order)
        key = np.zeros(len(codes), np.uint64)
        for n in range(1, self.order + 1):
            own = np.flatnonzero(window == n)
            key[own] = hashed[n][own - n + 1]
        # Each window of characters is scored once.
        _, first, again = np.unique(key, return_index=True, return_inverse=True)
        window = window[first]
        out = np.zeros((len(first), len(self.unknown)))
        left = np.ones(out.shape, bool)  # languages without a probability yet
        for n in range(self.order, 0, -1):
            can = np.flatnonzero((window >= n) & left.any(axis=1))
            if not len(can):
                continue
            at = first[can] - n + 1
            row, lang, value = self.grams[n - 1].find(hashed[n][at])
            row = can[row]
            new = left[row, lang]
            row, lang = row[new], lang[new]
            out[row, lang] += value[new]
            left[row, lang] = False
            if n > 1:
                row, lang, value = self.contexts[n - 1].find(hashed[n - 1][at])
                row = can[row]
                new = left[row, lang]
                out[row[new], lang[new]] += value[new]
            else:
                out[can] += np.where(left[can], self.unknown, 0)
        return out[again]


class Identifier:
    """All languages' models and their limits."""

    def __init__(self, settings: Settings, parts: dict[str, Part], symbols: int):
        self.settings, self.names = settings, sorted(parts)
        self.tables = Tables([parts[n] for n in self.names], symbols)
        self.limits = np.full(len(self.names), np.inf)
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.names)))

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "rows": np.zeros((1024, len(self.names)))}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): log-probabilities."""
        text = "".join(f"{EDGE}{w}{EDGE}" for w in words)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter((len(w) + 2 for w in words), int, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        each = self.tables.score(codes, place)
        each[starts] = 0  # the edge before a word is given
        return np.add.reduceat(each, starts, axis=0)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words' cached scores."""
        missing = [w for w in dict.fromkeys(words) if w not in self.cache]
        if len(self.cache) + len(missing) > CACHED:
            self.cache.clear()
            missing = list(dict.fromkeys(words))
        if missing:
            base = len(self.cache)
            while len(self.rows) < base + len(missing):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for k in range(0, len(missing), 20_000):
                self.rows[base + k : base + k + 20_000][: len(missing) - k] = self.word_scores(missing[k : k + 20_000])
            self.cache.update(zip(missing, range(base, base + len(missing)), strict=True))
        return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))

    def totals(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Log-probability by language, and characters, of a text's words."""
        if any(len(w) > 64 for w in words):  # not worth a place in the cache
            long = [w[k : k + LONGEST] for w in words if len(w) > 64 for k in range(0, len(w), LONGEST)]
            words = [w for w in words if len(w) <= 64]
            total, n = self.word_scores(long).sum(axis=0), sum(len(w) + 1 for w in long)
        else:
            total, n = np.zeros(len(self.names)), 0
        for k in range(0, len(words), 100_000):
            own = self._numbers(words[k : k + 100_000])
            total = total + self.rows[own].sum(axis=0)
        return total, n + sum(map(len, words)) + len(words)

    def entropies(self, texts: list[str | None]) -> list[tuple[np.ndarray, int] | None]:
        """For each text (each language's cross-entropy, characters); None without a letter."""
        out: list[tuple[np.ndarray, int] | None] = [None] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                numbers = self._numbers([w for _, words in held for w in words])
                counts = np.array([len(words) for _, words in held])
                totals = np.add.reduceat(self.rows[numbers], np.cumsum(counts) - counts, axis=0)
                for (k, words), total in zip(held, totals, strict=True):
                    n = len("".join(words)) + len(words)
                    out[k] = (-total / n, n)
                held.clear()
            size = 0

        for k, text in enumerate(texts):
            words = WORDS.findall(text.lower()) if text and self.names else []
            if not words:
                continue
            if len(words) > 50_000 or max(map(len, words)) > 64:
                total, n = self.totals(words)
                out[k] = (-total / n, n)
                continue
            held.append((k, words))
            size += len(words)
            if size > 50_000:
                flush()
        flush()
        return out

    def identify_all(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """For each text (language, score, cross-entropy, rejected)"""
        rows = []
        for found in self.entropies(texts):
            if found is None:
                rows.append((UND, 0.0, None, True))
                continue
            each, n = found
            best = int(each.argmin())
            odds = np.exp((each[best] - each) * math.sqrt(n))
            rows.append((self.names[best], float(1 / odds.sum()), float(each[best]), bool(each[best] > self.limits[best] + self.settings.short / math.sqrt(n))))
        return rows

    def identify(self, text: str | None) -> tuple[str, float, float | None, bool]:
        return self.identify_all([text])[0]


def bucket(id_col: Column, parts: int) -> Column:
    """crc32 of the identifier as text, by parts."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", settings: Settings = Settings()) -> Identifier:
    """Two thirds of the sample are counted, the last third sets the limits."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null and lang <> 'und'")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.xxhash64(F.col("id").cast("string"), F.lit("sample"))
    span = float(1 << 63)
    share = {k: min(1.0, settings.sample / n) for k, n in sizes.items()}
    drawn = rows.filter(F.coalesce(*(F.when(F.col("lang") == k, draw.cast("double") < (2 * s - 1) * span) for k, s in share.items()), F.lit(False))) if share else rows.limit(0)
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("part")), F.lit(3)).cast("int")
    drawn = drawn.select("text", "lang", part.alias("part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for text, lang, p in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if p:
                    found.setdefault(lang, Counter()).update(w[k : k + LONGEST] for w in WORDS.findall(text.lower()) for k in range(0, len(w), LONGEST))
            if sum(map(len, found.values())) > CACHED:
                yield from counts_of(found)
                found = {}
        yield from counts_of(found)

    def counts_of(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in found.items():
            grams = grams_of(words, settings.order)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    counted = written(drawn.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngrams")
    symbols = counted.select(F.explode(F.split("gram", "(?!^)(?!$)")).alias("c")).filter(F.col("c") != EDGE).distinct().count() + 2

    def build(group: pa.Table) -> pa.Table:
        grams = dict(zip(group.column("gram").to_pylist(), group.column("n").to_pylist(), strict=True))
        part = finished(Model.of_grams(grams, settings.order), settings.order, symbols)
        rows = [{"lang": group.column("lang")[0].as_py(), "part": k, **{name: x.tobytes() for name, x in zip(("grams", "values", "contexts", "weights"), own, strict=True)}} for k, own in enumerate(part)]
        return pa.Table.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("part", pa.int32()), *((c, pa.binary()) for c in ("grams", "values", "contexts", "weights"))]))

    parts: dict[str, Part] = {}
    for r in sorted(counted.groupBy("lang").applyInArrow(build, "lang string, part int, grams binary, values binary, contexts binary, weights binary").collect(), key=lambda r: (r["lang"], r["part"])):
        parts.setdefault(r["lang"], []).append(tuple(np.frombuffer(r[c], kind) for c, kind in (("grams", np.uint64), ("values", np.float32), ("contexts", np.uint64), ("weights", np.float32))))
    made = Identifier(settings, parts, symbols)
    if made.names:
        shared = labelled.sparkSession.sparkContext.broadcast(made)

        def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                held = [(text, lang) for text, lang, p in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if not p]
                found = own.entropies([text for text, _ in held])
                rows = [(name, name == lang, float(e)) for (_, lang), x in zip(held, found, strict=True) if x for name, e in zip(own.names, x[0], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.float64()))], ["lang", "own", "e"])

        each = written(drawn.mapInArrow(entropies, "lang string, own boolean, e double"), "entropies")
        quantile = lambda own, q: F.percentile_approx(F.when(F.col("own") == own, F.col("e")), q, 10_000)
        middle = each.groupBy("lang").agg(quantile(True, 0.5).alias("middle"), quantile(True, settings.keep).alias("most"), quantile(False, settings.beyond).alias("others"))
        away = each.join(F.broadcast(middle), "lang").filter("own").groupBy("lang").agg(F.percentile_approx(F.abs(F.col("e") - F.col("middle")), 0.5, 10_000).alias("deviation"))
        for r in middle.join(away, "lang").collect():  # a row per language
            most = min(r["most"], r["middle"] + settings.spread * 1.4826 * r["deviation"])
            others = r["others"]
            made.limits[made.names.index(r["lang"])] = most + settings.slack if others is None else max(most, (most + others) / 2)
    return made


def identify(df: DataFrame, model: Identifier, text_col: str = "text") -> DataFrame:
    """df with __lid_lang, __lid_score, __lid_entropy and __lid_rejected."""
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    shared = df.sparkSession.sparkContext.broadcast(model)
    added = {"__lid_lang": (StringType(), pa.string()), "__lid_score": (DoubleType(), pa.float64()), "__lid_entropy": (DoubleType(), pa.float64()), "__lid_rejected": (BooleanType(), pa.bool_())}
    df = df.drop(*added)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = [r for k in range(0, batch.num_rows, 512) for r in own.identify_all(batch.column(at).slice(k, 512).to_pylist())]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, kind) for c, (_, kind) in zip(cols, added.values(), strict=True))], [*batch.schema.names, *added])

    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(n, t) for n, (t, _) in added.items())]))


HELD_OUT = (3, 1)


def trained(documents: DataFrame, settings: Settings = Settings()) -> Identifier:
    """Learns only from rows outside the held-out share."""
    return fit(documents.filter(bucket(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1]), settings=settings)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identify(documents.select("doc_id", "text"), trained(documents))
    held = (bucket(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out")
    return found.select("doc_id", held, F.col("__lid_lang").alias("lang_pred"), F.col("__lid_score").alias("score"), F.col("__lid_entropy").alias("entropy"), F.col("__lid_rejected").alias("rejected"))


QUERIES = {"op8_language_id": op8_language_id}
