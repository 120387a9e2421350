"""Secret scans, with DataFrame functions only.

Three base kinds are found by pattern. A fourth, `random`, comes from tests on runs of
token characters: the encoding is inferred from the characters used (hexadecimal, base-32,
lower-case alphanumeric, base-64), and the run is read as symbol numbers of that alphabet.

A run is a secret where two things hold:

- It can't be writing. The null hypothesis is text and names as people write them: symbols
  as frequent as in all texts of the corpus outside such runs (counted whole, with `PRIOR`
  symbols of English on top, so small tables are judged alike), or as in English names where
  those are more even. Two statistics are added as normal scores (Stouffer): pairs of equal
  symbols (that of the chi-squared test of uniformity), of which writing has many, and
  changes between small letters, capitals and digits (a runs test by kind), of which writing has few. Both
  distributions under the null follow from shares and the run's length, so the p-value is
  length-aware. Benjamini-Hochberg's step-up at rate `fdr` within each class of encoding and
  length (powers of two), over all runs of all documents that no base span holds, bounds
  the share of writing among what is found.
- It can be chance. A battery asks whether symbols are uniform and independent: chi-squared
  of the symbol counts, runs above and below the alphabet's middle, and serial correlation
  at lag one. Three times the least p-value must be `alpha` at least, so of true secrets a
  share of `alpha` is lost here. Sequences such as the alphabet itself are stopped by this.

The step-up needs counts of p-values per class, on a fixed grid: at most ENCODINGS x 40 x
GRID rows, whatever the input. Spans and tests of each row are written once to the
shared folder, so the long expressions are read once; symbol counts are a scan of their own.

Defined results: null text counts as empty and has no span; repeated rows each get their
spans; an empty table gives an empty one; offsets are code points, end exclusive; runs of
fewer than `shortest` characters are not tested.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.runtime import table, written

# The base kinds' patterns.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]{%s})"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"

KINDS = ("assign", "access", "hex", "random")
#: name: (pattern of a whole run, alphabet). The first that fits is taken.
ENCODINGS = {
    "hex": ("[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    "base32": ("[A-Z2-7]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "alnum": ("[a-z0-9]+", "abcdefghijklmnopqrstuvwxyz0123456789"),
    "base64": ("[A-Za-z0-9+/_-]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: `=` only as padding at the end, so a run begins after `name=`.
RUN = "[A-Za-z0-9+/_-]{%d,}=*"
SHORTEST = 20
FDR, ALPHA = 0.05, 0.001
GRID, PER_DECADE = 400, 20

# Letters of English text, per thousand, a to z; shares of digits and capitals in names.
ENGLISH = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
DIGITS, CAPITALS = 0.1, 0.1
#: A character of another kind (capital, small, digit) than the one before; a small letter after a capital is none.
CHANGE = "(?<=[A-Z])[0-9]|(?<=[a-z])[A-Z0-9]|(?<=[0-9])[A-Za-z]"
#: The share of such characters in names: a word or number every few characters.
CHANGES = 0.12
#: Symbols that the fixed shares are worth beside the corpus's.
PRIOR = 1000

SPAN = "array<struct<start:long,end:long>>"
NONE = f"cast(array() as {SPAN})"


def spans(text: Column, pattern: str, least: tuple[int, int] | None = None) -> Column:
    """Leftmost non-overlapping matches. least: (group, characters) that a match must have."""
    sizes = {"m": F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), F.length)}
    if least:
        sizes["own"] = F.transform(F.regexp_extract_all(text, F.lit(pattern), least[0]), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("gap"), *(v.alias(k) for k, v in sizes.items()))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.array(F.struct(start.cast("long").alias("start"), (start + x["m"]).cast("long").alias("end")))
        if least:
            one = F.when(x["own"] >= least[1], one).otherwise(F.expr(NONE))
        return F.struct((start + x["m"]).cast("long").alias("at"), F.concat(acc["found"], one).alias("found"))

    return F.aggregate(zipped, F.struct(F.lit(0).cast("long").alias("at"), F.expr(NONE).alias("found")), step, lambda acc: acc["found"])


def guarded(text: Column, test: str | Column, found: Column) -> Column:
    """found, where the cheap test holds."""
    return F.when(text.rlike(test) if isinstance(test, str) else test, found).otherwise(F.expr(NONE))


def upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0: a polynomial below 2, a continued fraction above (relative error under 0.0005)."""
    z = F.least(z, F.lit(35.0))
    density = F.exp(-z * z / 2) * (2 * math.pi) ** -0.5
    t = F.lit(1.0) / (1 + 0.2316419 * z)
    near = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    far = density / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 5 / (z + 2.2))))))
    return F.when(z < 2, near).otherwise(far)


def p_value(z: Column) -> Column:
    """Two-sided."""
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _tests(codes: Column, k: Column) -> Column:
    """For symbol numbers 0..k-1: struct(p: the battery's p-value, pairs: ordered pairs of equal symbols)."""
    n = F.size(codes).cast("double")
    share = F.try_divide  # null, not an error, for runs too short to test
    squares = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda a, j: a + F.pow(F.size(F.filter(codes, lambda c: c == j)).cast("double"), 2))
    pairs = F.arrays_zip(F.slice(codes, F.lit(1), F.size(codes) - 1).alias("a"), F.slice(codes, F.lit(2), F.size(codes) - 1).alias("b"))
    upper = F.filter(codes, lambda c: c * 2 >= k)
    changes = F.filter(pairs, lambda x: (x["a"] * 2 >= k) != (x["b"] * 2 >= k))

    def of_runs(x: Column) -> Column:
        mean = share(F.lit(2.0) * x["high"] * (n - x["high"]), n) + 1
        var = share((mean - 1) * (mean - 2), n - 1)
        return F.when(var > 0, (x["runs"] - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(30.0))

    def of_serial(middle: Column) -> Column:
        spread = F.aggregate(codes, F.lit(0.0), lambda a, c: a + F.pow(c - middle, 2))
        cross = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + (x["a"] - middle) * (x["b"] - middle))
        return F.when(spread > 0, (cross / F.greatest(spread, F.lit(1e-9)) + share(F.lit(1.0), n)) * F.sqrt(n)).otherwise(F.lit(30.0))

    def of_counts(squares: Column) -> Column:
        df = k.cast("double") - 1
        chi, ninth = share(k * squares, n) - n, 2 / (9 * df)
        z = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - ninth)) / F.sqrt(ninth)
        return F.struct(z.alias("z"), (squares - n).alias("pairs"))

    z_runs = let(F.struct(F.size(upper).cast("double").alias("high"), (F.size(changes) + F.lit(1.0)).alias("runs")), of_runs)
    z_serial = let(share(F.aggregate(codes, F.lit(0.0), lambda a, c: a + c), n), of_serial)
    counted = let(squares, of_counts)
    most = F.struct(F.greatest(F.abs(counted["z"]), F.abs(z_runs), F.abs(z_serial)).alias("z"), counted["pairs"].alias("pairs"))
    return let(most, lambda x: F.struct(F.coalesce(F.least(F.lit(1.0), 3 * p_value(x["z"])), F.lit(0.0)).alias("p"), x["pairs"].alias("pairs")))


def symbol_shares(counts: dict[str, int]) -> dict[str, list[float]]:
    """By encoding, each symbol's share in writing: the corpus's (counts: ASCII letters and digits), or English's where that is the more even."""
    letters = string.ascii_lowercase
    each = {c: n / sum(ENGLISH) * (1 - DIGITS) for c, n in zip(letters, ENGLISH, strict=True)} | dict.fromkeys(string.digits, DIGITS / 10)
    fixed = {c: v * (1 - CAPITALS if c in letters else 1) for c, v in each.items()} | {c.upper(): each[c] * CAPITALS for c in letters}

    def shares(own: dict[str, float], name: str) -> list[float]:
        of = lambda c: own.get(c, 0) if name == "base64" or c.isdigit() else own[c.lower()] + own[c.upper()]
        found = [of(c) for c in ENCODINGS[name][1]]
        return [v / sum(found) for v in found]

    corpus = {c: counts.get(c, 0) + PRIOR * v for c, v in fixed.items()}
    return {name: min(shares(corpus, name), shares(fixed, name), key=lambda q: sum(x * x for x in q)) for name in ENCODINGS}


def corpus_counts(df: DataFrame, text_col: str, run: str) -> dict[str, int]:
    """How often each ASCII letter and digit occurs in all texts, outside the runs."""
    text = F.col("text")
    each = {c: F.sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("long")) for c in string.ascii_letters + string.digits}
    found = df.select(F.regexp_replace(text_col, run, " ").alias("text")).agg(*(v.alias(f"n{k}") for k, v in enumerate(each.values()))).first()
    return {c: found[k] or 0 for k, c in enumerate(each)}


def writing_place(symbols: Column, pairs: Column, second: Column, third: Column, changes: Column) -> Column:
    """Where the null's p-value lies on the grid: -PER_DECADE * log10, rounded down; of as few pairs of equal symbols and as many changes of kind, by Stouffer's sum.

    second, third: sums of the squares and cubes of the symbols' shares in writing."""
    n = symbols.cast("double")
    mean = n * (n - 1) * second
    var = 2 * n * (n - 1) * (second - second * second) + 4 * n * (n - 1) * (n - 2) * (third - second * second)

    def of_pairs(x: Column) -> Column:  # a gamma distribution of this mean and variance, by its cube root
        return (1 - x["ninth"] - F.pow(pairs / x["mean"], F.lit(1 / 3))) / F.sqrt(x["ninth"])

    def of_changes(share: Column) -> Column:  # the binomial tail, by its deviance
        part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
        return F.signum(share - CHANGES) * F.sqrt(F.greatest(F.lit(0.0), 2 * (n - 1) * (part(share, F.lit(CHANGES)) + part(1 - share, F.lit(1 - CHANGES)))))

    def place(z: Column) -> Column:
        tail = F.when(z > 0, upper_tail(z)).otherwise(1.0)
        return F.least(F.lit(GRID), F.floor(-PER_DECADE * F.log10(F.greatest(tail, F.lit(1e-300))))).cast("int")

    z_pairs = let(F.struct(mean.alias("mean"), (var / (9 * mean * mean)).alias("ninth")), of_pairs)
    z_changes = let(F.greatest(changes - 0.5, F.lit(0.0)) / (n - 1), of_changes)
    return F.when(n >= 2, let((z_pairs + z_changes) * 0.5**0.5, place)).otherwise(0)


def encoding_of(run: Column) -> Column:
    """The first encoding that fits a run with digits and letters of the kinds it needs; else null."""
    mixed = run.rlike("[0-9]") & run.rlike("[A-Za-z]")
    needs = {"base64": mixed & run.rlike("[a-z]") & run.rlike("[A-Z]")}
    out = None
    for name, (pattern, _) in ENCODINGS.items():
        fits = run.rlike(f"^(?:{pattern})$") & needs.get(name, mixed)
        out = F.when(fits, F.lit(name)) if out is None else out.when(fits, F.lit(name))
    return out


def battery(run: Column, shares: dict[str, list[float]]) -> Column:
    """struct(encoding, symbols, p: the battery's, place: writing's); null where no encoding fits."""
    facts = {e: (alphabet, len(alphabet), sum(q**2 for q in shares[e]), sum(q**3 for q in shares[e])) for e, (_, alphabet) in ENCODINGS.items()}

    def of(encoding: Column, k: int) -> Column:
        out = None
        for e, fact in facts.items():
            out = F.when(encoding == e, F.lit(fact[k])) if out is None else out.when(encoding == e, F.lit(fact[k]))
        return out

    def read(encoding: Column) -> Column:
        body = F.translate(F.rtrim(run, F.lit("=")), "-_", "+/")
        body = F.when(encoding == "hex", F.lower(body)).otherwise(body)
        codes = let(of(encoding, 0), lambda alphabet: F.transform(F.split(body, "(?!^)(?!$)"), lambda c: F.instr(alphabet, c) - 1))
        return F.when(encoding.isNotNull(), let(codes, lambda codes: let(_tests(codes, of(encoding, 1)), lambda t: result(encoding, F.size(codes), t))))

    def result(encoding: Column, symbols: Column, t: Column) -> Column:
        place = writing_place(symbols, t["pairs"], of(encoding, 2), of(encoding, 3), F.regexp_count(run, F.lit(CHANGE)))
        return F.struct(encoding.alias("encoding"), symbols.alias("symbols"), t["p"].alias("p"), place.alias("place"))

    return let(encoding_of(run), read)


def length_class(symbols: Column) -> Column:
    return F.floor(F.log2(symbols)).cast("int")


def rejections(tested: DataFrame, fdr: float = FDR) -> dict[tuple[str, int], int]:
    """By (encoding, length class): the least place from which runs are no writing. tested: encoding, class, place."""
    counts = tested.groupBy("encoding", "class", "place").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("encoding", "class")
    ranked = counts.withColumns({"upto": F.sum("n").over(by_class.orderBy(F.desc("place"))), "all": F.sum("n").over(by_class)})
    holds = F.pow(F.lit(10.0), -F.col("place") / PER_DECADE) * F.col("all") <= F.lit(fdr) * F.col("upto")
    found = ranked.filter(holds).groupBy("encoding", "class").agg(F.min("place").alias("place")).collect()
    return {(r["encoding"], r["class"]): r["place"] for r in found}  # at most ENCODINGS x 40


def scan_secrets(df: DataFrame, text_col: str = "text", fdr: float = FDR, keep_text: bool = True, alpha: float = ALPHA, shortest: int = SHORTEST) -> DataFrame:
    """df with __ss_base and __ss_all: arrays of struct(start, kind number, end, kind), ordered so; names that begin with `__ss_` are its own."""
    df = df.drop(*(c for c in df.columns if c.startswith("__ss_")))
    text, run = F.coalesce(F.col(text_col), F.lit("")), RUN % shortest
    shares = symbol_shares(corpus_counts(df, text_col, run))
    base = {
        "assign": guarded(text, ASSIGN % "12,", spans(text, ASSIGN % "1,", (2, 12))),
        "access": guarded(text, text.contains("AKIA"), spans(text, ACCESS)),
        "hex": guarded(text, HEX, spans(text, HEX)),
    }
    runs = guarded(text, run, spans(text, run))
    cut = lambda s: F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    tested = F.transform(runs, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), let(cut(s), lambda r: battery(r, shares)).alias("t")))
    kept = df.withColumns({f"__ss_{k}": v for k, v in base.items()})
    inside = lambda x: sum_or([F.exists(F.col(f"__ss_{k}"), lambda s: (s["start"] <= x["start"]) & (s["end"] >= x["end"])) for k in base])
    kept = kept.withColumn("__ss_runs", F.filter(tested, lambda x: x["t"].isNotNull() & ~inside(x)))
    kept = written(kept if keep_text else kept.drop(text_col), "spans")

    each = kept.select(F.explode("__ss_runs.t").alias("t")).select("t.encoding", length_class(F.col("t.symbols")).alias("class"), "t.place")
    limits = rejections(each, fdr)

    def random(x: Column) -> Column:
        t = x["t"]
        found = [(t["encoding"] == e) & (length_class(t["symbols"]) == c) & (t["place"] >= p) for (e, c), p in limits.items()]
        return (t["p"] >= alpha) & sum_or(found)

    def named(spans_: Column, kind: str) -> Column:
        return F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    found = F.concat(*(named(F.col(f"__ss_{k}"), k) for k in base))
    return kept.withColumns({"__ss_base": F.array_sort(found), "__ss_all": F.array_sort(F.concat(found, named(F.filter(F.col("__ss_runs"), random), "random")))}).drop("__ss_runs", *(f"__ss_{k}" for k in base))


def sum_or(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """text with the mark in place of each span; spans that overlap get one."""
    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        before = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(found, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return _digest(found)


def _digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter(F.col("__ss_base"), lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(F.col("__ss_base")), 256).alias("base_sha256"), joined(F.col("__ss_all")).alias("spans")
    )


QUERIES = {"op3_secrets": op3_secrets}
