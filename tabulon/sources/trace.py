"""Call traces as text, read as event rows: doc, seq, depth, op, props."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"^( *)([A-Za-z]\w*) ?(?:\((.*)\))?$"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace files under a path, one per document."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.raw)?$", 1).alias("doc"), F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    return parsed(lines)


def parsed(lines: DataFrame) -> DataFrame:
    """lines: doc, seq, line. Lines that are no call belong to the text before them and are left out."""
    inner = F.regexp_extract("line", LINE, 3)
    # Properties are `name: value`, divided by commas before the next name; lists in double parentheses stay text.
    parts = F.regexp_extract_all(inner, F.lit(r"([a-z]+[\w-]*:?[\w-]*): (\(\(.*\)\)|.*?)(?=, [a-z]+[\w-]*:?[\w-]*: |$)"), 0)
    pairs = F.map_from_entries(_first_of_each(F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^([a-z]+[\w-]*:?[\w-]*): ", 1).alias("k"), F.regexp_replace(p, r"^[a-z]+[\w-]*:?[\w-]*: ", "").alias("v")))))
    own = lines.filter(F.col("line").rlike(LINE))
    return own.select("doc", "seq", F.floor(F.length(F.regexp_extract("line", LINE, 1)) / 2).cast("int").alias("depth"), F.regexp_extract("line", LINE, 2).alias("op"), pairs.alias("props"))


def _first_of_each(pairs):
    """Pairs without those whose name an earlier one has."""
    return F.filter(pairs, lambda p, k: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == k + 1)


def op_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("op").agg(F.count(F.lit(1)).alias("n"))
