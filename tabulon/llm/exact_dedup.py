"""Exact dedup, skew-safe, with DataFrame functions only.

Texts are equal when identical after each run of white space becomes one space. Copies
combine in three steps, and each step's grouping key holds the whole normalised text
beside its digest, so a digest that two texts share never merges them:

1. locally: the partial aggregate of each task keeps one row per text of the task;
2. salted: the tasks' rows meet per (digest, salt, text), a salt standing for a share of
   the tasks, so no key gets more rows than tasks / SALTS;
3. globally: the at most SALTS winners of a text are combined.

The groups (a key, the row that stays, the size) are then written, and rows find theirs
by key: the digest, or digest and text where a digest stands for several texts. A hot
key on the rows' side is split by adaptive skew joins.

Defined results: null text counts as empty; null identifiers rank after all others; of
repeated rows (same identifier, same text) one stays; an empty table gives an empty one;
`deduplicate` keeps all columns; names that
begin with `__dd_` are its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.runtime import table, written

SALTS = 16
#: A run of white space that is not one space already.
RUNS = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _full(df: DataFrame, text_col: str, id_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """df with __dd_id, __dd_body and __dd_digest."""
    full = df.withColumns({"__dd_id": F.col(id_col), "__dd_body": normalised(F.col(text_col))})
    return full.withColumn("__dd_digest", digest(F.col("__dd_body")))


def _groups(full: DataFrame, salts: int) -> DataFrame:
    """One row per text: __dd_digest, __dd_body, keep_id, group_size."""
    salted = full.select("__dd_id", "__dd_digest", "__dd_body").withColumn("__dd_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = salted.groupBy("__dd_digest", "__dd_salt", "__dd_body").agg(F.min("__dd_id").alias("id"), F.count(F.lit(1)).alias("n"))
    return merged.repartition("__dd_digest").groupBy("__dd_digest", "__dd_body").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def _resolved(df: DataFrame, text_col: str, id_col: str, digest: Callable[[Column], Column], salts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(df with __dd_id and __dd_key, written rows of id, key and row number, groups by key)."""
    full = _full(df, text_col, id_col, digest)
    groups = _groups(full, salts).groupBy("__dd_digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = written(groups, "groups")
    key = F.col("__dd_digest")
    shared = groups.filter("texts > 1").select("__dd_digest", F.lit(True).alias("__dd_shared"))
    exact = shared.isEmpty()
    if not exact:  # digests that stand for several texts: their key holds the text
        full = full.join(shared, "__dd_digest", "left")
        key = F.when(F.col("__dd_shared"), F.concat("__dd_digest", F.lit(":"), "__dd_body")).otherwise(key)
    keyed = full.withColumn("__dd_key", key).drop("__dd_digest", "__dd_body", "__dd_shared")
    rows = written(keyed.select("__dd_id", "__dd_key", F.monotonically_increasing_id().alias("__dd_row")), "rows")
    if exact:
        groups = groups.select(F.col("__dd_digest").alias("__dd_key"), "keep_id", "group_size")
    else:
        groups = rows.groupBy("__dd_key").agg(F.min("__dd_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return keyed, rows, groups


def _verdicts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with keep_id, group_size and kept. Of repeated rows the first stays."""
    tied = rows.groupBy("__dd_key", "__dd_id").agg(F.count(F.lit(1)).alias("n"), F.min("__dd_row").alias("__dd_first")).filter("n > 1")
    tied = tied.select(F.col("__dd_key").alias("k"), F.col("__dd_id").alias("i"), "__dd_first")
    found = rows.join(groups, "__dd_key")
    found = found.join(tied, (found["__dd_key"] == tied["k"]) & found["__dd_id"].eqNullSafe(tied["i"]), "left").drop("k", "i")
    first = F.col("__dd_first").isNull() | (F.col("__dd_first") == F.col("__dd_row"))
    return found.withColumn("kept", F.col("__dd_id").eqNullSafe(F.col("keep_id")) & first)


def exact_groups(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """A row per row of df, dropped ones too: id, key, keep_id, group_size, kept."""
    _, rows, groups = _resolved(df, text_col, id_col, digest, salts)
    return _verdicts(rows, groups).select(F.col("__dd_id").alias("id"), F.col("__dd_key").alias("key"), "keep_id", "group_size", "kept")


def deduplicate(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """The rows of df that stay, with all their columns."""
    keyed, rows, groups = _resolved(df, text_col, id_col, digest, salts)
    by_id = written(_verdicts(rows, groups).groupBy("__dd_id", "__dd_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("not kept or n > 1"), "verdicts")

    def same(other: DataFrame) -> Column:
        return (keyed["__dd_key"] == other["__dd_key"]) & keyed["__dd_id"].eqNullSafe(other["__dd_id"])

    lost, twice = by_id.filter("not kept"), by_id.filter("kept and n > 1")
    # Merged at every size: what is lost grows with the rows.
    out = keyed.join(lost.hint("merge"), same(lost), "left_anti")
    if not twice.isEmpty():
        out = out.join(twice, same(twice), "left_anti").unionByName(keyed.join(twice, same(twice), "left_semi").dropDuplicates(["__dd_id", "__dd_key"]))
    return out.drop("__dd_id", "__dd_key")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("key").alias("text_sha256"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE_SQL = {
    "op4_exact_dedup": """
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW w AS (PARTITION BY body)
"""
}
