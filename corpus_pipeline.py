"""From raw documents to packed sequences: language, copies, near copies, secrets, packing.

Each stage reads the table that the one before has written and keeps the columns of
`documents`; the last returns pieces of sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.exact_dedup import deduplicate
from tabulon.llm.language_id import UND, fit, identify
from tabulon.llm.ngram_join import drop_near_duplicates
from tabulon.llm.packing import pack_texts
from tabulon.llm.runtime import fresh_path, table
from tabulon.llm.secrets import redacted, scan_secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models reject go: without a letter, or like no language they know. A missing lang is filled in."""
    found = identify(docs, fit(docs))
    kept = found.filter(~F.col("__lid_rejected") & (F.col("__lid_lang") != UND))
    return kept.withColumn("lang", F.coalesce("lang", "__lid_lang")).select(docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document stays."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, and those without a secret stay as they are."""
    found = scan_secrets(docs)
    clean = found.withColumn("text", redacted(F.col("text"), F.col("__ss_all")))
    return clean.withColumn("n_chars", F.when(F.size("__ss_all") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row per piece, with its ids."""
    return pack_texts(docs)


STAGES: list[tuple[str, Stage]] = [("language", language), ("copies", copies), ("near_copies", near_copies), ("secrets", secrets), ("packing", packing)]

#: Language models, MinHash and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
