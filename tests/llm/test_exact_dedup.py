import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabulon.llm.exact_dedup import deduplicate, exact_groups, sha256

ROWS = [(5, "a b"), (3, "a  b"), (9, "a\n\tb"), (4, "a\xa0b"), (7, ""), (8, None), (2, " "), (6, "x" * 100_000), (1, "x" * 100_000), (None, "a b"), (None, "lone"), (None, "lone"), (3, "a  b"), (11, "A b")]


def body(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def check(found, rows):
    by = defaultdict(list)
    for i, t in rows:
        by[body(t)].append(i)
    assert len(found) == len(rows)
    groups = defaultdict(list)
    for r in found:
        groups[r.keep_id, r.group_size].append(r)
    wanted = defaultdict(int)
    for ids in by.values():
        wanted[min((i for i in ids if i is not None), default=None), len(ids)] += len(ids)
    assert {k: len(v) for k, v in groups.items()} == wanted
    assert sum(r.kept for r in found) == len(by)
    assert all(r.id == r.keep_id for r in found if r.kept)


@pytest.mark.parametrize("digest", [sha256, lambda c: F.lit("same"), lambda c: F.length(c).cast("string")])
def test_groups_even_where_digests_collide(spark, digest):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    check(exact_groups(df, digest=digest).collect(), ROWS)
    kept = deduplicate(df, digest=digest).collect()
    assert sorted(body(r.text) for r in kept) == sorted({body(t) for _, t in ROWS})


def test_digest_is_of_the_normalised_text(spark):
    df = spark.createDataFrame([(1, " a \r\n b\x0b")], "doc_id long, text string")
    assert exact_groups(df).first().key == hashlib.sha256(b" a b ").hexdigest()


def test_large_group_over_many_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.col("id").cast("string")).alias("text")).repartition(40)
    r = exact_groups(df).filter("group_size > 1").agg(F.count("*"), F.max("group_size"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(r) == (1000, 1000, 1)


def test_empty_table_and_extra_columns(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a", "k", 2), (2, "a", "m", 3)], "doc_id long, text string, key string, group_size int")
    assert [tuple(r) for r in deduplicate(df).collect()] == [(1, "a", "k", 2)]


def test_native_plan(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = exact_groups(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
