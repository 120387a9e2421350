"""Stages on small tables against plain versions of them."""

import re

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"the word number {k} of that text with letters" for k in range(12))
    rows = [(k, f"the story of {k} and that of {k + 1} which there have from this " * 3, "en" if k % 5 else None, "s", 0) for k in range(40)]
    rows += [(100, base, "en", "s", 1), (101, base.replace(" ", "  "), "en", "s", 1), (102, base + " more words", "en", "s", 1), (103, 'the and of that token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" there', "en", "s", 1), (104, None, None, None, None), (105, "12345", None, "s", 5), (106, "zqxj kkvw zzqq xxjj wwkk " * 30, None, "s", 1)]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else n) for i, t, lang, s, n in rows], COLUMNS)


def test_stages(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert names == ["language", "copies", "near_copies", "secrets", "packing"]
    after = stage["language"](spark, docs, "")
    assert after.columns == docs.columns
    left = {r.doc_id for r in after.collect()}
    assert left == set(range(40)) | {100, 101, 102, 103}
    assert after.filter("lang is null").isEmpty()
    after = stage["copies"](spark, after, "").cache()
    assert {r.doc_id for r in after.collect()} == left - {101}
    after = stage["near_copies"](spark, after, "").cache()
    ids = {r.doc_id for r in after.collect()}
    assert 100 in ids and 102 not in ids and 103 in ids
    clean = {r.doc_id: r for r in after.collect()}
    after = stage["secrets"](spark, after, "")
    for r in after.collect():
        if r.doc_id == 103:
            assert r.text == 'the and of that [SECRET]" there' and r.n_chars == len(r.text)
        else:
            assert r == clean[r.doc_id]
    pieces = stage["packing"](spark, after, "").collect()
    assert {r.doc_id for r in pieces} == ids
    assert not any(re.search("04dbebab", str(r)) for r in pieces)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
