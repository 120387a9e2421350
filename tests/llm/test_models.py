"""Language ID and quality: held-out accuracy, and their parts against plain versions."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import language_id as lid
from tabulon.llm import quality

LANGS = {"aa": "the and of that with from this have which there", "bb": "der die und nicht sich auch eine werden durch über", "cc": "les des une dans pour avec être même où"}


def documents(n=240, seed=1):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(words.split(), k=rng.randint(5, 60))), lang) for k in range(n) for lang, words in [list(LANGS.items())[k % 3]]]


@pytest.fixture(scope="module")
def model(spark):
    return lid.fit(spark.createDataFrame(documents(), "doc_id long, text string, lang string"))


def test_languages_of_other_documents(spark, model):
    rows = [(k, t, lang, "x") for k, t, lang in documents(90, 7)] + [(1000, None, None, "x"), (1001, "12 34 !!", None, "x"), (1002, "", None, "x"), (1003, "qqq xxzz jjkk " * 20, None, "x"), (1003, "qqq xxzz jjkk " * 20, None, "x"), (1004, "the and of " * 30_000, "aa", "x"), (1005, "a" * 10_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    found = lid.identify(df, model).collect()
    assert len(found) == len(rows) and found[0].score == "x"
    by = {r.doc_id: r.asDict() for r in found}
    assert sum(by[k]["__lid_lang"] == by[k]["lang"] for k in range(90)) >= 88
    assert all(not by[k]["__lid_rejected"] for k in range(90))
    for k in (1000, 1001, 1002):
        assert by[k]["__lid_lang"] == "und" and by[k]["__lid_rejected"] and by[k]["__lid_score"] == 0
    assert by[1003]["__lid_rejected"] and by[1004]["__lid_lang"] == "aa" and by[1005]["__lid_lang"] in LANGS
    assert lid.identify(df.limit(0), model).count() == 0


def test_letters_and_marks(spark, model):
    assert lid.WORDS.findall("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    assert lid.WORDS.findall("½ ² Ⅷ ٣ \u0301 a1b_c") == ["a", "b", "c"]
    rows = [(k, t) for k, t in enumerate(["½", "² Ⅷ", "\u0301", "١٢", "a½"])]
    found = {r.doc_id: r["__lid_lang"] for r in lid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [found[k] == "und" for k in range(5)] == [True, True, True, True, False]


def test_a_language_that_was_left_out_is_rejected(spark):
    rng = random.Random(3)
    other = "los las una para con estar mismo donde mucho tambien".split()
    found = lid.fit(spark.createDataFrame(documents(600, 4) + [(9999, "spam " * 30 + "xq zzk qqw " * 20, "aa")], "doc_id long, text string, lang string"))
    texts = [" ".join(rng.choices(other, k=40)) for _ in range(50)]
    assert sum(found.identify(t)[3] for t in texts) >= 48
    assert not any(found.identify(t)[3] for _, t, _ in documents(90, 11))


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert lid.identify(df, lid.fit(df)).first()["__lid_lang"] == "und"


def test_probabilities_sum_to_one():
    words = {"abc": 3, "abd": 1, "ba": 2, "cab": 1}
    symbols = sorted(set("".join(words))) + [lid.EDGE]
    tables = lid.Tables([lid.finished(lid.Model(w, 3), 3, len(symbols) + 1) for w in (words, {"zz": 1, "az": 4})], len(symbols) + 1)
    for context in ("", "a", "ab", "zz", lid.EDGE, lid.EDGE + "a"):
        for k in range(2):
            total = 0.0
            for s in [*symbols, "z"]:
                codes = np.frombuffer((context + s).encode("utf-32-le"), np.uint32).astype(np.uint64)
                total += math.exp(tables.score(codes, np.arange(len(codes)))[-1, k])
            assert total == pytest.approx(1, abs=0.35 if context == "" else 0.05) or total < 1.0001


def plain_score(words, order, symbols, text):
    """Kneser-Ney over dictionaries, a character at a time."""
    m = lid.Model(words, order)

    def prob(gram):
        if not gram:
            return 1 / symbols
        n = len(gram)
        if gram[:-1] not in m.weights[n - 1]:
            return prob(gram[1:])
        return m.shares[n - 1].get(gram, 0.0) + m.weights[n - 1][gram[:-1]] * prob(gram[1:])

    full = lid.EDGE + text + lid.EDGE
    return sum(math.log(prob(full[max(0, k + 1 - order) : k + 1])) for k in range(1, len(full)))


def test_tables_equal_plain_kneser_ney():
    words = {"the": 9, "then": 3, "thing": 2, "hen": 4, "in": 7, "nothing": 1}
    tables = lid.Tables([lid.finished(lid.Model(w, 4), 4, 20) for w in (words, {"other": 2})], 20)
    model = lid.Identifier.__new__(lid.Identifier)
    model.names, model.tables = ["a", "b"], tables
    given = ["the", "thin", "zebra", "n", "nothingness", "hhhh"]
    found = model.word_scores(given)
    for k, word in enumerate(given):
        assert found[k, 0] == pytest.approx(plain_score(words, 4, 20, word))


def test_held_out_share(spark):
    rows = [(k,) for k in [0, 1, 77, 10**12, -5]]
    found = spark.createDataFrame(rows, "doc_id long").select("doc_id", lid.bucket(F.col("doc_id"), 3).alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.doc_id).encode()) % 3 for r in found)


def junk(rng):
    return rng.choice([" ".join(w.upper() + "!!" for w in rng.choices(LANGS["aa"].split(), k=30)), "spam " * 40, " | ".join(rng.choices(LANGS["bb"].split(), k=30)), " ".join(w + "***" for w in rng.choices(LANGS["aa"].split(), k=30))])


def test_quality_of_other_documents(spark):
    rng = random.Random(5)
    rows = [(k, junk(rng) if k % 4 == 0 else documents(1, k)[0][1] * 3, int(k % 4 != 0)) for k in range(600)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(9000, None), (9001, ""), (9002, "word " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k < 400] + [(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    vectors = quality.word_vectors(docs)
    network = quality.fit(docs, labels, vectors)
    found = {r.doc_id: r["__qc_score"] for r in quality.score(docs, vectors, network).collect()}
    right = sum((found[k] >= 0.7) == bool(y) for k, _, y in rows if k >= 400)
    assert right >= 190 and all(0 <= v <= 1 for v in found.values()) and len(found) == 603
    assert quality.score(docs.limit(0), vectors, network).count() == 0


def test_no_quality_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    vectors = quality.word_vectors(docs)
    network = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"), vectors)
    assert quality.score(docs, vectors, network).first()["__qc_score"] == 0.5


def test_random_indexing_equals_plain_sums():
    texts = ["a b c a", "", "b!! c", "é"]
    places, signs = quality.index_vectors()
    wanted = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for t in texts:
        own, _, _ = quality.tokens([t])
        for i, a in enumerate(own):
            for j in (i - 1, i + 1):
                if 0 <= j < len(own):
                    for k in range(quality.NONZERO):
                        wanted[a, places[own[j], k]] += signs[own[j], k]
    assert np.allclose(quality.neighbours(texts, places, signs).reshape(wanted.shape), wanted)


def test_pooling_equals_plain_means():
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIMENSIONS))
    texts = ["one two, THREE", "", "x x x 12", "word " * 3000]
    found = quality.pooled(texts, vectors)
    for k, t in enumerate(texts):
        own, _, _ = quality.tokens([t])
        if len(own):
            assert np.allclose(found[k, : quality.DIMENSIONS], vectors[own].mean(axis=0), atol=1e-5)
            assert np.allclose(found[k, quality.DIMENSIONS : 2 * quality.DIMENSIONS], vectors[own].std(axis=0), atol=1e-3)
        else:
            assert not found[k].any()


@pytest.mark.parametrize("first", [None, ""])
def test_slices_that_begin_with_an_empty_text(spark, first):
    rest = ["good words here", "", "more good words"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([first, *rest])], "doc_id long, text string").coalesce(1)
    assert np.allclose(quality.word_vectors(df), quality.word_vectors(df.filter("doc_id > 0")))
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIMENSIONS))
    found = quality.pooled([first or "", *rest], vectors)
    assert found.shape == (4, quality.FEATURES) and np.allclose(found[1:], quality.pooled(rest, vectors))


def test_all_words_of_a_language_are_counted(spark):
    rng = random.Random(5)
    # One language of many words, each often; one of few documents, each word once and a run of 6,000 letters
    many = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(150_000)]
    rows = [(k, " ".join(many[k * 1500 : k * 1500 + 1500] * 2), "aa") for k in range(100)]
    rare = ["".join(rng.choices("клмнопрст", k=7)) for _ in range(12)]
    run = "".join(rng.choices("一丁七万三上下不与且", k=6000))
    rows += [(1000 + k, w, "bb") for k, w in enumerate(rare)] + [(2000 + k, run, "cc") for k in range(6)]
    model = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["aa", "bb", "cc"]
    assert model.identify(" ".join(rare))[0] == "bb"
    grams = model.tables.grams[3].keys
    wanted = {run[k : k + 4] for k in range(6000 - 3) if not 4093 <= k <= 4095}
    keys = [lid.hashes(np.frombuffer(g.encode("utf-32-le"), np.uint32).astype(np.uint64), 4)[0] for g in wanted]
    assert np.isin(np.array(keys), grams).all()


def test_language_query_over_a_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = lid.op8_language_id(spark, folder).collect()
    assert len(found) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and docs[r.doc_id].lang not in (None, "und")]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or "")) for r in found)


def test_quality_query_over_a_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = quality.op2_quality(spark, folder).collect()
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in found)
    held = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97
