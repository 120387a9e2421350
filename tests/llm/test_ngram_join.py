import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import ngram_join as nj
from tabulon.llm.components import components
from tabulon.llm.shingles import ngram_sets, word_hashes

WORD = re.compile("[a-zA-Z0-9\u0080-\U0010ffff]+")


def sets_of(rows):
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        n = min(5, len(w))
        out.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()))
    return out


def brute(rows):
    """links by row number, component by row number"""
    own = sets_of(rows)
    links, top = Counter(), list(range(len(own)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(own)):
        for b in range(a):
            shared = len(own[a][1] & own[b][1])
            if shared and 9 * shared >= 4 * (len(own[a][1]) + len(own[b][1])):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(own):
        ids[find(k)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return [links[k] for k in range(len(own))], [least[find(k)] for k in range(len(own))]


def corpus(seed=3, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)] + ["É", "naïve"]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(30, 250))
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words).replace(" w1", ", W1"))
        rows.append(" ".join(rng.choices(vocabulary, k=40) + passage))
    rng.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("block", "signatures"), [(128, 4096), (3, 4)])
def test_links_and_classes_equal_brute_force(spark, block, signatures):
    rows = corpus() + [(900, "one two three"), (901, "one two three"), (902, ""), (903, None), (904, "!!!"), (905, "word " * 20_000), (906, "word word word word word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.id: r for r in nj.near_duplicates(df, block=block, signatures=signatures).collect()}
    links, least = brute(rows)
    for k, (i, _) in enumerate(rows):
        assert (found[i].links, found[i].class_id) == (links[k], least[k]), i
    assert found[900].copies == 2 and found[902].links == 0 and found[905].copies == 2


def test_nulls_repeats_and_clashing_names(spark):
    text = " ".join(f"t{k}" for k in range(50))
    rows = [(5, text, "n"), (5, text, "n"), (None, text, "n"), (6, text + " more", "n"), (5, "other words here now and then", "n"), (None, "lone text of six words here", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    found = nj.near_duplicates(df).collect()
    assert len(found) == 6
    assert sorted((r.id or 0, r.links) for r in found) == [(0, 0), (0, 3), (5, 0), (5, 3), (5, 3), (6, 3)]
    kept = nj.drop_near_duplicates(spark.createDataFrame(rows[:4], df.schema)).collect()
    assert [(r.doc_id, r.node) for r in kept] == [(5, "n")]
    assert nj.near_duplicates(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for s, recall in ((0.8, 0.99999), (0.5, 0.9)):
        bands, rows = nj.bands_and_rows(s, recall)
        assert bands * rows <= nj.HASHES
        assert nj.shares_band(s, bands, rows) >= recall > nj.shares_band(s, bands - 1, rows)
    assert nj.bands_and_rows(0.8, 0.99999) == (38, 6)


def test_unlike_texts_that_share_bands_stay_apart(spark):
    """A chain of texts, each half like the next: candidates chain, plausible links and verified pairs don't."""
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 10**9)}" for _ in range(30 * 3000 + 120)]
    rows = [(k, " ".join(words[30 * k : 30 * k + 90])) for k in range(3000)]  # similarity of neighbours: about 0.5
    near = [(5000 + k, " ".join(words[30 * k : 30 * k + 90] + ["more"])) for k in range(0, 3000, 500)]
    df = spark.createDataFrame(rows + near, "doc_id long, text string").repartition(4)
    counts = nj.bands_and_rows(0.8, nj.RECALL)
    signed = nj._signed(df, "text", "doc_id", 5, counts, nj.DIGEST).cache()
    banded = signed.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").count().filter("count > 1").count()
    links = nj._plausible(banded, signed, nj.least_matches(0.8, counts[0] * counts[1]), nj.SIGNATURES).distinct().count()
    assert shared > 1000 and links <= 60
    found = {r.id: r for r in nj.near_duplicates(df).collect()}
    assert sum(r.links for r in found.values()) == 2 * len(near)
    assert all(found[i].class_id == i - 5000 for i, _ in near)


def test_clashing_digests_make_one_class(spark):
    rows = [(k, f"text number {k} has some words of its own {k * 7}") for k in range(600)]
    found = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), digest=1).collect()
    assert sorted(r.id for r in found) == list(range(600))


def test_recall_of_planted_pairs(spark):
    rng = random.Random(6)
    rows, wanted = [], 0
    for k in range(400):
        base = [f"v{rng.randint(0, 10**9)}" for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(200), rng.randint(1, 5)):
            other[at] = f"x{rng.randint(0, 10**9)}"
        a, b = (own for _, own in sets_of([(0, " ".join(base)), (1, " ".join(other))]))
        wanted += 9 * len(a & b) >= 4 * (len(a) + len(b))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    found = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("links")).first()[0]
    assert wanted > 100 and found == 2 * wanted


def test_forests_connect_what_pairs_connect():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = rng.integers(1, 40)
        own = rng.integers(0, 4, (n, 12)).astype(np.uint8)
        least = int(rng.integers(3, 12))
        alike = (own[:, None, :] == own[None, :, :]).sum(axis=2) >= least

        def parts(pairs):
            label = list(range(n))
            for a, b in pairs:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
            return label

        found = nj.plausible_forest(own, least)
        assert all(alike[a, b] for a, b in found) and parts(found) == parts(np.argwhere(alike).tolist())


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    own = nj.MinHash(100, 6)
    same = (own.signature(a) == own.signature(b)).mean()
    assert abs(same - 800 / 1200) < 0.06


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90), dtype=np.uint64)) for _ in range(20)]
    found = nj.shared_counts(sets[:8], sets[8:])
    assert all(found[i, j] == len(np.intersect1d(sets[i], sets[8 + j])) for i in range(8) for j in range(12))


def test_words_and_grams():
    words, bounds = word_hashes(["Hello, wörld! HELLO", "", "...", "a_b"])
    assert bounds.tolist() == [0, 3, 3, 3, 5] and words[0] == words[2] != words[1]
    (a, b, c) = ngram_sets(["one two three four five six", "one two", ""], 5)
    assert (len(a), len(b), len(c)) == (2, 1, 0)


def test_long_texts_are_hashed_alike(monkeypatch):
    from tabulon.llm import shingles

    texts = ["ab cd " * 50, "x" * 500 + " é y", "", "one two three four five six seven"]
    whole = ngram_sets(texts, 5)
    monkeypatch.setattr(shingles, "AT_ONCE", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, ngram_sets(texts, 5), strict=True))


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1400)] + [(k, k + 1) for k in range(2000, 2040)] + [(7, 7)]
    top = {}

    def find(k):
        top.setdefault(k, k)
        while top[k] != k:
            k = top[k]
        return k

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: find(k) for k in top}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slices_that_begin_with_an_empty_text(spark):
    for texts in ([""], ["", "a b c"], ["", "", "a b c d e f", ""]):
        assert [len(s) for s in ngram_sets(texts, 5)] == [{0: 0, 3: 1, 6: 2}[len(t.split())] for t in texts]
    for first in (None, ""):
        rows = [(0, first), (1, "one two three four five six"), (2, ""), (3, "one two three four five six")]
        found = {r.id: r for r in nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
        assert [found[k].links for k in range(4)] == [0, 1, 0, 1]
