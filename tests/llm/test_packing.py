import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.llm.packing import Example, Limits, Packer, masked_ids, pack, pack_conversations, pack_texts, packed

SCHEMA = "doc_id long, text string"


def layout(rows, limits=Limits()):
    """Checks sequences and gives (tokens, padding)."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    tokens = padding = 0
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert 0 < at <= limits.tokens and len(own) <= limits.segments and sum(r.loss_tokens for r in own) <= limits.loss
        tokens += at
        padding += limits.tokens - at if at & (at - 1) else 0
    return tokens, padding


def test_every_id_lies_in_one_piece(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["", None, "a", "word " * 5000, "Été\n\n你好  x", "<|endoftext|>", "a" * 3000] + [f"some text number {k} " * (k % 60) for k in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("sequence_id", F.lit("clash")).repartition(3)
    rows = pack_texts(df).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for k, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by[k], key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == ids
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    tokens, padding = layout(rows)
    assert padding < 0.02 * tokens


def test_ties_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, "q")], SCHEMA)
    assert sorted((r.doc_id is None, r.length) for r in pack_texts(df).collect()) == [(False, 4), (False, 4), (True, 2)]
    assert pack_texts(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 100)), max_size=80), st.integers(16, 128), st.integers(1, 6), st.integers(8, 128))
def test_limits_hold_at_once(given_, tokens, segments, loss):
    limits = Limits(tokens=tokens, segments=segments, loss=loss, window=16, min_cut=2, waste=4)
    documents = [(k, (np.arange(n), np.arange(n) % 100 < share)) for k, (n, share) in enumerate(given_)]
    seen, sums = defaultdict(list), defaultdict(lambda: [0, 0, 0])
    for number, _, piece, whole, last in packed(documents, limits):
        seen[piece.doc] += list(whole[piece.start : piece.stop])
        own = sums[number]
        own[0] += len(piece)
        own[1] += 1
        own[2] += piece.losses()
    assert all(a <= tokens and b <= segments and c <= loss for a, b, c in sums.values())
    for k, (n, _) in enumerate(given_):
        assert sorted(seen[k]) == list(range(n))


def test_dot_product_takes_the_fullest(spark):
    packer = Packer(Limits(tokens=10, segments=4, loss=10, window=8, waste=10))
    for k, n in enumerate((2, 7, 3, 5)):
        assert list(packer.add(Example(k, 0, n))) == []
    assert [e.doc for e in next(packer.finish())][0] == 1


def test_masks_and_conversations(spark):
    df = spark.createDataFrame([(1, [5, 6, 7], [True, False, True]), (2, [9], None), (3, None, None)], "doc_id long, ids array<int>, mask array<boolean>")
    losses = defaultdict(int)
    for r in pack(df, masked_ids("ids", "mask"), ["ids", "mask"]).collect():
        losses[r.doc_id] += r.loss_tokens
    assert losses == {1: 2, 2: 1}
    talk = spark.createDataFrame([(1, 2, "assistant", "yes it is"), (1, 1, "user", "is it"), (2, 1, None, None)], "conv_id long, turn long, role string, text string")
    made = defaultdict(lambda: [0, 0])
    for r in pack_conversations(talk).collect():
        made[r.conv_id][0] += r.loss_tokens
        made[r.conv_id][1] += r.length
    assert made == {1: [4, 7], 2: [0, 1]}


@pytest.mark.parametrize("limit", ["tokens", "segments", "loss", "window"])
def test_limits_of_zero_are_errors(limit):
    with pytest.raises(ValueError, match="limit"):
        Limits(**{limit: 0})


def test_empty_examples_other_ids_and_bad_masks(spark):
    df = spark.createDataFrame([("a", [], []), ("b", [1, 2], [True, False]), (None, [3], None)], "name string, ids array<int>, mask array<boolean>")
    found = pack(df, masked_ids("ids", "mask"), ["ids", "mask"], "name")
    assert sorted((r.doc_id or "", list(r.ids), r.loss_tokens) for r in found.collect()) == [("", [3], 1), ("b", [1, 2], 1)]
    small = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    assert sorted((r.doc_id, r.start + k) for r in pack_texts(small).collect() for k in range(r.length)) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    with pytest.raises(ValueError, match="mask"):
        list(masked_ids("ids", "mask")({"ids": [[1, 2]], "mask": [[True]]}))


def test_long_conversations_are_streamed(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(7, k, "assistant" if k % 2 else "user", f"turn {k} " * 30) for k in range(300)] + [(None, 1, "user", "x"), (None, 1, "user", "x"), (8, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = pack_conversations(df, stretch=500).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for conv in (7, 8):
        ids = [x for c, _, _, text in rows if c == conv for x in [*t.encode(text, add_special_tokens=False).ids, 1]]
        own = sorted((r for r in found if r.conv_id == conv), key=lambda r: (r.turn, r.start))
        assert [x for r in own for x in r.ids] == ids
        assert sum(r.loss_tokens for r in own) == sum(len(t.encode(text, add_special_tokens=False).ids) + 1 for c, _, role, text in rows if c == conv and role == "assistant")
        assert max(r.doc_tokens for r in own) < 700
    assert [sum(n) for n in zip(*((r.length, r.loss_tokens) for r in found if r.conv_id is None), strict=True)] == [4, 0]
    assert pack_conversations(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    """op1 over a whole table: the library's ids, each in one piece, gapless sequences, little padding."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tabulon.llm.packing import op1_packing

    folder = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op1_packing(spark, folder).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for k, text in texts.items():
        ids, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    tokens, padding = layout(rows)
    assert padding < 0.02 * tokens
