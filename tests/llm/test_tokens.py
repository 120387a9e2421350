import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.llm.prefix_bpe import Growing, TextBpe, decode_ids, encode_texts

EXTRA = ["", " ", "A  b\n\n c\t\td ", "it's 123 I'LL don't \"'s x", "Été 你好世界 \x1c\x00 \x85 x", "<|endoftext|> a", "a" * 3000, " " * 5000 + "x", "café's\n\n\n", "日本語テキスト 한국어 русский", "x　　y   z", "ΣΣ ǅ ß ẞ 1²½"]
TEXT = st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(alphabet="ab 'sre\n1.!é", max_size=60)


@pytest.fixture(scope="module")
def own():
    import public_tokenizers as p

    return TextBpe(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)


@pytest.fixture(scope="module")
def peer():
    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_prefix_encoding_equals_merging(own, peer, text):
    ids = own.encode(text)
    assert ids.tolist() == peer.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", EXTRA)
def test_odd_texts(own, peer, text):
    assert own.encode(text).tolist() == peer.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.data())
def test_edits_are_exact(own, peer, text, data):
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, min(len(text), a + 6)))
    new = data.draw(st.sampled_from(["", " ", "'s", "re", "\n", "x1 ", "é"]))
    after, ids = own.edited(text, own.encode(text), a, b, new)
    assert after == text[:a] + new + text[b:]
    assert ids.tolist() == peer.encode_ordinary(after)


def test_prefix_tables_grow_and_change_near_edits(own):
    data = b"internationalisation of representations " * 40
    g = Growing(own.bpe, data[:100])
    g.append(data[100:])
    assert g.table == own.bpe.prefixes(data) and own.bpe.decode(g.ids()) == data
    computed = g.edit(500, 503, b"XY")
    assert g.table == own.bpe.prefixes(data[:500] + b"XY" + data[503:])
    assert computed < 200


def test_pairs_equal_merging(own):
    rng = random.Random(2)
    ids = list(own.bpe.usable.values())
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert own.bpe.follows(a, b) == (own.bpe.merged(own.bpe.tokens[a] + own.bpe.tokens[b]) == [a, b])


def test_round_trip_as_tables(spark):
    rows = [(k, t) for k, t in enumerate([*EXTRA, None])] + [(0, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("mine"), "data": F.lit(1), "text_": F.lit("x")})
    back = decode_ids(encode_texts(df)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.data)) for r in back) == sorted((i is None, i or 0, (t or "").encode()) for i, t in rows)
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "a ", "It's", "\n", "é", " ", "endoftext"]), max_size=8).map("".join)


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    from tabulon.llm.tokens import ByteBpe, WordBpe, encoder

    byte, word = p.path("byte_bpe_50k.json"), p.path("word_bpe_49k.json")
    return [(encoder(ByteBpe, byte, p.PATTERN), Tokenizer.from_file(byte)), (encoder(WordBpe, word), Tokenizer.from_file(word))]


@settings(max_examples=300, deadline=None)
@given(TEXT | SPECIAL)
def test_fast_encoders_equal_their_library(libraries, text):
    for own, library in libraries:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [*EXTRA, "x<|endoftext|>y <|startoftext|>"])
def test_odd_texts_of_the_library(libraries, text):
    for own, library in libraries:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
