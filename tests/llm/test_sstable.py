import io
import random
import zlib

import numpy as np
import pytest

from tabulon.llm import sstable


def shard(entries) -> io.BytesIO:
    out = io.BytesIO()
    writer = sstable.Writer(out)
    for key, ids in entries:
        writer.add(key, ids)
    writer.finish()
    return out


def test_entries_come_back_and_are_found(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK", 500)
    rng = random.Random(3)
    names = sorted({rng.randint(-(10**12), 10**12) for _ in range(500)})
    entries = [(sstable.key_of(None), np.array([7], "<u4"))] + [(sstable.key_of(n), np.array([rng.randint(0, 70_000) for _ in range(n % 40)], "<u4")) for n in names]
    entries.insert(3, (sstable.key_of(names[1], 1), np.array([1, 2], "<u4")))
    entries.sort(key=lambda e: e[0])
    file = shard(entries)
    reader = sstable.Reader(file)
    assert [(k, v.tolist()) for k, v in reader] == [(k, v.tolist()) for k, v in entries]
    assert len(reader.spans) > 10 and reader.entries == len(entries)
    for key, ids in entries:
        assert any(np.array_equal(ids, x) for x in reader.get(sstable.name_of(key)[0]))
    assert len(reader.get(names[1])) == 2 and reader.get(10**13) == []
    missing = [n for n in range(10**14, 10**14 + 2000) if all(reader.bloom[p >> 3] >> (p & 7) & 1 for p in sstable.probes(sstable.key_of(n)[:-4], reader.bits))]
    assert len(missing) < 60


def test_keys_keep_the_order_of_numbers():
    names = [None, -(2**63), -5, 0, 3, 2**63 - 1]
    keys = [sstable.key_of(n) for n in names]
    assert [sstable.name_of(k)[0] for k in sorted(keys[1:])] == names[1:]
    with pytest.raises(ValueError, match="ascend"):
        shard([(sstable.key_of(2), np.zeros(1, "<u4")), (sstable.key_of(1), np.zeros(1, "<u4"))])


def test_tables(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [f"Text number {k}, it's {k * k}!" for k in range(300)] + ["", "Été 你好", "x" * 5000]
    rows = [(k * 7 % 303, t, "c") for k, t in enumerate(texts)] + [(5, None, "c"), (5, "again", "c"), (None, "first", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)
    shards = sstable.write_tables(df, f"file://{tmp_path}/sst", shards=5)
    listed = spark.createDataFrame(shards.collect(), shards.schema)
    back = sstable.read_tables(listed).orderBy("shard", "ordinal").collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 1]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in back) == sorted((i is None, i or 0, ids(x)) for i, x, _ in rows)
    order = [(-1 if r.doc_id is None else r.doc_id) for r in back]
    assert order == sorted(order)
    assert len(sstable.lookup(listed, [5, 17, 99_999, None]).collect()) == 5
    assert not [p for p in (tmp_path / "sst").iterdir() if p.name.startswith(".shard") and not p.name.endswith(".crc")]


def test_query(spark, tmp_path):
    rows = [(k, "word " * (k % 9)) for k in range(50)] + [(60, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(sstable.op9_sstable(spark, str(tmp_path)).collect())
    at = 0
    for r, (k, text) in zip(found, rows, strict=True):
        n = len((text or "").split()) + 1
        assert (r.doc_id, r.start, r.n_tokens) == (k, at, n)
        at += n
    assert found[0].ids_crc32 == zlib.crc32(np.array([1], "<u4").tobytes())
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert sstable.op9_sstable(spark, str(tmp_path / "e")).count() == 0
