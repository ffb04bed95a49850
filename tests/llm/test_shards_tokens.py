import zlib

import pytest
from plain import ODD, table_of

from pulseline.llm import shards, tokens
from pulseline.llm.common import table
from pulseline.llm.queries import QUERIES, tokenizer_file


def laws(frame, n_rows, n_shards):
    counts = frame.groupby("shard").size().reindex(range(n_shards), fill_value=0)
    assert counts.sum() == n_rows and counts.max() - counts.min() <= 1
    for _, own in frame.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_sharding_query(spark, folder):
    got = QUERIES["op2_sharding"](spark, folder).toPandas()
    docs = table(spark, folder, "documents").toPandas()
    laws(got, len(docs), 40)
    want = {(r.doc_id, len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for r in docs.itertuples()}
    assert set(zip(got["doc_id"], got["size"], got["text_crc32"])) == want
    by_id = got.sort_values(["shard", "slot"])["doc_id"].tolist()
    assert by_id != sorted(by_id)


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 20_000])
def test_shards_of_odd_rows(spark, bucket_bytes):
    docs = table_of(spark, ODD)
    out = shards.write_shards(docs, 5, bucket_bytes=bucket_bytes)
    laws(out.toPandas(), len(ODD), 5)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "", r["text"] is None)
    assert sorted((key(r["record"]) for r in out.collect())) == sorted(key(r) for r in docs.collect())
    assert shards.digests(out).where("size = 16").count() == 4


def test_shards_are_the_same_for_any_input_order(spark):
    rows = [(i, f"text {i}" * (i % 9), "a") for i in range(300)]
    one = shards.digests(shards.write_shards(table_of(spark, rows), 7, bucket_bytes=4_000))
    two = shards.digests(shards.write_shards(table_of(spark, rows[::-1]).repartition(3), 7, bucket_bytes=4_000))
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)


def test_shards_of_many_equal_rows(spark):
    rows = [(1, "the same text again", "a")] * 2_000 + [(i, f"own text {i}", "a") for i in range(100)]
    out = shards.write_shards(table_of(spark, rows).repartition(4), 3, bucket_bytes=8_000)
    laws(out.toPandas(), len(rows), 3)


def test_no_rows(spark):
    docs = table_of(spark, [])
    assert shards.write_shards(docs, 4).count() == 0
    assert tokens.token_counts(docs, tokenizer_file()).count() == 0


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_token_counts_query(spark, folder):
    got = QUERIES["op3_token_counts"](spark, folder).toPandas().set_index("doc_id")
    docs = table(spark, folder, "documents").toPandas()
    for doc_id, e in zip(docs["doc_id"], library().encode_batch(docs["text"].tolist(), add_special_tokens=False)):
        assert got.loc[doc_id, "n_tokens"] == len(e.ids)
        assert got.loc[doc_id, "over_limit"] == (len(e.ids) > 1024)


def test_token_counts_of_odd_rows(spark):
    got = tokens.token_counts(table_of(spark, ODD), tokenizer_file()).collect()
    assert len(got) == len(ODD)
    want = sorted((len((t or "").encode()), len(library().encode(t or "", add_special_tokens=False).ids)) for _, t, _ in ODD)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want


def test_all_characters_count_as_in_the_library():
    counter, lib = tokens.Counter(tokens.vocabulary(tokenizer_file())), library()
    texts = ["".join(chr(c) + "a1 " for c in range(s, min(s + 301, 0x110000)) if not 0xD800 <= c < 0xE000) for s in range(0, 0x110000, 301)]
    texts += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "a" * 999, " " * 70 + "x  \n\n y", "aaab" * 300]
    assert counter.count(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_text_longer_than_a_batch(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_CHARS", 50)
    monkeypatch.setattr(tokens, "CHUNK", 7)
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    text = "The quick brown fox, 12 345 jumps!  Over\n\n" * 20
    counter = tokens.Counter(tokens.vocabulary(tokenizer_file()))
    assert counter.count([text, "short", text]) == [len(library().encode(t).ids) for t in (text, "short", text)]
