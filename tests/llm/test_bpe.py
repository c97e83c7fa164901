"""Byte-level BPE by a written model against the library of the rank files, round trips, edge rows."""

import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tarn.llm import bpe, queries

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def unpacked(b):
    return list(memoryview(bytes(b)).cast("I"))


def hard_texts():
    rnd = random.Random(5)
    points = lambda: rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000), 32, 10, 39, 115])
    return ["".join(chr(points()) for _ in range(200)) for _ in range(300)] + [
        "", " ", "\n\n \t x", "  　 ", "I'll've 's 'S don't 're'", "a\x1fb \x85 x　y<|endoftext|>", "9" * 30_000, "ab" * 20_000, " " * 3_000 + "x", "日本語のテキスト。", "\U0001f600\U0001f600 x", "\x00\x01",
    ]


def test_model_gives_each_token_its_rank():
    c, ranks = bpe.codec(RANKS, P.PATTERN), bpe.read_ranks(RANKS)
    # merges alone reach every token of this vocabulary, so none depends on being looked up whole
    assert all(c.model.encode(t.decode("latin-1").translate(c.shown)) == [r] for t, r in ranks.items())
    assert c.model.get_piece_size() == len(ranks) + 1 and c.model.unk_id() == len(ranks)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_and_bytes(name):
    path = P.path(name)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    c = bpe.Codec(path, P.PATTERN)
    for t in hard_texts():
        packed = c.encode(t)
        assert unpacked(packed) == lib.encode_ordinary(t)
        assert c.decode(packed) == t.encode()


def test_pattern_follows_the_library(library):
    every = " ".join(chr(p) for p in [*range(0x3000), *range(0xA000, 0xB000), *range(0x10000, 0x13000), *range(0x1D000, 0x1F800)])
    c = bpe.codec(RANKS, P.PATTERN)
    assert unpacked(c.encode(every)) == library.encode_ordinary(every)
    assert unpacked(c.encode(every.replace(" ", "a"))) == library.encode_ordinary(every.replace(" ", "a"))


def test_memory_is_emptied(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    c = bpe.Codec(RANKS, P.PATTERN)
    text = "one two three four five six one two"
    assert unpacked(c.encode(text)) == library.encode_ordinary(text) and len(c) <= 3


def expected(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    return (doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_query_on_edges(spark, tmp_path, library):
    rows = [(None, "x y"), (1, None), (2, ""), (3, "same"), (3, "same"), (9007199254740993, "big id"), *enumerate(hard_texts(), 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("text_bytes", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_byte_bpe(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected(library, *r)) for r in rows)


def test_query_on_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op13_byte_bpe(spark, SF).collect())) == sorted(expected(library, *r) for r in docs)


def test_slices_and_separate_steps_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumn("doc_id", F.col("doc_id").cast("string")).persist()
    apart = bpe.decode_documents(bpe.encode_documents(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    monkeypatch.setattr(bpe, "SLICE", 3000)
    assert sorted(map(tuple, bpe.code_documents(docs, RANKS, P.PATTERN).collect())) == sorted(map(tuple, apart.collect()))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert bpe.code_documents(none, RANKS, P.PATTERN).collect() == []
    assert bpe.decode_documents(bpe.encode_documents(none, RANKS, P.PATTERN), RANKS, P.PATTERN).collect() == []


def test_unknown_ids_and_ranks_are_refused(spark):
    df = spark.createDataFrame([(1, bytearray(struct.pack("<I", 60_000))), (2, None)], "doc_id long, ids binary")
    assert bpe.decode_documents(df.where("doc_id = 2"), RANKS, P.PATTERN).first().text_bytes is None
    with pytest.raises(Exception, match="IndexError"):
        bpe.decode_documents(df, RANKS, P.PATTERN).collect()
    with pytest.raises(ValueError, match="not 0, 1, 2"):
        bpe.model_bytes({b"a": 0, b"b": 2})
    with pytest.raises(ValueError, match="a byte has no rank"):
        bpe.model_bytes({b"a": 0, b"b": 1})
