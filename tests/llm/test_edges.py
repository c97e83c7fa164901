"""Ids beside nulls, repeated ids, texts without boundaries, large sides of joins, the pipeline on edge rows."""

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import common, decontam, mixing, store, tokens
from tarn.llm.common import tokenizer_path

BPE = tokenizer_path("byte_bpe_50k.json")


def test_store_keeps_large_ids_beside_nulls(spark):
    ids = [9007199254740993, 9007199254740995, None, 2]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    assert [r.doc_id for r in sorted(store.store_documents(df, BPE).collect(), key=lambda r: r.start)] == [None, 2, 9007199254740993, 9007199254740995]


def test_store_takes_ids_of_other_types(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), (None, "z")], "doc_id string, text string")
    assert [r.doc_id for r in sorted(store.store_documents(df, BPE).collect(), key=lambda r: r.start)] == [None, "a", "b"]


def test_store_refuses_ids_that_do_not_fit(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(Exception, match="wide=True"):
        store.write_store(df, str(tmp_path / "a"), BPE, end_id=1 << 16)
    store.write_store(df, str(tmp_path / "b"), BPE, end_id=1 << 16, wide=True)
    r = store.read_store(spark, str(tmp_path / "b"), wide=True).collect()[0]
    ids = common.encoder(BPE).tokenizer.encode("x", add_special_tokens=False).ids
    assert r.ids_crc32 == zlib.crc32(np.array([*ids, 1 << 16], "<u4").tobytes())


def test_fits_take_one_row_of_each_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "a"), (3, None)], "doc_id long, text string").withColumn("_label", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1), (2, None)], "doc_id long, y int")
    got = [(r.doc_id, r._label) for r in common.labelled_sample(docs, labels, "y", 10).collect()]
    assert sorted(got) == [(1, 1), (2, 0), (3, 1)]
    assert common.labelled_sample(docs, labels, "y", 2).count() == 2


def test_texts_without_a_boundary_cost_little_more_than_whole(spark):
    e = common.encoder(BPE).tokenizer
    text = "x" * 300_000
    t0 = time.process_time()
    want = len(e.encode(text, add_special_tokens=False).ids)
    t1 = time.process_time()
    got, chunks = tokens.count_by_chunks(e, text, 10_000, 512)
    assert got == want and chunks > 1 and time.process_time() - t1 < 25 * (t1 - t0) + 1


def test_chunks_are_those_encoded(spark):
    df = spark.createDataFrame([(1, "word " * 40_000), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_chunks for r in tokens.count_tokens(df, BPE).collect()}
    assert got[1] == 4 and got[2] == got[3] == 1


def test_decontamination_without_broadcasts_gives_the_same(spark, monkeypatch):
    docs, bench = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted(map(tuple, decontam.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect())) == one


def test_many_items_of_one_text(spark):
    words = [f"w{i}" for i in range(20)]
    bench = spark.createDataFrame([(i, " ".join(words)) for i in range(300)] + [(1000, "w3"), (1001, "w3 w4")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(["a", *words, "b"])), (2, "w3"), (3, "no")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(docs, bench).collect()}
    assert got == {1: (22, 20, 302), 2: (1, 1, 1), 3: (1, 0, 0)}


def test_mixing_with_many_sources_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = sorted(map(repr, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(repr, mixing.mix(docs).collect())) == one


@pytest.mark.parametrize("rows", [0, 1])
def test_pipeline_on_edge_rows(spark, tmp_path, rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    edge = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0), (7, "", "en", None, 0), (8, "x " * 9000, "en", "s", 18_000)], docs.schema)
    (edge if rows else edge.where("1 = 0")).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # all are too short or repeat themselves
    assert out == []


def test_items_without_an_id_count_as_one(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "x alpha beta gamma"), (2, "gamma delta"), (3, "one")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "alpha beta"), (None, "gamma delta"), ("i", "beta gamma"), ("j", None)], "item_id string, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, items).collect()}
    assert {d: (r.n_hit, r.n_items, r.contaminated, r.items_sha256) for d, r in got.items()} == {
        1: (3, 2, True, hashlib.sha256(b"i").hexdigest()), 2: (2, 1, True, hashlib.sha256(b"").hexdigest()), 3: (0, 0, False, hashlib.sha256(b"").hexdigest()),
    }
