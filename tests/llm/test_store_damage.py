"""Damage between the links of the Merkle chain: a recipe's chunk list, and a whole recipe file."""

import shutil

import pytest
from pyspark.sql import functions as F

from tarn.llm import store
from tarn.llm.common import tokenizer_path

BPE = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("s") / "store"
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{k}" for k in range(900))) for i in range(8)], "doc_id long, text string")
    store.write_store(docs, str(at), BPE)
    return at


def damaged(spark, folder, tmp_path, **changes):
    """A copy of the store with tables changed."""
    at = tmp_path / "bad"
    shutil.copytree(folder, at)
    for name, change in changes.items():
        df = spark.read.parquet(str(folder / name))
        shutil.rmtree(at / name)
        change(df).write.parquet(str(at / name))
    return str(at)


def test_undamaged_store_reads(spark, folder):
    assert store.read_store(spark, str(folder)).count() == 8


def test_swapped_chunks_are_found(spark, folder, tmp_path):
    n = store.KEY_BYTES
    swap = F.expr(f"concat(substring(chunks, {n + 1}, {n}), substring(chunks, 1, {n}), substring(chunks, {2 * n + 1}))")
    at = damaged(spark, folder, tmp_path, recipes=lambda df: df.withColumn("chunks", F.when(F.length("chunks") > n, swap).otherwise(F.col("chunks"))))
    with pytest.raises(Exception, match="does not give its root"):
        store.read_store(spark, at).collect()


def test_a_recipe_file_lost_with_its_manifest_row_is_found(spark, folder, tmp_path):
    file = spark.read.parquet(str(folder / "manifest")).agg(F.max("file")).first()[0]
    at = damaged(spark, folder, tmp_path, recipes=lambda df: df.where(F.col("file") != file), manifest=lambda df: df.where(F.col("file") != file))
    with pytest.raises(ValueError):
        store.read_store(spark, at)
