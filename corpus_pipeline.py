"""From raw documents to a token store: rules, near-duplicates, decontamination, mixing, token ids.

Every stage takes what its predecessor kept and returns the columns of documents, the last one the store's digest. A null text counts as an empty one
and fails the quality rules; rows that repeat stay rows until the near-duplicate stage keeps one of them; texts are taken whole; further columns of
documents pass through to the mixing stage, whose repetitions carry them too. Empty input gives an empty store.
"""

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import decontam, minhash, mixing, quality_rules, store
from tarn.llm.common import shared_folder, table, tokenizer_path
from tarn.sources.store import delete_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; null doc_ids are kept only where no other of the group has one."""
    return minhash.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no contaminating share of benchmark passages."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, whole and in part, as their sources' targets ask; a null source is a source."""
    return mixing.repeat_documents(docs)


def stored(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the token store, read back and verified."""
    found = store.store_documents(docs, tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks")


STAGES = [("quality rules", good), ("near duplicates", distinct), ("decontamination", clean), ("mixing", mixed), ("token store", stored)]

#: The stages sample, align and tokenize, which SQL cannot express; tests/llm/test_pipeline.py holds run() against its parts and the library's ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each is written, and what it was made from is deleted once it is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return docs
