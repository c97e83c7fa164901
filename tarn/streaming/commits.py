"""Commits over several tables: a batch of documents with all that is derived from them becomes visible at once, or not at all.

A store holds tables that share buckets of their key: the documents and what derive makes of them (metric rows, artifacts, rule
verdicts). A commit writes the buckets that its keys fall into anew, in every table, under table/batch=n/bucket=k; nothing that
is there is changed. Last of all it writes commits/n.json, which names for each bucket the batch that holds it; readers take the
newest of these files and open only what it names. So a commit that stops between two tables leaves no trace for readers, one
that runs again writes the same files over its own, and one that is already there changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tarn.sources.store import keep_latest, parsed

BUCKETS, DOCUMENTS = 64, "documents"
#: key, text and version of a document: the columns of the documents table, and of what is committed.
COLUMNS = ("key", "doc_raw", "version")

Derive = dict[str, Callable[[DataFrame], DataFrame]]


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, store: str) -> list[int]:
    fs, where = _files(spark, f"{store}/commits")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, store: str, at: int | None = None) -> dict | None:
    """The newest commit, or the newest up to `at`: batch, buckets (bucket to batch) and schemas; None before the first."""
    known = [n for n in _numbers(spark, store) if at is None or n <= at]
    if not known:
        return None
    return json.loads(spark.read.text(f"{store}/commits/{known[-1]:012d}.json", wholetext=True).first()["value"])


def _publish(spark: SparkSession, store: str, number: int, content: dict) -> None:
    """Writes the manifest under another name and renames it: it is there whole or not at all."""
    fs, final = _files(spark, f"{store}/commits/{number:012d}.json")
    _, draft = _files(spark, f"{store}/commits/.{number:012d}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if not fs.rename(draft, final):
        raise OSError(f"commit {number} could not be published")


def table(spark: SparkSession, store: str, name: str, at: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Rows of a table as the newest commit (or that up to `at`) has them, with their bucket; without a commit, no such table."""
    m = manifest(spark, store, at)
    if m is None:
        raise LookupError("the store has no commit")
    return _named(spark, store, name, m, buckets)


def _named(spark: SparkSession, store: str, name: str, m: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(m["schemas"][name])
    wanted = [(int(k), n) for k, n in m["buckets"].items() if buckets is None or int(k) in buckets]
    # at most one folder for each bucket; a bucket without rows of this table has none
    paths = [f"{store}/{name}/batch={n}/bucket={k}" for k, n in wanted]
    fs, _ = _files(spark, store)
    there = [p for p in paths if fs.exists(_files(spark, p)[1])]
    typed = StructType([*schema.fields]).add("batch", "integer").add("bucket", "integer")
    if not there:
        return spark.createDataFrame([], typed).drop("batch")
    return spark.read.schema(typed).option("basePath", f"{store}/{name}").parquet(*there).drop("batch")


def commit(batch: DataFrame, store: str, number: int, derive: Derive, buckets: int = BUCKETS) -> bool:
    """Commits key, doc_raw and version of batch as commit `number`; False if it, or a later one, is there already.

    Of several versions of a key, in the batch and in the store, the last stays (by version, then by text). Texts that are no
    documents never replace one: they go to the table rejected of their batch alone. derive has a function for each further
    table, from documents (key, doc_raw, version, doc) to rows with the column key; all rows of the buckets touched are derived
    anew from their documents.
    """
    spark = batch.sparkSession
    last = manifest(spark, store)
    if last is not None and last["batch"] >= number:
        return False
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    good, bad = parsed(batch.select(*COLUMNS).where(F.col("key").isNotNull()))
    rows = good.drop("doc").withColumn("bucket", bucket)
    bad.write.mode("overwrite").parquet(f"{store}/rejected/batch={number}")
    touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most `buckets`
    if last is not None:
        rows = rows.unionByName(_named(spark, store, DOCUMENTS, last, touched).select(*COLUMNS, "bucket"))
    schemas = {DOCUMENTS: batch.select(*COLUMNS).schema}
    keep_latest(rows, ["key"], ["version", "doc_raw"]).select(*COLUMNS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/{DOCUMENTS}/batch={number}")
    new = {"batch": number, "buckets": {**(last["buckets"] if last else {}), **{str(k): number for k in touched}}, "schemas": {DOCUMENTS: json.loads(schemas[DOCUMENTS].json())}}
    docs, _ = parsed(_named(spark, store, DOCUMENTS, new, touched).drop("bucket"))
    for name, make in derive.items():
        made = make(docs)
        made.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/{name}/batch={number}")
        new["schemas"][name] = json.loads(made.schema.json())
    _publish(spark, store, number, new)
    return True


def follow(spark: SparkSession, source: str, schema: StructType, store: str, checkpoint: str, derive: Derive, buckets: int = BUCKETS, files: int = 100) -> StreamingQuery:
    """Streams Parquet files of key, doc_raw and version under source into commits, one for each batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(lambda b, n: commit(b, store, n, derive, buckets) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def prune(spark: SparkSession, store: str) -> int:
    """Drops what the newest commit does not name, and older commits; no reader of these and no commit may be running. Returns how many folders went."""
    m = manifest(spark, store)
    if m is None:
        return 0
    fs, root = _files(spark, store)
    gone = 0
    for name in m["schemas"]:
        _, where = _files(spark, f"{store}/{name}")
        for b in fs.listStatus(where) if fs.exists(where) else []:
            number = b.getPath().getName()
            for k in fs.listStatus(b.getPath()) if number.startswith("batch=") else []:
                place = k.getPath().getName()
                if place.startswith("bucket=") and m["buckets"].get(place[7:]) != int(number[6:]):
                    gone += bool(fs.delete(k.getPath(), True))
    for n in _numbers(spark, store):
        if n < m["batch"]:
            fs.delete(_files(spark, f"{store}/commits/{n:012d}.json")[1], False)
    return gone
