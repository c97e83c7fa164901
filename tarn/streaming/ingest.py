"""Incremental ingestion: files that arrive are upserted by key, each once; a batch rewrites the buckets it touches alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from tarn.sources.store import keep_latest

BUCKETS = 64


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")


def versions(spark: SparkSession, schema: StructType, store: str, before: int | None = None) -> DataFrame:
    """Rows with bucket and batch of the last version of each bucket, of batches under `before` if it is given.

    Which version is last is a row for each bucket; the files of older ones are not opened.
    """
    typed = StructType([*schema.fields, StructField("batch", IntegerType()), StructField("bucket", IntegerType())])
    every = spark.read.schema(typed).option("basePath", store).parquet(f"{store}/batch=*")
    if before is not None:
        every = every.where(F.col("batch") < before)
    last = {r["bucket"]: r["batch"] for r in every.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}
    if not last:
        return every.where(F.lit(False))
    return every.where(F.struct("bucket", "batch").isin([F.struct(F.lit(k).alias("bucket"), F.lit(v).alias("batch")) for k, v in last.items()]))


def current(spark: SparkSession, schema: StructType, store: str) -> DataFrame:
    """All keys of the store, each in its last version."""
    return versions(spark, schema, store).drop("batch", "bucket")


def ingest(spark: SparkSession, source: str, schema, store: str, checkpoint: str, key: list[str], version: list[str], buckets: int = BUCKETS, files: int = 100) -> StreamingQuery:
    """Streams Parquet files under source into store/batch=n/bucket=k; current() reads it.

    A batch merges the buckets that its keys fall into with their last versions. One that runs twice writes the same
    files again, from the batches before it.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        session, columns = batch.sparkSession, batch.columns
        rows = batch.withColumn("bucket", _bucket(key, buckets))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        if number:
            old = versions(session, batch.schema, store, number).where(F.col("bucket").isin(touched)).drop("batch")
            rows = rows.unionByName(old.select(*columns, "bucket"))
        keep_latest(rows, key, version).select(*columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def prune(spark: SparkSession, store: str) -> int:
    """Drops the versions of buckets that newer ones replace; no batch may be running. Returns how many."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = paths.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(int(p.getParent().getName()[6:]), int(p.getName()[7:]), p) for b in fs.listStatus(root) if b.getPath().getName().startswith("batch=") for p in (x.getPath() for x in fs.listStatus(b.getPath())) if p.getName().startswith("bucket=")]
    last: dict[int, int] = {}
    for batch, bucket, _ in found:
        last[bucket] = max(batch, last.get(bucket, batch))
    old = [p for batch, bucket, p in found if batch < last[bucket]]
    for p in old:
        fs.delete(p, True)
    return len(old)
