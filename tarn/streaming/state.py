"""Keep-latest as keyed state of a stream: the last row of each key lives in the state store, and rows of an older version are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tarn.sources.store import keep_latest


class Latest(StatefulProcessor):
    """Holds one row for each key. A row whose version (columns in order, null before all) is above the held one's replaces it and goes on; others end here."""

    def __init__(self, schema: StructType, version: list[str]):
        self.schema, self.at = schema, [schema.fieldNames().index(v) for v in version]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.schema)

    def rank(self, row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) if row[i] is not None else (False,) for i in self.at)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best = tuple(self.held.get()) if self.held.exists() else None
        newest = best
        for row in rows:
            if newest is None or self.rank(tuple(row)) > self.rank(newest):
                newest = tuple(row)
        if newest is not best:
            self.held.update(newest)
            yield Row(**dict(zip(self.schema.fieldNames(), newest)))

    def close(self) -> None:
        pass


def latest_of(stream: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The rows of a stream that were the last of their key when they came. Rows of one version are told apart by neither: the first that came stays."""
    return stream.groupBy(*key).transformWithState(Latest(stream.schema, version), stream.schema, "Update", "None")


def follow(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, key: list[str], version: list[str], files: int = 100) -> StreamingQuery:
    """Streams Parquet files under source through the state; each batch's new last rows go to sink/batch=n, written again alike if the batch is.

    The state lives in RocksDB on the executors' disks, with its changes in the checkpoint folder: set for this stream alone, in a session of its own.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    out = latest_of(stream, key, version).writeStream.outputMode("update")
    return out.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{sink}/batch={n}") and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, schema: StructType, sink: str, key: list[str], version: list[str]) -> DataFrame:
    """The last row of each key so far: what the stream sent on for a key later is newer, so these are few rows a key."""
    return keep_latest(spark.read.schema(schema).parquet(f"{sink}/batch=*"), key, version).select(*schema.fieldNames())
