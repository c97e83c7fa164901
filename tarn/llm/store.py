"""Content-addressed store of token ids.

Each text is encoded once; a rolling hash over the last ids cuts the stream into chunks whose places depend on
content alone, so copies and near copies share chunks. A chunk is stored once, under its hash; a document's
recipe lists its chunks; recipes stand in files in ascending doc_id order, and a Merkle manifest (chunk hashes,
document roots, file roots, the store's root) lets a reader verify everything it gets back.

Layout: objects/kind=0 chunks (key, value), objects/kind=1 recipes as encoded, recipes (ordered, with start and
root), manifest (a root for each recipe file), top (the store's root over the file roots, with counts and sum of ids).

Null and empty texts hold the end id alone; null doc_ids come first; rows that repeat each have a recipe, and
share its chunks; an empty table makes an empty store.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, shared_folder

#: Chunk lengths in ids: cut where 9 bits of the rolling hash over the last 8 ids are 0, within these bounds.
LEAST, MOST, CUT_BITS, BACK = 128, 4096, 9, 8
KEY_BYTES = 16
#: Keys that a task remembers to have sent already; the rest is left to the aggregation.
SEEN = 100_000
#: Documents of a recipe file, about.
FILE_DOCS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    with np.errstate(over="ignore"):
        t = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        t ^= t >> np.uint64(29)
        h = np.zeros(n - BACK + 1, np.uint64)
        for k in range(BACK):
            h = h * _MIX + t[k : k + len(h)]
    at = np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + BACK
    out, last = [], 0
    for a in at.tolist():
        while a - last > MOST:
            last += MOST
            out.append(last)
        if a - last >= LEAST and a < n:
            out.append(a)
            last = a
    while n - last > MOST:
        last += MOST
        out.append(last)
    return [*out, n]


def encode_objects(docs: DataFrame, tokenizer: str, end_id: int, wide: bool) -> DataFrame:
    """kind 0: a chunk (key, value); kind 1: a recipe (key unique to its row, doc_id, n ids, value the chunk keys)."""
    kind, end = "<u4" if wide else "<u2", struct.pack("<I", end_id)

    def encode(batches):
        enc, part, row, seen = encoder(tokenizer), TaskContext.get().partitionId(), 0, set()
        if not wide and max(enc.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16:
            raise ValueError("ids of this tokenizer need wide=True")
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                ids = np.frombuffer(enc.packed(text or "") + end, "<u4").astype(kind)
                raw, width, last, keys = ids.tobytes(), ids.itemsize, 0, []
                for b in cuts(ids):
                    piece = raw[last * width : b * width]
                    last = b
                    key = hashlib.blake2b(piece, digest_size=KEY_BYTES).digest()
                    keys.append(key)
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        out.append((0, key, None, 0, piece))
                out.append((1, struct.pack(">IQ", part, row), None if pd.isna(doc_id) else doc_id, len(ids), b"".join(keys)))
                row += 1
            yield pd.DataFrame(out, columns=["kind", "key", "doc_id", "n", "value"])

    # doc_ids travel as strings: pandas would make floats of whole numbers beside nulls
    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(encode, "kind int, key binary, doc_id string, n long, value binary")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, wide: bool = False) -> None:
    """Writes the store under folder. wide: ids of 32 bits, for vocabularies over 65,536."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    objects = encode_objects(docs, tokenizer, end_id, wide).groupBy("kind", "key").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("value").alias("value"))
    objects.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/objects")
    raw = spark.read.schema(f"key binary, doc_id {id_type}, n long, value binary, kind int").parquet(f"{folder}/objects").where("kind = 1")
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), raw.count() // FILE_DOCS)
    placed = raw.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.col("key")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
    placed.select(F.spark_partition_id().alias("file"), "doc_id", "key", "n", "value").write.parquet(f"{folder}/placed")
    placed = spark.read.schema(f"file int, doc_id {id_type}, key binary, n long, value binary").parquet(f"{folder}/placed")
    # words before a file: a sum over the files, of which there are few; within a file a window
    totals = placed.groupBy("file").agg(F.sum("n").alias("_n"))
    base = totals.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_base"))
    w = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "key")
    recipes = placed.join(F.broadcast(base), "file").select(
        "file", F.row_number().over(w).alias("place"), "doc_id", (F.col("_base") + F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
        F.col("n").alias("n_tokens"), F.sha2("value", 256).alias("root"), F.col("value").alias("chunks"),
    )
    recipes.sortWithinPartitions("file", "place").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    roots = spark.read.parquet(f"{folder}/recipes").groupBy("file").agg(file_root().alias("root"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    roots.write.parquet(f"{folder}/manifest")
    spark.read.schema(roots.schema).parquet(f"{folder}/manifest").agg(*store_root()).write.parquet(f"{folder}/top")


def store_root() -> list:
    """Root over the manifest's file roots in order, files, documents and ids of the whole store: a row of the manifest stands for a recipe file."""
    in_order = F.array_sort(F.collect_list(F.struct("file", "root", "n_docs", "n_tokens")))
    lines = F.transform(in_order, lambda x: F.concat_ws(":", x["file"].cast("string"), x["root"], x["n_docs"].cast("string"), x["n_tokens"].cast("string")))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_tokens")]
    return [F.sha2(F.concat_ws(",", lines).cast("binary"), 256).alias("root"), F.count("*").alias("n_files"), *sums]


def file_root():
    """Hash over a recipe file's document roots in order."""
    in_order = F.array_sort(F.collect_list(F.struct("place", "doc_id", "start", "n_tokens", "root")))
    return F.sha2(F.concat_ws(",", F.transform(in_order, lambda x: F.concat_ws(":", F.coalesce(x["doc_id"].cast("string"), F.lit("")), x["start"].cast("string"), x["n_tokens"].cast("string"), x["root"]))).cast("binary"), 256)


_POLY, _POWERS = 0xEDB88320, {}


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reflected."""
    out, m = 0, 1 << 31
    while a:
        if a & m:
            out ^= b
            a ^= m
        m >>= 1
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1
    return out


def crc_shift(n_bytes: int) -> int:
    """x to the power of 8 n modulo the polynomial."""
    if n_bytes not in _POWERS:
        out, square, n = 1 << 31, 1 << 23, n_bytes
        while n:
            if n & 1:
                out = _times(out, square)
            square, n = _times(square, square), n >> 1
        _POWERS[n_bytes] = out
    return _POWERS[n_bytes]


def crc_joined(parts) -> int:
    """CRC-32 of a concatenation from (crc, bytes) of its parts."""
    out = 0
    for crc, n in parts:
        out = _times(crc_shift(n), out) ^ crc
    return out


def read_store(spark: SparkSession, folder: str, wide: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, root of each document, rebuilt from the files and verified.

    A chunk whose bytes do not give its key, a recipe whose chunk list does not give its root or whose chunks are missing
    or of another length, a recipe file that does not give its root, documents and ids in the manifest, or a manifest
    that does not give the store's root raises an error.
    """
    kind = "<u4" if wide else "<u2"

    @F.pandas_udf("ok boolean, n long, crc long")
    def digest(keys: pd.Series, values: pd.Series) -> pd.DataFrame:
        ids = [np.frombuffer(v, kind) for v in values]
        return pd.DataFrame({
            "ok": [hashlib.blake2b(v, digest_size=KEY_BYTES).digest() == bytes(k) for k, v in zip(keys, values)],
            "n": [len(x) for x in ids], "crc": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
        })

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([crc_joined((x["crc"], 4 * x["n"]) for x in p) for p in parts], dtype="int64")

    objects = spark.read.schema("key binary, value binary, kind int").parquet(f"{folder}/objects")
    chunks = objects.where("kind = 0").select("key", digest("key", "value").alias("_d")).select("key", F.when(F.col("_d.ok"), F.col("_d.n")).otherwise(F.raise_error(F.lit("a chunk is damaged"))).alias("n"), "_d.crc")
    recipes = spark.read.parquet(f"{folder}/recipes")
    roots = spark.read.parquet(f"{folder}/manifest")
    if [tuple(r) for r in roots.agg(*store_root()).collect()] != [tuple(r) for r in spark.read.parquet(f"{folder}/top").collect()]:
        raise ValueError("the manifest does not match the store's root")
    now = recipes.groupBy("file").agg(file_root().alias("now"), F.count("*").alias("docs_now"), F.sum("n_tokens").alias("ids_now"))
    same = F.col("now").eqNullSafe(F.col("root")) & F.col("docs_now").eqNullSafe(F.col("n_docs")) & F.col("ids_now").eqNullSafe(F.col("n_tokens"))
    wrong = now.join(roots, "file", "full").where(~same).count()
    if wrong:
        raise ValueError(f"{wrong} recipe files do not match the manifest")
    proved = F.when(F.sha2("chunks", 256) == F.col("root"), F.col("root")).otherwise(F.raise_error(F.lit("a recipe's chunk list does not give its root")))
    refs = recipes.withColumn("root", proved).select("file", "place", "doc_id", "start", "n_tokens", "root", F.expr(f"posexplode(transform(sequence(0, length(chunks) div {KEY_BYTES} - 1), i -> substring(chunks, i * {KEY_BYTES} + 1, {KEY_BYTES})))").alias("pos", "key"))
    got = refs.join(chunks, "key", "left").groupBy("file", "place", "doc_id", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc"))).alias("parts"))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return got.select(
        "doc_id", "start", F.when(total == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe's chunks are missing"))).alias("n_tokens"),
        joined("parts").alias("ids_crc32"), F.size("parts").cast("long").alias("n_chunks"), "root",
    )


def store_documents(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs to a new store in the shared folder and reads it back."""
    folder = shared_folder(docs.sparkSession)
    write_store(docs, folder, tokenizer, end_id)
    return read_store(docs.sparkSession, folder)
