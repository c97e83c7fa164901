"""One query for each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, licenses, minhash, mixing, pii, quality_classifier, quality_rules, repeats, store, tokens, toxicity, whitening
from .common import split_pattern, table, tokenizer_path


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "exact_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.store_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", F.col("kept").cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.find_runs(repeats.planted(table(spark, sf_dir, "documents"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    each = found.select(F.col("id").alias("vec_id"), "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("v").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("k")).alias("explained"), "identity_error")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.code_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern())
    return found.select("doc_id", F.octet_length("ids").cast("long").alias("_bytes"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text_bytes", 256).alias("decoded_sha256")).select(
        "doc_id", F.expr("_bytes div 4").alias("n_tokens"), "ids_sha256", "decoded_sha256"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_order_minhash, op4_pii, op5_decontamination, op6_token_store, op7_quality_rules, op8_mixing, op9_quality_classifier, op10_toxicity, op11_periodic_runs, op12_whitening, op13_byte_bpe)}


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_W}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_W}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT rid, i, grams.n, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '?') || '|' || md5(coalesce(text, ''))) AS o
  FROM documents
),
s AS (
  SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
),
-- each step clamps the sources whose cap the level reaches and spreads the rest
steps AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS level
  UNION ALL
  SELECT k + 1, (SELECT (sum(source_size) - coalesce(sum(CASE WHEN 3 * source_size <= level * weight THEN 3 * source_size END), 0))::DOUBLE
    / sum(CASE WHEN 3 * source_size <= level * weight THEN NULL ELSE weight END) FROM s) FROM steps WHERE k < 40
),
t AS (SELECT *, least(CAST(3 * source_size AS DOUBLE), (SELECT max(level) FROM steps) * weight) AS target FROM s),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM t
),
r AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS part FROM p),
q AS (
  SELECT d.*, r.source_size, r.target, r.whole, r.part, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o) - d.size AS ahead
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, part - ahead)) AS BIGINT) AS taken FROM q
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OP5_SQL, "op8_mixing": OP8_SQL}
