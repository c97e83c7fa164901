"""Whitening against numpy, exact deviations, edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def whole(rows):
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(1024 * float(np.float64(c))) + 100_000 for c in v]) for i, v in kept]


def check(rows, got, most=8):
    """got: rows of the query; rows: (id, vector), ids without repeats."""
    kept = whole(rows)
    x = np.array([v for _, v in kept], dtype=object)
    n, total = len(x), x.sum(axis=0)
    centred = (x - total / n).astype(float)
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    k = min(most, len(e))
    real = [j for j in range(k) if e[j] > 1e-12 * e[0]]
    assert len(got) == n * k and {(r.vec_id, r.component) for r in got} == {(i, j + 1) for i, _ in kept for j in range(k)}
    by = {(r.vec_id, r.component): r for r in got}
    for (i, v), c in zip(kept, centred):
        for j in range(k):
            r = by[i, j + 1]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, total))
            assert (r.whitened is None) == (j not in real)
            assert r.explained == pytest.approx(e[j] / np.trace(cov) if j in real else 0.0, rel=1e-9)
    for j in real:
        mine = np.array([by[i, j + 1].whitened for i, _ in kept])
        want = centred @ q[:, j] / np.sqrt(e[j])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and (errors == {None} if not real else errors.pop() < 1e-9)


def test_query_on_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, queries.op12_whitening(spark, SF).collect())


def through_query(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("index", F.lit("clash")).withColumn("v", F.lit(2))
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return queries.op12_whitening(spark, str(tmp_path)).collect()


def test_rows_that_are_left_out(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [1.0, 2.0, float("inf"), 0.0, 0.0]), (104, [])]
    check(rows, through_query(spark, tmp_path, rows + odd))


def test_vectors_of_another_length_are_left_out(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    check(rows, through_query(spark, tmp_path, [*rows, (99, [1.0, 2.0])]))


def test_more_dimensions_than_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(4)]
    check(rows, through_query(spark, tmp_path, rows))


def test_null_and_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in (None, 7, 7, 8, 9)]
    got = through_query(spark, tmp_path, rows)
    assert len(got) == 15 and sum(r.vec_id is None for r in got) == 3 and sum(r.vec_id == 7 for r in got) == 6


@pytest.mark.parametrize("rows", [[(1, [0.5, 0.25])], [(i, [1.0, 2.0, 3.0]) for i in range(5)]])
def test_nothing_varies(spark, tmp_path, rows):
    got = through_query(spark, tmp_path, rows)
    assert len(got) == len(rows) * len(rows[0][1])
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(0, None, 0.0, None)}


def test_empty_table(spark, tmp_path):
    assert through_query(spark, tmp_path, []) == []


def test_many_blocks_in_both_directions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 4)
    monkeypatch.setattr(whitening, "BLOCKS_PER_SPLIT", 2)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=10).tolist()) for i in range(61)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), "vec_id", "embedding")
    each = found.select(F.col("id").alias("vec_id"), "n", "deviation", "explained", "identity_error", F.posexplode("v").alias("k", "whitened"))
    check(rows, each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("k")).alias("explained"), "identity_error").collect())


def test_entries_too_large_for_whole_numbers(spark):
    df = spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(df, "vec_id", "embedding").collect()
