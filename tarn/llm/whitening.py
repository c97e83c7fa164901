"""Embedding whitening by block matrices.

Centred rows get an index and become a matrix of distributed blocks; the transpose times the matrix gives the scatter,
its middle dimension split so that the products are made and added up in many tasks. The scatter has d * d entries,
whatever the number of rows: its eigenvectors are taken on the driver and, scaled by the roots of their eigenvalues, form the
whitening matrix, by which the blocks are multiplied. The covariance of the result is then measured on the rows themselves.

Entries become whole numbers x = floor(scale * c) + shift first, so sums and squared deviations are exact. Vectors that
are null or hold null or non-finite entries are left out; so are those whose length is not the most frequent one (of
equal counts the longer), which have no place in the space of the others. Components whose eigenvalue is nothing next to the
largest (fewer rows than dimensions, constant entries, repeated rows alone) have no whitened value, and count as 0 explained.
Rows that repeat and null ids each give their rows; an empty table gives none; other columns are not read. An entry whose
whole number does not fit 52 bits is an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows and columns of a block; blocks whose products one task adds up.
BLOCK, BLOCKS_PER_SPLIT = 1024, 16
#: An eigenvalue under this share of the largest is rounding.
RANK = 1e-12


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int, shift: int) -> DataFrame:
    """(id, x): the vectors that stay, as whole numbers."""
    v = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = df.where(F.col(vector).isNotNull()).where(finite).select(F.col(key).alias("id"), v.alias("_v"))
    fits = lambda c: F.when(F.abs(c) < float(1 << 52), c.cast("long")).otherwise(F.raise_error(F.lit("an entry is too large for a whole number")).cast("long"))
    return kept.select("id", F.transform("_v", lambda c: fits(F.floor(c * float(scale)).cast("double") + F.lit(float(shift)))).alias("x"))


def indexed(df: DataFrame) -> DataFrame:
    """df with rows numbered from 0 in `index`, without a gap: places in the partitions of a written table, after the rows of partitions before."""
    placed = written(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # a row for each partition of the table: small enough to send to all tasks, whatever they hold
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("index", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def blocks_of(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """(index, v: array of doubles) as a block matrix."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(BLOCK, BLOCK)


def rows_of(m: BlockMatrix) -> DataFrame:
    """(index, v) of a block matrix."""
    rows = callMLlibFunc("getIndexedRows", m.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("v"))


def product(left: BlockMatrix, right: BlockMatrix) -> BlockMatrix:
    """left times right with the middle dimension dealt to many tasks: multiply() by itself gives a small result's products to one."""
    splits = max(1, -(-left.numColBlocks // BLOCKS_PER_SPLIT))
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def whitening_matrix(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The whitening matrix (d, k), eigenvalues by falling size, and shares of the trace, from the scatter of n centred rows."""
    cov = (scatter + scatter.T) / (2 * n)
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0)  # the largest entry is positive
    real = e > max(RANK * max(e[0], 0.0), 0.0)
    trace = float(np.trace(cov))
    e = np.where(real, e, 0.0)
    return q / np.sqrt(np.where(real, e, np.inf)), e, e / trace if trace > 0 else np.zeros(len(e))


def identity_error(rows: DataFrame, used: list[int]) -> float | None:
    """Largest absolute entry of the covariance of the whitened values of (index, v) minus the identity; None without a component."""
    v, pairs = F.col("v"), [(a, b) for k, a in enumerate(used) for b in used[k:]]
    if not pairs:
        return None
    row = rows.agg(*[F.covar_pop(v[a], v[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(row, pairs))


def whiten(df: DataFrame, key: str, vector: str, components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """id, x, n, deviation (exact, decimal), v (whitened components), explained (an array beside v) and identity_error of each vector that stays.

    deviation is the sum over dimensions of (n * x - S) ** 2 with S the sums. Only d sums and d * d entries reach the driver.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, key, vector, scale, shift)
    sizes = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    kind = df.schema[key].dataType.simpleString()
    if not sizes:
        return spark.createDataFrame([], f"id {kind}, x array<long>, n long, deviation decimal(38,0), v array<double>, explained array<double>, identity_error double")
    d, n = sizes[0]["d"], sizes[0]["n"]
    rows = indexed(vectors.where(F.size("x") == d))
    # sums of each task's rows, dimension by dimension: d rows for each task
    sums = {r["k"]: int(r["s"]) for r in rows.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.sum(F.col("c").cast("decimal(16,0)")).alias("s")).collect()}
    total = [sums[k] for k in range(d)]
    means = F.array(*[F.lit(s / n) for s in total])
    centred = rows.select("index", F.zip_with("x", means, lambda x, m: x.cast("double") - m).alias("v"))
    a = blocks_of(centred, n, d)
    scatter = np.asarray(product(a.transpose(), a).toLocalMatrix().toArray())
    w, e, explained = whitening_matrix(scatter, n, min(components, d))
    small = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(w)], "index long, v array<double>")
    projected = written(rows_of(a.multiply(blocks_of(small, d, w.shape[1]))))
    used = [k for k in range(len(e)) if e[k] > 0]
    error = identity_error(projected, used)
    s = F.array(*[F.lit(x).cast("decimal(38,0)") for x in total])
    gaps = F.zip_with("x", s, lambda x, t: (F.lit(n).cast("decimal(19,0)") * x.cast("decimal(18,0)")).cast("decimal(38,0)") - t)
    deviation = F.aggregate(gaps, F.lit(0).cast("decimal(38,0)"), lambda t, g: (t + g.cast("decimal(19,0)") * g.cast("decimal(19,0)")).cast("decimal(38,0)"))
    v = F.transform("v", lambda x, k: F.when(F.array_contains(F.lit(used), k), x)) if used else F.transform("v", lambda x: F.lit(None).cast("double"))
    out = rows.select("index", "id", "x", deviation.alias("deviation")).join(projected.select("index", v.alias("v")), "index")
    return out.select("id", "x", F.lit(n).cast("long").alias("n"), "deviation", "v", F.array(*[F.lit(float(x)) for x in explained]).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
