"""Clusters of vectors, their medoids and how far everything is from one.

Rows are (_g, _k, _v): cluster, key, vector of doubles. Centres and candidates are the only vectors that every task gets, a
bounded number at a time; sums and extremes come from aggregation in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators import ranks
from tarn.sources.store import written

#: Candidates of a cluster whose sums one round takes, at first and at most.
FIRST, MOST = 64, 4096
#: Vectors and numbers of a block at most, about; cells of a cluster's grid.
ROWS, NUMBERS, CELLS = 16_384, 262_144, 625


def gap(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def standardised(df: DataFrame, columns: list[str]) -> Column:
    """An array of the z-scores of columns over df; one that does not vary is 0 everywhere. Two numbers for each column reach the driver."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return F.array(*[(F.col(c).cast("double") - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(columns)])


def _nearest(v: Column | str, centres: list[list[float]]) -> Column:
    """(distance, place) of the nearest centre, of equals the first."""
    return F.array_min(F.array(*[F.struct(F.round(gap(v, F.array(*map(F.lit, c))), 9).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))


def starts(rows: DataFrame, k: int) -> list[list[float]]:
    """Up to k starting centres, the same in any order of rows: that nearest to the mean, then always the one farthest from all before (of equals the least key)."""
    d = rows.select(F.size("_v").alias("d")).first()["d"]
    mean = list(rows.agg(*[F.avg(F.get("_v", F.lit(i))).alias(f"m{i}") for i in range(d)]).first())
    far = F.round(gap("_v", F.array(*map(F.lit, mean))), 9)
    found = [rows.agg(F.min_by("_v", F.struct(far, F.col("_k"))).alias("v")).first()["v"]]
    while len(found) < k:
        away = _nearest("_v", found)["d"]
        row = rows.agg(F.min_by(F.struct(F.col("_v").alias("v"), away.alias("d")), F.struct(-away, F.col("_k"))).alias("b")).first()["b"]
        if row["d"] == 0:
            break
        found.append(row["v"])
    return found


def grouped(rows: DataFrame, k: int, rounds: int = 50) -> DataFrame:
    """(_g, _k, _v): rows of (_k, _v) dealt to up to k clusters by k-means from starts(); fewer form where vectors coincide.

    It ends when no sum changes, or after `rounds`; ties go to the cluster of the lower number, centres are rounded to nine places.
    """
    centres = starts(rows, k)
    d = len(centres[0])
    for _ in range(rounds):
        dealt = rows.select(_nearest("_v", centres)["i"].alias("_g"), "_v")
        got = dealt.groupBy("_g").agg(*[F.round(F.avg(F.get("_v", F.lit(i))), 9).alias(f"m{i}") for i in range(d)]).collect()  # k rows
        new = [list(r)[1:] for r in sorted(got, key=lambda r: r["_g"])]
        if new == centres:
            break
        centres = new
    return rows.select(_nearest("_v", centres)["i"].alias("_g"), "_k", "_v")


def _grid(d: int) -> np.ndarray:
    """Edges, in standard deviations, that cut each of d dimensions into equal shares of a normal one; none where even halves are more than CELLS cells."""
    bins = int(CELLS ** (1 / d) + 1e-9)
    return np.array([NormalDist().inv_cdf(i / bins) for i in range(1, bins)])


def _table(of: pa.Table, column: str, d: int) -> np.ndarray:
    return pc.list_flatten(of.column(column)).to_numpy().reshape(-1, d)


def _beside(blocks: DataFrame, small: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of each block of (_g, _b) with the rows of small that its group has."""
    asked = small.join(blocks.select("_g", F.col("_b").alias("_at")).distinct(), "_g")
    return blocks.groupBy("_g", "_b").cogroup(asked.groupBy("_g", "_at")).applyInArrow(f, schema)


def _bounded(blocks: DataFrame, size: DataFrame, d: int, kind: dict[str, str]) -> DataFrame:
    """(_g, _k, _v, _low) of blocks: _low is no more than a member's sum of distances to all members, by sums over cells of its group.

    By Hoelder's inequality a cell's sum of distances is at least (sum of squares)^1.5 / (sum of fourth powers)^0.5, and both sums follow from
    the cell's count, vectors, outer products and the like; it is also at least the count times the distance of the cell's mean.
    Cells are those of a grid where there are few dimensions, else the whole group: distances in many dimensions differ little, so the bound is near.
    """
    edges = _grid(d)

    def summed(rows: pa.Table, about: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and about.num_rows:
            x, w = _table(rows, "_v", d) - _table(about, "_m", d)[0], rows.column("_w").to_numpy().astype(float)
            cell = np.zeros(len(x), dtype=np.int64)
            if len(edges):
                for i, s in enumerate(_table(about, "_sd", d)[0]):
                    cell = cell * (len(edges) + 1) + np.searchsorted(edges, x[:, i] / (s or 1.0))
            order = np.argsort(cell, kind="stable")
            names, first = np.unique(cell[order], return_index=True)
            for name, at in zip(names, np.split(order, first[1:])):
                y, u = x[at], w[at]
                q = (y * y).sum(1)
                out.append((int(name), np.concatenate([[u.sum(), u @ q, u @ (q * q)], u @ y, (u * q) @ y, ((y * u[:, None]).T @ y).ravel()])))
        return pa.table({"_g": pa.array([rows.column("_g")[0].as_py()] * len(out), rows.schema.field("_g").type), "_c": pa.array([c for c, _ in out], pa.int64()), "_s": pa.array([list(s) for _, s in out], pa.list_(pa.float64()))})

    each = _beside(blocks, size.select("_g", "_m", "_sd"), summed, f"_g {kind['_g']}, _c long, _s array<double>")
    added = each.select("_g", "_c", F.posexplode("_s").alias("_i", "_x")).groupBy("_g", "_c", "_i").agg(F.sum("_x").alias("_x"))
    cells = written(added.groupBy("_g", "_c").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_s")).select("_g", F.col("_s._x").alias("_s")).join(size.select("_g", "_m"), "_g"))

    def lows(rows: pa.Table, about: pa.Table) -> pa.Table:
        low = np.zeros(rows.num_rows)
        if about.num_rows:
            x = _table(rows, "_v", d) - _table(about, "_m", d)[0]
            xx = (x * x).sum(1)
            for s in _table(about, "_s", 3 + 2 * d + d * d):
                n, q, q4, y, qy, yy = s[0], s[1], s[2], s[3 : 3 + d], s[3 + d : 3 + 2 * d], s[3 + 2 * d :].reshape(d, d)
                xy, wide = x @ y, xx + q / n
                # what rounding can have moved is taken off the squares and put onto the fourth powers
                two = np.maximum(n * xx - 2 * xy + q - 1e-13 * n * wide, 0)
                four = n * xx * xx + 4 * ((x @ yy) * x).sum(1) + q4 + 2 * xx * q - 4 * xx * xy - 4 * (x @ qy)
                four = np.maximum(four, 0) + 1e-13 * (n * (xx * xx) + q4 + n * wide * wide) + 1e-300
                mean = n * np.sqrt(np.maximum(((x - y / n) ** 2).sum(1), 0))
                low += np.maximum(np.sqrt(two / four) * two, mean - 1e-7 * n * np.sqrt(wide) * 1e-3)
        # a little less for the rounding of the sums
        return pa.table({"_g": rows.column("_g"), "_k": rows.column("_k"), "_v": rows.column("_v"), "_low": pa.array(low * (1 - 1e-9))})

    return _beside(blocks, cells, lows, f"_g {kind['_g']}, _k {kind['_k']}, _v array<double>, _low double")


def _sums(blocks: DataFrame, chosen: DataFrame, d: int, kind: dict[str, str]) -> DataFrame:
    """(_g, _k, _e): the sum of distances of each chosen member to all of its group, difference by difference."""

    def partial(rows: pa.Table, asked: pa.Table) -> pa.Table:
        e = np.zeros(asked.num_rows)
        if rows.num_rows and asked.num_rows:
            x, w = _table(rows, "_v", d), rows.column("_w").to_numpy().astype(float)
            for i, c in enumerate(_table(asked, "_v", d)):
                y = x - c
                e[i] = np.sqrt(np.einsum("ij,ij->i", y, y)) @ w
        return pa.table({"_g": asked.column("_g"), "_k": asked.column("_k"), "_e": pa.array(e)})

    each = _beside(blocks, chosen.select("_g", "_k", "_v"), partial, f"_g {kind['_g']}, _k {kind['_k']}, _e double")
    return each.groupBy("_g", "_k").agg(F.sum("_e").alias("_e"))


def medoids(rows: DataFrame) -> DataFrame:
    """(_g, _k, _v, radius, n): of each cluster the member of the least sum of distances to all members (of equals the least key).

    Members of one vector are weighed together under their least key. A bound under each member's sum comes from moments (_bounded()), whose cost is in
    proportion to the rows; sums are taken of the members of the least bounds, a bounded number of each cluster in a round, and members
    whose bound reaches the best sum so far are out. Blocks of a cluster are dealt over all tasks. Where the bounds rule out little, as with
    vectors that lie in distant heaps in many dimensions, a cluster of n vectors still costs n * n distances.
    """
    d = rows.where("_v IS NOT NULL").select(F.size("_v").alias("d")).first()
    if not d or not d["d"]:
        return rows.select("_g", "_k", "_v", F.lit(None).cast("double").alias("radius"), F.lit(None).cast("long").alias("n")).limit(0)
    d = d["d"]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    # a vector that lacks a number has no distance
    whole = rows.where(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x)))
    apart = written(whole.groupBy("_g", "_v").agg(F.min("_k").alias("_k"), F.count("*").alias("_w")))
    means = [F.avg(F.get("_v", F.lit(i))) for i in range(d)]
    spreads = [F.stddev_pop(F.get("_v", F.lit(i))) if len(_grid(d)) else F.lit(1.0) for i in range(d)]
    size = written(apart.groupBy("_g").agg(F.count("*").alias("_n"), F.array(*means).alias("_m"), F.array(*spreads).alias("_sd")))
    # a block has about ROWS vectors, or as many as hold NUMBERS numbers
    share = F.ceil(F.col("_n") / max(64, min(ROWS, NUMBERS // d)))
    blocks = written(apart.join(size.select("_g", "_n"), "_g").select("_g", F.pmod(F.xxhash64("_k"), share).alias("_b"), "_k", "_w", "_v"))
    left = written(_bounded(blocks, size, d, kind))
    best, take = None, FIRST
    while True:
        # the candidates of the least bound: chosen by it alone, so a cluster never sends more than `take`
        chosen = written(ranks.numbered(left, ["_g"], ["_low", "_k"], "_i").where(F.col("_i") <= take).select("_g", "_k", "_v"))
        sums = _sums(blocks, chosen, d, kind).join(chosen, ["_g", "_k"])
        least = sums.groupBy("_g").agg(F.min_by(F.struct(F.round("_e", 6).alias("_e"), "_k", "_v"), F.struct(F.round("_e", 6), "_k")).alias("_b"))
        best = least if best is None else best.unionByName(least).groupBy("_g").agg(F.min_by("_b", F.struct("_b._e", "_b._k")).alias("_b"))
        best = written(best)
        rest = left.join(chosen, ["_g", "_k"], "left_anti").join(best.select("_g", F.col("_b._e").alias("_be")), "_g")
        left = written(rest.where(F.col("_low") < F.col("_be") + 1e-6).drop("_be"))
        if left.isEmpty():
            break
        take = min(MOST, take * 4)
    centre = best.select("_g", F.col("_b._k").alias("_mk"), F.col("_b._v").alias("_mv"))
    by = rows.join(centre, "_g").groupBy("_g", "_mk").agg(F.first("_mv").alias("_v"), F.max(gap("_v", "_mv")).alias("radius"), F.count("*").alias("n"))
    return by.select("_g", F.col("_mk").alias("_k"), "_v", "radius", "n")


def covered(df: DataFrame, key: str, columns: list[str], k: int) -> DataFrame:
    """(cluster, probe, members, radius, worst, formed, asked): k clusters of the z-scored columns, the medoid of each as its probe.

    radius is the distance of a cluster's farthest member from its probe; worst, the same in all rows, that of the row farthest from
    its nearest probe, of any cluster; formed says how many clusters there are, fewer than asked where rows coincide. Rows that lack a
    column or the key are left out; an empty table gives no rows. Clusters are numbered by their probes' keys.
    """
    # written, since df can be an aggregate of a large table and three passes start from it
    known = written(df.dropna(subset=[key, *columns]).select(F.col(key).alias("_k"), *columns))
    if known.isEmpty():
        kind = known.schema["_k"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"cluster int, probe {kind}, members long, radius double, worst double, formed int, asked int")
    rows = written(known.select("_k", standardised(known, columns).alias("_v")))
    held = written(grouped(rows, k))
    found = medoids(held).orderBy("_k").collect()  # k rows
    worst = rows.agg(F.max(_nearest("_v", [r["_v"] for r in found])["d"]).alias("w")).first()["w"]
    out = [(i, r["_k"], r["n"], r["radius"], worst, len(found), k) for i, r in enumerate(found)]
    kind = known.schema["_k"].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"cluster int, probe {kind}, members long, radius double, worst double, formed int, asked int")
