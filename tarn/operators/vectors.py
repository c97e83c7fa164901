"""Distances between sets of vectors from additive sums: mean and covariance terms, jackknife by subtraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators import clusters
from tarn.sources.store import written


#: Sums of tasks that one task of the first round adds up are those of the same number modulo SALTS; a row holds BLOCK numbers or one row of a matrix.
SALTS, BLOCK = 128, 65_536
#: Numbers that a task holds at once before it sends the sums of its groups on.
HELD = 30_000_000


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, values) summed over rows of the same keys, in tasks: rows of one key are as many as the rounds before it leave."""

    def add(key, pdf):
        values = pdf["values"].to_numpy()
        total = values[0].astype(float)
        for v in values[1:]:
            total = total + v
        return pd.DataFrame([(*key, int(pdf["n"].sum()), total)], columns=[*keys, "n", "values"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy(*keys).applyInPandas(add, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n long", "values array<double>"]))


def moments(df: DataFrame, group: str | list[str], vector: str) -> DataFrame:
    """(group, n, total, products): count, sum of the vectors and sum of their outer products (flat, d * d) of each group.

    A task adds up its own rows and sends a group's sums cut into blocks; blocks are added in two rounds, first those of every
    SALTS-th task, so that whatever the number of rows and tasks, no task gets more than a few of one block. Rows whose vector
    or group is null are left out; vectors have one length. Moments of disjoint sets add up and subtract (added(), without()).
    """
    keys = [group] if isinstance(group, str) else list(group)
    types = [df.schema[k].dataType.simpleString() for k in keys]

    def sent(sums: dict, task: int):
        out = []
        for key, (n, total, products) in sums.items():
            d = len(total)
            rows, step = np.vstack([total, products]), max(1, BLOCK // d)
            out += [(*key, task % SALTS, at // step, n, rows[at : at + step].ravel()) for at in range(0, d + 1, step)]
        return pd.DataFrame(out, columns=[*keys, "_salt", "_block", "n", "values"])

    def partial(batches):
        sums: dict = {}
        held, task = 0, TaskContext.get().partitionId()
        for pdf in batches:
            for key, rows in pdf.groupby(keys, sort=False)["_v"]:
                x = np.stack(rows.to_numpy()).astype(float)
                if key not in sums:
                    held += x.shape[1] ** 2
                n, total, products = sums.get(key, (0, 0.0, 0.0))
                sums[key] = n + len(x), total + x.sum(axis=0), products + x.T @ x
                if held > HELD:
                    yield sent(sums, task)
                    sums, held = {}, 0
        yield sent(sums, task)

    rows = df.where(F.col(vector).isNotNull()).dropna(subset=keys).select(*keys, F.col(vector).alias("_v"))
    each = rows.mapInPandas(partial, ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, types)), "_salt int, _block int, n long, values array<double>"]))
    blocks = _added(_added(each, [*keys, "_salt", "_block"]).drop("_salt"), [*keys, "_block"])
    whole = blocks.groupBy(*keys).agg(F.max("n").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_block", "values"))), lambda b: b["values"])).alias("_m"))
    d = F.floor((F.sqrt(1.0 + 4.0 * F.size("_m")) - 1) / 2 + 0.5).cast("int")  # d * d + d numbers
    return whole.select(*keys, "n", F.slice("_m", F.lit(1), d).alias("total"), F.slice("_m", d + 1, d * d).alias("products"))


def added(m: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the unions of disjoint sets: rows of the same keys are added, a few at a time."""
    packed = m.select(*keys, F.pmod(F.xxhash64("total", "n"), F.lit(SALTS)).cast("int").alias("_salt"), "n", F.concat("total", "products").alias("values"))
    whole = _added(_added(packed, [*keys, "_salt"]).drop("_salt"), keys)
    d = F.floor((F.sqrt(1.0 + 4.0 * F.size("values")) - 1) / 2 + 0.5).cast("int")
    return whole.select(*keys, "n", F.slice("values", F.lit(1), d).alias("total"), F.slice("values", d + 1, d * d).alias("products"))


def without(whole: DataFrame, part: DataFrame, keys: list[str]) -> DataFrame:
    """part's rows with the moments of whole less part in place of part's; sets that part uses up are left out."""
    left = part.select(*[c for c in part.columns if c not in ("n", "total", "products")], F.struct("n", "total", "products").alias("_p"))
    both = left.join(whole.select(*keys, F.struct("n", "total", "products").alias("_w")), keys)
    less = lambda c: F.zip_with(f"_w.{c}", f"_p.{c}", lambda a, b: a - b).alias(c)
    return both.where("_w.n > _p.n").select(*[c for c in left.columns if c != "_p"], (F.col("_w.n") - F.col("_p.n")).alias("n"), less("total"), less("products"))


def _terms(*columns: str):
    """Both terms from the moments in six columns, in tasks."""

    @F.pandas_udf("mean_term double, covariance_term double")
    def terms(n1: pd.Series, t1: pd.Series, p1: pd.Series, n2: pd.Series, t2: pd.Series, p2: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([distance(*x) for x in zip(n1, t1, p1, n2, t2, p2)], columns=["mean_term", "covariance_term"], dtype=float)

    return terms(*columns)


def between(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean_term, covariance_term, distance) of the moments of a and b under the same keys; n is b's."""
    left = a.select(*keys, F.col("n").alias("n1"), F.col("total").alias("t1"), F.col("products").alias("p1"))
    right = b.select(*keys, F.col("n").alias("n2"), F.col("total").alias("t2"), F.col("products").alias("p2"))
    both = left.join(right, keys).select(*keys, F.col("n2").alias("n"), _terms("n1", "t1", "p1", "n2", "t2", "p2").alias("_t"))
    return both.select(*keys, "n", "_t.mean_term", "_t.covariance_term").withColumn("distance", F.col("mean_term") + F.col("covariance_term"))


def validity(df: DataFrame, group: str, source: str, key: str, reference: str, vector: str, splits: int = 4, seed: str = "split") -> DataFrame:
    """(group, kind, part, n, mean_term, covariance_term, distance): can the distance tell the groups apart at their size?

    Rows of a group pair its own vectors with the reference's at the same key. Kinds: score, a group's vectors against its
    references; identity, all references against themselves, which must be 0 (group and part null); split, `splits` halvings of
    the references by hash of the key, a diagnostic of unpaired sets and no floor for scores; jackknife, a score without the
    source in part, from sums less that source's. A group of one source has no jackknife. A reference counts once for each of its keys.
    """
    known = df.where(F.col(vector).isNotNull() & F.col(reference).isNotNull())
    own = written(moments(known, [group, source], vector))
    ref = written(moments(known, [group, source], reference))
    own_all, ref_all = added(own, [group]), added(ref, [group])
    named = lambda d, kind, part=None: d.select(F.col(group).cast("string").alias(group), F.lit(kind).alias("kind"), (F.col(part).cast("string") if part else F.lit(None).cast("string")).alias("part"), "n", "mean_term", "covariance_term", "distance")
    once = known.groupBy(key).agg(F.min_by(reference, F.struct(F.col(source), F.col(group))).alias("_r"))
    every = moments(once.withColumn(group, F.lit("")), group, "_r")
    identity = between(every, every, [group]).withColumn(group, F.lit(None).cast("string"))
    half = F.pmod(F.xxhash64(F.lit(seed), F.col("_i"), F.col(key)), F.lit(2))
    dealt = once.select(key, "_r", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("_i")).withColumn("_h", half)
    halves = written(moments(dealt, ["_i", "_h"], "_r"))
    split = between(halves.where("_h = 0"), halves.where("_h = 1"), ["_i"]).withColumn(group, F.lit(None).cast("string"))
    drop = between(without(ref_all, ref, [group]), without(own_all, own, [group]), [group, source])
    parts = [named(between(ref_all, own_all, [group]), "score"), named(identity, "identity"), named(split, "split", "_i"), named(drop, "jackknife", source)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def jackknife_summary(report: DataFrame, group: str) -> DataFrame:
    """(group, score, n_sources, mean, sd, least, most, separated): separated where the score's gap to every other group passes both spreads."""
    r = report.where(F.col(group).isNotNull())
    by = r.groupBy(group).agg(
        F.max(F.when(F.col("kind") == "score", F.col("distance"))).alias("score"), F.count_if(F.col("kind") == "jackknife").alias("n_sources"),
        *[f(F.when(F.col("kind") == "jackknife", F.col("distance"))).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("least", F.min), ("most", F.max))],
    )
    # a row for each group that the report names: neighbours in score order are the nearest
    w = Window.orderBy("score", group)
    gap = lambda other: F.abs(other("score").over(w) - F.col("score")) > F.greatest(F.coalesce("sd", F.lit(0.0)), F.coalesce(other("sd").over(w), F.lit(0.0)))
    return by.withColumn("separated", F.coalesce(gap(F.lag), F.lit(True)) & F.coalesce(gap(F.lead), F.lit(True)))


def distance(n1: int, t1, p1, n2: int, t2, p2) -> tuple[float, float]:
    """Mean and covariance terms from the moments of two sets."""
    got = []
    for n, t, p in ((n1, t1, p1), (n2, t2, p2)):
        t = np.asarray(t, float)
        p = np.asarray(p, float).reshape(len(t), len(t))
        got.append((t / n, (p - np.outer(t, t) / n) / max(n - 1, 1)))
    (m1, s1), (m2, s2) = got
    w, q = np.linalg.eigh(s1)
    root = (q * np.sqrt(np.maximum(w, 0))) @ q.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ s2 @ root), 0)).sum()
    return float(((m1 - m2) ** 2).sum()), float(np.trace(s1) + np.trace(s2) - 2 * cross)


def frechet_pairs(df: DataFrame, group: str, vector: str) -> DataFrame:
    """a, b, mean_term, covariance_term and distance of each two groups, in tasks: a pair's moments are two rows."""
    m = written(moments(df, group, vector))
    a = m.select(F.col(group).alias("a"), F.col("n").alias("n1"), F.col("total").alias("t1"), F.col("products").alias("p1"))
    b = m.select(F.col(group).alias("b"), F.col("n").alias("n2"), F.col("total").alias("t2"), F.col("products").alias("p2"))
    # every two of the named sets, as asked for
    both = a.join(b, F.col("a") < F.col("b")).select("a", "b", _terms("n1", "t1", "p1", "n2", "t2", "p2").alias("_t"))
    return both.select("a", "b", "_t.mean_term", "_t.covariance_term").withColumn("distance", F.col("mean_term") + F.col("covariance_term"))


def noise_ladder(df: DataFrame, key: str, vector: str, shares: list[float], seed: str = "noise") -> DataFrame:
    """share, distance and rises: each rung adds to every place a drawn number of up to `share` times the vector's largest; the distance must rise."""
    v = F.transform(vector, lambda x: x.cast("double"))
    rung = F.explode(F.array(F.lit(0.0), *map(F.lit, shares)))
    steps = df.select(key, v.alias("_v"), rung.alias("share")).withColumn("_most", F.array_max(F.transform("_v", F.abs)))
    drawn = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col(key), i), F.lit(2001)) / 1000.0 - 1.0
    noisy = steps.select(F.format_string("%.4f", "share").alias("share"), F.transform("_v", lambda x, i: x + F.col("share") * F.col("_most") * drawn(i)).alias("_v"))
    base = F.lit(f"{0:.4f}")
    pairs = frechet_pairs(noisy, "share", "_v").where(F.col("a") == base).select(F.col("b").cast("double").alias("share"), "distance")
    before = F.lag("distance", 1, 0.0).over(Window.orderBy("share"))  # a row for each rung
    return pairs.withColumn("rises", F.col("distance") > before)


def medoids(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """medoid: the member with the least sum of distances to its group (of equals the least key); radius: the distance of its farthest member; n."""
    rows = written(df.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.transform(vector, lambda x: x.cast("double")).alias("_v")))
    return clusters.medoids(rows).select(F.col("_g").alias(group), F.col("_k").alias("medoid"), "radius", "n")


def mean_distance(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Squared distance of the means of each two groups."""
    m = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    other = m.select(F.col(group).alias("b"), "i", F.col("m").alias("m2"))
    return m.withColumnRenamed(group, "a").join(other, "i").where("a < b").groupBy("a", "b").agg(F.sum((F.col("m") - F.col("m2")) ** 2).alias("mean_term"))


def frechet(df: DataFrame, group: str, vector: str, a, b) -> tuple[float, float]:
    """Mean and covariance terms of the distance of groups a and b; two rows of d * d sums reach the driver."""
    rows = {r[group]: r for r in moments(df.where(F.col(group).isin(a, b)), group, vector).collect()}
    return distance(*(x for g in (a, b) for x in (rows[g]["n"], rows[g]["total"], rows[g]["products"])))


def leave_one_out(df: DataFrame, source: str, vector: str) -> DataFrame:
    """shift: squared distance of the mean of all rows from that of all but one source, from sums: total minus source."""
    d = df.where(F.col(vector).isNotNull() & F.col(source).isNotNull())
    sums = d.select(source, F.posexplode(vector).alias("i", "x")).groupBy(source, "i").agg(F.sum(F.col("x").cast("double")).alias("_s"), F.count("*").alias("_n"))
    all_ = sums.groupBy("i").agg(F.sum("_s").alias("_total"), F.sum("_n").alias("_rows"))
    rest = F.try_divide(F.col("_total") - F.col("_s"), F.col("_rows") - F.col("_n"))
    return sums.join(F.broadcast(all_), "i").groupBy(source).agg(F.sum((F.col("_total") / F.col("_rows") - rest) ** 2).alias("shift"))  # all_ is a row for each place of a vector
