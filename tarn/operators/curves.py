"""Rate-quality curves: cubic fits by orthogonal polynomials, their mean difference over the overlap, ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cubic(df: DataFrame, curve: list[str], x: str, y: str) -> DataFrame:
    """c0..c3, lo, hi, n of each curve: least squares in u = (x - mean) / scale, with mean and scale.

    Moments up to the sixth of u and its products with y are sums of one pass; the four normal equations of the
    centred and scaled moments are solved by orthogonalising 1, u, u^2, u^3 in columns.
    """
    w = Window.partitionBy(*curve)
    c = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_m", F.avg(x).over(w)).withColumn("_s", F.stddev_pop(x).over(w))
    u = (F.col(x) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    c = c.select(*curve, "_m", "_s", F.col(x).alias("_x"), F.col(y).alias("_y"), u.alias("_u"), F.lit(1.0).alias("p0"), u.alias("p1"))
    # p2, p3: three-term recursion, its coefficients window sums over the curve
    for k in (1, 2):
        p, q = F.col(f"p{k}"), F.col(f"p{k - 1}")
        a = F.sum(F.col("_u") * p * p).over(w) / F.nullif(F.sum(p * p).over(w), F.lit(0.0))
        b = F.sum(p * p).over(w) / F.nullif(F.sum(q * q).over(w), F.lit(0.0))
        c = c.withColumn(f"_a{k}", a).withColumn(f"_b{k}", b).withColumn(f"p{k + 1}", (F.col("_u") - F.col(f"_a{k}")) * p - F.col(f"_b{k}") * q)
    fits = [(F.sum(F.col("_y") * F.col(f"p{k}")) / F.nullif(F.sum(F.col(f"p{k}") * F.col(f"p{k}")), F.lit(0.0))).alias(f"d{k}") for k in range(4)]
    g = c.groupBy(*curve, "_m", "_s").agg(*fits, *[F.max(f"_{n}").alias(f"_{n}") for n in ("a1", "b1", "a2", "b2")], F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count_distinct("_x").alias("n"))
    a1, b1, a2, b2, d = F.col("_a1"), F.col("_b1"), F.col("_a2"), F.col("_b2"), [F.col(f"d{k}") for k in range(4)]
    # p2 = u^2 - a1 u - b1; p3 = (u - a2) p2 - b2 u
    return g.select(
        *curve, F.col("_m").alias("mid"), F.col("_s").alias("scale"), "lo", "hi", "n",
        (d[0] - b1 * d[2] + a2 * b1 * d[3]).alias("c0"), (d[1] - a1 * d[2] + (a1 * a2 - b1 - b2) * d[3]).alias("c1"), (d[2] - (a1 + a2) * d[3]).alias("c2"), d[3].alias("c3"),
    )


def _integral(side: str, at: Column) -> Column:
    u = (at - F.col(f"{side}_mid")) / F.col(f"{side}_scale")
    c = [F.col(f"{side}_c{k}") for k in range(4)]
    return F.col(f"{side}_scale") * (c[0] * u + c[1] * u**2 / 2 + c[2] * u**3 / 3 + c[3] * u**4 / 4)


def bd_rate(df: DataFrame, curve: list[str], arm: str, a: str, b: str, rate: str, quality: str) -> DataFrame:
    """bd_rate (percent of b over a at equal quality) and overlap of the log-rate ranges, for each curve key.

    Null where an arm has fewer than four quality values, a rate that is not positive, or no common range.
    """
    pts = df.where(F.col(arm).isin(a, b)).withColumn("_lr", F.when(F.col(rate) > 0, F.log(rate)))
    f = cubic(pts, [*curve, arm], quality, "_lr")
    ranges = pts.groupBy(*curve, arm).agg(F.min("_lr").alias("rlo"), F.max("_lr").alias("rhi"), F.min(rate).alias("_least"))
    f = f.join(ranges, [*curve, arm])
    side = lambda which, name: f.where(F.col(arm) == which).select(*curve, *[F.col(k).alias(f"{name}_{k}") for k in ("mid", "scale", "lo", "hi", "n", "c0", "c1", "c2", "c3", "rlo", "rhi", "_least")])
    both = side(a, "a").join(side(b, "b"), curve)
    lo, hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    usable = (F.col("a_n") >= 4) & (F.col("b_n") >= 4) & (hi > lo) & (F.col("a__least") > 0) & (F.col("b__least") > 0)
    mean = ((_integral("b", hi) - _integral("b", lo)) - (_integral("a", hi) - _integral("a", lo))) / (hi - lo)
    span = F.greatest("a_rhi", "b_rhi") - F.least("a_rlo", "b_rlo")
    overlap = F.greatest(F.lit(0.0), F.least("a_rhi", "b_rhi") - F.greatest("a_rlo", "b_rlo")) / F.nullif(span, F.lit(0.0))
    return both.select(*curve, F.when(usable, 100 * (F.exp(mean) - 1)).alias("bd_rate"), overlap.alias("overlap"))


def rate_at(df: DataFrame, curve: list[str], rate: str, quality: str, at: float) -> DataFrame:
    """Rate at a quality, log-linear between the ladder's points; curves that do not reach it are left out."""
    w = Window.partitionBy(*curve).orderBy(quality, rate)
    seg = df.select(*curve, F.col(quality).alias("q0"), F.log(rate).alias("r0"), F.lead(quality).over(w).alias("q1"), F.log(F.lead(rate).over(w)).alias("r1"))
    hit = seg.where((F.col("q0") <= at) & (F.col("q1") >= at) & (F.col("q1") > F.col("q0")))
    value = F.exp(F.col("r0") + (at - F.col("q0")) / (F.col("q1") - F.col("q0")) * (F.col("r1") - F.col("r0")))
    return hit.groupBy(*curve).agg(F.min(value).alias("rate"))


def monotonic(df: DataFrame, curve: list[str], rung: str, rate: str, quality: str) -> DataFrame:
    """bad rungs of each ladder: the rate does not fall, or the quality does not get worse (rise), with the rung."""
    w = Window.partitionBy(*curve).orderBy(rung)
    bad = (F.col(rate) >= F.lag(rate).over(w)) | (F.col(quality) <= F.lag(quality).over(w))
    return df.withColumn("_bad", F.coalesce(bad, F.lit(False))).groupBy(*curve).agg(F.count("*").alias("rungs"), F.count_if("_bad").alias("bad"))


def bd_quality(df: DataFrame, curve: list[str], arm: str, a: str, b: str, rate: str, quality: str) -> DataFrame:
    """bd_quality: mean difference of b over a at equal rate, from cubic fits of quality over log rate; null as in bd_rate."""
    pts = df.where(F.col(arm).isin(a, b)).withColumn("_lr", F.when(F.col(rate) > 0, F.log(rate)))
    f = cubic(pts, [*curve, arm], "_lr", quality)
    side = lambda which, name: f.where(F.col(arm) == which).select(*curve, *[F.col(k).alias(f"{name}_{k}") for k in ("mid", "scale", "lo", "hi", "n", "c0", "c1", "c2", "c3")])
    both = side(a, "a").join(side(b, "b"), curve)
    lo, hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    mean = ((_integral("b", hi) - _integral("b", lo)) - (_integral("a", hi) - _integral("a", lo))) / (hi - lo)
    return both.select(*curve, F.when((F.col("a_n") >= 4) & (F.col("b_n") >= 4) & (hi > lo), mean).alias("bd_quality"))
