"""Statistics over many groups at once. Every function takes the columns that make a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.scalar import sign_test_floor, sign_test_p
from tarn.operators import ranks
from tarn.sources.store import written


def correlation(x: str, y: str) -> Column:
    """Pearson's r, null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def signs(df: DataFrame, group: list[str], delta: str = "delta") -> DataFrame:
    """Counts, exact p and floor of a sign test for each group; exact zeros are counted apart."""
    d = F.col(delta)
    by = df.where(d.isNotNull()).groupBy(*group).agg(F.count_if(d > 0).alias("n_pos"), F.count_if(d < 0).alias("n_neg"), F.count_if(d == 0).alias("n_zero"))
    return by.withColumn("p", sign_test_p(F.col("n_pos"), F.col("n_neg"))).withColumn("floor", sign_test_floor(F.col("n_pos") + F.col("n_neg")))


def holm(df: DataFrame, group: list[str], p: str = "p", family: int | None = None) -> DataFrame:
    """p_holm: step-down adjusted, monotone and at most 1; a family larger than the p-values costs correction."""
    w = Window.partitionBy(*group)
    ranked = w.orderBy(p, *[c for c in df.columns if c != p and c not in group])
    m = F.greatest(F.count("*").over(w), F.lit(family or 0))
    step = df.withColumn("_s", (m - F.row_number().over(ranked) + 1) * F.col(p)).withColumn("_r", F.row_number().over(ranked))
    return step.withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)))).drop("_s", "_r")


def effect_size(df: DataFrame, group: list[str], delta: str = "delta") -> DataFrame:
    """Paired dz: mean over sample deviation; null where the deviation is nothing next to the values."""
    by = df.groupBy(*group).agg(F.avg(delta).alias("mean"), F.stddev_samp(delta).alias("sd"), F.max(F.abs(delta)).alias("_scale"), F.count(delta).alias("n"))
    return by.withColumn("dz", F.when(F.col("sd") > 1e-12 * F.greatest(F.col("_scale"), F.lit(1e-300)), F.col("mean") / F.col("sd"))).drop("_scale")


def spearman(df: DataFrame, group: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """rho of each group from midranks; null under `least` rows or for a constant side."""
    return ranks.spearman(df, group, x, y, least)


def wilcoxon(df: DataFrame, group: list[str], delta: str = "delta", exact: int = 20) -> DataFrame:
    """Signed-rank test: exact by counting subsets of doubled midranks up to `exact` pairs, else the normal approximation.

    Zeros are dropped. The exact distribution is an integer array that grows rank by rank; ranks are collected for groups of
    up to `exact` pairs alone.
    """
    d = df.where((F.col(delta) != 0) & F.col(delta).isNotNull()).withColumn("_a", F.abs(delta))
    plus = d.where(F.col(delta) > 0).groupBy(*group, "_a").agg(F.count("*").alias("_plus"))
    each = ranks.same(ranks.midranks(d, group, "_a"), plus, [*group, "_a"], "left")
    t, small = F.col("ties"), F.col("of") <= exact
    by = each.groupBy(*group, F.col("of").cast("int").alias("n")).agg(
        F.sum(F.coalesce("_plus", F.lit(0)) * F.col("rank")).alias("w_plus"), F.sum(t * (t * t - 1)).alias("_ties"),
        F.flatten(F.collect_list(F.when(small, F.array_repeat((2 * F.col("rank")).cast("int"), t.cast("int"))))).alias("_ranks"),
    )
    total = (F.col("n") * (F.col("n") + 1)).cast("int")

    def grow(counts: Column, r: Column) -> Column:
        return F.zip_with(counts, F.concat(F.array_repeat(F.lit(0).cast("long"), r), F.slice(counts, 1, F.size(counts) - r)), lambda a, b: a + b)

    few = F.when(F.col("n") <= exact, total).otherwise(0)  # no array for a large group
    ways = F.aggregate("_ranks", F.concat(F.array(F.lit(1).cast("long")), F.array_repeat(F.lit(0).cast("long"), few)), grow)
    low = F.least(2 * F.col("w_plus"), total - 2 * F.col("w_plus")).cast("int")
    tail = F.aggregate(F.slice(ways, F.lit(1), low + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    z = F.abs((F.col("w_plus") - n * (n + 1) / 4) / sd)
    return by.withColumn("p_exact", F.when(F.col("n") <= exact, F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), F.col("n"))))).withColumn("z", F.when(sd > 0, z)).drop("_ranks", "_ties")


def draw(seed: str, *parts: Column) -> Column:
    """An integer below 2 ** 32 from md5 of the seed and the parts: the same draw in any run, order and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def _numbered(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """df with _i, the place of each row in its group by key from 0 on, and _n, the group's rows."""
    return ranks.numbered(df, group, [key], "_i").withColumn("_i", F.col("_i") - 1).withColumnRenamed("_all", "_n")


def bootstrap(df: DataFrame, group: list[str], key: str, value: str, resamples: int = 200, confidence: float = 0.95, seed: str = "b") -> DataFrame:
    """Percentile interval of the mean. Each replicate draws as many rows as its group has; rows are numbered by key."""
    numbered = _numbered(df.where(F.col(value).isNotNull()).select(*group, key, F.col(value).alias("_v")), group, key)
    picks = numbered.select(*group, "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_rep"))
    picks = picks.withColumn("_pick", F.pmod(draw(seed, *[F.col(g) for g in group], F.col("_rep"), F.col("_i")), F.col("_n")))
    drawn = picks.select(*group, "_rep", F.col("_pick").alias("_i")).join(numbered.select(*group, "_i", "_v"), [*group, "_i"])
    means = drawn.groupBy(*group, "_rep").agg(F.avg("_v").alias("_m"))
    a = (1 - confidence) / 2
    lo, hi = int(a * resamples + 1e-9), min(resamples - 1, int((1 - a) * resamples + 1e-9))
    sort = F.array_sort(F.collect_list("_m"))
    return means.groupBy(*group).agg(sort[lo].alias("lo"), sort[hi].alias("hi"))


def bootstrap_rho(df: DataFrame, group: list[str], key: str, x: str, y: str, resamples: int = 200, confidence: float = 0.95, seed: str = "b") -> DataFrame:
    """Percentile interval of Spearman's rho: ranks are taken anew in each replicate. Drawn as bootstrap() draws."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    numbered = _numbered(both.select(*group, key, F.col(x).alias("_x"), F.col(y).alias("_y")), group, key)
    picks = numbered.select(*group, "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_rep"))
    picks = picks.withColumn("_pick", F.pmod(draw(seed, *[F.col(g) for g in group], F.col("_rep"), F.col("_i")), F.col("_n")))
    drawn = picks.select(*group, "_rep", F.col("_pick").alias("_i")).join(numbered.select(*group, "_i", "_x", "_y"), [*group, "_i"])
    rhos = spearman(drawn, [*group, "_rep"], "_x", "_y").where("rho IS NOT NULL")
    a = (1 - confidence) / 2
    at = lambda share: F.element_at(F.array_sort(F.collect_list("rho")), F.greatest(F.lit(1), F.least(F.count("*"), F.floor(share * F.count("*") + 1e-9) + 1)).cast("int"))
    return rhos.groupBy(*group).agg(at(a).alias("lo"), at(1 - a).alias("hi"), F.count("*").alias("replicates"))


def permutation(df: DataFrame, group: list[str], key: str, x: str, y: str, permutations: int = 200, seed: str = "p") -> DataFrame:
    """Two-tailed permutation p of Spearman's rho, (hits + 1) / (permutations + 1)."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, key, F.col(x).alias("_vx"), F.col(y).alias("_vy"))
    both = ranks.ranked(ranks.ranked(known, group, "_vx", "_x"), group, "_vy", "_y")
    # written, since three branches start from it: each would join ranks and numbers anew, by broadcasts through the driver
    both = written(ranks.numbered(both, group, [key], "_i").select(*group, "_i", "_x", "_y"))
    seen = both.groupBy(*group).agg(correlation("_x", "_y").alias("rho"))
    reps = both.select(*group, F.col("_i").alias("_from"), "_x", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("_rep"))
    order = [draw(seed, *[F.col(g) for g in group], F.col("_rep"), F.col("_from")), F.col("_from")]
    moved = ranks.numbered(reps, [*group, "_rep"], order, "_i").select(*group, "_rep", "_i", "_x")
    rhos = ranks.same(moved, both.select(*group, "_i", "_y"), [*group, "_i"]).groupBy(*group, "_rep").agg(correlation("_x", "_y").alias("_r"))
    return ranks.same(rhos, seen, group).groupBy(*group, "rho").agg(((F.count_if(F.abs("_r") >= F.abs("rho") - 1e-12) + 1) / (permutations + 1)).alias("p"))


def equivalence(df: DataFrame, group: list[str], key: str, bound: float, delta: str = "delta", resamples: int = 200, least: int = 4) -> DataFrame:
    """Two one-sided tests by a 90% bootstrap interval: it and every delta lie within the bound; thin marks equivalence on few pairs."""
    n = df.where(F.col(delta).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.avg(delta).alias("mean"), F.max(F.abs(delta)).alias("max_abs"))
    both = n.join(bootstrap(df, group, key, delta, resamples, 0.90), group)
    inside = (F.col("lo") > -bound) & (F.col("hi") < bound) & (F.col("max_abs") < bound)
    verdict = F.when(F.col("n") < 2, "insufficient_pairs").when(inside, "equivalent").otherwise("not_shown_equivalent")
    return both.withColumn("verdict", verdict).withColumn("thin", (F.col("verdict") == "equivalent") & (F.col("n") < least))


def bonferroni(p: Column, family: int) -> Column:
    return F.least(F.lit(1.0), p * family)


def residuals(df: DataFrame, group: list[str], x: str, y: str, unit: float) -> DataFrame:
    """residual of each row from its group's least-squares line, in units; groups whose line does not fall are left out."""
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group).agg(F.count("*").alias("_n"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return df.join(fit.where("_n >= 3 AND _b < 0"), group).withColumn("residual", (F.col("_b") * F.col(x) + F.col("_a") - F.col(y)) / unit).drop("_n", "_a", "_b")
