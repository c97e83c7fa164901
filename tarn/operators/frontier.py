"""Deciding cells: the separable winner, dominance, faster alternatives, sensitivity to the threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators import ranks


def decide(df: DataFrame, cell: list[str], arm: str, score: str, threshold: float) -> DataFrame:
    """winner, margin, n_arms and separable of each cell: the lead of the lowest score reaches the threshold (less 1e-9)."""
    w = Window.partitionBy(*cell).orderBy(score, arm)
    top = df.where(F.col(score).isNotNull()).withColumn("_rn", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w)).withColumn("n_arms", F.count("*").over(Window.partitionBy(*cell)))
    margin = F.col("_next") - F.col(score)
    return top.where("_rn = 1").select(*cell, F.col(arm).alias("winner"), margin.alias("margin"), "n_arms", F.coalesce(margin >= threshold - 1e-9, F.lit(False)).alias("separable"))


def decided(df: DataFrame, cell: list[str], arm: str, score: str, threshold: float, eligible: Column, least: int = 2, order: list[str] | None = None) -> DataFrame:
    """Each cell of `least` arms or more with its verdict: n_arms, n_eligible, verdict, winner, leader, runner_up, margin, tied.

    Only eligible arms (a null condition is not one) with a score are ranked, by score and then `order` (the arm by itself). Verdicts: no_eligible_arm;
    single_eligible_arm, which is the winner without being separable; separable, the leader's lead reaches the threshold less 1e-9 and it is the winner;
    else tie_within_threshold: no winner, and tied lists the arms whose gap to the leader is under the threshold, the leader first, in rank order.
    No window: the two best and the ties of a cell come from aggregates.
    """
    ok = F.coalesce(eligible, F.lit(False)) & F.col(score).isNotNull()
    keys = [F.col(c) for c in (order or [arm])]
    ranked = F.struct(F.col(score).cast("double").alias("s"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col(arm).alias("arm"))
    marked = df.select(*cell, ok.alias("_ok"), ranked.alias("_r"))
    top = marked.groupBy(*cell).agg(F.count("*").alias("n_arms"), F.count_if("_ok").cast("long").alias("n_eligible"), F.min(F.when(F.col("_ok"), F.col("_r"))).alias("_top")).where(F.col("n_arms") >= least)
    rest = ranks.same(marked.where("_ok"), top.select(*cell, "_top"), cell)
    near = F.col("_r.s") - F.col("_top.s") < threshold - 1e-9
    # repeated rows of one arm are one place each: the second best is the least of all but one row of the best
    by = rest.groupBy(*cell).agg(
        F.count_if(F.col("_r") == F.col("_top")).alias("_same"), F.min(F.when(F.col("_r") > F.col("_top"), F.col("_r"))).alias("_second"),
        F.array_sort(F.collect_list(F.when(near, F.col("_r")))).alias("_near"),
    )
    both = ranks.same(top, by, cell, "left")
    second = F.when(F.col("_same") > 1, F.col("_top")).otherwise(F.col("_second"))
    margin = second["s"] - F.col("_top.s")
    verdict = F.when(F.col("n_eligible") == 0, "no_eligible_arm").when(F.col("n_eligible") == 1, "single_eligible_arm").when(margin >= threshold - 1e-9, "separable").otherwise("tie_within_threshold")
    both = both.withColumn("verdict", verdict).withColumn("margin", margin)
    tied = F.when(F.col("verdict") == "tie_within_threshold", F.transform("_near", lambda x: x["arm"])).otherwise(F.array().cast("array<string>"))
    winner = F.when(F.col("verdict").isin("separable", "single_eligible_arm"), F.col("_top.arm"))
    return both.select(*cell, "n_arms", "n_eligible", "verdict", winner.alias("winner"), F.col("_top.arm").alias("leader"), second["arm"].alias("runner_up"), "margin", tied.alias("tied"))


def operating_map(df: DataFrame, cell: list[str], arm: str, eligible: Column, objectives: dict[str, tuple[str, float]], least: int = 2) -> DataFrame:
    """decided() under each objective, named in `objective`: objectives give the score (lower is better) and the threshold of a separable lead."""
    out = None
    for name, (score, threshold) in objectives.items():
        one = decided(df, cell, arm, score, threshold, eligible, least).withColumn("objective", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def map_summary(decisions: DataFrame) -> DataFrame:
    """(objective, cells, contested, separable, ties, single, none, winners, separable_pct): a cell of two eligible arms or more is contested; separable_pct is of these, null without one."""
    v = F.col("verdict")
    by = decisions.groupBy("objective").agg(
        F.count("*").alias("cells"), F.count_if(F.col("n_eligible") > 1).alias("contested"), F.count_if(v == "separable").alias("separable"), F.count_if(v == "tie_within_threshold").alias("ties"),
        F.count_if(v == "single_eligible_arm").alias("single"), F.count_if(v == "no_eligible_arm").alias("none"), F.count_distinct(F.when(v == "separable", F.col("winner"))).alias("winners"),
    )
    return by.withColumn("separable_pct", F.try_divide(100.0 * F.col("separable"), F.col("contested")))


def side_by_side(decisions: DataFrame, cell: list[str], a: str, b: str) -> DataFrame:
    """Each cell's leaders under two objectives, and agreement: same, different, or undecided where one objective names no winner."""
    one = lambda n, s: decisions.where(F.col("objective") == n).select(*cell, F.col("leader").alias(f"leader_{s}"), F.col("winner").alias(f"winner_{s}"))
    both = ranks.same(one(a, "a"), one(b, "b"), cell)
    known = F.col("winner_a").isNotNull() & F.col("winner_b").isNotNull()
    return both.withColumn("agreement", F.when(~known, "undecided").when(F.col("winner_a") == F.col("winner_b"), "same").otherwise("different"))


def ladders(df: DataFrame, cell: list[str], config: str, x: str, y: str, unit: float, order: list[str], least: int = 3) -> DataFrame:
    """Rows that know y with the residual of their cell's rate-damage line, in units: positive is less damage than its bits foretell.

    One point for each bitstream: of the rows of one config in a cell only the first by `order` votes in the fit, and every row of the cell, all fills of
    a bitstream, is then scored against it (points, slope, r2, residual, influence). A fit needs `least` points that vary on both axes, and a line that
    falls; cells without one are left out. influence is the slope less what it is without the row's bitstream, from the sums less its point; null
    where the rest has fewer than two distinct x.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    first = known.groupBy(*cell, config).agg(F.min_by(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), F.struct(*order)).alias("_p"))
    px, py = F.col("_p.x"), F.col("_p.y")
    mean = first.groupBy(*cell).agg(F.count("*").alias("points"), F.avg(px).alias("_mx"), F.avg(py).alias("_my"))
    at = ranks.same(first, mean, cell).withColumn("_dx", px - F.col("_mx")).withColumn("_dy", py - F.col("_my"))
    fit = at.groupBy(*cell).agg(F.first("points").alias("points"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), *[F.sum(F.col(a) * F.col(b)).alias(n) for n, a, b in (("_xx", "_dx", "_dx"), ("_yy", "_dy", "_dy"), ("_xy", "_dx", "_dy"))])
    fit = fit.where((F.col("points") >= least) & (F.col("_xx") > 0) & (F.col("_yy") > 0) & (F.col("_xy") < 0)).withColumn("slope", F.col("_xy") / F.col("_xx")).withColumn("r2", F.col("_xy") * F.col("_xy") / (F.col("_xx") * F.col("_yy")))
    rows = ranks.same(ranks.same(known, fit, cell), at.select(*cell, config, "_dx", "_dy"), [*cell, config])
    residual = (F.col("slope") * (F.col(x) - F.col("_mx")) + F.col("_my") - F.col(y)) / unit
    # without one of n points, sums about the mean lose n / (n - 1) times its products
    lost = F.col("points") / (F.col("points") - 1)
    rest = F.col("_xx") - lost * F.col("_dx") * F.col("_dx")
    without = F.when(rest > 1e-12 * F.col("_xx"), (F.col("_xy") - lost * F.col("_dx") * F.col("_dy")) / rest)
    return rows.withColumn("residual", residual).withColumn("influence", F.col("slope") - without).drop("_mx", "_my", "_xx", "_yy", "_xy", "_dx", "_dy")


#: Points of a block that are compared with each other in one array.
BLOCK = 256


def _dominates(y, x, n: int):
    """y is as good as x (lower is better) on every axis that both have, and better on one."""
    as_good, better = F.lit(True), F.lit(False)
    for i in range(n):
        both, a, b = y[i].isNotNull() & x[i].isNotNull(), y[i], x[i]
        as_good, better = as_good & (~both | (a <= b)), better | (both & (a < b))
    return F.coalesce(as_good & better, F.lit(False))


def _survivors(points: DataFrame, cell: list[str], n: int) -> DataFrame:
    """(cell, _points): arrays of the points that none of their block dominates; a block holds up to BLOCK of one cell and pattern, dealt by their sums."""
    laid = ranks.numbered(points.withColumn("_sum", _sum(n)), [*cell, "_pattern"], ["_sum", "_p"], "_i").withColumn("_block", F.floor((F.col("_i") - 1) / BLOCK))
    one = laid.groupBy(*cell, "_pattern", "_block").agg(F.collect_list("_p").alias("_every"))
    return one.select(*cell, "_pattern", F.filter("_every", lambda x: ~F.exists("_every", lambda y: _dominates(y, x, n))).alias("_points"))


def _sum(n: int):
    return F.aggregate("_p", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def undominated(df: DataFrame, cell: list[str], arm: str, lower: list[str], higher: list[str]) -> DataFrame:
    """Rows of each cell that no other row equals on every axis that both know and beats on one of these.

    An axis that a row lacks says nothing about it: (1, 1, null) removes (2, 2, 5). So this relation is not transitive, and a removed row
    may still remove others. Among rows that lack the same axes it is: of these only the ones that none of their kind dominates need be
    compared with the rest. They are found block by block, the blocks dealt once by the sum of the axes and once more from what is left,
    and every row is then held against arrays of them; no pairs of rows are made. Rows without any axis stay.
    """
    n = len(lower) + len(higher)
    axes = F.array(*[F.col(c).cast("double") for c in lower], *[-F.col(c).cast("double") for c in higher])
    pattern = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in [*lower, *higher]])
    points = df.select(*cell, pattern.alias("_pattern"), axes.alias("_p")).distinct()
    first = _survivors(points, cell, n).select(*cell, "_pattern", F.explode("_points").alias("_p"))
    right = _survivors(first, cell, n).select(*[F.col(c).alias(f"_{c}") for c in cell], "_points")
    same = F.lit(True)
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    held = df.withColumn("_axes", axes)
    return held.join(right, same & F.exists("_points", lambda y: _dominates(y, F.col("_axes"), n)), "left_anti").drop("_axes")


def sensitivity(df: DataFrame, cell: list[str], arm: str, score: str, thresholds: list[float]) -> DataFrame:
    """Separable cells at each threshold: the thresholds are a fixed few, so each cell is decided once and read for all."""
    one = decide(df, cell, arm, score, 0.0)
    return one.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), "margin").groupBy("threshold").agg(F.count("*").alias("cells"), F.count_if(F.col("margin") >= F.col("threshold") - 1e-9).alias("separable"))


def threshold_classes(df: DataFrame, cell: list[str], arm: str, score: str, thresholds: list[float]) -> DataFrame:
    """class and held, the number of thresholds at which the winner is named, of each cell over thresholds: robust where its winner is named at every one of them, tight_only where it is named at the least
    and not at the largest, never where at none. A winner is named at a threshold that its lead reaches. The order of the scores does not depend on the threshold, so no
    cell names one winner at one threshold and another at the next.
    """
    held = lambda t: F.coalesce(F.col("margin") >= t - 1e-9, F.lit(False))
    t = sorted(thresholds)
    name = F.when(held(t[-1]), "robust").when(held(t[0]), "tight_only").otherwise("never")
    count = reduce(Column.__add__, [held(x).cast("long") for x in t])
    return decide(df, cell, arm, score, 0.0).where("margin IS NOT NULL").select(*cell, "winner", name.alias("class"), count.alias("held"))
