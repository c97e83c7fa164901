"""Predictors of an outcome over units (clips), each held against what could have made it: coverage, provenance, thin units.

Cells are (unit, verdict); a target's outcome of a unit is the share of its cells, among those of the target's denominator, whose verdict is
in the numerator. An attribute that fires must also hold on the units of enough cells, and be nearer to the outcome than to the number of
cells, which is history of what was run and no property of the unit; else it is withdrawn.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators import ranks, stats
from tarn.sources.store import written


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t: the regularised incomplete beta function by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h if flip else front * h


def rank_p(df: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """df with t and p of Spearman's rho by Student's distribution of n - 2 degrees: null under three rows or without rho, 0 for a rho of 1 or -1."""

    @F.pandas_udf("double")
    def p_of(r: pd.Series, k: pd.Series) -> pd.Series:
        def one(r, k):
            if r is None or pd.isna(r) or k < 3:
                return None
            return 0.0 if abs(r) >= 1 else student_p(r * math.sqrt((k - 2) / (1 - r * r)), k - 2)

        return pd.Series([one(*x) for x in zip(r, k)], dtype="float64")

    t = F.when(F.abs(rho) < 1, F.col(rho) * F.sqrt((F.col(n) - 2) / (1 - F.col(rho) * F.col(rho))))
    return df.withColumn("t", F.when(F.col(n) >= 3, t)).withColumn("p", p_of(rho, F.col(n).cast("long")))


def predictors(long: DataFrame, group: list[str], name: str, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """rho, t, p, p_holm and verdict of each named predictor of a group: SIGNIFICANT after Holm, `loser (dies under Holm)` where p alone would do, else loser."""
    r = rank_p(stats.spearman(long, [*group, name], x, y))
    known = stats.holm(r.where("p IS NOT NULL"), group or [], "p") if group else stats.holm(r.where("p IS NOT NULL").withColumn("_g", F.lit(1)), ["_g"], "p").drop("_g")
    verdict = F.when(F.col("p_holm") < alpha, "SIGNIFICANT").when(F.col("p") >= alpha, "loser").otherwise("loser (dies under Holm)")
    out = ranks.same(r, known.select(*group, name, "p_holm"), [*group, name], "left")
    return out.withColumn("verdict", F.when(F.col("p").isNotNull(), verdict))


def outcome_rates(cells: DataFrame, unit: str, verdict: str, targets: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(target, unit, rate, cells): targets name their numerator's and denominator's verdicts."""
    each = F.array(*[F.struct(F.lit(t).alias("target"), F.when(F.col(verdict).isin(den), F.col(verdict).isin(num)).alias("hit")) for t, (num, den) in targets.items()])
    hits = cells.where(F.col(unit).isNotNull()).select(unit, F.inline(each)).where("hit IS NOT NULL")
    return hits.groupBy("target", unit).agg(F.avg(F.col("hit").cast("double")).alias("rate"), F.count("*").alias("cells"))


def adjudicate(
    cells: DataFrame, unit: str, verdict: str, targets: dict[str, tuple[list[str], list[str]]], attributes: DataFrame, names: list[str], provenance: Column, drop: list[str],
    min_cells: int = 2, least_units: int = 6, effect: float = 0.5, alpha: float = 0.05, permutations: int = 200, share: float = 0.75, together: int = 3, seed: str = "p",
) -> tuple[DataFrame, DataFrame]:
    """The scan and its adjudication.

    Scan: (target, subset, attribute, n, rho, p, p_holm, status, alarm, together) for the subsets all, thick (units of min_cells cells or more) and
    dropped (without the units of drop). p is a permutation's, Holm's family is the number of names whatever can be tested. status: predictive (least_units
    units, |rho| of effect or more, p_holm under alpha), suggestive (the effect alone), descriptive (fewer units), else negative. alarm: |rho| over 0.9. together:
    that many attributes of a subset or more are predictive at once, which points at one confound and not at discoveries.

    Adjudication: (target, attribute, n, rho, p_holm, status, thick_n, thick_rho, thick_p_holm, coverage_rho, outcome_coverage_rho, provenance_rho, outcome_provenance_rho,
    outcome_provenance_p, holds, cleaner, verdict). verdict is status, but withdrawn for a predictive attribute that does not hold on the thick units (three or more,
    p_holm under alpha) or whose rank correlation with the number of cells is not under share times that with the outcome; an unknown one is not.
    attributes has a row for each unit; provenance is a condition on it. A unit without an attribute is left out of that attribute's tests alone.
    """
    # a row for each unit and target, and for each unit: written, since many tests below start from them
    rates = written(outcome_rates(cells, unit, verdict, targets))
    attributes = written(attributes.where(F.col(unit).isNotNull()).select(unit, provenance.cast("double").alias("_origin"), *names))
    known = attributes.select(unit, "_origin", F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("x")) for a in names])))
    both = rates.join(known.where("x IS NOT NULL"), unit)
    subsets = F.array_compact(F.array(F.lit("all"), F.when(F.col("cells") >= min_cells, F.lit("thick")), F.when(~F.col(unit).isin(drop), F.lit("dropped")) if drop else F.lit("dropped")))
    long = written(both.select("target", "attribute", unit, "x", F.col("rate").alias("y"), "cells", "_origin", F.explode(subsets).alias("subset")))
    group = ["target", "subset", "attribute"]
    counts = long.groupBy(*group).agg(F.count("*").alias("n"))
    tested = ranks.same(long, counts.where("n >= 3").drop("n"), group)
    found = stats.permutation(tested, group, unit, "x", "y", permutations, seed)
    scan = ranks.same(counts, found, group, "left").withColumn("p", F.when(F.col("rho").isNotNull(), F.col("p")))
    adjusted = stats.holm(scan.where("p IS NOT NULL").select(*group, "p"), ["target", "subset"], "p", len(names))
    scan = ranks.same(scan, adjusted.select(*group, "p_holm"), group, "left")
    strong = F.coalesce(F.abs("rho") >= effect, F.lit(False))
    status = F.when(F.col("n") < least_units, "descriptive").when(strong & F.coalesce(F.col("p_holm") < alpha, F.lit(False)), "predictive").when(strong, "suggestive").otherwise("negative")
    scan = scan.withColumn("status", status).withColumn("alarm", F.coalesce(F.abs("rho") > 0.9, F.lit(False)))
    fired = scan.groupBy("target", "subset").agg((F.count_if(F.col("status") == "predictive") >= together).alias("together"))
    scan = ranks.same(scan, fired, ["target", "subset"])

    all_ = long.where("subset = 'all'")
    coverage = stats.spearman(all_, ["target", "attribute"], "x", "cells", 2).select("target", "attribute", F.col("rho").alias("coverage_rho"))
    origin = stats.spearman(all_, ["target", "attribute"], "x", "_origin", 3).select("target", "attribute", F.col("rho").alias("provenance_rho"))
    units = rates.join(attributes.select(unit, "_origin"), unit)
    outcome = stats.spearman(units, ["target"], "rate", "cells", 2).select("target", F.col("rho").alias("outcome_coverage_rho"))
    by_origin = stats.permutation(units, ["target"], unit, "_origin", "rate", permutations, seed).select("target", F.col("rho").alias("outcome_provenance_rho"), F.when(F.col("rho").isNotNull(), F.col("p")).alias("outcome_provenance_p"))
    thick = scan.where("subset = 'thick'").select("target", "attribute", F.col("n").alias("thick_n"), F.col("rho").alias("thick_rho"), F.col("p_holm").alias("thick_p_holm"))
    out = scan.where("subset = 'all'").select("target", "attribute", "n", "rho", "p_holm", "status")
    for more, keys in ((thick, ["target", "attribute"]), (coverage, ["target", "attribute"]), (origin, ["target", "attribute"]), (outcome, ["target"]), (by_origin, ["target"])):
        out = out.join(more, keys, "left")
    holds = F.coalesce((F.col("thick_n") >= 3) & (F.col("thick_p_holm") < alpha), F.lit(False))
    cleaner = F.coalesce(F.abs("coverage_rho") < share * F.abs("rho"), F.lit(False))
    out = out.withColumn("holds", holds).withColumn("cleaner", cleaner)
    final = F.when((F.col("status") == "predictive") & ~(F.col("holds") & F.col("cleaner")), "withdrawn").otherwise(F.col("status"))
    return scan, out.withColumn("verdict", final)
