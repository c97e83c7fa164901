"""Studies over suites of paired deltas: verdicts with direction, padded families, subsets, links, goals, contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.scalar import pairs_needed, sign_test_floor, sign_test_p
from tarn.operators import ranks, stats


def assess(pairs: DataFrame, group: list[str], delta: str, threshold: str, lower_is_better: str, family: int = 1, alpha: float = 0.05) -> DataFrame:
    """One row for each suite: counts, mean, median, exact p, its corrected value, direction, clears and one of seven verdicts.

    threshold and lower_is_better are columns that are the same in all rows of a suite. In this order: fewer than two
    pairs are insufficient_pairs; a direction that is not unanimous (or no pair with one) is no_consistent_direction;
    where no p can reach alpha, underpowered; p over alpha, consistent_not_significant; a mean, and half of the
    pairs at least, that reach the threshold are perceptual_win or perceptual_loss by direction; the rest is
    sub_jnd_significant. Null deltas are no pairs.
    """
    d = F.col(delta)
    by = pairs.where(d.isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"), F.count_if(d > 0).alias("n_pos"), F.count_if(d < 0).alias("n_neg"), F.avg(d).alias("mean"), F.median(d).alias("median"),
        F.count_if(F.abs(d) >= F.col(threshold)).alias("clearing"), F.max(threshold).alias("_t"), F.bool_or(lower_is_better).alias("_low"),
    )
    informative = F.col("n_pos") + F.col("n_neg")
    by = by.withColumn("p", sign_test_p(F.col("n_pos"), F.col("n_neg"))).withColumn("p_corrected", F.least(F.lit(1.0), F.col("p") * family))
    unanimous = (informative > 0) & ((F.col("n_pos") == 0) | (F.col("n_neg") == 0))
    better = F.when(F.col("_low"), F.col("n_neg") == informative).otherwise(F.col("n_pos") == informative)
    clears = (F.abs("mean") >= F.col("_t")) & (2 * F.col("clearing") >= F.col("n"))
    verdict = (
        F.when(F.col("n") < 2, "insufficient_pairs").when(~unanimous, "no_consistent_direction")
        .when(F.least(F.lit(1.0), sign_test_floor(informative) * family) > alpha + 1e-12, "underpowered")
        .when(F.col("p_corrected") > alpha + 1e-12, "consistent_not_significant")
        .when(clears & better, "perceptual_win").when(clears, "perceptual_loss").otherwise("sub_jnd_significant")
    )
    return by.withColumn("direction", F.when(unanimous & better, "better").when(unanimous, "worse")).withColumn("clears", clears).withColumn("verdict", verdict).drop("_t", "_low")


#: The one wording that each verdict may have.
WORDING = {
    "perceptual_win": "consistent across the suite, statistically significant, and above the perceptual threshold -- may be worded as an improvement",
    "perceptual_loss": "consistent across the suite, statistically significant, and above the perceptual threshold, but in the WORSE direction -- this is a perceptible degradation; word it as a cost or a regression, never as a win, and never report the arm as preferable on this metric",
    "sub_jnd_significant": "consistent and statistically significant across the suite but BELOW the perceptual threshold -- report as a small, reproducible, imperceptible effect; never as a perceptual win, a quality improvement, or a 'better' result",
    "consistent_not_significant": "direction is consistent but does not reach significance -- not evidence; report as an observation with n stated, or add pairs",
    "underpowered": "direction is consistent but n is too small for ANY two-tailed test to reach alpha -- this is an unfinished experiment, not a negative result; add pairs before drawing either conclusion",
    "no_consistent_direction": "direction is not consistent across the suite -- no claim",
    "insufficient_pairs": "fewer than 2 usable pairs -- fall back to the JND verdict",
}


def suite_verdicts(
    pairs: DataFrame, group: list[str], key: str, delta: str, threshold: str, lower_is_better: str, primary: Column, family: int = 1, alpha: float = 0.05, resamples: int = 200, exact: int = 20,
) -> DataFrame:
    """assess() whole: one row for each suite with everything that may be said of it.

    Beside its columns: n_zero, dz, ci_low, ci_high, ci_excludes_zero (a seeded bootstrap of the mean), wilcoxon_p (exact up to `exact` pairs that are not zero, else
    null), floor (the least p that the informative pairs can reach), jnd_ratio, clearing, consistent, underpowered, significant, is_primary (primary is a condition on the
    group's columns), wording and warnings. A suite of fewer than two pairs has counts and a verdict alone. Without a threshold nothing clears it; without a sense of
    better there is no direction. Warnings: zero pairs, which no test uses; pairs needed where none can be significant; an interval that holds 0 beside a significant
    test; a win or loss on a metric that is not the primary one, which carries no claim.
    """
    d, one = F.col(delta), pairs.where(F.col(delta).isNotNull())
    cut = F.col(threshold)
    by = one.groupBy(*group).agg(
        F.count("*").alias("n"), F.count_if(d > 0).alias("n_pos"), F.count_if(d < 0).alias("n_neg"), F.count_if(d == 0).alias("n_zero"), F.avg(d).alias("mean"),
        F.count_if(F.coalesce(F.abs(d) >= cut, F.lit(False))).alias("clearing"), F.max(cut).alias("_t"), F.bool_or(lower_is_better).alias("_low"),
    )
    mid = ranks.medians(one, group, {"median": delta})
    size = stats.effect_size(one, group, delta).select(*group, "dz")
    ends = stats.bootstrap(one, group, key, delta, resamples).select(*group, F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"))
    signed = stats.wilcoxon(one, group, delta, exact).select(*group, F.col("p_exact").alias("wilcoxon_p"))
    for more in (mid, size, ends, signed):
        by = ranks.same(by, more, group, "left")
    informative = F.col("n_pos") + F.col("n_neg")
    enough = F.col("n") >= 2
    by = by.withColumn("sign_p", sign_test_p(F.col("n_pos"), F.col("n_neg"))).withColumn("floor", sign_test_floor(informative)).withColumn("p_corrected", F.least(F.lit(1.0), F.col("sign_p") * family))
    unanimous = (informative > 0) & ((F.col("n_pos") == 0) | (F.col("n_neg") == 0))
    improved = F.when(F.col("_low"), F.col("n_neg") == informative).when(~F.col("_low"), F.col("n_pos") == informative)
    by = by.withColumn("consistent", unanimous).withColumn("direction", F.when(unanimous & improved, "better").when(unanimous & ~improved, "worse"))
    by = by.withColumn("jnd_ratio", F.try_divide(F.abs("mean"), F.col("_t"))).withColumn("clears", F.coalesce((F.abs("mean") >= F.col("_t")) & (2 * F.col("clearing") >= F.col("n")), F.lit(False)))
    least = F.least(F.lit(1.0), F.col("floor") * family)
    by = by.withColumn("underpowered", least > alpha + 1e-12).withColumn("significant", F.col("p_corrected") <= alpha + 1e-12).withColumn("ci_excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))
    verdict = (
        F.when(~enough, "insufficient_pairs").when(~F.col("consistent"), "no_consistent_direction").when(F.col("underpowered"), "underpowered").when(~F.col("significant"), "consistent_not_significant")
        .when(F.col("clears") & (F.coalesce("direction", F.lit("")) == "worse"), "perceptual_loss").when(F.col("clears"), "perceptual_win").otherwise("sub_jnd_significant")
    )
    by = by.withColumn("verdict", verdict).withColumn("is_primary", F.coalesce(primary, F.lit(False)))
    wording = F.element_at(F.create_map(*[F.lit(x) for p in WORDING.items() for x in p]), F.col("verdict"))
    needed = pairs_needed(alpha, family)
    warnings = F.when(enough, F.array_compact(F.array(
        F.when(F.col("n_zero") > 0, F.concat(F.col("n_zero").cast("string"), F.lit(" pair(s) of exactly 0 are in no test: two arms of identical output?"))),
        F.when(F.col("verdict") == "underpowered", F.concat(informative.cast("string"), F.lit(f" informative pair(s) in a family of {family} cannot be significant; {needed} are needed"))),
        F.when((F.col("verdict") == "sub_jnd_significant") & ~F.col("ci_excludes_zero"), F.lit("the interval of the mean holds 0: state the interval, not the mean alone")),
        F.when(F.col("verdict").isin("perceptual_win", "perceptual_loss") & ~F.col("is_primary"), F.lit("not the primary metric of its region: it corroborates and carries no claim")),
    ))).otherwise(F.array().cast("array<string>"))
    by = by.withColumn("wording", wording).withColumn("warnings", warnings)
    only = ("mean", "median", "dz", "ci_low", "ci_high", "ci_excludes_zero", "sign_p", "wilcoxon_p", "floor", "p_corrected", "jnd_ratio", "clearing", "clears", "consistent", "direction", "underpowered", "significant")
    return by.select(*group, "n", "n_pos", "n_neg", "n_zero", *[F.when(enough, F.col(c)).alias(c) for c in only], "is_primary", "verdict", "wording", "warnings")


def collect_pairs(runs: DataFrame, pair_by: list[str], arm: str, a: str, b: str, metrics: list[str], key: str, failures: str, shown: int = 3) -> tuple[DataFrame, DataFrame]:
    """(metric, pair_by, key_a, key_b, value_a, value_b, delta) of the pairs of two arms, and what was left out: (reason, metric, n, examples).

    A run with failures is left out (failed); one that was never checked, whose failures are null, stays and is named (unchecked). A run that lacks a pair key is left out
    (no_pair_key). Of several runs of an arm at one key the first by `key` stays and the others are named (ambiguous): the pair keys do not tell runs apart. Keys with one
    arm are counted (unpaired); a pair without a metric on one side counts for that metric (no_metric). Each run or pair is named once for a reason, whatever the number of
    metrics; examples are the `shown` smallest keys.
    """
    ours = runs.where(F.col(arm).isin(a, b))
    whole = F.lit(True)
    for k in pair_by:
        whole = whole & F.col(k).isNotNull()
    failed = F.coalesce(F.size(failures) > 0, F.lit(False))
    marked = ours.withColumn("_why", F.when(failed, "failed").when(~whole, "no_pair_key"))
    good = marked.where("_why IS NULL")
    side = F.struct(F.col(key).alias("key"), *[F.col(m).cast("double").alias(m) for m in metrics])
    first = lambda x: F.min_by(F.when(F.col(arm) == x, side), F.when(F.col(arm) == x, F.col(key)))
    by = good.groupBy(*pair_by).agg(first(a).alias("_a"), first(b).alias("_b"))
    full = by.where("_a IS NOT NULL AND _b IS NOT NULL")
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_a.{m}").alias("value_a"), F.col(f"_b.{m}").alias("value_b")) for m in metrics]))
    long = full.select(*pair_by, F.col("_a.key").alias("key_a"), F.col("_b.key").alias("key_b"), each)
    pairs = long.where("value_a IS NOT NULL AND value_b IS NOT NULL").select("metric", *pair_by, "key_a", "key_b", "value_a", "value_b", (F.col("value_b") - F.col("value_a")).alias("delta"))
    # of each arm at a key all but the first are ambiguous: a run is one of them if its key is not that of the side
    extra = ranks.same(good.select(*pair_by, arm, key), by.select(*pair_by, F.col("_a.key").alias("_ka"), F.col("_b.key").alias("_kb")), pair_by)
    extra = extra.where(F.col(key) != F.when(F.col(arm) == a, F.col("_ka")).otherwise(F.col("_kb")))
    none = F.lit(None).cast("string")
    name = lambda df, reason, what, metric=none: df.select(reason.alias("reason"), metric.alias("metric"), what.cast("string").alias("_x"))
    pair = F.concat_ws("|", *[F.col(k).cast("string") for k in pair_by])
    skips = name(marked.where("_why IS NOT NULL"), F.col("_why"), F.col(key))
    skips = skips.unionByName(name(good.where(F.col(failures).isNull()), F.lit("unchecked"), F.col(key)))
    skips = skips.unionByName(name(extra, F.lit("ambiguous"), F.col(key)))
    skips = skips.unionByName(name(by.where("_a IS NULL OR _b IS NULL"), F.lit("unpaired"), pair))
    skips = skips.unionByName(name(long.where("value_a IS NULL OR value_b IS NULL"), F.lit("no_metric"), pair, F.col("metric")))
    # the smallest of each hash part first, so no task holds more than a few names
    part = skips.groupBy("reason", "metric", F.pmod(F.xxhash64("_x"), F.lit(64)).alias("_p")).agg(F.count("*").alias("n"), F.min("_x").alias("_x"))
    few = part.groupBy("reason", "metric").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_list("_x")), 1, shown).alias("examples"))
    return pairs, few


def goal_rows(gains: DataFrame, label: str, unit: str, gain: str, jnd: float, anchors: list[tuple[str, str, float, str]], alpha: float = 0.05) -> DataFrame:
    """(method, kind, value, n, favouring, p, p_holm, verdict): a goal's methods between its null and oracle rows.

    Every unit counts once, with the upper median of its gains (positive is good); value is the upper median over units. p is a sign test of the favouring units against
    all others, p_holm over all methods. Verdicts, in order: insufficient (fewer than two units); not_significant (units on both sides, p_holm over alpha); underpowered (no p can
    reach alpha at n); not_significant; perceptual_win where |value| reaches jnd; else sub_jnd_significant. anchors are (method, kind, value, verdict), kind null or oracle:
    given, never tested.
    """
    one = ranks.quantiles(gains, [label, unit], gain, {"_g": 0.5}, upper=True).select(label, unit, "_g")
    by = one.groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col("_g") > 0).alias("favouring"))
    by = ranks.same(by, ranks.quantiles(one, [label], "_g", {"value": 0.5}, upper=True).select(label, "value"), [label])
    by = by.withColumn("p", sign_test_p(F.col("favouring"), F.col("n") - F.col("favouring"))).withColumn("_all", F.lit(1))
    h = stats.holm(by.select("_all", "p", label, "n", "favouring", "value"), ["_all"]).drop("_all")
    split = (F.col("favouring") > 0) & (F.col("favouring") < F.col("n"))
    verdict = (
        F.when(F.col("n") < 2, "insufficient").when(split & (F.col("p_holm") > alpha), "not_significant").when(sign_test_floor(F.col("n")) > alpha, "underpowered")
        .when(F.col("p_holm") > alpha, "not_significant").when(F.abs("value") >= jnd - 1e-9, "perceptual_win").otherwise("sub_jnd_significant")
    )
    rows = h.select(F.col(label).alias("method"), F.lit("method").alias("kind"), "value", "n", "favouring", "p", "p_holm", verdict.alias("verdict"))
    if not anchors:
        return rows
    given = gains.sparkSession.createDataFrame(anchors, "method string, kind string, value double, verdict string")
    return rows.unionByName(given, allowMissingColumns=True)


def per_unit(cells: DataFrame, group: list[str], unit: str, delta: str) -> DataFrame:
    """One delta for each unit of a group: the mean over its cells."""
    return cells.groupBy(*group, unit).agg(F.round(F.avg(delta), 6).alias(delta))


def significance(units: DataFrame, family: list[str], candidate: str, delta: str, size: int, floor: int = 6, alpha: float = 0.05) -> DataFrame:
    """A sign test for each candidate over its units' deltas (positive: the baseline won), Holm over a family padded to `size`.

    Candidates under `floor` units are underpowered whatever their p.
    """
    s = stats.signs(units, [*family, candidate], delta).withColumn("n", F.col("n_pos") + F.col("n_neg") + F.col("n_zero"))
    h = stats.holm(s.select(*family, "p", candidate, "n", "n_pos", "n_neg"), family, "p", size)
    verdict = F.when(F.col("n") < floor, f"underpowered (n<{floor})").when(F.col("p_holm") < alpha, "SIGNIFICANT").otherwise("n.s.")
    return h.withColumn("verdict", verdict)


def links(cells: DataFrame, group: list[str], unit: str, delta: str, threshold: float) -> DataFrame:
    """Each link's units: their mean deltas' upper median, how many favour (negative) and how many are perceptible."""
    units = per_unit(cells, group, unit, delta)
    d = F.col(delta)
    by = units.groupBy(*group).agg(
        F.count("*").alias("units"), F.count_if(d < 0).alias("favouring"), F.count_if(d > 0).alias("against"), F.count_if(F.abs(d) >= threshold).alias("perceptible"), F.avg(d).alias("mean"),
    )
    by = ranks.same(by, ranks.quantiles(units, group, delta, {"upper_median": 0.5}, upper=True).drop("n"), group)  # the middle value, the upper one of two
    return by.withColumn("p", sign_test_p(F.col("against"), F.col("favouring")))


def scorecard(units: DataFrame, goal: list[str], gain: str, alpha: float = 0.05) -> DataFrame:
    """A verdict for each goal from its units' gains (positive is good): met, missed, or open where no test can tell."""
    s = stats.signs(units, goal, gain).join(units.groupBy(*goal).agg(F.avg(gain).alias("mean"), F.min(gain).alias("worst"), F.max(gain).alias("best")), goal)
    verdict = F.when(F.col("floor") > alpha, "open").when((F.col("p") <= alpha) & (F.col("n_pos") > F.col("n_neg")), "met").when(F.col("p") <= alpha, "missed").otherwise("not shown")
    return s.withColumn("verdict", verdict)


def best_per_cell(df: DataFrame, cell: list[str], arm: str, score: str, guard: float) -> DataFrame:
    """The arm of the lowest score in each cell, the spread of all, and whether the spread passes the guard."""
    by = df.where(F.col(score).isNotNull()).groupBy(*cell).agg(F.min_by(arm, F.struct(F.col(score), F.col(arm))).alias("best"), F.count("*").alias("n"), (F.max(score) - F.min(score)).alias("spread"))
    return by.withColumn("tells", F.col("spread") >= guard)


def contrasts(df: DataFrame, pair_by: list[str], arm: str, pairs: list[tuple[str, str]], value: str, order: list[str] | None = None) -> DataFrame:
    """delta = right - left at each pair key, for each named contrast of two arms: both sides from one pass.

    Of repeated runs of an arm at a key the first by `order` counts (by its value where there is none); null arms and null values take no part.
    """
    named = sorted({x for p in pairs for x in p})
    keys = F.struct(*(order or [value]))
    known = df.where(F.col(arm).isin(named) & F.col(value).isNotNull())
    one = known.groupBy(*pair_by).agg(*[F.min_by(F.when(F.col(arm) == a, F.col(value)), F.when(F.col(arm) == a, keys)).alias(f"_v{i}") for i, a in enumerate(named)])
    side = lambda a: F.col(f"_v{named.index(a)}")
    asked = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (side(b) - side(a)).alias("delta")) for a, b in pairs])
    return one.select(*pair_by, F.inline(asked)).where("delta IS NOT NULL")


def sign_flips(df: DataFrame, rung: list[str], delta: str) -> DataFrame:
    """Each rung's counts by sign, and whether its majority differs from the rung's before it."""
    w = Window.orderBy(*rung)
    by = df.groupBy(*rung).agg(F.count_if(F.col(delta) > 0).alias("n_pos"), F.count_if(F.col(delta) < 0).alias("n_neg"))
    side = F.signum(F.col("n_pos") - F.col("n_neg"))
    # a row for each rung: few, whatever the input
    return by.withColumn("side", side.cast("int")).withColumn("flipped", F.coalesce(F.col("side") * F.lag("side").over(w) < 0, F.lit(False)))


def outcomes_by_attribute(units: DataFrame, attributes: list[str], unit: str, outcome: str) -> DataFrame:
    """(attribute, unit, x, y): attributes of each unit in long form beside its outcome; a null attribute is left out alone."""
    return units.select(F.col(unit), F.col(outcome).alias("y"), F.explode(F.map_from_arrays(F.array(*map(F.lit, attributes)), F.array(*[F.col(a).cast("double") for a in attributes]))).alias("attribute", "x")).where("x IS NOT NULL AND y IS NOT NULL")


def predictors(long: DataFrame, group: list[str], least: int = 5) -> DataFrame:
    """rho of each predictor with its t value (for the library's p), ranked by size inside its group."""
    r = stats.spearman(long, group, "x", "y", least)
    return r.withColumn("t", F.when(F.abs("rho") < 1 - 1e-12, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))))


def degenerate(df: DataFrame, unit: str, values: list[str], least: float = 0.05) -> DataFrame:
    """(unit, predictor, cv, degenerate): predictors that hardly vary inside a unit cannot rank anything there."""
    long = df.select(unit, F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.col(v).cast("double") for v in values]))).alias("predictor", "v"))
    by = long.groupBy(unit, "predictor").agg(F.try_divide(F.stddev_pop("v"), F.abs(F.avg("v"))).alias("cv"))
    return by.withColumn("degenerate", F.coalesce(F.col("cv") < least, F.lit(True)))
