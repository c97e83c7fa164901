"""Summaries of decided cells, arms, videos and parameters: winners, shares, medians, spreads, verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import scalar
from tarn.operators import grid, ranks


def group_verdict(df: DataFrame, group: list[str], arm: str, bits: str, ok: str, base_bits: str, margin: str) -> DataFrame:
    """Of each group: whether every comparison holds, the arm of fewest bits, its saving in percent, and the worst margin's arm."""
    best = F.min_by(F.struct(arm, bits, base_bits), F.struct(bits, arm))
    by = df.dropna(subset=group).groupBy(*group).agg(F.bool_and(ok).alias("all_ok"), best.alias("_b"), F.max_by(arm, F.struct(margin, arm)).alias("worst"))
    return by.select(*group, "all_ok", F.col(f"_b.{arm}").alias("winner"), (100 * F.try_divide(F.col(f"_b.{base_bits}") - F.col(f"_b.{bits}"), F.col(f"_b.{base_bits}"))).alias("saving_pct"), "worst")


def winner_counts(decided: DataFrame, winner: str = "winner") -> DataFrame:
    """Cells that each arm wins, and of these the separable, tied and single-arm ones."""
    return decided.groupBy(winner).agg(F.count("*").alias("cells"), F.count_if("separable").alias("separable"), F.count_if(~F.col("separable") & (F.col("n_arms") > 1)).alias("ties"), F.count_if(F.col("n_arms") == 1).alias("single"))


def medians(df: DataFrame, arm: str, values: list[str], least: int = 8) -> DataFrame:
    """Median of each value for the arms seen at least `least` times."""
    often = df.groupBy(arm).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return ranks.same(often, ranks.medians(df, [arm], {v: v for v in values}), [arm], "left")


def matched_medians(df: DataFrame, cell: list[str], arm: str, values: list[str]) -> DataFrame:
    """Medians over the cells that every arm has."""
    need = df.agg(F.count_distinct(arm).alias("_need"))
    full = df.groupBy(*cell).agg(F.count_distinct(arm).alias("_have")).join(F.broadcast(need), F.col("_have") == F.col("_need")).select(*cell)  # need is one row
    matched = df.join(full, cell, "left_semi")
    return ranks.same(matched.groupBy(arm).agg(F.count_distinct(*cell).alias("cells")), ranks.medians(matched, [arm], {v: v for v in values}), [arm], "left")


def front_share(df: DataFrame, front: DataFrame, arm: str, least: int = 4) -> DataFrame:
    """Share of an arm's cells in which it is on the front."""
    seen = df.groupBy(arm).agg(F.count("*").alias("seen")).where(F.col("seen") >= least)
    return seen.join(front.groupBy(arm).agg(F.count("*").alias("on_front")), arm, "left").na.fill(0, ["on_front"]).withColumn("share", F.col("on_front") / F.col("seen"))


def cross_tab(df: DataFrame, by: str, a: Column, b: Column) -> DataFrame:
    """Counts of the four outcomes of two goals; a null goal counts as missed."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return df.groupBy(by).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"))


def degeneracy(df: DataFrame, group: list[str], outcome: str, limit: float = 0.9) -> DataFrame:
    """Share of the commonest outcome of each group; degenerate from limit on."""
    by = df.groupBy(*group, outcome).agg(F.count("*").alias("_n")).groupBy(*group).agg((F.max("_n") / F.sum("_n")).alias("share"))
    return by.withColumn("degenerate", F.col("share") >= limit)


def spread_inflation(df: DataFrame, group: list[str], unit: str, value: str) -> DataFrame:
    """Pooled deviation over the mean deviation within units."""
    within = df.groupBy(*group, unit).agg(F.stddev_pop(value).alias("_s"), F.sum(value).alias("_t"), F.sum(F.col(value) * F.col(value)).alias("_q"), F.count(value).alias("_n"))
    by = within.groupBy(*group).agg(F.avg("_s").alias("within"), F.sum("_t").alias("_t"), F.sum("_q").alias("_q"), F.sum("_n").alias("_n"))
    pooled = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - F.pow(F.col("_t") / F.col("_n"), F.lit(2.0)), F.lit(0.0)))
    return by.select(*group, "within", pooled.alias("pooled"), F.try_divide(pooled, F.nullif(F.col("within"), F.lit(0.0))).alias("inflation"))


def sweep_summary(df: DataFrame, group: list[str], setting: str, value: str, video: str) -> DataFrame:
    """Of each swept group: spread of the setting means' values, and how often the commonest best setting is the best."""
    best = df.groupBy(*group, video).agg(F.min_by(setting, F.struct(value, setting)).alias("_best"), (F.max(value) - F.min(value)).alias("_spread"))
    counts = best.groupBy(*group, "_best").agg(F.count("*").alias("_n"), F.sum("_spread").alias("_s"))
    return counts.groupBy(*group).agg(F.sum("_n").alias("videos"), (F.sum("_s") / F.sum("_n")).alias("mean_spread"), F.min_by("_best", F.struct(-F.col("_n"), F.col("_best"))).alias("best"), (F.max("_n") / F.sum("_n")).alias("share"))


def hexagons(df: DataFrame, x: str, y: str, value: str, size: float) -> DataFrame:
    """Mean of value in hexagonal bins (q, r) of a given size, by cube rounding of axial coordinates."""
    q, r = (math.sqrt(3) / 3 * F.col(x) - F.col(y) / 3) / size, (2 / 3 * F.col(y)) / size
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return df.groupBy(fq.cast("long").alias("q"), fr.cast("long").alias("r")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def boxes(df: DataFrame, keys: list[str], flag: Column, pad: int, height: int, width: int) -> DataFrame:
    """Tight box of the flagged places, padded, clamped, and widened to even ends where there is room; null without any."""
    by = df.where(flag).groupBy(*keys).agg(*[f(c).alias(f"_{n}") for c, n, f in (("by", "y0", F.min), ("by", "y1", F.max), ("bx", "x0", F.min), ("bx", "x1", F.max))])
    lo = lambda c: (F.greatest(F.col(c) - pad, F.lit(0)) / 2).cast("int") * 2
    hi = lambda c, n: F.least(((F.least(F.col(c) + 1 + pad, F.lit(n)) + 1) / 2).cast("int") * 2, F.lit(n))
    y0, y1, x0, x1 = lo("_y0"), hi("_y1", height), lo("_x0"), hi("_x1", width)
    return by.select(*keys, y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1"), ((y1 - y0) * (x1 - x0) / (height * width)).alias("share"))


def concordance(df: DataFrame, group: list[str], a: Column, b: Column) -> DataFrame:
    """Rows in which two outcomes agree."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(a == b).alias("agree"))


def pair_verdict(df: DataFrame, pair: list[str], metric: str, delta: str, jnd: str, perceptual: list[str]) -> DataFrame:
    """Four outcomes of a pair over its gating metrics (rows; a null delta is not available), and the binding metric."""
    ok = F.col(delta).isNotNull()
    margin = F.abs(delta) / F.col(jnd)
    outside = ok & (F.abs(delta) >= F.col(jnd))
    by = df.groupBy(*pair).agg(
        F.count_if(ok).alias("available"), F.count_if(outside).alias("outside"), F.count_if(ok & F.col(metric).isin(perceptual)).alias("_p"),
        F.max_by(F.when(outside, F.col(metric)), F.when(outside, F.struct(margin, F.col(metric)))).alias("binding"),
    )
    name = F.when(F.col("available") == 0, "insufficient_data").when(F.col("outside") > 0, "distinguishable").when(F.col("_p") > 0, "indistinguishable").otherwise("indistinguishable_psnr_only")
    return by.withColumn("verdict", name).drop("_p")


def regime_contrast(df: DataFrame, unit: str, order: str, value: str, ends: int = 2) -> DataFrame:
    """Median of the first rungs less that of the last, rungs in the order of the baseline's coordinate."""
    w = Window.partitionBy(unit)
    r = df.withColumn("_a", F.row_number().over(w.orderBy(order, value))).withColumn("_n", F.count("*").over(w))
    first, last = F.median(F.when(F.col("_a") <= ends, F.col(value))), F.median(F.when(F.col("_a") > F.col("_n") - ends, F.col(value)))
    return r.where(F.col("_n") >= 2 * ends).groupBy(unit).agg((first - last).alias("contrast"))


def capture(df: DataFrame, group: list[str], score: str, gain: str, place: list[str], share: float) -> DataFrame:
    """ratio and random of grid.oracle_capture() with as many blocks as the share reaches: k is rounded up, and random takes k of the mean."""
    c = grid.oracle_capture(df, group, score, gain, place, share, up=True)
    return c.select(*group, F.col("capture").alias("ratio"), F.col("by_chance").alias("random"))


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order that ends in a unique column."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def resolved(df: DataFrame, region: str, metric: str, table: list[tuple[str, str, str, bool]], banned: list[str]) -> DataFrame:
    """value and gates of each row: the column that table (region, metric, column, gates) names for its region.

    A column that is banned is an error at once; a region that the table does not have gives null.
    """
    wrong = sorted({c for _, _, c, _ in table} & set(banned))
    if wrong:
        raise ValueError(f"banned metrics: {', '.join(wrong)}")
    value, gates = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    for r, m, c, g in table:
        if m == metric:
            value, gates = F.when(F.col(region) == r, F.col(c)).otherwise(value), F.when(F.col(region) == r, F.lit(g)).otherwise(gates)
    return df.withColumn("value", value).withColumn("gates", gates)


def compared(df: DataFrame, a: str, b: str, threshold: float, lower_is_better: bool) -> DataFrame:
    """delta = b - a, within (under the threshold), margin (in thresholds) and better (a, b or tie)."""
    delta = F.col(b) - F.col(a)
    won = delta < 0 if lower_is_better else delta > 0
    return df.withColumn("delta", delta).withColumn("within", F.abs(delta) < threshold).withColumn("margin", F.abs(delta) / threshold).withColumn("better", F.when(F.abs(delta) < threshold, "tie").when(won, "b").otherwise("a"))


def members(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """Rows whose every named column holds one of its values."""
    for c, values in allowed.items():
        df = df.where(F.col(c).isin(*values))
    return df


def parameter_group(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """Rows whose parameter's name is of a group."""
    return df.where(F.col(name).startswith(f"{prefix}_"))


def by_dotted(df: DataFrame, doc: str, keys: dict[str, str]):
    """Rows of documents grouped by dotted keys; a row that lacks one is in no group."""
    named = df.select("*", *[F.try_variant_get(doc, f"$.{path}", "string").alias(n) for n, path in keys.items()])
    return named.dropna(subset=list(keys)).groupBy(*keys)


def spread_by(df: DataFrame, group: list[str], values: dict[str, str]) -> DataFrame:
    """Mean and population deviation of each value, of finite numbers alone."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    return df.groupBy(*group).agg(*[f(finite(c)).alias(f"{n}_{w}") for n, c in values.items() for w, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def single_key_sweeps(df: DataFrame, config: str, group: list[str] | None = None, fixed: list[str] | None = None) -> DataFrame:
    """(group, key, rest, settings, runs): for every key of a group's config maps, runs that agree in all other keys and differ in it.

    A run that lacks a key which others of its group have counts with the setting null. The keys in `fixed` say which arm a run is: they are part of
    rest and are never swept. rest is JSON text, so values that hold separators stay apart.
    """
    group = group or []
    keys = df.groupBy(*group).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys(config))))).alias("_keys"))
    one = ranks.same(df, keys, group).select(*group, F.array_sort(F.map_entries(config)).alias("_e"), F.explode(F.filter("_keys", lambda k: ~k.isin(fixed or []))).alias("key"))
    rest = scalar.canonical(F.filter("_e", lambda e: e["key"] != F.col("key")))
    value = scalar.quoted(F.get(F.filter("_e", lambda e: e["key"] == F.col("key")), F.lit(0))["value"])
    named = one.select(*group, "key", rest.alias("rest"), F.coalesce(value, F.lit("null")).alias("_v"))
    return named.groupBy(*group, "key", "rest").agg(F.count_distinct("_v").alias("settings"), F.count("*").alias("runs")).where("settings > 1")


def fixed_bins(df: DataFrame, group: list[str], value: Column, width: float) -> DataFrame:
    """Counts by bins of one width from zero on, both ways; null values are in none."""
    return df.select(*group, F.floor(value / width).alias("bin")).where("bin IS NOT NULL").groupBy(*group, "bin").agg(F.count("*").alias("n"))


def normalised(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """df with unit (min-max, 0 to 1) and z of value in its group; both are 0 where it does not vary, and null for a null value. Two passes, no window: a row for each group is joined back."""
    s = df.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    both, v = ranks.same(df, s, group), F.col(value)
    part = lambda top, bottom: F.when(v.isNotNull(), F.coalesce(F.try_divide(top, F.nullif(bottom, F.lit(0.0))), F.lit(0.0)))
    return both.withColumn("unit", part(v - F.col("_lo"), F.col("_hi") - F.col("_lo"))).withColumn("z", F.when(F.col("_hi") == F.col("_lo"), v * 0.0).otherwise(part(v - F.col("_m"), F.col("_s")))).drop("_lo", "_hi", "_m", "_s")
